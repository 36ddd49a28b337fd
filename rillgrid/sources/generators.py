"""Synthetic puzzles from numbered rows: each row's draw follows from the seed and its number alone."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.functions.answers import longest_common_prefix
from rillgrid.operators.batch import first_rows, number_rows


def _tree(rng: random.Random, operands: int, low: int, high: int) -> tuple[str, int | None, list[int], list[str]]:
    """A random expression: its text, value (None if a division leaves a rest), numbers and subexpressions."""
    if operands == 1:
        n = rng.randint(low, high)
        return str(n), n, [n], []
    left = rng.randint(1, operands - 1)
    a, x, m, h = _tree(rng, left, low, high)
    b, y, n, g = _tree(rng, operands - left, low, high)
    op = rng.choice("+-*/")
    text = f"({a} {op} {b})"
    if x is None or y is None:
        v = None
    elif op == "/":
        v = x // y if y and x % y == 0 else None
    else:
        v = {"+": x + y, "-": x - y, "*": x * y}[op]
    return text, v, m + n, [*h, *g, text]


def countdown(spark: SparkSession, rows: int, operands: int, seed: int = 42, numbers: tuple[int, int] = (1, 50), targets: tuple[int, int] = (10, 90)) -> DataFrame:
    """index, target, numbers, hints: distinct numbers, a target in range that is none of them, exact divisions only."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                rng = random.Random(f"{seed}:{operands}:{i}")
                while True:
                    _, v, ns, hints = _tree(rng, operands, *numbers)
                    if v is not None and targets[0] <= v <= targets[1] and len({*ns, v}) == operands + 1:
                        break
                rng.shuffle(ns)
                out.append((i, v, ns, hints))
            yield pd.DataFrame(out, columns=["index", "target", "numbers", "hints"])

    return spark.range(rows).mapInPandas(drawn, "index long, target long, numbers array<long>, hints array<string>")


def operands(spark: SparkSession, target: int, operator: str, low: int, high: int) -> DataFrame:
    """a, b: all pairs in [low, high] with a operator b = target, quotients without a rest."""
    a, b = F.col("a"), F.col("b")
    made = {
        "+": spark.range(low, high + 1).select(F.col("id").alias("a"), (target - F.col("id")).alias("b")),
        "-": spark.range(low, high + 1).select(F.col("id").alias("a"), (F.col("id") - target).alias("b")),
        "*": spark.range(low, high + 1).filter("id <> 0").filter(F.lit(target) % F.col("id") == 0).select(F.col("id").alias("a"), (F.lit(target) / F.col("id")).cast("long").alias("b")),
        "/": spark.range(low, high + 1).filter("id <> 0").select((F.col("id") * target).alias("a"), F.col("id").alias("b")),
    }[operator]
    return made.filter(a.between(low, high) & b.between(low, high))


def uniform_numbers(spark: SparkSession, rows: int, operands: int = 6, most_target: int = 1000, low: int = 1, high: int = 100, seed: int = 42) -> DataFrame:
    """index, target, nums: uniform and independent, whether or not there is a solution."""
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), k, F.col("id")), F.lit(n))
    nums = F.transform(F.sequence(F.lit(1), F.lit(operands)), lambda i: draw(i, high - low + 1) + low)
    return spark.range(rows).select(F.col("id").alias("index"), (draw(F.lit(0), most_target) + 1).alias("target"), nums.alias("nums"))


def variants(parts: dict[str, DataFrame], order: str = "index") -> DataFrame:
    """All variants one after another, with a `variant` column and one running index."""
    named = [df.withColumn("variant", F.lit(name)).withColumn("_v", F.lit(k)) for k, (name, df) in enumerate(parts.items())]
    both = reduce(DataFrame.unionByName, named).withColumnRenamed(order, "_o")
    return number_rows(both, "_v", "_o", name="index").drop("_v", "_o")


def modular_sum(a, b, modulus: int):
    return (a + b) % modulus


def digit_prompts(spark: SparkSession, most: int, most_diff: int, most_length: int) -> DataFrame:
    """prompt: `first,second:modulus,n` for all first, differences and n, from 0 to their limits."""
    made = lambda n, name: spark.range(n + 1).withColumnRenamed("id", name)
    grid = made(most, "a").join(made(most_diff, "d")).join(made(most_length, "n"))
    return grid.select(F.concat(F.col("a").cast("string"), F.lit(","), modular_sum(F.col("a"), F.col("d"), most).cast("string"), F.lit(f":{most},"), F.col("n").cast("string")).alias("prompt"))


def sampled_prompts(spark: SparkSession, rows: int, most: int, most_diff: int, most_length: int, seed: int = 42) -> DataFrame:
    """index, prompt: so many of these prompts, drawn by a seed."""
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(n + 1))
    a = draw("a", most)
    text = F.concat(a.cast("string"), F.lit(","), modular_sum(a, draw("d", most_diff), most).cast("string"), F.lit(f":{most},"), draw("n", most_length).cast("string"))
    return spark.range(rows).select(F.col("id").alias("index"), text.alias("prompt"))


def digit_answer(prompt: Column) -> Column:
    """The numbers that go on the prompt's sequence."""
    number = lambda k: F.regexp_extract(prompt, r"^(\d+),(\d+):(\d+),(\d+)$", k).cast("long")
    first, second, modulus, n = (number(k) for k in (1, 2, 3, 4))
    step = F.pmod(second - first, modulus)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda i: ((second + step * i) % modulus).cast("string")), ",")).otherwise("")


def prefix_rewards(response: Column, truth: Column, whole: float = 1.0) -> Column:
    """An array over the response's characters: a share of the whole for each until the first that isn't the truth's."""
    each = F.lit(whole) / (F.length(truth) + 1)
    same = longest_common_prefix(response, truth)
    return F.transform(F.filter(F.split(response, ""), lambda c: c != ""), lambda c, i: F.when(i < same, each).otherwise(0.0))


def random_letter(seed: int, key: Column) -> Column:
    return F.char(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(26)) + 97)


def counting_texts(rows: DataFrame) -> DataFrame:
    """Rows of character_counts with `prompt`, and `response` that counts aloud and boxes the number."""
    letters, c = F.split("word", "-"), F.col("letter")
    steps = F.transform(letters, lambda x: F.concat(x, F.when(x == c, F.lit(" = ")).otherwise(F.lit(" != ")), c, F.lit(".")))
    end = F.concat(F.lit("\\boxed{"), F.col("count").cast("string"), F.lit("} "), c, F.lit(" in "), F.col("word"), F.lit("."))
    return rows.withColumn("prompt", F.concat(F.lit("How many "), c, F.lit(" are there in word "), F.col("word"), F.lit("?"))).withColumn("response", F.concat(F.array_join(steps, "\n"), F.lit("\n"), end))


def word_puzzles(original: list[dict], synthetic: list[dict], shapes: dict[tuple[int, int], int], seed: int = 42, tries: int = 200) -> list[dict]:
    """Puzzles of (groups, words each): count, each with a group of either pool at least; a group is used once.

    Pools are lists of (idx, description, words), small by their nature; what a puzzle takes is gone
    for the next, so this is a loop on the driver.  A puzzle's groups share no word.
    """
    rng = random.Random(seed)
    pools = [list(original), list(synthetic)]
    out: list[dict] = []
    for (groups, size), count in shapes.items():
        made = attempts = 0
        while made < count and attempts < 100 * count:
            attempts += 1
            taken = _puzzle(rng, pools, groups, size, tries)
            if taken is None:
                continue
            for k, pool in enumerate(pools):
                used = {i for which, i, _, _ in taken if which == k}
                pools[k] = [g for i, g in enumerate(pool) if i not in used]
            rng.shuffle(taken)
            answers = [{"answerDescription": g["description"], "words": words} for _, _, g, words in taken]
            flat = [w for a in answers for w in a["words"]]
            rng.shuffle(flat)
            text = "{" + ", ".join("[" + ", ".join(w.upper() for w in a["words"]) + "]" for a in answers) + "}"
            used = sorted(g["idx"] for _, _, g, _ in taken if isinstance(g.get("idx"), int))
            out.append({"index": len(out), "question": {"words": flat, "answers": answers}, "answer": text, "metadata": {"variant": f"{groups}x{size}", "total_words": len(flat), "group_count": groups, "words_per_group": size, "indexes_used": used}})
            made += 1
    return out


def _drawn_group(rng: random.Random, pool: list[dict], size: int, used: set[str], tries: int) -> tuple[int, dict, list[str]] | None:
    """A group of the pool and `size` of its words, none of them used."""
    for _ in range(tries if pool else 0):
        i = rng.randrange(len(pool))
        if len(pool[i]["words"]) >= size:
            words = rng.sample(pool[i]["words"], size)
            if used.isdisjoint(words):
                return i, pool[i], words
    return None


def _puzzle(rng: random.Random, pools: list[list[dict]], groups: int, size: int, tries: int) -> list[tuple[int, int, dict, list[str]]] | None:
    """(pool, place, group, words) of one puzzle's groups."""
    used: set[str] = set()
    taken: list[tuple[int, int, dict, list[str]]] = []
    for k in (0, 1):
        found = _drawn_group(rng, pools[k], size, used, tries)
        if found is None:
            return None
        taken.append((k, *found))
        used.update(found[2])
    rest = [(k, i, g) for k, pool in enumerate(pools) for i, g in enumerate(pool) if (k, i) not in {(t[0], t[1]) for t in taken}]
    rng.shuffle(rest)
    for k, i, g in rest:
        if len(taken) == groups:
            break
        if len(g["words"]) >= size:
            words = rng.sample(g["words"], size)
            if used.isdisjoint(words):
                taken.append((k, i, g, words))
                used.update(words)
    return taken if len(taken) == groups else None


def digit_sequences(spark: SparkSession, first: int, diffs: int, lengths: int, modulus: int = 100) -> DataFrame:
    """All prompts `first,diff:n` and the arithmetic sequences that answer them: plain columns, no Python."""
    grid = spark.range(first).withColumnRenamed("id", "a").crossJoin(spark.range(1, diffs + 1).withColumnRenamed("id", "d")).crossJoin(spark.range(1, lengths + 1).withColumnRenamed("id", "n"))
    answer = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: ((F.col("a") + F.col("d") * (i + 1)) % modulus).cast("string")), ",")
    return grid.select(F.concat_ws("", F.col("a"), F.lit(","), (F.col("a") + F.col("d")) % modulus, F.lit(":"), F.col("n")).alias("prompt"), answer.alias("response"))


def character_counts(spark: SparkSession, rows: int, seed: int = 42, length: tuple[int, int] = (3, 5)) -> DataFrame:
    """index, word, letter, count: random hyphenated words and how often a letter stands in them."""
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(n))
    size = draw("n", length[1] - length[0] + 1) + length[0]
    letters = F.transform(F.sequence(F.lit(1).cast("long"), size), lambda i: F.char(F.pmod(F.xxhash64(F.lit(seed), F.lit("c"), F.col("id"), i), F.lit(26)) + 97))
    base = spark.range(rows).select(F.col("id").alias("index"), F.array_join(letters, "-").alias("word"), F.element_at(letters, (draw("k", length[0]) + 1).cast("int")).alias("letter"))
    return base.withColumn("count", F.size(F.filter(F.split("word", "-"), lambda c: c == F.col("letter"))))


def mix(parts: list[DataFrame], ratios: list[float], total: int, seed: object, key: str) -> DataFrame:
    """int(total * ratio) rows of each part, those first in the seeded order."""
    out = None
    for part, ratio in zip(parts, ratios, strict=True):
        one = first_rows(part.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))), int(total * ratio), "_h", key).drop("_h")
        out = one if out is None else out.unionByName(one)
    return out
