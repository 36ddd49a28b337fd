"""Prompts and training records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = ("A", "B", "C", "D", "E", "F", "G", "H")


def render(template: str, **values: Column) -> Column:
    """A template with {name} fields filled from columns; a null value leaves its field empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def list_text(values: Column) -> Column:
    """An array as `[1, 2, 3]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit("]"))


def groups_text(groups: Column) -> Column:
    """Groups of words as `{[A, B], [C, D]}` in upper case."""
    return F.concat(F.lit("{"), F.array_join(F.transform(groups, lambda g: F.concat(F.lit("["), F.array_join(F.transform(g, F.upper), ", "), F.lit("]"))), ", "), F.lit("}"))


def placeholder_answer(groups: Column, words: Column) -> Column:
    """`{[word, word], [word, word]}` of the given shape."""
    one = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("word"), words), ", "), F.lit("]"))
    return F.concat(F.lit("{"), F.array_join(F.array_repeat(one, groups), ", "), F.lit("}"))


def chat(**messages: Column) -> Column:
    """Messages in the given order of roles, those with null content left out."""
    made = F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in messages.items()])
    return F.filter(made, lambda m: m["content"].isNotNull())


def record(source: str, ability: str, split: str, prompt: Column, truth: Column, index: Column, **extra: Column) -> list[Column]:
    """data_source, prompt, ability, reward_model and extra_info of one training row."""
    return [
        F.lit(source).alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.cast("long").alias("index"), *[c.alias(k) for k, c in extra.items()]).alias("extra_info"),
    ]


def shuffled_choices(df: DataFrame, right: str, wrong: list[str], seed: object, key: str) -> DataFrame:
    """df with `choices` (lines A to H) in a seeded order of each row, and the right one's letter as `gold`."""
    options = [right, *wrong]
    drawn = F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key), F.lit(i))).alias("h"), F.lit(i == 0).alias("right"), F.col(c).alias("text")) for i, c in enumerate(options)]))
    letters = F.array(*[F.lit(x) for x in LETTERS[: len(options)]])
    return (
        df.withColumn("_d", drawn)
        .withColumn("choices", F.array_join(F.transform("_d", lambda d, i: F.concat(letters[i], F.lit(") "), d["text"])), "\n"))
        .withColumn("gold", F.element_at(letters, F.array_position(F.transform("_d", lambda d: d["right"]), True).cast("int")))
        .drop("_d")
    )


def segments(content: Column, tags: tuple[str, ...] = ("image", "video")) -> Column:
    """Content cut at <image> and <video> tags: typed pieces, empty text left out."""
    mark = "|".join(f"<{t}>" for t in tags)
    cut = F.split(F.regexp_replace(content, f"({mark})", "\u0001$1\u0001"), "\u0001", -1)
    typed = F.transform(cut, lambda p: F.struct(F.when(p.rlike(f"^(?:{mark})$"), F.regexp_replace(p, "[<>]", "")).otherwise("text").alias("type"), F.when(~p.rlike(f"^(?:{mark})$"), p).alias("text")))
    return F.filter(typed, lambda p: (p["type"] != "text") | (p["text"] != ""))


def split_completion(prompt: Column, completion: Column, mark: str = "\n\nAssistant: ") -> tuple[Column, Column]:
    """(prompt up to its last mark, what follows the mark before the completion)."""
    at = F.length(prompt) - F.length(F.substring_index(prompt, mark, -1))
    found = F.contains(prompt, F.lit(mark))
    return F.when(found, prompt.substr(F.lit(1), at)).otherwise(prompt), F.when(found, F.concat(F.substring_index(prompt, mark, -1), completion)).otherwise(completion)


def passages(hits: Column) -> Column:
    """Retrieved texts, title on the first line, as `Doc i (Title: ...)` blocks."""
    return F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(h, "\n", 1), F.lit(")\n"), F.when(F.contains(h, F.lit("\n")), F.regexp_replace(h, r"^[^\n]*\n", "")).otherwise(""))), "\n\n")


def hint(hints: Column, number: Column, none: str = "No more hints.") -> Column:
    """Hint `number` (from 0) of a row; the last one, which is the solution, is never given."""
    return F.when((number >= 0) & (number < F.size(hints) - 1), F.get(hints, number)).otherwise(F.lit(none))


def flattened(df: DataFrame, column: str, sep: str = "/") -> DataFrame:
    """A struct column's fields, at any depth, as columns named by their path."""

    def fields(kind, path):
        for f in kind:
            here = [*path, f.name]
            yield from fields(f.dataType, here) if hasattr(f.dataType, "fields") else [here]

    paths = list(fields(df.schema[column].dataType, []))
    return df.select(*[F.col(".".join(f"`{p}`" for p in [column, *path])).alias(sep.join(path)) for path in paths])
