import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.functions import answers
from rillgrid.operators import advantages, metrics, partitioning, retrieval, sampling, sequences
from rillgrid.operators.batch import Batch, number_rows
from rillgrid.sources import readers


def batch(spark, n=6):
    return Batch.of(spark.createDataFrame([(i + 1, "abcdefghijkl"[i]) for i in range(n)], "obs long, label string"), "obs")


def column(b, name):
    return [r[name] for r in b.collect()]


def test_batch_rows(spark):
    b = batch(spark)
    assert column(b.reorder([3, 4, 2, 0, 1, 5]), "label") == list("decabf")
    with pytest.raises(ValueError):
        b.chunk(5)
    parts = b.chunk(2)
    assert [column(p, "obs") for p in parts] == [[1, 2, 3], [4, 5, 6]]
    assert Batch.concat(parts).collect() == b.collect()
    three = batch(spark, 3)
    assert column(three.repeat(2), "label") == list("aabbcc")
    assert column(three.repeat(2, interleave=False), "label") == list("abcabc")
    times = Batch(three.df.withColumn("n", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), F.col("obs").cast("int"))))
    assert column(times.sample_level_repeat("n"), "label") == list("aaabcc")
    for divisor, expected in ((2, "abca"), (3, "abc"), (7, "abcabca")):
        padded, pad = three.pad_to_divisor(divisor)
        assert column(padded, "label") == list(expected)
        assert column(padded.unpad(pad), "label") == list("abc")
    assert column(three.repeat(2).fold(3).reorder([1, 2, 0]).unfold(), "label") == list("bbccaa")
    b.slice(1, 6, 2).check()
    assert column(b.slice(1, 6, 2), "obs") == [2, 4, 6]
    assert column(b.where(F.col("obs") > 4), "obs") == [5, 6]


def test_batch_columns(spark):
    b = Batch(batch(spark).df, {"m": 1, "k": 2})
    taken, left = b.pop(["obs"], ["k"])
    assert (taken.columns, taken.meta, left.columns, left.meta) == (["obs"], {"k": 2}, ["label"], {"m": 1})
    assert b.rename("obs", "act").columns == ["act", "label"]
    with pytest.raises(ValueError):
        b.rename(["obs"], ["a", "b"])
    with pytest.raises(KeyError):
        b.select(["none"])
    assert column(taken.union(b), "label") == list("abcdef")
    with pytest.raises(ValueError):
        b.union(Batch(b.df.withColumn("obs", F.col("obs") + 1)))
    rows = spark.createDataFrame([(0, [1, 2, 3, 4], [1, 2]), (1, [5, 6, 7, 8], [5, 6])], "_pos long, x array<int>, y array<int>")
    assert [(r["x"], r["y"]) for r in Batch(rows).unfold_column_chunks(2, ["x"]).collect()] == [([1, 2], [1, 2]), ([3, 4], [1, 2]), ([5, 6], [5, 6]), ([7, 8], [5, 6])]


def test_numbers_have_no_gaps(spark):
    n = number_rows(spark.range(1000).withColumn("h", F.xxhash64("id")), "h")
    assert sorted(r[0] for r in n.select("_pos").collect()) == list(range(1000))


def test_advantages(spark):
    df = spark.createDataFrame([("g", 1, 1.0, 3), ("g", 2, 0.0, 1), ("h", 3, 1.0, 5)], "g string, id long, s double, n long")
    z = {r.id: r.advantage for r in advantages.group_zscore(df, ["g"], "s").collect()}
    assert z == pytest.approx({1: 0.7071058, 2: -0.7071058, 3: 0.9999990}, abs=1e-6)
    o = {r.id: r.advantage for r in advantages.length_weighted(df, ["g"], "s", "n").collect()}
    assert o == pytest.approx({1: 0.25, 2: -0.75, 3: 1.0})
    assert {r.id: r.advantage for r in advantages.softmean_baseline(df.withColumn("s", F.lit(0.0)), "s", group=["g"]).collect()} == pytest.approx({1: 0, 2: 0, 3: 0})
    p = spark.createDataFrame([("g", 1, 0.2), ("g", 2, 0.9), ("g", 3, 0.5)], "g string, id long, s double")
    assert {r.id: r.advantage for r in advantages.best_minus_second(p, ["g"], "s", "id").collect()} == pytest.approx({1: 0, 2: 0.4, 3: 0})
    l = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 0.0), ("g", 3, 0.0)], "g string, id long, s double")
    assert {r.id: r.advantage for r in advantages.leave_one_out(l, ["g"], "s").collect()} == pytest.approx({1: 1.0, 2: -0.5, 3: -0.5})


def test_sequences(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in (1, 2, 3)], "s long, t long, v double")
    assert [r.return_ for r in sequences.suffix_sum(df, ["s"], ["t"], "v").orderBy("t").collect()] == [6, 5, 3]
    assert [r.return_ for r in sequences.discounted_return(df, ["s"], ["t"], "v", 0.5).orderBy("t").collect()] == [2.75, 3.5, 3]
    ids = spark.createDataFrame([(1, i, t) for i, t in enumerate([20, 10, 34, 1, 0, 0, 0])], "s long, t long, v long")
    assert [r.mask for r in sequences.response_mask(ids, ["s"], ["t"], F.col("v") == 1).orderBy("t").collect()] == [1, 1, 1, 1, 0, 0, 0]
    mask = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 0, 1, 1, 1])], "s long, t long, v long")
    assert [r.position for r in sequences.position_ids(mask, ["s"], ["t"], F.col("v")).orderBy("t").collect()] == [0, 0, 0, 1, 2]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, "A", 0.9), (1, 2, "B", 0.8), (1, 3, "B", 0.7), (1, 4, "A", 0.6)], "g long, o long, k string, v double")
    assert [tuple(r) for r in metrics.majority_vote(df, ["g"], "k", "v", "o").collect()] == [(1, "A", 2, 0.9)]
    assert metrics.bootstrap([1, 2, 3, 4, 5], 3, np.mean, 100)[0] == pytest.approx(3.0, abs=0.3)
    assert 3.5 < metrics.bootstrap([1, 2, 3, 4, 5], 3, max, 100)[0] < 5
    with pytest.raises(ValueError):
        metrics.bootstrap([], 1, max)
    a = spark.createDataFrame([("x", True, False), ("x", False, True), ("x", False, False), ("x", True, True)], "v string, c boolean, l boolean")
    rows = {r.variant: r for r in metrics.accuracy_rollup(a, "v", "c", "l").collect()}
    assert (rows["total"].accuracy, rows["x"].accuracy_excl_length, rows["x"].prop_incorrect_due_to_length) == (0.5, 0.5, 0.5)
    assert metrics.throughput(600, 2, 2) == 150


def test_partitioning():
    rng = random.Random(1)
    for equal in (False, True):
        for how in (partitioning.greedy, partitioning.karmarkar_karp):
            n = [rng.randrange(1, 90) for _ in range(24)]
            parts = how(n, 4, equal)
            assert sorted(i for p in parts for i in p) == list(range(24))
            assert not equal or {len(p) for p in parts} == {6}
            sums = [sum(n[i] for i in p) for p in parts]
            assert equal or max(sums) - min(sums) <= 90
            if how is partitioning.greedy:
                sums, counts, again = [0] * 4, [0] * 4, [[] for _ in range(4)]
                for i, x in enumerate(n):  # item by item, as it says
                    p = min(range(4), key=lambda p: (counts[p] if equal else 0, sums[p], p))
                    sums[p] += x
                    counts[p] += 1
                    again[p].append(i)
                assert parts == again
    lengths = [rng.randrange(1, 91) for _ in range(20)]
    parts = partitioning.micro_batches(lengths, 300)
    assert len(parts) == -(-sum(lengths) // 300) and len(partitioning.micro_batches(lengths, 300, at_least=7, multiple_of=4)) == 8
    assert sorted(i for p in parts for i in p) == list(range(20))
    with pytest.raises(ValueError):
        partitioning.karmarkar_karp([1], 2)


def test_answers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(answers.hash_answer(F.lit("a #### 12 b #### 1,234"))) == "1234"
    assert value(answers.hash_answer(F.lit("so 3 or 4."), strict=False)) == "4."
    assert value(answers.qa_normalise(F.lit("The  Cat, a hat!"))) == "cat hat"
    assert value(answers.token_f1(F.lit("the cat sat"), F.lit("a cat"))) == pytest.approx(2 / 3)
    assert [value(answers.overlong_penalty(F.lit(n), 10, 4, 1.0)) for n in (5, 8, 10)] == [0, -0.5, -1.0]
    assert value(answers.longest_common_prefix(F.lit("abcd"), F.lit("abxd"))) == 2
    assert answers.countdown("<answer>1+2+3</answer>", 6, [1, 2, 3]) == 1.0
    assert answers.countdown("<answer>1+2</answer>", 6, [1, 2, 3]) == 0.1
    assert answers.countdown("1+2+3", 6, [1, 2, 3]) == 0
    assert answers.last_boxed(r"x \boxed{1} y \boxed{\frac{1}{2}}") == r"\frac{1}{2}"
    assert [answers.evaluate(x) for x in ("2*(3+4)", "7//2", "-2**2", "1/0", "2 3", "__import__('os')", "9**9**9")] == [14, 3, -4, None, None, None, None]


def test_sampling_and_retrieval(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    s = {r.k: r.split for r in sampling.split(df, 1, ["k"], 0.8).collect()}
    assert sum(v == "train" for v in s.values()) == 80
    assert s == {r.k: r.split for r in sampling.split(df.repartition(7), 1, ["k"], 0.8).collect()}
    vectors = np.random.default_rng(0).normal(size=(50, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "k long, v array<double>")
    got = {(r.query, r["rank"]): r.key for r in retrieval.knn(v, v.filter("k < 5"), "k", "v", 3, block=2).collect()}
    scores = np.round(vectors[:5] @ vectors.T, 5)
    assert got == {(q, r + 1): int(k) for q in range(5) for r, k in enumerate(np.lexsort((np.arange(50), -scores[q]))[:3])}


def test_maths():
    from rillgrid.functions import maths

    assert maths.canonical(r"x = \dfrac12") == r"\frac{1}{2}"
    assert maths.canonical("3/4") == r"\frac{3}{4}" and maths.canonical("0.5") == r"\frac{1}{2}" and maths.canonical(".25") == "0.25"
    assert maths.canonical(r"\sqrt3") == r"\sqrt{3}" and maths.canonical(r"12 \text{ cm}") == "12" and maths.canonical("1,234") == "1234"
    for a, g, same in ((r"\frac{1}{2}", "0.5", True), ("50%", "0.5", True), ("(1, 2/4)", "(1,0.5)", True), ("(1,2)", "[1,2]", False), (r"2\sqrt{4}", "4", True), ("7", "8", False), (r"90^\circ", "90", True), (None, "1", False), ("2^{10}", "1024", True)):
        assert maths.equal(a, g) is same, (a, g)
    assert maths.repetition("abcdefgh") < 0.1 < 0.2 < maths.repetition("ab" * 200)


def test_groups(spark):
    from rillgrid.functions import groups
    from rillgrid.sources import generators

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(groups.parse_groups(F.lit("{[b, A], [d,c ]}"))) == [["A", "B"], ["C", "D"]]
    assert value(groups.parse_groups(F.lit("none"))) is None
    assert [value(groups.group_score(F.lit(a), F.lit("{[A, B], [C, D]}"))) for a in ("[d, c] [b, a]", "I abstain", "[a, c]")] == [1.0, 0.3, 0.1]
    assert value(groups.roles(F.lit("Answer: {Al = Knave} Answer: {Al = Knight, Bo = knave}"))) == {"al": "knight", "bo": "knave"}
    assert [tuple(r) for r in value(groups.tool_calls(F.lit('<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call><tool_call>bad</tool_call>')))] == [("f", '{"x":1}')]
    assert value(groups.hint_count(F.lit("<hint> a <hint>"))) == 2
    assert value(groups.truncate(F.lit("abcdefgh"), 4)) == "ab...(truncated)...gh"
    assert value(groups.pad_tokens(F.array(F.lit(1), F.lit(2)), 4, 0)) == [0, 0, 1, 2]
    assert value(groups.pad_tokens(F.array(*map(F.lit, range(5))), 3, 0, side="left")) == [2, 3, 4]
    assert value(groups.first_choice(F.lit("The answer: (c) 3"))) == "C"
    assert value(groups.code_block(F.lit("x ```python\ny\n``` z"))) == "y\n"
    assert {"9,10:20", "0,1:1"} <= {r.prompt for r in generators.digit_sequences(spark, 10, 1, 20).collect()}
    assert {r.prompt: r.response for r in generators.digit_sequences(spark, 10, 1, 2, 20).collect()}["9,10:2"] == "11,12"
    rows = generators.countdown(spark, 20, 3).collect()
    assert [r["index"] for r in rows] == list(range(20))
    assert all(answers.evaluate(r.hints[-1]) == r.target and len({*r.numbers, r.target}) == 4 and 10 <= r.target <= 90 for r in rows)
    assert all(r["count"] == r.word.split("-").count(r.letter) >= 1 for r in generators.character_counts(spark, 30).collect())


def test_readers_and_streams(spark, tmp_path):
    from rillgrid.sources import readers
    from rillgrid.streaming import streams

    (tmp_path / "g.jsonl").write_text('{"description": "d", "words": [" a ", "b"], "contest": "c"}\nbad\n{"description": "e", "words": ["x"]}\n')
    assert [(r.words, r.source) for r in readers.word_groups(spark, f"file://{tmp_path}/g.jsonl", "s").collect()] == [(["A", "B"], "s")]
    (tmp_path / "b.csv").write_text("Game ID,Puzzle Date,Group Name,Word,Starting Row,Starting Column\n2,2024-01-02,G,b,0,1\n2,2024-01-02,G,a,0,0\n1,2024-01-01,H,c,1,1\n")
    assert [(r["index"], r.description, r.words) for r in readers.csv_groups(spark, f"file://{tmp_path}/b.csv").orderBy("index").collect()] == [(0, "H", ["C"]), (1, "G", ["A", "B"])]
    rows = spark.createDataFrame([(0, "System: s\n\nUser: u\n\nAssistant: a", 1.0), (1, "plain", 2.0)], "i long, p string, g double")
    records = readers.rl_records(rows, F.col("p"), F.struct("g"), F.struct("i"), "i")
    assert [[tuple(m) for m in r.prompt] for r in records.orderBy("index").collect()] == [[("system", "s"), ("user", "u"), ("assistant", "a")], [("user", "plain")]]
    assert readers.problems(records) == [] and readers.problems(records.drop("index")) == ["no column index"]
    assert readers.problems(records.withColumn("metadata", F.lit("{"))) == ["2 bad values in metadata"]
    assert sorted(r[0] for r in readers.ranked_shards(spark.range(10), 3, 1, "id").groupBy("shard").count().select("count").collect()) == [3, 3, 3]
    turns = spark.createDataFrame([(1, 0, "a b"), (1, 1, "x <answer>"), (1, 2, "late"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c")], "conv_id long, turn long, text string")
    turns.coalesce(1).write.parquet(f"file://{tmp_path}/turns")
    stream = streams.turn_loop(spark.readStream.schema(turns.schema).parquet(f"file://{tmp_path}/turns"), 3, 100)
    run = stream.writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("turns").collect()) == [(1, 2, 4, "answer"), (2, 3, 3, "turns")]


def test_prompts(spark):
    from rillgrid.functions import prompts

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(prompts.render("use {n} for {t}{x}", n=prompts.list_text(F.array(F.lit(1), F.lit(2))), t=F.lit(3), x=F.lit(None))) == "use [1, 2] for 3"
    assert value(prompts.groups_text(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))))) == "{[A, B], [C]}"
    assert value(prompts.placeholder_answer(F.lit(2), F.lit(2))) == "{[word, word], [word, word]}"
    assert [tuple(m) for m in value(prompts.chat(system=F.lit(None).cast("string"), user=F.lit("u")))] == [("user", "u")]
    assert [tuple(s) for s in value(prompts.segments(F.lit("a<image>b<video>")))] == [("text", "a"), ("image", None), ("text", "b"), ("video", None)]
    assert value(F.struct(*prompts.split_completion(F.lit("q\n\nAssistant: <think>"), F.lit("x")))) == ("q\n\nAssistant: ", "<think>x")
    assert value(prompts.passages(F.array(F.lit("T\nbody"), F.lit("U")))) == "Doc 1 (Title: T)\nbody\n\nDoc 2 (Title: U)\n"
    assert [value(prompts.hint(F.array(F.lit("a"), F.lit("b")), F.lit(k))) for k in (0, 1)] == ["a", "No more hints."]
    rows = spark.createDataFrame([(i, "r", "x", "y", "z") for i in range(30)], "k long, r string, a string, b string, c string")
    got = prompts.shuffled_choices(rows, "r", ["a", "b", "c"], 1, "k").collect()
    assert all(f"{r.gold}) r" in r.choices for r in got) and {r.gold for r in got} == set("ABCD")
    made = rows.select(*prompts.record("s", "math", "train", prompts.chat(user=F.col("r")), F.col("a"), F.col("k"), answer=F.col("b"))).first()
    assert (made.data_source, made.reward_model.ground_truth, made.extra_info.answer, made.prompt[0].content) == ("s", "x", "y", "r")
    assert prompts.flattened(one.select(F.struct(F.lit(1).alias("a"), F.struct(F.lit(2).alias("c")).alias("b")).alias("s")), "s").columns == ["a", "b/c"]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_many_wide_rows(spark, adaptive):
    """No row is lost and no place is given twice, with a payload, ties in the order and 8 partitions."""
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        n = 100_000
        rows = spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("h"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("payload"))
        out = number_rows(rows, "h", name="at")
        got = out.agg(F.count("*"), F.count_distinct("at"), F.min("at"), F.max("at"), F.count_distinct("id"), F.sum(F.length("payload"))).first()
        assert tuple(got) == (n, n, 0, n - 1, n, n * 640)
        # in order: each row's hash is above the one before it
        late = out.select("at", "h").join(out.select((F.col("at") - 1).alias("at"), F.col("h").alias("next")), "at").filter("next < h")
        assert late.isEmpty()
        split = sampling.split(rows.select("id", "payload"), 1, ["id"], 0.8).groupBy("split").count().collect()
        assert {r[0]: r[1] for r in split} == {"train": 80_000, "test": 20_000}
        shards = readers.ranked_shards(rows, 3, 2, "id").groupBy("shard").count().collect()
        assert {r[0]: r[1] for r in shards} == {0: 33_333, 1: 33_333, 2: 33_333}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_first_metadata_wins(spark):
    a, b = batch(spark, 2), batch(spark, 2)
    both = Batch.concat([Batch(a.df, {"k": 1}), Batch(b.df, {"k": 2, "m": 3})])
    assert both.meta == {"k": 1} and len(both) == 4
    assert column(a.padding(2, "first"), "label") == list("abaa") and column(a.padding(2), "label") == list("abbb")
    assert (a[1]["label"], column(a[-1:], "label"), column(a[[True, False]], "label")) == ("b", ["b"], ["a"])
    with pytest.raises(IndexError):
        a[5]


def test_batches_are_saved(spark, tmp_path):
    b = Batch(batch(spark, 3).df, {"k": [1, 2]})
    b.save(f"file://{tmp_path}/b")
    again = Batch.load(spark, f"file://{tmp_path}/b")
    assert again.meta == b.meta and again.collect() == b.collect()
    assert set(b.sizes_gb()) == {"obs", "label"}
