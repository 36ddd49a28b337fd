import random

from pyspark.sql import functions as F

from rillgrid.llm import quality, stages

import corpus_pipeline

from . import data

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, n=80):
    rng = random.Random(9)
    function = "the of and to in a is that it for on was be with as by".split()
    word = lambda: rng.choice(function) if rng.random() < 0.5 else "".join(rng.choice("etaoinshr") for _ in range(6))
    prose = lambda k: [word() for _ in range(k)]
    item, base = prose(40), prose(150)
    texts = [None, "", "short text", " | ".join(prose(120)), " ".join(prose(60) + item + prose(30)), " ".join(prose(80) + ["joe@mail.example.com", "10.1.2.3"])]
    for i in range(n - len(texts)):
        w = prose(150) if i % 4 else base[:]
        if i % 8 == 0:
            w[rng.randrange(150)] = f"new{i}"
        texts.append(" ".join(w))
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    sf = f"file://{tmp_path}"
    rows = write(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    one = stages.quality_rules(spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == kept and 3 not in kept and {0, 1, 2}.isdisjoint(kept) and {4, 5, 6} <= kept
    two = stages.near_dedup(spark, one, sf)
    left = [r for r in rows if r[0] in kept]
    expected = {d for d, v in data.near(left, 5).items() if v[2]}
    assert {r.doc_id for r in two.collect()} == expected
    three = stages.decontamination(spark, two, sf)
    assert {r.doc_id for r in three.collect()} == expected - {4}
    four = stages.pii(spark, three, sf)
    texts = {r.doc_id: r.text for r in four.collect()}
    assert {d for d, t in texts.items() if t != rows[d][1]} == {5} and "joe" not in texts[5] and "10.1.2.3" not in texts[5]
    assert all(len(r.text) == r.n_chars for r in four.collect())
    for df in (one, two, three, four):
        assert df.columns == columns
    out = corpus_pipeline.run(spark, sf).collect()
    sizes = {d: len(data.words(t)) for d, t in texts.items()}
    assert {r.doc_id for r in out} <= set(texts)
    assert all(r.text == texts[r.doc_id] and 0 < r.taken <= 3 * sizes[r.doc_id] for r in out)
    assert abs(sum(r.taken for r in out) - sum(sizes.values())) <= 0.02 * sum(sizes.values())


def test_empty_table(spark, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_call_the_dealt_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "mixing"]


def test_clashing_names_in_every_stage(spark, tmp_path):
    """Columns that are called as the operators' own ones, keys that are null or shared, and empty texts go through all stages."""
    sf = f"file://{tmp_path}"
    rows = write(spark, sf)
    names = ["_gone", "_size", "_id", "size", "taken", "mix_size", "_pieces", "_wrong", "_found", "found", "content", "row", "shard", "target", "source_size", "_lang", "band", "c1", "anchor", "n", "item_id", "_c", "quota"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    extra = [None, 7, 7]
    more = docs.filter("doc_id IN (6, 7, 8)").withColumn("doc_id", F.element_at(F.array(*[F.lit(x).cast("long") for x in extra]), (F.col("doc_id") - 5).cast("int")))
    docs = docs.unionByName(more)
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        assert out.columns[: len(columns)] == columns, name
        if name != "mixing":
            assert out.columns == columns
        assert out.count() > 0
        bare = out.select(*columns).limit(0)
        assert step(spark, bare, sf).count() == 0
        docs = out.select(*columns)
    assert {r["_gone"] for r in docs.collect()} == {0}


def test_ties_and_repeats(spark, tmp_path):
    """Rows that repeat in full: one of them stays, and none of another text is lost with it."""
    sf = f"file://{tmp_path}"
    write(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once = {r.doc_id for r in stages.near_dedup(spark, docs, sf).collect()}
    twice = [r.doc_id for r in stages.near_dedup(spark, docs.unionByName(docs), sf).collect()]
    assert sorted(twice) == sorted(once)
