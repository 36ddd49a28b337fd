import numpy as np
import pytest

from rillgrid.llm import near, substring, suffixes, windows

from . import data


def frame(spark, rows):
    return spark.createDataFrame(rows, data.SCHEMA)


@pytest.mark.parametrize(("window", "gram", "hot"), [(50, 8, 20_000), (10, 3, 2)])
def test_substring(spark, window, gram, hot):
    rows = data.documents()
    got = {r[0]: tuple(r[1:]) for r in substring.dedup(frame(spark, rows), window, gram, hot).collect()}
    assert got == data.cut_words(rows, window)


@pytest.mark.parametrize(("window", "gram", "hot"), [(400, 32, 4_000), (60, 12, 3)])
def test_suffixes(spark, window, gram, hot):
    rows = data.documents()
    got = {r[0]: tuple(r[1:]) for r in suffixes.dedup(frame(spark, rows), window, gram, hot).collect()}
    assert got == data.cut_bytes(rows, window)


def test_anchors_of_texts_beyond_the_masks_places(monkeypatch):
    """With places of 5 bits, texts of hundreds of units get the anchors that they get with 24."""
    h = windows.tx.mix(np.random.default_rng(3).integers(0, 50, 700), 4)
    h[500:600] = h[20:120]
    firsts = np.array([0, 3, 400, 400, 700])
    want = windows.anchors(h, firsts, 20, 4)
    monkeypatch.setattr(windows, "_MASK", ~np.uint64(31))
    for a, b in zip(want, windows.anchors(h, firsts, 20, 4), strict=True):
        assert a.tolist() == b.tolist()
    assert windows.leftmost(np.arange(100, dtype=np.uint64)[::-1] << np.uint64(30), 32).tolist() == list(range(31, 100))


def test_suffixes_of_periodic_and_nul_bytes(spark):
    rows = [(1, "ab" * 50 + "\0" * 40, *[None] * 9), (2, "\0" * 40 + "b" + "ab" * 30, *[None] * 9), (3, "xyz", *[None] * 9)]
    got = {r[0]: tuple(r[1:]) for r in suffixes.dedup(frame(spark, rows), 20, 4, 3).collect()}
    assert got == data.cut_bytes(rows, 20)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_near(spark, k):
    rows = data.documents()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.dedup(frame(spark, rows), k).collect()}
    assert got == data.near(rows, k)


def test_near_chain(spark):
    """Each text is like the next, the first unlike the last: one component."""
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100]), *[None] * 9) for i in range(25)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.dedup(frame(spark, rows), 2).collect()}
    assert got == data.near(rows, 2)
    assert len({v[1] for v in got.values()}) == 1


def test_empty_and_repeated(spark):
    none = frame(spark, [])
    assert substring.dedup(none).count() == suffixes.dedup(none).count() == near.dedup(none).count() == 0
    row = data.documents()[20]
    twice = frame(spark, [row, row])
    assert substring.dedup(twice).count() == 2 and substring.dedup(twice).select("n_removed").distinct().count() == 1
    assert near.dedup(twice).filter("kept").count() == 2
    assert near.keep(twice).count() == 1
    assert suffixes.dedup(twice).count() == 2


def test_texts_are_returned(spark):
    rows = data.documents()
    kept = {r.doc_id: r.kept for r in substring.dedup(frame(spark, rows), with_text=True).collect()}
    assert kept[min(kept)] is not None
    assert all(isinstance(r.kept, (bytes, bytearray)) for r in suffixes.dedup(frame(spark, rows), with_text=True).collect())


def test_shards_are_cut_by_bytes():
    """A partition's sorted segments come in slabs that end where the key changes, about as large as asked, whatever the batches."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 40, 500))
    seg = [bytes(rng.integers(97, 120, rng.integers(5, 60)).astype(np.uint8)) for _ in key]
    table = pa.table({"shard": key, "doc_id": np.arange(500), "firsts": pa.array([[i, i + 1] for i in range(500)], pa.list_(pa.int32())), "seg": pa.array(seg, pa.binary()), "salted": pa.array(key % 2 == 0)})
    for rows in (7, 100, 1000):
        seen, sizes = [], []

        def shard(x):
            ids = x["doc_id"].tolist()
            seen.append(ids)
            sizes.append(len(x["buf"]))
            assert [bytes(x["buf"][a:b]) for a, b in zip(x["offs"][:-1], x["offs"][1:], strict=True)] == [seg[i] for i in ids]
            assert x["firsts"].reshape(-1, 2)[:, 0].tolist() == ids and x["salted"].tolist() == [bool(key[i] % 2 == 0) for i in ids]
            return iter([])

        list(windows.slabs_of_keys(iter(table.to_batches(max_chunksize=rows)), shard, 2000))
        assert [i for ids in seen for i in ids] == list(range(500))
        keys = [set(key[ids].tolist()) for ids in seen]
        assert all(not a & b for i, a in enumerate(keys) for b in keys[i + 1 :]) and len(seen) > 3
        assert max(sizes) < 2000 + 2 * 60 * 30


def test_partitions_follow_the_text(spark):
    from rillgrid.llm import tables

    docs = spark.range(50).selectExpr("id AS doc_id", "repeat('x', 1000000) AS text")
    assert tables.text_bytes(docs) == 50_000_000 and tables.partitions(docs, 1) == 50
    assert tables.partitions(docs.limit(0), 1) == spark.sparkContext.defaultParallelism
    assert tables.text_bytes(spark.createDataFrame([(1, None), (2, "é")], "doc_id long, text string")) == 2


def test_near_recall_of_planted_pairs(spark):
    """Pairs of similarity 0.8 and more, each of texts of its own, are all found; those below aren't linked."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(300):
        n = 120
        words = [f"p{i}w{k}" for k in range(n)]
        other = list(words)
        for k in rng.choice(n, rng.integers(1, 9), replace=False):
            other[k] = f"q{i}w{k}"
        rows += [(2 * i, " ".join(words), *[None] * 9), (2 * i + 1, " ".join(other), *[None] * 9)]
        a, b = ({tuple(x[j : j + 2]) for j in range(n - 1)} for x in (words, other))
        want[2 * i + 1] = 100 * len(a & b) >= 80 * len(a | b)
    got = {r.doc_id: r.component_id for r in near.dedup(frame(spark, rows), 2).collect()}
    linked = {d: got[d] == d - 1 for d in want}
    assert linked == want and 50 < sum(want.values()) < 300


def test_near_misses_around_one_text(spark):
    """Many texts a little over or under the threshold from one leader, with changes in common: components as by brute force."""
    import random

    rng = random.Random(8)
    base = [f"b{k}" for k in range(100)]
    spots = rng.sample(range(100), 30)
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(spots, rng.randrange(4, 14)):
            w[k] = f"c{k}v{rng.randrange(3)}"
        rows.append((i, " ".join(w), *[None] * 9))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.dedup(frame(spark, rows), 2).collect()}
    assert got == data.near(rows, 2)


def test_long_texts(spark):
    """Texts of hundreds of thousands of units go through whole, with a passage that a short one has too."""
    import random

    rng = random.Random(6)
    long = [f"l{rng.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(long[70_000:70_100]), *[None] * 9), (2, " ".join(long), *[None] * 9), (3, "other words", *[None] * 9)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup(frame(spark, rows)).collect()}
    assert got == {1: (100, 0), 2: (120_000, 100), 3: (2, 0)}
    removed = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.dedup(frame(spark, rows)).collect()}
    n = len(rows[0][1])
    assert removed[1] == (n, n, 1) and removed[2][1:] == (n, 1)
    near_rows = [(1, " ".join(long), *[None] * 9), (2, " ".join(["new", *long]), *[None] * 9)]
    assert [r.component_id for r in near.dedup(frame(spark, near_rows)).collect()] == [1, 1]
