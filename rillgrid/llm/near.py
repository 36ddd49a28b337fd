"""Near-duplicates by min-max hashing, with links confirmed on full sets.

A document's set is its distinct word shingles.  Under each of `perms` permutations of 64-bit
hashes both the smallest and the largest value are kept, so a signature of 2 * perms values costs
half the hash evaluations.  Bands of `rows` values deal documents to buckets; a pair of
similarity s shares one with probability 1 - (1 - s**rows)**bands, at 0.8 and 40 bands of 5 all
but 1.3e-7.  Documents of equal sets are one class and only its smallest doc_id is compared.

Buckets aren't expanded into pairs.  Each document's shingles that no other document in a bucket
has are counted: they bound its similarity with any.  A bucket's leader is the document with the
smallest share of its own, a group's least changed one; all others are compared with it, and the
components of these links mostly settle the bucket.

At last come pairs of one leader and different components.  A document is described by its changes:
the leader's shingles that it lacks and its own that the leader lacks.  Two documents share
exactly both_a + both_b - size of the leader + the changes they have in common, so a pair needs so
many common changes; none at all suffices only if both link with the leader, which puts them in
one component.  Changes are ordered by rarity, those that all stand in one component left out; a
document is indexed by as many of its first ones as a pair must meet in, and pairs meet by
(leader, change) if what is left after it can still reach the need.  They are confirmed on full
sets.  So no link between components is lost, and a pair within one would add nothing.

Cases: a null or empty text, or one of white space, has an empty set and links with nothing; a
text of fewer words than a shingle has one shingle, the whole; rows that share a doc_id count as
one document, a null one is compared with none and kept; of equals the smallest doc_id stays; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .tables import bounded_batches, fewer, partitions, stage, text_bytes, texts

U64 = np.uint64


def sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingles, sorted within each, and the documents' offsets."""
    buf, offs = tx.buffers(part.column("text"))
    starts, ends, firsts = tx.words(buf, offs)
    h = tx.hash_spans(buf, starts, ends, tx.LOWER)
    own, n = tx.owners(firsts), np.diff(firsts)
    g = tx.rolling(h, k, 6)
    at = np.flatnonzero(own[: len(g)] == own[len(h) - len(g) :])
    short = np.flatnonzero((n > 0) & (n < k))
    doc = np.concatenate([own[at], short])
    g = np.concatenate([g[at], tx.span_hash(h, firsts[short], firsts[short + 1], 8)])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    doc, g = doc[new], g[new]
    return g, np.searchsorted(doc, np.arange(part.num_rows + 1))


def signatures(g: np.ndarray, offs: np.ndarray, perms: int) -> np.ndarray:
    """Smallest and largest value of each set (none may be empty) under each permutation: 2 * perms a row."""
    out = np.empty((len(offs) - 1, 2 * perms), U64)
    if len(offs) > 1:
        factor = tx.mix(np.arange(perms), 31) | U64(1)
        shift = tx.mix(np.arange(perms), 32)
        for p in range(perms):
            x = g * factor[p] + shift[p]
            out[:, 2 * p] = np.minimum.reduceat(x, offs[:-1])
            out[:, 2 * p + 1] = np.maximum.reduceat(x, offs[:-1])
    return out


def _outline(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    perms = -(-bands * rows // 2)

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text"):
                g, offs = sets(part, k)
                n = np.diff(offs)
                full = np.flatnonzero(n)
                sig = signatures(g, np.append(offs[:-1][full], offs[-1]), perms)[:, : bands * rows].reshape(len(full), bands, rows)
                key = np.zeros((len(full), bands), U64)
                for r in range(rows):
                    key = tx.mix(key ^ sig[:, :, r], r + 1)
                key = tx.mix(key + np.arange(bands, dtype=U64), 41)
                cut = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(tx.group_hash(g, offs, 1).view(np.int64)), pa.array(tx.group_hash(g, offs, 2).view(np.int64)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(key.ravel().view(np.int64)))],
                    ["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return docs.mapInArrow(outlined, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _met(pairs: DataFrame, docs: DataFrame, n: int, share: int = 2000) -> DataFrame:
    """Texts for pairs (a, b): of each a (kind 0) and then of its b (kind 1), in order.

    So a task holds one set of a at a time; an a of more than `share` partners is dealt over
    several tasks.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    dealt = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    leaders = many.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    need = leaders.unionByName(dealt.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("kind")))
    return docs.join(need, "doc_id").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "kind", "doc_id")


def _compared(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
    """From such texts: a, b, both full sets, and which of b's shingles a has."""
    of, mine = None, np.zeros(0, U64)
    for batch in batches:
        for part in tx.slabs(batch, "text"):
            g, offs = sets(part, k)
            out = []
            for i, (a, kind, b) in enumerate(zip(part.column("a").to_pylist(), part.column("kind").to_pylist(), part.column("doc_id").to_pylist(), strict=True)):
                x = g[offs[i] : offs[i + 1]]
                if kind == 0:
                    of, mine = a, x
                elif of == a and len(x) and len(mine):
                    at = np.minimum(np.searchsorted(mine, x), len(mine) - 1)
                    out.append((a, b, mine, x, mine[at] == x))
            yield out


def overlaps(pairs: DataFrame, docs: DataFrame, k: int, n: int) -> DataFrame:
    """Of pairs (a, b): a, b, and the sizes of both full sets and of what they share (`both`)."""
    names = ["a", "b", "a_size", "b_size", "both"]

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _compared(batches, k):
            rows = [(a, b, len(mine), len(x), int(same.sum())) for a, b, mine, x, same in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)], names)

    return _met(pairs, docs, n).mapInArrow(sized, ", ".join(f"{c} long" for c in names))


def changes(pairs: DataFrame, docs: DataFrame, k: int, n: int) -> DataFrame:
    """(a, b, shingle): the shingles that just one of a and b has."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _compared(batches, k):
            rest = [np.concatenate([x[~same], np.setdiff1d(mine, x, assume_unique=True)]) for _, _, mine, x, same in found]
            ids = [np.repeat(np.array([r[j] for r in found], np.int64), [len(x) for x in rest]) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array((np.concatenate(rest) if rest else np.zeros(0, U64)).view(np.int64))], ["a", "b", "shingle"])

    return _met(pairs, docs, n).mapInArrow(listed, "a long, b long, shingle long")


def unsettled(star: DataFrame, part: DataFrame, docs: DataFrame, k: int, percent: int, n: int) -> DataFrame:
    """Pairs (a, b) of one leader and different components that may link, from each leader's comparisons.

    star: a (the leader), b, a_size, b_size, both.  part: node, component.  With all sides scaled by
    100 + percent, a pair needs gap_a + gap_b + (100 + percent) * a_size common changes.
    """
    scale = 100 + percent
    named = star.join(part.select(F.col("node").alias("b"), "component"), "b", "left").withColumn("c", F.coalesce("component", "b"))
    named = named.join(part.select(F.col("node").alias("a"), F.col("component").alias("lead_component")), "a", "left").withColumn("out", ~F.col("c").eqNullSafe(F.coalesce("lead_component", "a")))
    named = named.select("a", "b", "c", "out", (F.lit(scale) * F.col("a_size")).alias("whole"), (F.lit(percent) * F.col("b_size") - F.lit(scale) * F.col("both")).alias("gap"))
    best = named.groupBy("a").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("gap").alias("any_gap"), F.min(F.when(F.col("out"), F.col("gap"))).alias("out_gap")).filter("low <> high")
    least = F.greatest(F.ceil((F.col("gap") + F.when(F.col("out"), F.col("any_gap")).otherwise(F.col("out_gap")) + F.col("whole")) / scale), F.lit(1))
    named = stage(named.join(best, "a").select("a", "b", "c", "out", "whole", "gap", least.cast("int").alias("least")), "several")
    found = stage(changes(named.select("a", "b"), docs, k, n).join(named, ["a", "b"]), "changes")
    shared = found.groupBy("a", "shingle").agg(F.count("*").alias("times"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("a", "shingle", "times")
    mine = Window.partitionBy("a", "b")
    placed = found.join(shared, ["a", "shingle"]).withColumn("at", F.row_number().over(mine.orderBy("times", "shingle"))).withColumn("left", F.count("*").over(mine) - F.col("at"))
    placed = stage(placed.filter(F.col("left") + 1 >= F.col("least")).select("a", "b", "c", "out", "shingle", "whole", "gap", "left"), "placed")
    one, two = (placed.select("a", "shingle", "whole", *[F.col(c).alias(f"{x}_{c}") for c in ("b", "c", "out", "gap", "left")]) for x in "xy")
    need = F.col("x_gap") + F.col("y_gap") + F.col("whole")
    met = one.filter("x_out").join(two.drop("whole"), ["a", "shingle"]).filter("x_c <> y_c AND (NOT y_out OR x_b < y_b)").filter(F.lit(scale) * (1 + F.least("x_left", "y_left")) >= need)
    return met.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct()


def own_shingles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, own): how many of a document's shingles stand in no other of the documents."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text"):
                g, offs = sets(part, k)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.repeat(part.column("doc_id").to_numpy(), np.diff(offs)))], ["shingle", "doc_id"])

    rows = docs.mapInArrow(listed, "shingle long, doc_id long")
    once = rows.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).filter("doc_id = last")
    return once.groupBy("doc_id").agg(F.count("*").alias("own"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reached by links), kept."""
    bounded_batches(docs.sparkSession)
    docs = texts(docs)
    size = text_bytes(docs)
    seen = stage(fewer(_outline(docs, k, bands, rows), size), "signatures")
    classes = seen.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")).filter("members > 1")
    later = stage(seen.filter("n_shingles > 0").select("doc_id", "s1", "s2").join(classes, ["s1", "s2"]).filter("doc_id <> rep").select("doc_id", "rep").distinct(), "classes")
    alone = seen.filter("n_shingles > 0").join(later, "doc_id", "left_anti").select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = alone.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    met = stage(fewer(alone.join(buckets, "band").drop("members"), size), "buckets")

    def reaches(both, size_a, size_b):
        return both * 100 >= (size_a + size_b - both) * percent

    # what stands in no other of these documents can't be shared, which bounds a document's similarity with any
    # the texts of these documents are dealt once, and read again from here
    docs = stage(fewer(docs.join(met.select("doc_id").distinct(), "doc_id"), size), "candidates")
    n = partitions(docs, 16)
    own = own_shingles(docs, k)
    at = met.join(own, "doc_id", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    at = stage(at.filter(reaches(F.col("common"), F.col("n"), F.col("common"))), "open")
    worth = F.struct((F.col("common") / F.col("n")).alias("share"), F.xxhash64("doc_id").alias("draw"), "doc_id")
    at = at.join(at.groupBy("band").agg(F.max(worth)["doc_id"].alias("lead")), "band").filter("doc_id <> lead")
    star = at.groupBy(F.col("lead").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("times")).select("a", "b")
    star = stage(overlaps(stage(star, "star"), docs, k, n), "compared")
    links = star.filter(reaches(F.col("both"), F.col("a_size"), F.col("b_size"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    part = components(links)
    rest = unsettled(star, part, docs, k, percent, n)
    more = overlaps(stage(rest, "rest"), docs, k, n).filter(reaches(F.col("both"), F.col("a_size"), F.col("b_size"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = stage(more, "more")
    if not more.isEmpty():
        part = components(part.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    rep = seen.select("doc_id", "n_shingles").join(later, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    named = rep.join(part.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest, all columns; of rows that share a doc_id, one.

    The ids of the others go to the rows in a join by doc_id.
    """
    gone = stage(dedup(docs, **how).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    twice = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    rows = docs if twice.isEmpty() else docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id IS NULL"))
    return rows.join(gone, "doc_id", "left_anti").select(*rows.columns)
