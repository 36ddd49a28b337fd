"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources by code point (null last) weigh 5, 2, 1 and so on and share all words; none goes
beyond `most` times its source's words, and what is over is shared anew by weight.
Blocks of equal tokens go to the sources by highest quotient target / (2 * seats + 1); then each
source's blocks go to its shards in the same way, the shards' words being the votes.  A shard is
the documents of a hash of (source, doc_id); it takes whole passes over its documents and, for the
rest of its quota, documents in a seeded order, the last one in part.

Highest quotients needn't be drawn one seat at a time.  With V votes, N seats and k parties the
divisor of the last seat lies between V / (N + k / 2) and V / (N - k / 2), as rounding adds half a
seat a party at most; so a party surely has the seats that the upper bound gives it, and bids for
those up to what the lower bound gives.  That is k bids more than parties in all, and the highest
fill what is left: the same seats as one at a time.

Cases: a null text has 0 words and takes 0; a null source is a source of its own; an empty table
gives an empty result; rows that share a doc_id, or have none, are taken each on its own words, and equal rows
take the same place one after another; columns other than doc_id, text and source, whatever their
names, are ignored by mix() and kept by choose().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stage

# The sources' weights, in turn.
WEIGHTS = (5, 2, 1)
WORDS = r"[^\x20\x09-\x0D]+"


def _size(text):
    """Words of a text: the starts of a run of other than ASCII white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORDS))).cast("long")


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, target: a row for each source, of which there are few beside the documents.

    The shares are weight * level up to a cap of most * source_size; the sources are capped in the
    order of cap / weight, so the level follows from running sums.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    w = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = w.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", (F.sum("source_size").over(whole) - F.col("capped")) / F.col("open"))
    # the first source whose cap is not reached sets the level for it and all after it
    w = w.withColumn("free", F.col("weight") * F.col("level") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("capped"), F.col("level")))).over(whole)["level"]
    share = F.coalesce(level * F.col("weight"), F.col("cap"))
    return w.select("source", "source_size", F.round(F.least(share, F.col("cap")), 6).alias("target"))


def apportion(parties: DataFrame, within: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """parties with `quota`, the seats that each gets of its group's by Sainte-Lague; ties go by `order`."""
    group = Window.partitionBy(*within)
    total, half = F.sum(votes).over(group), F.count(F.lit(1)).over(group) / 2
    # the seats that a divisor of total / n gives, less or more one for what floating point may miss
    given = lambda n: F.when(total > 0, F.floor(F.col(votes) * n / total + 0.5)).otherwise(F.lit(0))
    base = parties.withColumn("_sure", F.greatest(given(F.col(seats) - half) - 1, F.lit(0)).cast("long"))
    base = base.withColumn("_most", F.when(F.col(votes) > 0, given(F.col(seats) + half) + 1).otherwise(F.lit(0)).cast("long"))
    base = base.withColumn("_left", (F.col(seats) - F.sum("_sure").over(group)).cast("long"))
    bids = base.filter("_most > _sure").select(*within, *order, votes, "_left", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_seat"))
    bids = bids.withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
    top = Window.partitionBy(*within).orderBy(F.col("_quotient").desc(), *[F.col(c).asc_nulls_last() for c in order], F.col("_seat"))
    won = bids.filter("_left > 0").withColumn("_rank", F.row_number().over(top)).filter("_rank <= _left").groupBy(*within, *order).agg(F.count("*").alias("_won"))
    keys = [*within, *order]
    won = won.select(*[F.col(c).alias(f"_w_{c}") for c in keys], "_won")
    on = [base[c].eqNullSafe(won[f"_w_{c}"]) for c in keys]
    return base.join(won, on, "left").select(*[base[c] for c in parties.columns], (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _dealt(rows: DataFrame, block: int, shard_words: int, seed: str, most: float) -> DataFrame:
    """rows, with doc_id, source, size and content (a digest of id and text), and source_size, target, taken and shard.

    The seeded order of a shard's documents is the order of its blocks, of which the first are taken.
    """
    sizes = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    sources = targets(sizes, most)
    total = Window.partitionBy()
    sources = sources.withColumn("all_blocks", F.round(F.sum("target").over(total) / block).cast("long"))
    quotas = apportion(sources, [], "target", "all_blocks", ["source"]).withColumnRenamed("quota", "source_blocks")
    n_shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("int")
    quotas = stage(quotas.select(F.col("source").alias("q_source"), "source_size", "target", "source_blocks", n_shards.alias("n_shards")), "quotas")
    # a row per source, as the sources' names are known: small beside any table of documents
    dealt = rows.join(quotas, rows["source"].eqNullSafe(quotas["q_source"])).drop("q_source")
    dealt = dealt.withColumn("shard", (F.conv(F.substring("content", 1, 15), 16, 10).cast("long") % F.col("n_shards")).cast("int"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    shards = apportion(stage(shards, "shards"), ["source"], "shard_size", "source_blocks", ["shard"])
    # blocks are whole; the words a shard takes never go beyond `most` passes over it
    shards = shards.select(F.col("source").alias("s_"), F.col("shard").alias("k_"), "shard_size", F.least(F.col("quota") * block, F.floor(F.col("shard_size") * F.lit(float(most)))).cast("long").alias("words"))
    chosen = dealt.join(shards, dealt["source"].eqNullSafe(shards["s_"]) & (dealt["shard"] == shards["k_"]))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.col("content")))
    order = Window.partitionBy("source", "shard").orderBy(drawn, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("size").over(order) - F.col("size")
    rest = F.col("words") - passes * F.col("shard_size")
    extra = F.least(F.greatest(rest - before, F.lit(0)), F.col("size"))
    return chosen.withColumn("taken", (passes * F.col("size") + extra).cast("long"))


def _sized(docs: DataFrame) -> list:
    """doc_id, source, size and content, a digest of id and text, of a row."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    content = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return [doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), _size(text).alias("size"), content.alias("content")]


def mix(docs: DataFrame, block: int = 16, shard_words: int = 200_000, seed: str = "mix", most: float = 3.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken, the words that the mix takes of it.

    block: words in a block.  shard_words: words that a shard holds about, which bounds what one
    task orders; a source of any size is dealt over so many shards.
    """
    rows = stage(docs.select(*_sized(docs)), "sizes")
    return _dealt(rows, block, shard_words, seed, most).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


def choose(docs: DataFrame, block: int = 16, shard_words: int = 200_000, seed: str = "mix", most: float = 3.0) -> DataFrame:
    """The rows of docs of which the mix takes words, with size, source_size, target and taken.

    Where docs has a column of such a name, the new one is called mix_ and the name, with more
    underscores if that is taken too.  Rows go through the deal whole, in one shuffle by shard.
    """
    names = {}
    for c in ("size", "source_size", "target", "taken"):
        names[c] = c if c not in docs.columns else f"mix_{c}"
        while names[c] in docs.columns:
            names[c] += "_"
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _dealt(docs.select(*_sized(docs), row), block, shard_words, seed, most).filter("taken > 0")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in names.items()])
