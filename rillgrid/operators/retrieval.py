"""Exact nearest neighbours by inner product, and BM25."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def knn(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 5, block: int = 4096) -> DataFrame:
    """query, key, score, rank: each query's k rows of the largest inner product, ties to the smallest key.

    The queries are the stated set; they pass through the driver and go out in blocks of at most
    `block`.  A task of the base keeps its own k best of each query over all its batches, so
    what is shuffled follows the tasks and not the base's rows.
    """
    out = None
    found = queries.select(key, vector).toLocalIterator()
    spark = base.sparkSession
    while part := list(islice(found, block)):
        ids = np.array([r[0] for r in part], np.int64)
        sent = spark.sparkContext.broadcast((ids, np.array([r[1] for r in part], np.float64).reshape(len(part), -1)))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            top, keys = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            for b in batches:
                if not len(b):
                    continue
                top = np.concatenate([top, np.round(q @ np.stack(b["v"].to_numpy()).astype(np.float64).T, digits)], 1)
                keys = np.concatenate([keys, np.broadcast_to(b["k"].to_numpy(), (len(ids), len(b)))], 1)
                order = np.lexsort((keys, -top), axis=1)[:, :k]
                top, keys = np.take_along_axis(top, order, 1), np.take_along_axis(keys, order, 1)
            yield pd.DataFrame({"query": np.repeat(ids, keys.shape[1]), "key": keys.ravel(), "score": top.ravel()})

        rows = base.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).filter("v IS NOT NULL").mapInPandas(best, "query long, key long, score double")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "query long, key long, score double, rank int")
    top = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return out.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, k: int, k1: float = 0.9, b: float = 0.4, few: int = 20_000) -> DataFrame:
    """query, key, score, rank of each query's k best documents; words are runs of word characters in lower case."""
    split = lambda c: F.split(F.lower(c), r"\W+")
    terms = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(split(F.col("text")))).alias("w")).filter("w <> ''")
    sized = docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).withColumn("len", F.regexp_count("text", F.lit(r"\w+")))
    n, mean = sized.agg(F.count(F.lit(1)), F.avg("len")).first()
    # up to `few` words of the queries are sent to the scan, so that no other word leaves it; more are joined
    wanted = stored(terms.select("w").distinct(), "words")
    tokens = sized.select("key", "len", F.explode(F.split("text", r"\W+")).alias("w"))
    tokens = tokens.join(F.broadcast(wanted) if wanted.count() <= few else wanted, "w", "left_semi")
    tf = stored(tokens.groupBy("w", "key", "len").agg(F.count(F.lit(1)).alias("tf")), "frequencies")
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
    scored = tf.join(df, "w").withColumn("g", gain).join(terms, "w").groupBy("query", "key").agg(F.round(F.sum("g"), 6).alias("score"))
    top = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return scored.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def documents(hits: DataFrame, corpus: DataFrame, key: str, text: str) -> DataFrame:
    """hits with the title (first line, without quotes) and text (the other lines) of their documents."""
    c = F.col(text)
    title = F.regexp_replace(F.substring_index(c, "\n", 1), '^"|"$', "")
    body = F.when(F.contains(c, F.lit("\n")), F.regexp_replace(c, r"^[^\n]*\n", "")).otherwise("")
    return hits.join(corpus.select(F.col(key).alias("key"), title.alias("title"), body.alias("text"), c.alias("contents")), "key")


def served(hits: DataFrame) -> DataFrame:
    """One row for each query: its hits as an array of (document, score) in rank order."""
    h = F.array_sort(F.collect_list(F.struct("rank", F.struct("key", "title", "text").alias("document"), "score")))
    return hits.groupBy("query").agg(h.alias("_h")).select("query", F.transform("_h", lambda x: F.struct(x["document"].alias("document"), x["score"].alias("score"))).alias("hits"))


def contains_text(corpus: DataFrame) -> bool:
    """Whether an index's table holds the documents themselves."""
    return any(c in corpus.columns for c in ("contents", "text"))


class Retriever:
    """Searches a corpus: `search` for one query's text, `batch_search` for a table of queries (query, and text or vector)."""

    def __init__(self, corpus: DataFrame, key: str, k: int = 10):
        self.corpus, self.key, self.k = corpus, key, k

    def batch_search(self, queries: DataFrame) -> DataFrame:
        raise TypeError("a retriever of a kind is needed")

    def search(self, query) -> list[dict]:
        spark = self.corpus.sparkSession
        kind = "string" if isinstance(query, str) else "array<double>"
        name = "text" if isinstance(query, str) else "vector"
        return [r.asDict() for r in self.batch_search(spark.createDataFrame([(0, query)], f"query long, {name} {kind}")).orderBy("rank").collect()]


class WordRetriever(Retriever):
    """BM25 over a text column."""

    def batch_search(self, queries: DataFrame) -> DataFrame:
        return bm25(self.corpus, queries, self.key, "text", "query", self.k)


class DenseRetriever(Retriever):
    """Exact inner products with a vector column."""

    def batch_search(self, queries: DataFrame) -> DataFrame:
        q = queries.select(F.col("query").alias(self.key), F.col("vector").alias("vector"))
        return knn(self.corpus, q, self.key, "vector", self.k)


def retriever(name: str, corpus: DataFrame, key: str, k: int = 10) -> Retriever:
    """A retriever by its name: bm25, or else one over vectors."""
    return (WordRetriever if name == "bm25" else DenseRetriever)(corpus, key, k)


def encoded_query(text, model: str, is_query: bool = True):
    """The prefix that a family of encoders wants before a text."""
    if "e5" in model.lower():
        return F.concat(F.lit("query: " if is_query else "passage: "), text)
    if "bge" in model.lower() and is_query:
        return F.concat(F.lit("Represent this sentence for searching relevant passages: "), text)
    return text


def unit(vector):
    """A vector over its Euclidean length."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(vector, lambda x: x / size)


def pooled(df: DataFrame, sequence: list[str], order: str, vector: str, mask: str | None = None, how: str = "mean") -> DataFrame:
    """One vector for each sequence of token vectors: the mean of masked ones, or that of the first token."""
    if how == "first":
        return df.groupBy(*sequence).agg(F.min_by(vector, order).alias("vector"))
    if how != "mean":
        raise ValueError(how)
    rows = df if mask is None else df.filter(F.col(mask) > 0)
    one = rows.select(*sequence, F.posexplode(vector).alias("i", "x")).groupBy(*sequence, "i").agg(F.avg("x").alias("x"))
    return one.groupBy(*sequence).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
