"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stage


def _star(edges: DataFrame, small: bool, tasks: int) -> DataFrame:
    """One star step on edges (u, v), u > v: neighbours are linked to the smallest of the neighbourhood.

    Minima are taken before they are shuffled and meet their edges again by a join, a row for each
    node; the edges of a node of very many links are no group there, and adaptive execution splits them.
    """
    if small:  # of each node, smaller neighbours only
        around = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    else:
        around = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    least = around.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m"))
    met = around.join(least, "node").coalesce(tasks)
    if small:
        new = met.select(F.col("other").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    else:
        new = met.filter("other > node").select(F.col("other").alias("u"), F.col("m").alias("v"))
    return new.filter("u <> v").distinct().coalesce(tasks)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link and none to a node that has a link of its own."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    node = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return node.filter("up > 1 OR up = 1 AND root = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of links (u, v): the smallest node that it reaches.

    Each round links larger neighbours to the smallest of the neighbourhood and then smaller ones,
    until every component is a star around its smallest node.
    """
    edges = stage(links.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u <> v").distinct(), "edges")
    # as few tasks as the links fill: most graphs here are small beside the documents
    tasks = 1 + edges.count() // 100_000
    while not _settled(edges):
        edges = stage(_star(stage(_star(edges, False, tasks), "large"), True, tasks), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
