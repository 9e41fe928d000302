"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

MOST_ROUNDS = 50


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``u``, itself included; counted before the shuffle, so a hub is one row a task."""
    return edges.groupBy(F.col("u").alias("w")).agg(F.least(F.col("w"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the star is made from, written; and the star."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    down = scratch.cut(down, "down")
    least = _least(down)
    told = down.join(least, F.col("u") == F.col("w"))
    return down, told.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to another: root is the smallest node of its component.

    ``links`` has two long columns, ``a`` and ``b``; order, repeats and links of a node to itself don't matter. Each
    round is joins and aggregations over the links; hubs are split by skew handling of the joins. Nulls link nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct()
    edges, before = scratch.cut(edges, "edges"), None
    for _ in range(MOST_ROUNDS):
        down, small = _small_star(_large_star(edges))
        old, edges = edges, scratch.cut(small, "edges")
        scratch.drop(old, down)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
