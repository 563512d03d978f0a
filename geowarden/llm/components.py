"""Connected components by alternating large-star and small-star rounds, all of it in DataFrames.

Every round is two joins and two aggregates over the edges that are left; nothing is collected
but one count and one checksum a round.  Edges turn into stars whose centre is the smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that ``links`` names, root being the smallest node it reaches.

    Null ends and self links are left out; repeated and mirrored links do no harm; no links give
    an empty table.  A node of any degree costs no more than its edges: neighbours are aggregated,
    never gathered, and the join on a hot node has one row on its other side, which adaptive
    execution splits.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v").distinct()
    edges, before = durable(edges), None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = (seen["n"], seen["s"])
        if now == before or not now[0]:
            break
        before = now
        edges = durable(_small_star(_large_star(edges)))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
