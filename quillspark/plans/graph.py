"""Connected components over an edge table, as rounds of star contraction.

Each round is two aggregations and two joins on the node; a hot node's rows are
pre-aggregated before the shuffle and its join is open to AQE's skew splitting.
The edge table is written to the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.staging import Staged


def _settled(edges: DataFrame) -> bool:
    """Are all edges (u, v) rays of stars: every u once, and no v a u?"""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("ray"), F.lit(0).alias("hub")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("ray").alias("rays"), F.max("hub").alias("hub"))
    return ends.where("rays > 1 or (rays = 1 and hub = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the least node around u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (node, component): the least node that links reach.

    Only nodes with a link to another node appear; nulls and self-links are ignored.
    No rows come from no edges.  Direction and repeats of edges do not matter.
    """
    start = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    held = Staged(start)
    for _ in range(max_rounds):
        if _settled(held.df):
            break
        nxt = Staged(_small_star(_large_star(held.df)))
        held.drop()
        held = nxt
    else:
        raise RuntimeError("connected components did not settle")
    stars = held.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component"), F.col("component")).distinct())
