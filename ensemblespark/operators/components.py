"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a min per node (partial aggregation, so a hub costs one row per task), one
equi-join of the edges with those minima and a distinct. Rows of a hub are so alike that their
partition is small in bytes and Spark would leave it whole, so the minima of nodes with more than
HUB neighbours, few by their number, are broadcast, and hubs' rows are never dealt out by node.
Edges never reach the driver; only their number does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks import forget, keep

#: Neighbours beyond which a node is a hub; there are at most as many hubs as edges over half of that.
HUB = 100_000


def _beside_least(rows: DataFrame, least: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (u, v) with their node's m of least (u, m, n), which is kept and returned besides."""
    least = keep(least)
    hubs = F.broadcast(least.where(F.col("n") > HUB).select("u", "m"))
    other = rows.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return other.unionByName(rows.join(hubs, "u")), least


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    beside, least = _beside_least(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    return beside.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    beside, least = _beside_least(down, down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    moved = beside.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reached.

    Null ends and self-loops are ignored; repeated edges count once; an empty edge table
    gives an empty result. Converged when a round changes no edge (fingerprints compared).
    """
    now = keep(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    seen = mark(now)
    while seen[0]:
        large, one = _large_star(now)
        large = keep(large)
        small, two = _small_star(large)
        after = keep(small)
        forget(now, one, large, two)
        now, last, seen = after, seen, mark(after)
        if last == seen:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
