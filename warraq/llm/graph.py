"""Connected components by star contraction, without collecting any group.

Every round replaces edges by edges to the smallest neighbour (first outward,
then inward), so chains shrink by a constant factor and the edge count never
grows. Minima are partial aggregates, so a hub that a third of all rows share is
combined before it is shuffled, and its joins are divided into shares; rounds are
cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import members


def star_edges(ties: DataFrame) -> DataFrame:
    """ties(rec, attr) -> edges (u, v), u > v, from each record to the smallest record of each attribute."""
    ties = ties.where("rec is not null and attr is not null")
    hubs = ties.groupBy("attr").agg(F.min("rec").alias("v"), F.count(F.lit(1)).alias("n"))
    large = members.large_keys(hubs, ["attr"], "n")
    return members.join_divided(hubs.where("n > 1").select("attr", "v"), ties, ["attr"], large, "rec").where("rec != v").select(F.col("rec").alias("u"), "v").distinct()


def _outward(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    large = members.large_keys(low, ["u"], "n")
    moved = members.join_divided(low.select("u", F.least("u", "m").alias("m")), both.where("v > u"), ["u"], large, "v")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _inward(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame):
    h = F.xxhash64("u", "v")
    return edges.agg(F.count("*"), F.sum((h % 1000003).cast("long")), F.bit_xor(h)).first()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) with u > v -> (rec, root) for every record of a component of two or more; root is the smallest."""
    edges = cut(edges.select("u", "v"))
    mark = _mark(edges)
    while True:
        edges = cut(_inward(_outward(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    found = edges.select(F.col("u").alias("rec"), F.col("v").alias("root"))
    return found.unionByName(edges.select(F.col("v").alias("rec"), F.col("v").alias("root")).distinct())
