"""Joins by keys of which one may hold a third of all rows: large keys are divided into shares.

A key that many rows have is divided into shares of a bounded number of rows, and
the other side's row is repeated once for each share; a key with few rows is one
share and nothing is repeated for it. Only the MOST_LARGE largest keys are looked at: any other has at
most one MOST_LARGE-th of all rows, so their list has a fixed size and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one share, and keys that are divided.
SHARE, MOST_LARGE = 20_000, 2_000


def digest(c: str, name: str) -> list[Column]:
    """128 bits of a text as two numbers: long keys are joined by these, not by their texts."""
    return [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit(7), c).alias(f"{name}2")]


def large_keys(counts: DataFrame, key: list[str], count: str) -> DataFrame:
    """counts(key..., count) -> key..., _shares of the keys with more rows than a share holds, the largest MOST_LARGE of them."""
    n = counts.where(F.col(count) > SHARE).groupBy(*key).agg(F.max(count).alias("_n"))
    return n.orderBy(F.desc("_n"), *key).limit(MOST_LARGE).select(*key, F.ceil(F.col("_n") / SHARE).cast("int").alias("_shares"))


def expand(pairs: DataFrame, members: DataFrame, key: list[str], count: str, member: str) -> DataFrame:
    """pairs(key..., count = members of the key, ...) joined with members(key..., member): one row a pair and member."""
    return join_divided(pairs, members, key, large_keys(pairs, key, count), member)


def join_divided(few: DataFrame, many: DataFrame, key: list[str], large: DataFrame, member: str) -> DataFrame:
    """An inner join by key; rows of `many` go to shares by `member`, rows of `few` to all shares of their key."""
    large = F.broadcast(large)  # at most MOST_LARGE rows
    one = F.coalesce("_shares", F.lit(1))
    m = many.join(large, key, "left").withColumn("_share", F.pmod(F.xxhash64(member, F.lit(3)), one).cast("int")).drop("_shares")
    p = few.join(large, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), one - 1))).drop("_shares")
    return p.join(m, [*key, "_share"]).drop("_share")
