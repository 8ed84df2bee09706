"""Samples: seeded draws, stratified picks, deterministic batches.

`draw` repeats the generator of a small pool on the driver (the order is part of
the result). `hash_draw` is the scalable draw: a top-k by hash, another draw.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import with_place

#: A driver-side draw refuses pools of more ids than this.
MOST_IDS = 1_000_000


def draw(pool: DataFrame, size: int, seed: int, id_: str = "id") -> DataFrame:
    """size ids without replacement in draw order (column rank); an error if the pool is smaller."""
    ids = [r[0] for r in pool.select(id_).distinct().orderBy(id_).limit(MOST_IDS + 1).collect()]
    if len(ids) > MOST_IDS:
        raise ValueError("the pool is too large for a driver-side draw; use hash_draw")
    if size > len(ids):
        raise ValueError(f"cannot draw {size} of {len(ids)}")
    picked = random.Random(seed).sample(ids, size)
    order = pool.sparkSession.createDataFrame([(x, i) for i, x in enumerate(picked)], f"{id_} {pool.schema[id_].dataType.simpleString()}, rank int")
    return pool.join(order, id_)


def hash_key(id_: str | Column, seed: int) -> Column:
    """An order by multiplication and remainder that any SQL engine can repeat, from the digits of an id."""
    c = F.col(id_) if isinstance(id_, str) else id_
    n = F.coalesce(F.expr("0L") + F.regexp_replace(c.cast("string"), "[^0-9]", "").substr(1, 15).try_cast("long"), F.lit(0))
    return F.pmod((F.pmod(n, F.lit(1_000_003)) + seed) * 48_271, F.lit(2_147_483_647))


def hash_draw(pool: DataFrame, size: int, seed: int, id_: str = "id") -> DataFrame:
    """size rows, the first by hash order; ties by id. A top-k, no full sort."""
    return pool.orderBy(hash_key(id_, seed), id_).limit(size)


def stratified_pick(rows: DataFrame, score: str, half: int, seed: int, id_: str = "id") -> DataFrame:
    """Half from the 4 x half rows of highest score, half from all rows not yet picked, by hash order; column stratum_pick says which."""
    top = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).orderBy(F.desc(score), id_).limit(4 * half)
    high = hash_draw(top, half, seed, id_).withColumn("stratum_pick", F.lit("high"))
    rest = rows.join(high.select(id_).distinct(), id_, "left_anti")
    return high.unionByName(hash_draw(rest, half, seed + 1, id_).withColumn("stratum_pick", F.lit("uniform")))


def stratified_draw(rows: DataFrame, score: str, size: int, seed: int, id_: str = "id") -> DataFrame:
    """stratified_pick with one seeded generator over a small pool, in draw order: id, stratum, rank.

    Ranked by score (ties by id; null and NaN last), half of the size comes from the
    4 x half first, the rest from all others; fewer where there are fewer rows.
    """
    s = F.when(~F.isnan(score), F.col(score))
    ids = [r[0] for r in rows.groupBy(id_).agg(F.max(s).alias("_s")).orderBy(F.desc_nulls_last("_s"), id_).limit(MOST_IDS + 1).collect()]
    if len(ids) > MOST_IDS:
        raise ValueError("the pool is too large for a driver-side draw; use stratified_pick")
    g, half = random.Random(seed), size // 2
    tail = ids[: max(4 * half, 1)]
    high = g.sample(tail, min(half, len(tail)))
    rest = [x for x in ids if x not in set(high)]
    picked = [(x, "high_disagreement") for x in high] + [(x, "uniform_random") for x in g.sample(rest, min(size - len(high), len(rest)))]
    return rows.sparkSession.createDataFrame([(*p, i) for i, p in enumerate(picked)], f"{id_} {rows.schema[id_].dataType.simpleString()}, stratum string, rank int")


def length_batches(rows: DataFrame, length: str, budget: int, by: str, id_: str = "id") -> DataFrame:
    """Batches of similar length inside each bucket `by`: column batch, longest first, at most `budget` rows each."""
    x = with_place(rows, [by], [-F.col(length), F.col(id_)], "_place")
    return x.withColumn("batch", F.floor(F.col("_place") / budget).cast("int")).drop("_place")


def halve_oversized(batches: DataFrame, length: str, by: list[str], most: int, id_: str = "id") -> DataFrame:
    """Batches whose longest row exceeds `most` keep their longer half (rounded down, at least one row); longest first."""
    g = batches.groupBy(*by).agg(F.max(length).alias("_most"), F.count("*").alias("_n"))
    keep = F.when((F.col("_most") > most) & (F.col("_n") > 1), F.floor(F.col("_n") / 2)).otherwise(F.col("_n"))
    w = Window.partitionBy(*by).orderBy(F.desc(length), id_)  # a batch is bounded
    x = batches.join(g.select(*by, keep.alias("_keep")), by).withColumn("_i", F.row_number().over(w))
    return x.where(F.col("_i") <= F.col("_keep")).drop("_i", "_keep")


def key_prefix(rows: DataFrame, key: str, limit: int | None) -> DataFrame:
    """The first `limit` rows in key order (all, if none is given)."""
    return rows if limit is None else rows.orderBy(key).limit(limit)


def top_k(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def nth_of(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """For each key its n-th row, n counted around."""
    w = Window.partitionBy(by)
    x = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return x.where(F.col("_i") == F.pmod(F.lit(n), F.col("_n"))).drop("_i", "_n")
