"""Sample matching target category proportions: swap repair over category signatures.

A record's signature is the set of categories it belongs to. Only the counts of
signatures reach the driver: with C categories given as bands of strata there
are at most strata x (2C + 1) of them. A random sample that satisfies the floors
is repaired by exchanging signature counts until no exchange lowers the
deviation from the targets; the records of each signature are then drawn by hash.

Defined results: repeated rows of an id count once (its categories are united); a
null or NaN disagreement, or a null stratum, belongs to no category; records
without an id are left out; rows without a category only fill up the sample; where
the floors together exceed the sample's size, scarce categories get theirs first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .thresholds import hash_order, prefix_thresholds, with_below

#: The target table is a small dimension; more rows than this are refused.
MOST_CATEGORIES = 2_000
BLANKS = r"^[\s\x{a0}]+|[\s\x{a0}]+$"


def load_targets(targets: DataFrame) -> list:
    rows = targets.where("category is not null").orderBy("category").limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} target categories")
    return rows


def signatures(pilot: DataFrame, cats: list) -> DataFrame:
    """id, sig: the categories of each id as a string of their numbers."""
    stratum = F.lower(F.regexp_replace("stratum", BLANKS, ""))
    x = F.col("disagreement")
    inside = [F.max(F.coalesce((stratum == c.stratum.strip().lower()) & ~F.isnan(x) & (x >= c.band_low) & (x < c.band_high), F.lit(False))).alias(f"c{i}") if c.stratum is not None and c.band_low is not None and c.band_high is not None else F.lit(False).alias(f"c{i}") for i, c in enumerate(cats)]
    per_id = pilot.where("id is not null").groupBy("id").agg(F.lit(0).alias("_"), *inside)
    return per_id.select("id", F.concat_ws(",", *(F.when(F.col(f"c{i}"), F.lit(str(i))) for i in range(len(cats)))).alias("sig"))


def floor_start(supply: np.ndarray, member: np.ndarray, floors: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A random sample of at most `size` signature counts that gives every category its floor where it can, scarce ones first."""
    take = np.zeros(len(supply), np.int64)
    for c in np.argsort(member.T @ supply, kind="stable"):
        lack = int(min(floors[c], member[:, c] @ supply) - member[:, c] @ take)
        lack = min(lack, size - int(take.sum()))
        if lack > 0:
            pool = np.where(member[:, c], supply - take, 0)
            take += rng.multivariate_hypergeometric(pool, min(lack, int(pool.sum())), method="marginals")
    rest = supply - take
    more = min(size - int(take.sum()), int(rest.sum()))
    return take + rng.multivariate_hypergeometric(rest, more, method="marginals") if more > 0 else take


def repair(take: np.ndarray, supply: np.ndarray, member: np.ndarray, want: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Exchanges counts between two signatures while that lowers the deviation and keeps the floors.

    For each signature that gives, all that can take are scored at once.
    """
    take = take.copy()
    floor_now = np.minimum(floors, member.T @ supply)

    def off(have):
        return np.abs(have - want).sum(-1) + 1e6 * np.maximum(floor_now - have, 0).sum(-1)

    step = max(1, int(take.sum()))
    while step >= 1:
        have = member.T @ take
        best, move = off(have) - 1e-9, None
        takers = np.flatnonzero(supply - take >= step)
        for i in np.flatnonzero(take >= step) if len(takers) else ():
            o = off(have - step * member[i] + step * member[takers])
            o[takers == i] = np.inf
            k = int(o.argmin())
            if o[k] < best:
                best, move = o[k], (i, takers[k])
        if move is None:
            step //= 2
        else:
            take[move[0]] -= step
            take[move[1]] += step
    return take


def draw(pilot: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample: id, sig; report: category, supply, wanted_rows, floor_rows, drawn_rows, drawn_share, unmet, falls_short).

    unmet: the sample as drawn has fewer rows of the category than its target
    (whole rows) or its floor, for want of supply or because targets conflict;
    falls_short: there are fewer rows than that in all.
    """
    spark = pilot.sparkSession
    cats = load_targets(targets)
    shape = "category string, supply long, wanted_rows double, floor_rows long, drawn_rows long, drawn_share double, unmet boolean, falls_short boolean"
    rows = cut(signatures(pilot, cats).withColumn("h", hash_order("id", seed=seed)))
    counts = rows.groupBy("sig").agg(F.count("*").alias("n")).orderBy("sig").collect()
    sigs = [r.sig for r in counts]
    supply = np.array([r.n for r in counts], np.int64)
    member = np.zeros((len(sigs), len(cats)), np.int64)
    for i, s in enumerate(sigs):
        for c in s.split(",") if s else []:
            member[i, int(c)] = 1
    size = max((c.sample_rows or 0 for c in cats), default=0)
    want = np.array([(c.target_share or 0.0) * (c.sample_rows or 0) for c in cats])
    floors = np.array([c.min_rows or 0 for c in cats], np.int64)
    have = member.T @ supply if len(sigs) else np.zeros(len(cats), np.int64)
    if len(sigs) and len(cats):
        take = repair(floor_start(supply, member, floors, size, np.random.default_rng(seed)), supply, member, want, floors)
    else:
        take = np.zeros(len(sigs), np.int64)
    drawn = member.T @ take if len(sigs) else have
    total = max(1, int(take.sum()))
    report = [(c.category, int(have[i]), float(want[i]), int(floors[i]), int(drawn[i]), float(drawn[i] / total), bool(drawn[i] < max(np.floor(want[i]), floors[i])), bool(have[i] < max(want[i], floors[i]))) for i, c in enumerate(cats)]
    budgets = {s: int(n) for s, n in zip(sigs, take) if n}
    cuts = prefix_thresholds(rows.withColumn("w", F.lit(1)), budgets, group="sig")
    sample = with_below(rows, cuts, "_in", group="sig").where("_in").select("id", "sig")
    return sample, spark.createDataFrame(report, shape)
