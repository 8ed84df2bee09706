"""Cluster bootstrap: paired draws of clusters, pooled counts, percentile intervals.

The count table of the clusters is small by nature (one row a prompt or
utterance of an evaluation set); its size is checked. Replicates are worked
through in blocks of a bounded size.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rates as R

MOST_CLUSTERS = 200_000
#: Draws of one generator, and numbers of a block of replicates.
MOST_DRAWS, BLOCK_CELLS = 50_000_000, 4_000_000


def _f1(c: np.ndarray) -> np.ndarray:
    fr, fa, tr = c[:, 0], c[:, 1], c[:, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        p, r = tr / (tr + fr), tr / (tr + fa)
        return np.where(p + r != 0, 2 * p * r / (p + r), np.nan)


def _frr(c: np.ndarray) -> np.ndarray:
    ta, fr = c[:, 0], c[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(ta + fr > 0, fr / (ta + fr), np.nan)


RATES = {"f1": (("fr", "fa", "tr"), _f1), "frr": (("ta", "fr"), _frr)}


def draws(k: int, replicates: int, seed: int):
    """Blocks of rows, one a replicate: how often each of k clusters is drawn.

    One generator serves all replicates in turn, as published intervals have it. A
    block holds at most BLOCK_CELLS numbers, whatever k and the replicates.
    """
    r = random.Random(seed)
    rows = max(1, BLOCK_CELLS // k)
    for lo in range(0, replicates, rows):
        yield np.stack([np.bincount([r.randrange(k) for _ in range(k)], minlength=k) for _ in range(min(rows, replicates - lo))]).astype(float)


def paired_bootstrap(base: DataFrame, other: DataFrame, cluster: str, replicates: int, seed: int, rate: str = "f1") -> DataFrame:
    """One row: delta of the rate (other - base), interval, sd, excludes_zero.

    One draw serves both arms. Bounds are order statistics at int(.025 B) and
    min(int(.975 B), B - 1); sd has B - 1 degrees; NaN replicates come last. The
    draws of one generator follow one another, so they are made in one place: at
    most MOST_DRAWS of them (portable_bootstrap has no such bound).
    """
    names, f = RATES[rate]
    x = base.select(cluster, *(F.col(c).alias(f"a_{c}") for c in names)).join(other.select(cluster, *(F.col(c).alias(f"b_{c}") for c in names)), cluster)
    rows = x.orderBy(cluster).limit(MOST_CLUSTERS + 1).collect()
    if not rows or len(rows) > MOST_CLUSTERS or len(rows) * replicates > MOST_DRAWS:
        raise ValueError(f"a bootstrap needs 1 to {MOST_CLUSTERS} shared clusters and at most {MOST_DRAWS} draws, not {len(rows)} clusters {replicates} times")
    a = np.array([[r[f"a_{c}"] for c in names] for r in rows], float)
    b = np.array([[r[f"b_{c}"] for c in names] for r in rows], float)
    deltas = np.concatenate([f(m @ b) - f(m @ a) for m in draws(len(rows), replicates, seed)])
    order = np.sort(deltas)
    lo, hi = float(order[int(0.025 * replicates)]), float(order[min(int(0.975 * replicates), replicates - 1)])
    sd = float(deltas.std(ddof=1)) if replicates > 1 else None
    point = float(f(b.sum(0)[None])[0] - f(a.sum(0)[None])[0])
    return base.sparkSession.createDataFrame([(len(rows), point, lo, hi, sd, lo > 0 or hi < 0)], "clusters int, delta double, low double, high double, sd double, excludes_zero boolean")


def portable_bootstrap(counts: DataFrame, cluster: str, value: str, weight: str, replicates: int, multiplier: int = 48_271, modulus: int = 2_147_483_647) -> DataFrame:
    """Mean of value over weight for each replicate, with draws from a congruential generator that SQL can repeat.

    The draw at place i of replicate r takes the cluster numbered
    ((r * 7919 + i * 104729 + 12345) * multiplier mod modulus) mod K.
    """
    k = counts.count()
    if k > MOST_CLUSTERS:
        raise ValueError(f"resampling takes at most {MOST_CLUSTERS} clusters")
    numbered = counts.select(F.row_number().over(Window.orderBy(cluster)).alias("_i"), value, weight).withColumn("_i", F.col("_i") - 1)
    spark = counts.sparkSession
    picks = spark.range(replicates).withColumnRenamed("id", "replicate").select("replicate", F.explode(F.sequence(F.lit(0), F.lit(max(k - 1, 0)))).alias("_p"))
    picks = picks.select("replicate", F.pmod(F.pmod((F.col("replicate") * 7919 + F.col("_p") * 104_729 + 12_345) * multiplier, F.lit(modulus)), F.lit(max(k, 1))).cast("int").alias("_i"))
    return picks.join(numbered, "_i").groupBy("replicate").agg((F.sum(value) / F.sum(weight)).alias("rate"))


def _replicates(f, a: np.ndarray, n: int, p: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """The rate of each replicate that has one, in blocks of bounded size."""
    rng, rows = np.random.default_rng(seed), max(1, BLOCK_CELLS // len(a))
    v = np.concatenate([f(rng.multinomial(n, p, size=min(rows, replicates - lo)) @ a) for lo in range(0, replicates, rows)])
    return v[~np.isnan(v)]


def delta_by_cluster(base: DataFrame, other: DataFrame, cluster: str, empty: str = "nan") -> DataFrame:
    """cluster, delta of F1 of each shared cluster's own counts (other - base)."""
    f1 = lambda t, n: t.select(cluster, R.detection_rates(empty=empty)["f1"].alias(n))
    return f1(base, "_a").join(f1(other, "_b"), cluster).select(cluster, (F.col("_b") - F.col("_a")).alias("delta"))


def cluster_se(counts: DataFrame, cluster: str, replicates: int, seed: int, rate: str = "f1") -> DataFrame:
    """Standard error of a pooled rate under cluster resampling (sd of replicates)."""
    names, f = RATES[rate]
    rows = counts.select(cluster, *names).orderBy(cluster).limit(MOST_CLUSTERS + 1).collect()
    if not rows or len(rows) > MOST_CLUSTERS:
        raise ValueError(f"resampling needs 1 to {MOST_CLUSTERS} clusters")
    a = np.array([[r[c] for c in names] for r in rows], float)
    v = _replicates(f, a, len(a), np.full(len(a), 1 / len(a)), replicates, seed)
    se = float(v.std(ddof=1)) if len(v) > 1 else float("nan")
    return counts.sparkSession.createDataFrame([(len(a), se)], "clusters int, se double")


def clip_equivalent_se(counts: DataFrame, cluster: str, clips: str, draws_: int, replicates: int, seed: int, rate: str = "f1") -> DataFrame:
    """Standard error when clusters are drawn in proportion to their clips, each draw adding a clip's share of the counts."""
    names, f = RATES[rate]
    rows = counts.where(F.col(clips) > 0).select(cluster, clips, *names).orderBy(cluster).limit(MOST_CLUSTERS + 1).collect()
    if not rows or len(rows) > MOST_CLUSTERS:
        raise ValueError(f"resampling needs 1 to {MOST_CLUSTERS} clusters")
    n = np.array([r[clips] for r in rows], float)
    a = np.array([[r[c] for c in names] for r in rows], float) / n[:, None]
    v = _replicates(f, a, draws_, n / n.sum(), replicates, seed)
    return counts.sparkSession.createDataFrame([(len(rows), float(v.std(ddof=1)) if len(v) > 1 else float("nan"))], "clusters int, se double")
