"""Rates from pooled counts, intervals and power: plain column arithmetic.

Division never raises: a zero denominator gives NaN, zero or null, as the policy
says. NaN is larger than every number in Spark, so thresholds are guarded.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY = {"nan": lambda: F.lit(float("nan")), "zero": lambda: F.lit(0.0), "null": lambda: F.lit(None).cast("double")}
# Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054
# Fixed value: the sum of the normal quantiles for 5 % two-sided and 80 % power.
POWER_Z = 2.8015852


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ratio(n, d, empty: str = "nan") -> Column:
    n, d = _c(n).cast("double"), _c(d).cast("double")
    return F.when(d != 0, F.try_divide(n, d)).otherwise(EMPTY[empty]())


def above(x, limit) -> Column:
    """x > limit, false for NaN and null."""
    c = _c(x)
    return F.coalesce(~F.isnan(c) & (c > _c(limit)), F.lit(False))


def within(x, centre: float, band: float) -> Column:
    c = _c(x)
    return F.coalesce(~F.isnan(c) & (F.abs(c - centre) <= band), F.lit(False))


def detection_rates(ta="ta", fr="fr", fa="fa", tr="tr", cd="cd", ed="ed", empty: str = "nan") -> dict[str, Column]:
    """precision, recall, f1, far, frr, der, accuracy of pooled counts."""
    ta, fr, fa, tr, cd, ed = map(_c, (ta, fr, fa, tr, cd, ed))
    p, r = ratio(tr, tr + fr, empty), ratio(tr, tr + fa, empty)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r, empty), "far": 1 - r, "frr": ratio(fr, fr + ta, empty), "der": ratio(ed, ed + cd, empty), "accuracy": ratio(ta + tr, ta + tr + fr + fa, empty)}


def official_rates(ta="ta", fr="fr", fa="fa", tr="tr", cd="cd", ed="ed") -> dict[str, Column]:
    """The organizers' convention: zero where nothing was counted, shares by row of the confusion."""
    ta_, fr_, fa_, tr_, cd_, ed_ = map(_c, (ta, fr, fa, tr, cd, ed))
    base = detection_rates(ta_, fr_, fa_, tr_, cd_, ed_, "zero")
    return base | {"ta_share": ratio(ta_, ta_ + fr_, "zero"), "fr_share": ratio(fr_, ta_ + fr_, "zero"), "fa_share": ratio(fa_, fa_ + tr_, "zero"), "tr_share": ratio(tr_, fa_ + tr_, "zero"), "cd_share": ratio(cd_, cd_ + ed_, "zero"), "ed_share": ratio(ed_, cd_ + ed_, "zero"), "per": 1 - base["accuracy"]}


def wilson(k, n) -> tuple[Column, Column]:
    """95 % score interval in percent, clamped; (0, 0) without trials."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    some = F.when(n > 0, n)
    p, zz = k / some, Z95 * Z95
    d = 1 + zz / some
    centre = (p + zz / (2 * some)) / d
    half = Z95 * F.sqrt(p * (1 - p) / some + zz / (4 * some * some)) / d
    known = lambda c: F.when(n > 0, c * 100).otherwise(0.0)
    return known(F.greatest(centre - half, F.lit(0.0))), known(F.least(centre + half, F.lit(1.0)))


def _tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials."""
    if p <= 0 or p >= 1:
        return 1.0 if p <= 0 or k >= n else 0.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


def exact_interval(k: int, n: int, level: float = 0.95, steps: int = 200) -> tuple[float, float]:
    """Clopper-Pearson bounds by bisection; (0, 1) without trials."""
    if n <= 0:
        return 0.0, 1.0
    side = (1 - level) / 2

    def solve(rises) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if rises(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: 1 - _tail(k - 1, n, p) < side)
    high = 1.0 if k == n else solve(lambda p: _tail(k, n, p) > side)
    return low, high


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([exact_interval(int(a), int(b)) if a == a and b == b else (None, None) for a, b in zip(k, n)], columns=["low", "high"], dtype=float)


def did_error(se, k, rho) -> Column:
    """Standard error of a difference of differences: a second arm of k times the variance, correlated by rho."""
    k, rho = _c(k), _c(rho)
    return _c(se) * F.sqrt(1 + k - 2 * rho * F.sqrt(k))


def detectable(se, k, rho) -> Column:
    """Smallest difference of differences found with 80 % power."""
    return POWER_Z * did_error(se, k, rho)


def recommendation(mde, threshold) -> Column:
    """struct(decision, margin): keep where the detectable difference lies below the threshold, else cut; null and NaN are cut."""
    m = _c(mde)
    keep = F.coalesce(~F.isnan(m) & (m < _c(threshold)), F.lit(False))
    return F.struct(F.when(keep, "keep").otherwise("cut").alias("decision"), F.when(m != 0, _c(threshold) / m).alias("margin"))


def order_statistic(values: Column, index: Column) -> Column:
    """The element of the sorted values at a 0-based place; no interpolation."""
    return F.get(F.sort_array(values), index.cast("int"))
