"""Hash-threshold histograms: exact budgets per group without sorting.

Rows of a group are ordered by a hash. The largest prefix within a budget is
found by summing weights over hash buckets, keeping the whole buckets below the
budget and refining only the one bucket in which it ends, digit by digit. The
bucket in which a group's budget ends is found on the executors, so one row a
group reaches the driver each round, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the hash, and bits that one histogram resolves (4,096 sums a group).
BITS, DIGIT = 60, 12


def hash_order(*cols: Column | str, seed: int = 1) -> Column:
    """A uniform hash of 60 bits, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*(F.col(c) if isinstance(c, str) else c for c in cols), F.lit(seed)), 64 - BITS)


def prefix_thresholds(rows: DataFrame, budgets: dict[str, float], group: str = "grp", h: str = "h", weight: str = "w") -> dict[str, int]:
    """Largest threshold of each group such that its rows with hash below it weigh at most its budget.

    budgets holds the groups to resolve (a small dimension, which is broadcast).
    Groups whose rows all fit get 2**BITS or more.
    """
    spark = rows.sparkSession
    out, open_ = {}, {g: (0, float(b)) for g, b in budgets.items()}  # group -> (hash prefix, what is left)
    done_bits = 0
    while open_ and done_bits < BITS:
        shift = BITS - done_bits - DIGIT
        wanted = spark.createDataFrame([(g, p, left) for g, (p, left) in open_.items()], "_g string, _p long, _left double")
        digit = F.shiftright(F.col(h), shift).bitwiseAND((1 << DIGIT) - 1).cast("int")
        x = rows.select(F.col(group).alias("_g"), F.shiftright(F.col(h), shift + DIGIT).alias("_p"), digit.alias("d"), F.col(weight).alias("w"))
        sums = x.join(F.broadcast(wanted), ["_g", "_p"]).groupBy("_g", "_left", "d").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        run = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("_g").orderBy("d")))  # at most 4,096 rows a group
        ends = run.where("upto > _left").groupBy("_g").agg(F.min(F.struct("d", (F.col("_left") - F.col("upto") + F.col("w")).alias("rest"), "n")).alias("e"))
        found = {r["_g"]: r.e for r in ends.collect()}
        nxt = {}
        for g, (p, _) in open_.items():
            e = found.get(g)
            if e is None:
                out[g] = (p + 1) << (shift + DIGIT)
                continue
            at = (p << DIGIT) | e.d
            if e.n == 1 or shift == 0:  # a single row, or rows of one hash: they stay out together
                out[g] = at << shift
            else:
                nxt[g] = (at, e.rest)
        open_ = nxt
        done_bits += DIGIT
    return out


def with_below(rows: DataFrame, thresholds: dict[str, int], out: str, group: str = "grp", h: str = "h") -> DataFrame:
    """Adds whether a row lies under its group's threshold; rows of other groups do not."""
    cuts = rows.sparkSession.createDataFrame([(g, t) for g, t in thresholds.items()], "_g string, _t long")
    x = rows.join(F.broadcast(cuts), F.col(group) == F.col("_g"), "left")
    return x.withColumn(out, F.coalesce(F.col(h) < F.col("_t"), F.lit(False))).drop("_g", "_t")
