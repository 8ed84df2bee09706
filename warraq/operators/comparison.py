"""Joins with guards and comparisons of results: three-way joins, ordinals, label and metric differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonemes as P
from ..functions import rates as R
from ..functions.alignment import alignment


def three_way(hyp: DataFrame, ref: DataFrame, canon: DataFrame, key: str = "id", value: str = "tokens") -> DataFrame:
    """key, hyp, ref, canon: an inner join that refuses keys which any of the three lacks."""
    parts = [t.select(key, F.col(value).alias(n), F.lit(1).alias(f"_{n}")) for n, t in (("hyp", hyp), ("ref", ref), ("canon", canon))]
    x = parts[0].join(parts[1], key, "full_outer").join(parts[2], key, "full_outer")
    lacking = x.where("_hyp is null or _ref is null or _canon is null")
    if not lacking.isEmpty():
        raise ValueError(f"the three tables do not hold the same {key} values")
    return x.select(key, "hyp", "ref", "canon")


def zip_by_ordinal(a: DataFrame, b: DataFrame, ordinal: str) -> DataFrame:
    """Rows of equal place side by side; refuses tables of different length or with repeated places."""
    n, m, both = a.count(), b.count(), a.select(ordinal).join(b.select(ordinal), ordinal).count()
    if not n == m == both:
        raise ValueError(f"{n} and {m} rows, {both} shared places")
    return a.join(b, ordinal)


def label_differences(a: DataFrame, b: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """by, rows, different, distance: where two labellings of the same keys differ."""
    x = a.select(key, by, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    x = x.select(by, P.tokens(F.coalesce("_a", F.lit(""))).alias("p"), P.tokens(F.coalesce("_b", F.lit(""))).alias("q"))
    return x.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(F.col("p") != F.col("q")).alias("different"), F.sum(P.token_distance("p", "q")).alias("distance"))


def metric_deltas(ours: DataFrame, theirs: DataFrame, key: str, metrics: list[str], tolerance: float) -> DataFrame:
    """key, metric, ours, theirs, delta, agrees; NaN agrees with NaN only."""
    pick = lambda t, n: t.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select(key, "x.metric", F.col("x.v").alias(n))
    x = pick(ours, "ours").join(pick(theirs, "theirs"), [key, "metric"])
    both_nan = F.isnan("ours") & F.isnan("theirs")
    return x.withColumn("delta", F.col("ours") - F.col("theirs")).withColumn("agrees", both_nan | R.within(F.col("delta"), 0.0, tolerance))


def uniform_sign(rows: DataFrame, value: str, band: float) -> DataFrame:
    """verdict: 'within' if all values lie in the band, 'shifted' if all have one sign, else 'mixed'; null and NaN are left out."""
    c = F.col(value)
    g = rows.where(c.isNotNull() & ~F.isnan(c)).agg(F.max(F.abs(c)).alias("far"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    return g.select(F.when(F.col("far") <= band, "within").when((F.col("lo") > 0) | (F.col("hi") < 0), "shifted").otherwise("mixed").alias("verdict"))


def tiered_order(rows: DataFrame, tiers: list[Column], distance: str, key: str) -> DataFrame:
    """Adds tier (the first condition that holds, counted from 0; last without any); orders by tier, far first, key."""
    t = F.lit(len(tiers))
    for i, c in reversed(list(enumerate(tiers))):
        t = F.when(c, i).otherwise(t)
    return rows.withColumn("tier", t).orderBy("tier", F.desc(F.coalesce(distance, F.lit(0))), key)


def recovery_summary(choices: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """located, unique, ambiguous and missing keys; neither table is sent to the driver for the join."""
    x = wanted.select(key).distinct().join(choices.select(key, "candidates").hint("merge"), key, "left")
    n = F.col("candidates")
    return x.agg(F.count("*").alias("queries"), F.count_if(n.isNotNull()).alias("located"), F.count_if(n == 1).alias("unique_place"), F.count_if(n > 1).alias("ambiguous"), F.count_if(n.isNull()).alias("missing"))


def require_identity(block: DataFrame, seed: int, size: int) -> DataFrame:
    """A block with its seed and size columns, or an error if either differs from what is expected."""
    r = block.agg(F.count("*").alias("n"), F.min("seed").alias("lo"), F.max("seed").alias("hi")).first()
    if (r.n, r.lo, r.hi) != (size, seed, seed):
        raise ValueError(f"expected {size} rows of seed {seed}, found {r.n} of {r.lo} to {r.hi}")
    return block


def length_band(rows: DataFrame, words: str, least: int, most: int) -> DataFrame:
    return rows.where(F.size(words).between(least, most))


def correct_rates(rows: DataFrame, reference: str, hypothesis: str, by: list[str]) -> DataFrame:
    """Length-weighted correct rate and accuracy, to four places; rows with an empty reference are left out.

    correct = (n - D - S) / n and accuracy = (n - D - S - I) / n of the pooled columns.
    """
    x = rows.select(*by, P.tokens(F.coalesce(F.col(reference), F.lit(""))).alias("r"), P.tokens(F.coalesce(F.col(hypothesis), F.lit(""))).alias("h")).where("size(r) > 0")
    x = x.groupBy(*by, "r", "h").agg(F.count("*").alias("w")).withColumn("o", alignment("r", "h"))
    n_of = lambda k: F.size(F.filter("o", lambda c: c["op"] == k)) * F.col("w")
    g = x.groupBy(*by).agg(F.sum(F.size("r") * F.col("w")).alias("tokens"), *(F.sum(n_of(k)).alias(n) for k, n in (("S", "substitutions"), ("D", "deletions"), ("I", "insertions"))))
    bad = F.col("deletions") + F.col("substitutions")
    return g.select("*", F.round(R.ratio(F.col("tokens") - bad, "tokens"), 4).alias("correct_rate"), F.round(R.ratio(F.col("tokens") - bad - F.col("insertions"), "tokens"), 4).alias("accuracy"))


# The scorer's columns, of all symbols and of vowels only.
SCORED_COLUMNS = {False: ("Reference_phn", "Annotation_phn"), True: ("Reference_vow_phn", "Annotation_vow_phn")}


def scored_columns(truth: DataFrame, vowels_only: bool = False, key: str = "ID") -> DataFrame:
    """key, reference, annotation of the table that a scorer is given; an error if it lacks one."""
    ref, ann = SCORED_COLUMNS[vowels_only]
    if not {key, ref, ann} <= set(truth.columns):
        raise KeyError(f"{key}, {ref} and {ann} are needed, not {truth.columns}")
    return truth.select(key, F.col(ref).alias("reference"), F.col(ann).alias("annotation"))


def softmax(logits: str | Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest."""
    from ..functions.text import let

    c = F.col(logits) if isinstance(logits, str) else logits
    exps = let(F.array_max(c), lambda top: F.transform(c, lambda v: F.exp(v - top)))
    return let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s)))


def positions_with_confidence(letters: str, marks: str, logits: str) -> Column:
    """array<struct<letter, mark, confidence, forced>>: the largest probability of each place; blanks are forced."""
    z = F.arrays_zip(F.col(letters).alias("l"), F.col(marks).alias("m"), F.col(logits).alias("g"))
    return F.transform(z, lambda p: F.struct(p["l"].alias("letter"), F.when(p["l"] == " ", "").otherwise(p["m"]).alias("mark"), F.array_max(softmax(p["g"])).alias("confidence"), (p["l"] == " ").alias("forced")))


def provenance(**known: str) -> dict[str, str]:
    """Stamps for a result: the package version and whatever the caller knows (seed, digests, revision)."""
    from .. import __version__

    return {"package": "warraq", "version": __version__} | {k: str(v) for k, v in sorted(known.items())}
