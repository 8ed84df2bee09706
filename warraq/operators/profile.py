"""Profiles: histograms, order statistics, cross tables, identity and survival rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonemes as P
from ..functions import rates as R
from ..functions import text as X


def character_audit(rows: DataFrame, text: str, names: bool = False) -> DataFrame:
    """Characters that later steps would drop: ch, class, n; and, if wanted, the Unicode names of those of class 'other'."""
    x = rows.select(F.explode(X.unsupported(text)).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")).select("ch", X.character_class("ch").alias("class"), "n")
    return x.withColumn("name", X.first_character_name(F.when(F.col("class") == "other", F.col("ch")))) if names else x


def token_histogram(rows: DataFrame, text: str, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """token, n, known: uses of each token and whether the vocabulary holds it."""
    n = rows.select(F.explode(X.words(text)).alias(token)).groupBy(token).agg(F.count("*").alias("n"))
    return n.join(vocabulary.select(token).distinct().withColumn("known", F.lit(True)), token, "left").select(token, "n", F.coalesce("known", F.lit(False)).alias("known"))


def unused_tokens(rows: DataFrame, text: str, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    return vocabulary.select(token).distinct().join(rows.select(F.explode(X.words(text)).alias(token)).distinct(), token, "left_anti")


def distinct_units(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(F.explode(X.words(text)).alias("unit")).distinct()


#: Ranges of values into which a summary divides each group.
RANGES = 256


def order_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, least, p05, median, p90, p95, most: elements of the sorted values, without interpolation.

    Values are first reduced to (value, count). Each group's values fall into
    RANGES equal ranges between its least and its most; running counts of the
    ranges and of the values within a range give the places, so no task holds all values of a group
    unless they lie in one range. Places are n // 20, n // 2, 9 n // 10 and n + (-n // 20).
    """
    from pyspark.sql import Window

    by = by or []
    h = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    keys = [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)] or [F.lit(0).alias("_g0")]
    names = [f"_g{i}" for i in range(max(1, len(by)))]
    h = h.select(*keys, "v", "c")
    ends = h.groupBy(*names).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in names]
    both = lambda cs: reduce(lambda x, y: x & y, cs)
    x = h.alias("h").join(ends.alias("e"), both(same("h", "e"))).select("h.*", "_lo", "_hi")
    width = (F.col("_hi").cast("double") - F.col("_lo").cast("double")) / RANGES
    place = F.when(width > 0, F.least(F.floor((F.col("v").cast("double") - F.col("_lo").cast("double")) / width), F.lit(RANGES - 1))).otherwise(0)
    x = x.withColumn("_r", F.coalesce(place, F.lit(0)).cast("int")).select(*names, "v", "c", "_r")
    w = Window.partitionBy(*names).orderBy("_r")  # at most RANGES rows a group
    sums = x.groupBy(*names, "_r").agg(F.sum("c").alias("_s")).withColumn("_before", F.sum("_s").over(w) - F.col("_s")).withColumn("n", F.sum("_s").over(Window.partitionBy(*names)))
    y = x.alias("x").join(sums.alias("s"), both([*same("x", "s"), F.col("x._r") == F.col("s._r")])).select("x.*", "_before", "n")
    y = y.withColumn("hi", F.col("_before") + F.sum("c").over(Window.partitionBy(*names, "_r").orderBy("v"))).withColumn("lo", F.col("hi") - F.col("c"))

    def at(place: Column, name: str) -> Column:
        return F.max(F.when((place >= F.col("lo")) & (place < F.col("hi")), F.col("v"))).alias(name)

    n = F.col("n")
    down = lambda c: F.floor(c).cast("long")
    g = y.groupBy(*names).agg(F.max("n").alias("n"), F.min("v").alias("least"), at(down(n / 20), "p05"), at(down(n / 2), "median"), at(down(9 * n / 10), "p90"), at(n + down(-n / 20), "p95"), F.max("v").alias("most"))
    return g.select(*(F.col(f"_g{i}").alias(b) for i, b in enumerate(by)), "n", "least", "p05", "median", "p90", "p95", "most")


def bucket_histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bucket (index of the last edge at or below the value, -1 below all), n. Nulls are left out, NaN is in the last."""
    c = F.col(value)
    bucket = F.lit(-1)
    for i, e in enumerate(edges):
        bucket = F.when(c >= e, F.lit(i)).otherwise(bucket)
    return rows.where(c.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def cross_table(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both, with margins: total_a / total_b tell the summed rows."""
    x = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).cube("a", "b").agg(F.count("*").alias("n"), F.grouping("a").cast("int").alias("total_a"), F.grouping("b").cast("int").alias("total_b"))
    return x


def final_marks(rows: DataFrame, text: str, phonemes: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Last word's mark against the class of the last phoneme; punctuation divides words, a word has a mark or a letter."""
    ws = X.marked_words(text)
    x = rows.where(F.col(text).isNotNull() & F.col(phonemes).isNotNull()).select(*by, ws.alias("w"), P.tokens(phonemes).alias("t")).where("size(w) > 0 and size(t) > 0")
    return x.groupBy(*by, P.final_mark(F.try_element_at("w", F.lit(-1))).alias("mark"), P.phoneme_class(F.try_element_at("t", F.lit(-1))).alias("class")).agg(F.count("*").alias("n"))


def identity_rates(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows whose texts are equal, equal in skeleton, and equal without punctuation only."""
    x = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    same = lambda f, name: (f(a) == f(b)).cast("double").alias(name)
    y = x.select(same(F.col, "equal"), same(X.skeleton, "same_skeleton"), same(X.depunctuated, "same_without_punctuation"))
    return y.agg(F.count("*").alias("rows"), *(F.avg(c).alias(c) for c in y.columns))


def content_loss(rows: DataFrame, source: str, output: str, least: float = 0.7) -> DataFrame:
    """Rows whose output keeps less than `least` of the source's words."""
    x = rows.where(F.col(source).isNotNull() & F.col(output).isNotNull()).select(X.kept_share(source, output).alias("share")).where("share is not null")
    return x.agg(F.count("*").alias("rows"), F.count_if(F.col("share") < least).alias("truncated"), F.count_if(F.col("share") != 1).alias("changed"))


def conflicting_duplicates(rows: DataFrame, text: str, value: str, order: str) -> DataFrame:
    """Different composed texts: rows, and rows whose value differs from the first one's."""
    x = rows.where(F.col(text).isNotNull()).select(X.nfc(F.col(text)).alias("t"), F.col(value).alias("v"), F.col(order).alias("o"))
    first = x.groupBy("t").agg(F.min_by("v", F.struct("o", "v")).alias("first"), F.count("*").alias("n"))
    y = x.join(first, "t")
    return y.agg(F.count_distinct("t").alias("texts"), F.count("*").alias("rows"), F.count_if(~F.col("v").eqNullSafe(F.col("first"))).alias("conflicting"))


def first_per_prompt(rows: DataFrame, prompt: str, order: str) -> DataFrame:
    """First row of each prompt with the number of its clips."""
    rest = [c for c in rows.columns if c != prompt]
    return rows.groupBy(prompt).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("r"), F.count("*").alias("clips")).select(prompt, "clips", "r.*")


def marked_positions(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Marked letters in word-final and in other place."""
    ws = F.transform(X.arabic_words(F.coalesce(F.col(text), F.lit(""))), X.marked_letters)
    x = rows.select(*by, F.explode(ws).alias("w"))
    marked = lambda c: F.size(F.filter(c, lambda p: F.size(p["marks"]) > 0))
    return x.groupBy(*by).agg(F.sum(marked(F.slice("w", -1, 1))).alias("final"), F.sum(marked(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))).alias("other"))


def monotone(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Whether the values never fall in order (a small ordered result, such as one row a condition)."""
    from pyspark.sql import Window

    x = rows.withColumn("_b", F.lag(value).over(Window.orderBy(order)))
    return x.agg(F.coalesce(F.every(F.coalesce(F.col(value) >= F.col("_b"), F.lit(True))), F.lit(True)).alias("monotone"))


def target_verdicts(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """measured(name, value), targets(name, centre, band, decisive) -> name, value, in_band, decisive; a target without a value is missed."""
    x = targets.join(measured, "name", "left")
    c = F.col("value")
    return x.select("name", "value", F.coalesce(~F.isnan(c) & (F.abs(c - F.col("centre")) <= F.col("band")), F.lit(False)).alias("in_band"), "decisive")


def overall_verdict(verdicts: DataFrame) -> DataFrame:
    """passed: every decisive target is met; the others are for diagnosis only."""
    return verdicts.agg(F.coalesce(F.every(F.col("in_band") | ~F.col("decisive")), F.lit(True)).alias("passed"), F.count_if(~F.col("in_band")).alias("missed"))


def band_verdict(rows: DataFrame, value: str, centre: float, band: float) -> DataFrame:
    """Adds in_band: whether the value lies within the band; NaN and null never do."""
    return rows.withColumn("in_band", R.within(value, centre, band))
