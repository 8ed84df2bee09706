"""Detection scoring: align, count, pool, rate; collapse diagnostics; ablations.

One Arrow crossing for the alignments, one small shuffle for the pooled sums.
Identical triples are scored once and weighted, so repeated rows cost nothing
and a hot utterance is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonemes as P
from ..functions import rates as R
from ..functions.alignment import COUNTS, alignment, mdd_counts


def join_predictions(predictions: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """Inner join: predictions without truth, and truth without prediction, are dropped."""
    return predictions.join(truth, key)


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last one in order (duplicate keys: the last wins)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order and rows.schema[c].dataType.typeName() not in ("map",)])).alias("r")).select(key, "r.*")


def utterance_counts(rows: DataFrame, canon: str, said: str, heard: str, by: list[str]) -> DataFrame:
    """by..., n, and the six counts: each different triple is aligned once."""
    distinct = rows.groupBy(*by, F.col(canon).alias("_c"), F.col(said).alias("_a"), F.col(heard).alias("_p")).agg(F.count("*").alias("n"))
    scored = distinct.withColumn("_k", mdd_counts(*(P.tokens(F.coalesce(F.col(x), F.lit(""))) for x in ("_c", "_a", "_p"))))
    return scored.select(*by, "n", *(F.col(f"_k.{c}").alias(c) for c in COUNTS))


def pooled(counts: DataFrame, by: list[str]) -> DataFrame:
    """Sums of counts, each utterance as often as it occurs; rates come from sums, never from mean rates."""
    return counts.groupBy(*by).agg(F.sum("n").alias("utterances"), *(F.sum(F.col(c) * F.col("n")).alias(c) for c in COUNTS))


def with_rates(counts: DataFrame, empty: str = "nan") -> DataFrame:
    return counts.withColumns(R.detection_rates(empty=empty))


def with_official_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(R.official_rates())


def base_rate(counts: DataFrame, by: list[str]) -> DataFrame:
    """False rejection where the annotation is the canonical itself."""
    return pooled(counts, by).withColumn("frr", R.ratio("fr", F.col("fr") + F.col("ta")))


def drop_final(tokens: Column, canon: Column) -> Column:
    """Without its last token where the canonical ends in a short vowel; a sequence never becomes empty."""
    short = P.phoneme_class(F.try_element_at(canon, F.lit(-1))) == "short"
    return F.when(F.coalesce(short, F.lit(False)) & (F.size(tokens) > 1), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(1)))).otherwise(tokens)


def corruption_attribution(per_prompt: DataFrame, by: str = "prompt") -> DataFrame:
    """per_prompt(by, canon_gold, canon_auto, clips, gold_fr_fa, auto_fr_fa) -> sites, damage, their flags.

    sites: disagreeing alignment columns times clips; damage: change of false
    decisions. over_bound: more damage than sites; artifact: damage without a site.
    """
    ops = alignment(P.tokens("canon_gold"), P.tokens("canon_auto"))
    out = per_prompt.withColumn("_ops", ops).withColumn("sites", F.size(F.filter("_ops", lambda x: x["op"] != "C")) * F.col("clips"))
    out = out.withColumn("damage", F.abs(F.col("auto_fr_fa") - F.col("gold_fr_fa")))
    return out.select(by, "sites", "damage", (F.col("damage") > F.col("sites")).alias("over_bound"), ((F.col("sites") == 0) & (F.col("damage") > 0)).alias("artifact"))


def collapse_report(rows: DataFrame, prediction: str, canon: str, target: str, by: list[str]) -> DataFrame:
    """copy_rate, informative utterances, and how often the prediction is strictly nearer to the canonical."""
    p, c, t = (P.tokens(F.coalesce(F.col(x), F.lit(""))) for x in (prediction, canon, target))
    x = rows.select(*by, p.alias("_p"), c.alias("_c"), t.alias("_t")).withColumn("_inf", F.col("_c") != F.col("_t"))
    x = x.withColumn("_near", F.col("_inf") & (P.token_distance("_p", "_c") < P.token_distance("_p", "_t")))
    g = x.groupBy(*by).agg(F.count("*").alias("utterances"), F.count_if(F.col("_p") == F.col("_c")).alias("_copies"), F.count_if("_inf").alias("informative_utterances"), F.count_if("_near").alias("_nearer"))
    return g.select(*by, "utterances", R.ratio("_copies", "utterances").alias("copy_rate"), "informative_utterances", R.ratio("_nearer", "informative_utterances").alias("canonical_preference"))


def collapse_verdict(conditioned: DataFrame, ablated: DataFrame, on: str, least: int = 200, limit: float = 0.15) -> DataFrame:
    """Power is tested before the threshold; the threshold is exclusive; NaN never fires. Differing splits don't join."""
    a, b = conditioned.alias("a"), ablated.alias("b")
    x = a.join(b, F.col(f"a.{on}") == F.col(f"b.{on}"))
    informative = F.least("a.informative_utterances", "b.informative_utterances")
    delta = F.col("a.canonical_preference") - F.col("b.canonical_preference")
    return x.select(F.col(f"a.{on}").alias(on), informative.alias("informative"), delta.alias("delta"), (informative >= least).alias("powered"), ((informative >= least) & R.above(delta, limit)).alias("fires"))


def round_trip(rows: DataFrame, produced: str, reference: str, by: list[str], vocabulary: tuple[str, ...] = P.INVENTORY) -> DataFrame:
    """Exact-match rate, token error rate, length conservation and tokens outside the vocabulary."""
    x = rows.select(*by, P.tokens(F.coalesce(F.col(produced), F.lit(""))).alias("_p"), P.tokens(F.coalesce(F.col(reference), F.lit(""))).alias("_r"))
    known = F.array(*map(F.lit, vocabulary))
    g = x.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.col("_p") == F.col("_r")).alias("exact"), F.sum(P.token_distance("_p", "_r")).alias("distance"), F.sum(F.size("_r")).alias("reference_tokens"),
        F.sum(F.size("_p")).alias("produced_tokens"), F.count_if(F.size("_p") < 0.9 * F.size("_r")).alias("short_rows"), F.sum(F.size(F.filter("_p", lambda t: ~F.array_contains(known, t)))).alias("unknown_tokens"),
    )
    return g.select("*", R.ratio("exact", "rows", "null").alias("exact_rate"), R.ratio("distance", "reference_tokens", "null").alias("token_error_rate"), R.ratio("produced_tokens", "reference_tokens", "null").alias("length_ratio"))
