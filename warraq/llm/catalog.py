"""Queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from . import langid, leaks, lookalike, mixture, oracles, overlap, pieces, quota, splits


def _p1(spark: SparkSession, d: str) -> list[DataFrame]:
    return [read(spark, d, t) for t in ("train_rows", "tts_rows", "holdout", "msa_pilot_sample")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(*_p1(spark, d)).select("eval_key", "train_key").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(*_p1(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs of different sequences, each once, with the records on either side."""
    return overlap.overlap_classes(*_p1(spark, d)).select("ref", "text", F.col("distance").cast("long").alias("distance"), "eval_records", "train_records")


def _p2(spark: SparkSession, d: str) -> DataFrame:
    return splits.records(read(spark, d, "msa_pilot_sample"), read(spark, d, "holdout"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The groups of two or more as the split search assigned them."""
    return splits.assign(_p2(spark, d)).where("group_size > 1").select(F.col("rec").alias("rec_key"), "group_key")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(_p2(spark, d)).select(F.col("rec").alias("rec_key"), "group_key", "split")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(splits.assign(_p2(spark, d)))


def _p3(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.field_texts(read(spark, d, "candidates"), read(spark, d, "verses"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(_p3(spark, d))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_canonical(_p3(spark, d), "text").select("field_name", "rec_key", "canon")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its class: the consistent form's digest, whether the class holds different strings, and its rows."""
    return lookalike.look_alike_classes(_p3(spark, d)).select("field_name", "rec_key", F.sha2("canon", 256).alias("class_id"), "differs", "n_rows").distinct()


def _p4(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return quota.draw(read(spark, d, "msa_pilot_sample"), read(spark, d, "sample_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories of which the drawn sample has too few, where the exact supply confirms it."""
    lacking = _p4(spark, d)[1].where("drawn_rows < greatest(wanted_rows, floor_rows)")
    return lacking.where("falls_short").select("category")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)[1]


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)[0]


def _p5(spark: SparkSession, d: str) -> DataFrame:
    limits = pieces.load_limits(read(spark, d, "tool_limits"))
    return pieces.batch_items(read(spark, d, "chunked_batches"), limits).unionByName(pieces.verse_items(read(spark, d, "verses"), limits))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_pieces(_p5(spark, d)).where("n_pieces > 1").select("tool", "item_key").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_p5(spark, d)).select("tool", "item_key", "piece_no", "piece", "overlap_chars").distinct()


def p5_seams(spark: SparkSession, d: str) -> DataFrame:
    """True number of seams of each item against the recorded one."""
    return pieces.pieces(_p5(spark, d)).where("piece_no = 0").select("tool", "item_key", (F.col("n_pieces") - 1).alias("seams"), "recorded").distinct()


def p5_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each item put together again from its pieces without their overlaps, and whether every piece keeps the limit."""
    items = _p5(spark, d).distinct()
    made = pieces.pieces(items.withColumn("tool", F.to_json(F.struct("tool", "lim", F.md5("text").alias("d")))))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(piece, overlap_chars + 1)").alias("own"))))  # the pieces of one item
    one = made.groupBy("tool", "item_key").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["own"]), "")).alias("digest"), F.max(F.length("piece")).alias("longest"))
    t = F.from_json("tool", "tool string, lim int, d string")
    return one.select(t.alias("t"), "item_key", "digest", "longest").select("t.tool", "item_key", "digest", F.coalesce(F.col("longest") <= F.col("t.lim"), F.lit(True)).alias("within")).distinct()


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "benchmark_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Aligned pairs whose score a run of ten words must reach; the exact run follows as a check."""
    scored = _p6(spark, d).where(F.col("score") >= leaks.MATCH * leaks.RUN)
    return scored.where(F.col("run_words") >= leaks.RUN).select("doc_id", "item_id").distinct()


def p6_alignments(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the aligned pairs."""
    x = _p6(spark, d)
    return x.select("doc_id", "item_id", F.col("score").cast("long").alias("score"), F.col("run_words").cast("long").alias("run_words"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(_p6(spark, d), read(spark, d, "benchmark_items"))


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(read(spark, d, "documents"), read(spark, d, "source_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the mix has too few tokens, where the exact supply confirms it."""
    lacking = _p7(spark, d)[1].where("mixed_tokens < wanted_tokens or mixed_tokens = 0")
    return lacking.where("falls_short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[1]


def p7_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The report of the largest mix in which every source that has documents holds its share."""
    return mixture.mix(read(spark, d, "documents"), read(spark, d, "source_targets"), balanced=True)[1]


#: The network of a session's last folder; p8 queries over one folder share it.
_fitted: dict[tuple[str, str], langid.ByteNet] = {}


def _network(spark: SparkSession, d: str) -> langid.ByteNet:
    key = (spark.sparkContext.applicationId, d)
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = langid.fit(read(spark, d, "lang_samples"), read(spark, d, "documents"))
    return _fitted[key]


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return langid.segments(read(spark, d, "documents"), _network(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.unlabelled_passages(_p8(spark, d))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).select("doc_id", "segment_no", "lang", "from_word", "n_words", "confidence")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(_p8(spark, d), read(spark, d, "documents"), _network(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p1_classes, p2_found, p2_splits, p2_report, p3_found, p3_forms, p3_classes, p4_found, p4_report, p4_sample, p5_found, p5_pieces, p5_seams, p5_round_trip, p6_found, p6_alignments, p6_scores, p6_report, p7_found, p7_mix, p7_report, p7_balanced, p8_found, p8_segments, p8_documents)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
