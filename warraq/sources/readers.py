"""Sources: files into DataFrames, with the guards that belong to their formats.

Ids are text throughout (leading zeros count). Everything is read with a declared
schema; nothing is inferred from data.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import phonemes as P
from ..functions import text as X

MANIFEST = (["path", "sentence"], ["path", "sentence", "canonical"])


def training_rows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """id, canonical tokens and texts; other columns (audio) are never read."""
    x = spark.read.parquet(path)
    if split is not None:
        x = x.where(F.col("split") == split)
    return x.select(F.col("id").cast("string").alias("id"), "sentence", "tashkeel_sentence", "phoneme_ref").withColumn("canonical", P.tokens("phoneme_ref"))


def synthetic_rows(spark: SparkSession, path: str) -> DataFrame:
    """The source has no id: its key comes from the stored row position."""
    x = spark.read.parquet(path)
    return x.select(F.concat(F.lit("iqra_tts_"), F.col("row_no").cast("string")).alias("id"), F.col("sentence_ref").alias("sentence"), "phoneme_ref", "phoneme_mis", "speaker", "label").withColumn("canonical", P.tokens("phoneme_ref"))


def ground_truth(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """One row for each id; of repeated ids the last in `order` (else an error)."""
    x = spark.read.parquet(path).withColumn("match_distance", F.col("match_distance").cast("int"))
    if order:
        rest = [c for c in x.columns if c != "id"]
        return x.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("id", "r.*")
    if not x.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("repeated ids in the ground truth")
    return x


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value, file: lines of text files with their 0-based numbers (a file is read by one task)."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return texts.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"), "file")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, header exactly path, sentence[, canonical]; short rows are an error."""
    first = spark.read.text(path).first()
    header = first.value.split("\t") if first else []
    if header not in MANIFEST:
        raise ValueError(f"not a manifest header: {header}")
    n = len(header) - 1
    x = spark.read.text(path).where(F.col("value") != "\t".join(header))
    parts = F.split("value", "\t", -1)
    row = F.when(F.size(parts) == n + 1, parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))))
    return x.select(row.alias("r")).select(*(F.get("r", F.lit(i)).alias(c) for i, c in enumerate(header)))


def ark(spark: SparkSession, path: str) -> DataFrame:
    """id, tokens: an id alone has no tokens; a repeated id is an error."""
    x = spark.read.text(path).where("trim(value) != ''").select(F.split(X.squeeze("value"), " ", 2).alias("p"))
    out = x.select(F.get("p", F.lit(0)).alias("id"), P.tokens(F.coalesce(F.get("p", F.lit(1)), F.lit(""))).alias("tokens"))
    if not out.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("repeated ids in the ark")
    return out


def predictions_json(spark: SparkSession, path: str) -> DataFrame:
    """{id: text} -> id, prediction."""
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return x.select(F.explode("m").alias("id", "prediction"))


def records_json(spark: SparkSession, path: str, fields: str = "prediction string, phoneme_ref string, phoneme_mis string, speaker string") -> DataFrame:
    """{id: {fields}} -> id, fields."""
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{fields}>>".replace(" string", ":string")).alias("m"))
    return x.select(F.explode("m").alias("id", "r")).select("id", "r.*")


def holdout_json(spark: SparkSession, path: str) -> DataFrame:
    """A hold-out document -> split (train, dev, phoneme), value."""
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", "holdout_train_ids array<string>, holdout_dev_ids array<string>, holdout_phoneme_refs array<string>").alias("d")).select("d.*")
    parts = [x.select(F.lit(n).alias("split"), F.explode(c).alias("value")) for n, c in (("train", "holdout_train_ids"), ("dev", "holdout_dev_ids"), ("phoneme", "holdout_phoneme_refs"))]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("value", F.when(F.col("split") == "phoneme", X.squeeze("value")).otherwise(F.col("value")))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """index, token: one token a line; an empty file, a line of several tokens or a repeated token is an error."""
    named = F.filter(F.transform(F.split("value", "\r?\n"), X.squeeze), lambda t: t != "")
    x = spark.read.text(path, wholetext=True).select(F.posexplode(named).alias("index", "token"))
    g = x.agg(F.count("*").alias("n"), F.count_distinct("token").alias("d"), F.count_if(F.contains("token", F.lit(" "))).alias("wide")).first()
    if not g.n or g.d != g.n or g.wide:
        raise ValueError("a vocabulary file holds one different token a line")
    return x


def verses_xml(spark: SparkSession, path: str) -> DataFrame:
    """surah, ayah, text of sura/aya elements; the bismillah attribute is ignored; no verse is an error."""
    aya = T.ArrayType(T.StructType([T.StructField("_index", T.IntegerType()), T.StructField("_text", T.StringType())]))
    x = spark.read.format("xml").option("rowTag", "sura").schema(T.StructType([T.StructField("_index", T.IntegerType()), T.StructField("aya", aya)])).load(path)
    out = x.select(F.col("_index").alias("surah"), F.explode("aya").alias("a")).select("surah", F.col("a._index").alias("ayah"), F.col("a._text").alias("text"))
    if out.isEmpty():
        raise ValueError("no verse in the file")
    return out


def segments(rows: DataFrame, order: str, cells: list[str], file: str = "file") -> DataFrame:
    """Word rows into segments: a row whose first cell is blank or starts with # ends one. file, segment, words in order.

    Rows without an Arabic word are dropped, and segments without any. The running
    count is one pass over each file's lines.
    """
    first = F.coalesce(F.trim(cells[0]), F.lit(""))
    x = rows.withColumn("_b", (first == "") | F.startswith(first, F.lit("#")))
    x = x.withColumn("segment", F.sum(F.col("_b").cast("int")).over(Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("_b"))
    for c in cells:
        x = x.withColumn(c, X.nfc(F.coalesce(F.col(c), F.lit(""))))
    x = x.where(F.rlike(cells[0], F.lit(f"[{X.WIDE_LETTER}]")))
    return x.groupBy(file, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *cells))), lambda w: F.struct(*(w[c].alias(c) for c in cells))).alias("words"))


def word_segments(spark: SparkSession, path: str) -> DataFrame:
    """The word table (tab-separated, header, four columns, short rows padded) as segments."""
    names = ["dediac", "original_gold", "max_gold", "max_gold_alt"]
    lines = numbered_lines(spark, path).where("line > 0")
    parts = F.split("value", "\t")
    rows = lines.select("file", "line", *(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)))
    return segments(rows, "line", names)


def submission(lines: DataFrame, order: str = "line", value: str = "value", file: str = "file") -> DataFrame:
    """file, item, answer: after each '## Item k of n' header the first line that starts with '>'."""
    k = F.regexp_extract(value, r"^## Item (\d+) of \d+", 1)
    x = lines.withColumn("_h", F.when(k != "", k.cast("int")))
    x = x.withColumn("item", F.last("_h", ignorenulls=True).over(Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    a = x.where(F.col("item").isNotNull() & F.startswith(value, F.lit(">"))).groupBy(file, "item").agg(F.min_by(value, order).alias("v"))
    return a.select(file, "item", X.nfc(F.trim(F.substring("v", 2, 2**30))).alias("answer")).where("answer != ''")


def jsonl(spark: SparkSession, path: str, schema: str = "id string, sentence string, tashkeel_sentence string, phoneme_ref string, phoneme_aug string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def sibling_texts(spark: SparkSession, index: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Joins each row to the text file of its name in a folder; the closing line break is dropped."""
    texts = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1).alias("_stem"), F.regexp_replace("value", r"\n+$", "").alias("transcript"))
    return index.withColumn("_stem", F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)).join(texts, "_stem").drop("_stem")


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, sha256, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.sha2("content", 256).alias("sha256"), "content")


@F.pandas_udf(T.LongType())
def wav_frames(content: pd.Series) -> pd.Series:
    """Frames of a PCM wave file; null where it isn't one."""
    def frames(b: bytes | None):
        if not b or len(b) < 44 or b[:4] != b"RIFF":
            return None
        at, align = 12, 2
        while at + 8 <= len(b):
            kind, size = b[at : at + 4], struct.unpack("<I", b[at + 4 : at + 8])[0]
            if kind == b"fmt ":
                align = struct.unpack("<H", b[at + 20 : at + 22])[0]
            if kind == b"data":
                return min(size, len(b) - at - 8) // max(1, align)
            at += 8 + size + size % 2
        return None

    return content.map(frames).astype("Int64")


def wav_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """path, frames, longest first."""
    return binary_files(spark, folder, "*.wav").select("path", wav_frames("content").alias("frames")).orderBy(F.desc("frames"), "path")


@F.pandas_udf(T.BinaryType())
def mono(content: pd.Series) -> pd.Series:
    """16-bit samples of one or two interleaved channels at 16 kHz as one channel; halves go to the even number."""
    import io
    import wave

    import numpy as np

    def one(b: bytes | None):
        if b is None:
            return None
        with wave.open(io.BytesIO(b)) as w:
            if w.getframerate() != 16_000 or w.getsampwidth() != 2 or w.getnchannels() not in (1, 2):
                raise ValueError("expected 16 kHz, 16 bit, one or two channels")
            s = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return np.rint(s.mean(1)).astype("<i2").tobytes()

    return content.map(one).astype(object)


def pick_column(df: DataFrame, *names: str) -> str:
    """The first of the names that the table has; else an error."""
    for n in names:
        if n in df.columns:
            return n
    raise KeyError(f"none of {names} in {df.columns}")
