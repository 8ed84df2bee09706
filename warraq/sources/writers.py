"""Sinks: guarded writers. Guards run before anything is written."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_manifest(df: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated with header; refuses an empty output and fields with tabs or line breaks."""
    if df.isEmpty():
        raise ValueError("refusing to write an empty manifest")
    bad = None
    for c in columns:
        b = F.rlike(F.coalesce(F.col(c), F.lit("")), F.lit(r"[\t\r\n]"))
        bad = b if bad is None else bad | b
    if not df.where(bad).isEmpty():
        raise ValueError("a field holds a tab or a line break")
    df.select(*columns).write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("lineSep", "\n").csv(path)


def write_ark_triple(df: DataFrame, folder: str, columns: dict[str, str], id_: str = "id") -> None:
    """One text sink for each of hyp, ref and canon, row by row from one table; empty sequences keep their id."""
    for name, c in columns.items():
        df.select(F.rtrim(F.concat_ws(" ", F.col(id_), F.array_join(c, " "))).alias("value")).write.mode("errorifexists").text(f"{folder}/{name}.ark")


def ark_predictions(ark: DataFrame, expected: int) -> DataFrame:
    """id, prediction in id order; refuses another number of rows than expected."""
    n = ark.count()
    if n != expected:
        raise ValueError(f"{n} predictions, expected {expected}")
    return ark.select("id", F.array_join("tokens", " ").alias("prediction")).orderBy("id")


def write_predictions_json(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """{id: text} as one document (evaluation sets are small; refuses more than `most` rows)."""
    rows = df.orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for one document")
    Path(path).write_text(json.dumps({r.id: r.prediction for r in rows}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_document(df: DataFrame, path: str, provenance: dict[str, str], partial: bool = False) -> None:
    """A one-row nested result with its provenance as JSON; refuses a partial one."""
    if partial:
        raise ValueError("refusing to write a partial result")
    rows = df.toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("a document is made of exactly one row")
    Path(path).write_text(json.dumps({"provenance": provenance} | json.loads(rows[0]), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_variants(clips: DataFrame, canonicals: DataFrame, path: str, prompt: str = "prompt") -> None:
    """clips x (variant, prompt, canonical) as manifests partitioned by variant; refuses uncovered prompts."""
    if not clips.select(prompt).distinct().join(canonicals.select(prompt).distinct(), prompt, "left_anti").isEmpty():
        raise ValueError("a prompt has no canonical")
    x = clips.join(canonicals, prompt).select("path", "sentence", "canonical", "variant")
    if x.isEmpty():
        raise ValueError("refusing to write empty manifests")
    x.write.partitionBy("variant").option("sep", "\t").option("header", True).csv(path)


def paired_or_fail(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose values agree at each ordinal; any disagreement or missing partner is an error."""
    x = left.select(key, F.col(value).alias("_a")).join(right.select(key, F.col(value).alias("_b")), key, "full_outer")
    if not x.where("not (_a <=> _b)").isEmpty():
        raise ValueError("positional pairing does not agree")
    return left


def write_speaker_splits(df: DataFrame, path: str, speaker: str, dev: str) -> None:
    """Partitions by split: one speaker goes to dev."""
    df.withColumn("split", F.when(F.col(speaker) == dev, "dev").otherwise("train")).write.partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A text cache, one object a line; the committer makes it appear whole or not at all."""
    df.write.mode("errorifexists").json(path)


def copy_listed(files: DataFrame, ids: DataFrame, folder: str) -> int:
    """Copies the files (path, content) whose clip id is listed into a folder that all executors share; returns how many.

    Every task writes its own files, each under another name first, so a repeated
    task leaves whole files only.
    """
    from ..functions.text import utterance_id

    def copy(batches):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                target = os.path.join(folder, path.rsplit("/", 1)[-1])
                part = f"{target}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content or b"")
                os.replace(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    x = files.withColumn("id", utterance_id("path")).join(ids.select("id").distinct(), "id", "left_semi").select("path", "content")
    return x.mapInArrow(copy, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def write_canonicals(rows: DataFrame, transcripts: DataFrame, key: str, value: str, path: str) -> None:
    """key, value as tab-separated text once every value agrees with its transcript; any disagreement stops it."""
    paired_or_fail(rows, transcripts, key, value).select(F.concat_ws("\t", F.col(key).cast("string"), F.coalesce(F.col(value), F.lit(""))).alias("value")).write.mode("errorifexists").text(path)


def write_packet(items: DataFrame, folder: str, instructions: str, most: int = 10_000) -> None:
    """One draw rendered twice: blank.txt without marks, gold.json with them; and the instructions. items: item, text."""
    from ..functions.text import strip_marks

    rows = items.select("item", "text", strip_marks("text").alias("blank")).orderBy("item").limit(most + 1).collect()
    if not rows or len(rows) > most:
        raise ValueError(f"a packet has 1 to {most} items")
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    (target / "blank.txt").write_text("".join(f"## Item {r.item} of {len(rows)}\n{r.blank}\n\n> \n\n" for r in rows), encoding="utf-8")
    (target / "gold.json").write_text(json.dumps({"items": [{"item": r.item, "text": r.text, "blank": r.blank} for r in rows]}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    (target / "instructions.md").write_text(instructions, encoding="utf-8")
