"""Batch text tools on executors: protocol, registry, chunked application.

A tool maps a list of texts to a list of texts of the same length and order. It
is built once per worker, behind an Arrow iterator; over-long inputs are packed
into word chunks as a list column.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X


class BatchTool(Protocol):
    name: str
    max_input_chars: int | None

    def provenance(self) -> dict[str, str]: ...

    def run(self, texts: list[str]) -> list[str]: ...


_REGISTRY: dict[str, Callable[[], BatchTool]] = {}


def register(name: str, make: Callable[[], BatchTool]) -> None:
    _REGISTRY[name] = make


def build(name: str) -> BatchTool:
    if name not in _REGISTRY:
        raise ValueError(f"unknown tool {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]()


def word_chunks(text: str | Column, limit: int | None) -> Column:
    """array<string> of what a tool is given: the text as it is within the limit, else chunks of whole words.

    Chunks are as full as possible from the left; a word longer than the limit is an
    error; white space between words becomes one blank.
    """
    c = F.col(text) if isinstance(text, str) else text
    if limit is None:
        return F.when(c.isNotNull(), F.array(c))
    state = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("open"))

    def take(s: Column, w: Column) -> Column:
        word = F.when(F.length(w) > limit, F.raise_error(F.concat(F.lit("a word is longer than the limit of "), F.lit(str(limit))))).otherwise(w)
        more = F.when(s["open"] == "", word).otherwise(F.concat_ws(" ", s["open"], word))
        fits = F.length(more) <= limit
        return F.struct(F.when(fits, s["full"]).otherwise(F.array_append(s["full"], s["open"])).alias("full"), F.when(fits, more).otherwise(word).alias("open"))

    packed = F.aggregate(X.words(c), state, take, lambda s: F.filter(F.array_append(s["full"], s["open"]), lambda p: p != ""))
    return F.when(F.length(c) <= limit, F.array(c)).when(c.isNotNull(), packed)


def apply_tool(df: DataFrame, make: Callable[[], BatchTool], text: str, out: str = "output", limit: int | None = None) -> DataFrame:
    """Adds `out` and seams: what the tool makes of each text, and the joints of its chunks. Null texts stay null with no seam.

    Chunks are packed in the JVM as a list column. The tool, built once a worker, is
    called once for the chunks of a whole Arrow batch; its answers take the lists'
    offsets and are joined again in the JVM.
    """
    df = df.drop(out, "seams")
    names = df.columns
    x = df.withColumn("_parts", word_chunks(text, limit))

    def run(batches):
        tool = make()
        for b in batches:
            parts = b.column("_parts")
            flat = parts.flatten().to_pylist()
            got = tool.run(flat)
            if len(got) != len(flat):
                raise ValueError(f"{tool.name} gave {len(got)} answers to {len(flat)} texts")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(parts), 0))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            answers = pa.ListArray.from_arrays(ends, pa.array(got, pa.string()), mask=parts.is_null())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), answers], [*names, "_parts"])

    done = x.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_parts", T.ArrayType(T.StringType()))]))
    return done.select(*names, F.array_join("_parts", " ").alias(out), F.greatest(F.coalesce(F.size("_parts"), F.lit(0)) - 1, F.lit(0)).alias("seams"))


class MarkStripper:
    """A tool without a model: removes marks. Used where a query needs some tool."""

    name = "strip"

    def __init__(self, max_input_chars: int | None = None):
        import re

        self.max_input_chars = max_input_chars
        self.marks = re.compile("[ً-ٰٕۖ-ۭـ]")

    def provenance(self) -> dict[str, str]:
        return {"tool": self.name, "limit": str(self.max_input_chars)}

    def run(self, texts: list[str]) -> list[str]:
        return [self.marks.sub("", t) for t in texts]


class CommandTool:
    """A tool in another process: one text a line to its input, one line each back; counts must agree."""

    def __init__(self, name: str, command: list[str], max_input_chars: int | None = None):
        self.name, self.command, self.max_input_chars = name, command, max_input_chars

    def provenance(self) -> dict[str, str]:
        return {"tool": self.name, "command": " ".join(self.command)}

    def run(self, texts: list[str]) -> list[str]:
        if not texts:
            return []
        sent = "\n".join(t.replace("\n", " ") for t in texts) + "\n"
        got = subprocess.run(self.command, input=sent, capture_output=True, text=True, check=True).stdout.split("\n")
        if got and got[-1] == "":
            got.pop()
        if len(got) != len(texts):
            raise ValueError(f"{self.name} returned {len(got)} lines for {len(texts)}")
        return got


register("strip", MarkStripper)
