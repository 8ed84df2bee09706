"""Splitting oversized items at natural boundaries: recursive bisection.

An item longer than its limit is cut at the strongest boundary near its middle;
halves that still exceed the limit less their overlap are cut again; then every
piece but the first is given the last words of the piece before. The pieces
without their overlaps joined together are the item, character for character.

Defined results: lengths are Unicode code points of the text as stored; null
texts give no piece, items within the limit (or without one) one piece as they
are; overlaps are shortened to whole words that fill at most half of the limit
(of a word that is itself cut, the part in the piece before counts as a word);
an unbroken run longer than the limit is cut between characters, never before a
combining mark unless marks alone exceed the limit.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: The tool table is a small dimension; more rows than this are refused.
MOST_TOOLS = 2_000
#: Boundaries from strong to weak: line end, sentence end, clause end, blank; a cut falls behind the match.
BOUNDARIES = [re.compile(p) for p in ("\\s*[\n\r\u2028\u2029]\\s*", r"[.!?؟۔…]+[\"'»”)\]]*\s+", r"[,;:،؛—]\s*", r"\s+")]
_WORD = re.compile(r"\S+")


def _cut_points(text: str) -> list[list[int]]:
    return [[m.end() for m in b.finditer(text) if m.start() > 0 and m.end() < len(text)] for b in BOUNDARIES]


def _choose(points: list[list[int]], text: str, lo: int, hi: int) -> int:
    """The strongest boundary in the middle half, nearest to the midpoint; else any boundary; else between characters."""
    mid, quarter = (lo + hi) / 2, (hi - lo) / 4
    for a, b in ((mid - quarter, mid + quarter), (lo + 1, hi - 1)):
        for p in points:
            i, j = bisect_left(p, a), bisect_right(p, b)
            if i < j:
                k = bisect_left(p, mid, i, j)
                near = [p[x] for x in (k - 1, k) if i <= x < j]
                return min(near, key=lambda x: (abs(x - mid), x))
    c = int(mid)
    back = c
    while back > lo + 1 and unicodedata.category(text[back])[0] == "M":
        back -= 1
    return back if unicodedata.category(text[back])[0] != "M" else max(lo + 1, c)


def split_item(text: str, limit: int, overlap_words: int) -> list[tuple[int, int, int]]:
    """(overlap start, start, end) of each piece; text[start:end] in order make up the text."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    points = _cut_points(text)
    words = [m.start() for m in _WORD.finditer(text)]

    def overlap_from(start: int) -> int:
        """Where the overlap of a piece begins: at most overlap_words words before start, in half of the limit."""
        if not start or overlap_words <= 0:
            return start
        last = bisect_left(words, start)
        first = max(0, last - overlap_words)
        least = start - limit // 2
        while first < last and words[first] < least:
            first += 1
        return words[first] if first < last else start

    done, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - overlap_from(lo) <= limit:
            done.append((lo, hi))
        else:
            c = _choose(points, text, lo, hi)
            todo += [(c, hi), (lo, c)]
    out, before = [], 0
    for lo, hi in done:  # an overlap never reaches beyond the piece before
        o = overlap_from(lo)
        if o < before:
            i = bisect_left(words, before)
            o = min(words[i], lo) if i < len(words) else lo
        out.append((o, lo, hi))
        before = o
    return out


def load_limits(limits: DataFrame) -> list:
    rows = limits.where("tool is not null").orderBy("tool").limit(MOST_TOOLS + 1).collect()
    if len(rows) > MOST_TOOLS:
        raise ValueError(f"more than {MOST_TOOLS} tools")
    if any(r.max_input_chars is not None and r.max_input_chars < 1 for r in rows):
        raise ValueError("a limit must be at least one character")
    return rows


_SHAPE = "tool string, item_key string, piece_no int, piece string, overlap_chars int, n_pieces int, recorded int"


def _split_batches(batches):
    names = [x.rsplit(" ", 1)[0] for x in _SHAPE.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    for b in batches:
        rows = []
        for tool, key, text, limit, words, recorded in zip(*(b.column(c).to_pylist() for c in ("tool", "item_key", "text", "lim", "words", "recorded"))):
            cuts = split_item(text, limit, words or 0)
            rows += [(tool, key, i, text[o:e], s - o, len(cuts), recorded) for i, (o, s, e) in enumerate(cuts)]
            if len(rows) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def batch_items(batches: DataFrame, limits: list) -> DataFrame:
    """Items of chunked_batches with their tool's limit: tool, item_key, text, lim, words, recorded seams."""
    key = F.lower(F.regexp_replace("tool", r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
    known = F.create_map(*(x for r in limits for x in (F.lit(r.tool.strip().lower()), F.struct(F.lit(r.tool).alias("tool"), F.lit(r.max_input_chars).cast("int").alias("lim"), F.lit(r.overlap_words).cast("int").alias("words")))))
    rows = batches.select("batch_id", F.element_at(known, key).alias("t"), "seams", F.posexplode("texts").alias("p", "text")) if limits else batches.select("batch_id", F.expr("cast(null as struct<tool string, lim int, words int>)").alias("t"), "seams", F.posexplode("texts").alias("p", "text"))
    return rows.where("text is not null and batch_id is not null").select("t.tool", F.concat_ws(":", F.col("batch_id").cast("string"), F.col("p").cast("string")).alias("item_key"), "text", "t.lim", "t.words", F.try_element_at("seams", F.col("p") + 1).alias("recorded"))


def verse_items(verses: DataFrame, limits: list) -> DataFrame:
    """Each verse once for every tool with a limit."""
    tools = [F.struct(F.lit(r.tool).alias("tool"), F.lit(r.max_input_chars).cast("int").alias("lim"), F.lit(r.overlap_words).cast("int").alias("words")) for r in limits if r.max_input_chars is not None]
    if not tools:
        return verses.select(F.lit(None).cast("string").alias("tool"), F.lit("").alias("item_key"), "text", F.lit(0).alias("lim"), F.lit(0).alias("words"), F.lit(None).cast("int").alias("recorded")).limit(0)
    return verses.where("text is not null and verse_id is not null").select(F.concat(F.lit("v"), F.col("verse_id").cast("string")).alias("item_key"), "text", F.explode(F.array(*tools)).alias("t")).select("t.tool", "item_key", "text", "t.lim", "t.words", F.lit(None).cast("int").alias("recorded"))


def pieces(items: DataFrame) -> DataFrame:
    """All pieces of the items; those within their limit stay in the JVM and are one piece."""
    ship_package(items.sparkSession)
    over = F.coalesce(F.length("text") > F.col("lim"), F.lit(False))
    whole = items.where(~over).select("tool", "item_key", F.lit(0).alias("piece_no"), F.col("text").alias("piece"), F.lit(0).alias("overlap_chars"), F.lit(1).alias("n_pieces"), "recorded")
    return whole.unionByName(cut_pieces(items))


def cut_pieces(items: DataFrame) -> DataFrame:
    """The pieces of items that exceed their limit."""
    ship_package(items.sparkSession)
    return items.where(F.length("text") > F.col("lim")).mapInArrow(_split_batches, _SHAPE)
