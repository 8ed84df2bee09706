"""Evaluation texts leaking into training text: n-gram seeds, then Smith-Waterman.

Every n-gram of an item is a seed, however many documents hold it: an edited copy
may keep any of them and lose the others. The hashes of all seeds make up one bit
filter of a fixed size; documents are read once, whatever the number of items, and
those with an n-gram in the filter are kept with their folded words. Their
n-grams are joined to the seeds by equality, n-grams of many documents salted, and
each document that shares a seed with an item is aligned with it locally, word by
word, around the shared seeds, many pairs at a time.

Defined results: null or empty texts contain nothing; items of fewer than n words
have no seeds and are never found, nor are copies so edited that no n words in a
row are left; repeated documents each come out under their own id; each different
text of an item counts as an item; documents of any length are processed whole.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship_package
from .letters import Words

NGRAM, RUN = 5, 10
#: The filter of seeds has 2 ** FILTER_BITS bits (4 MB), however many seeds there are.
FILTER_BITS = 25
#: Shares of an n-gram's documents that go to different tasks.
SALTS = 16
MATCH, NEAR, MISMATCH, GAP = 2, 1, -1, -1
#: Alignments that score less than this many matched words' worth are not reported.
LEAST_WORDS = 6
#: Cells of one row of the score matrices that are computed at a time.
ROW_CELLS = 400_000


# ---- words and seeds -----------------------------------------------------------
class Grams:
    """Folded words of texts and the 64-bit hashes of their n-grams."""

    def __init__(self):
        self.words, self.known = Words(), {}

    def _hash(self, word: str) -> int:
        if len(self.known) > 500_000:
            self.known.clear()
        h = self.known[word] = int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return h

    def __call__(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text; of all n-grams: hash, number of the text, first word)."""
        words = [self.words(t) for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        get = self.known.get
        h = np.fromiter((get(w) or self._hash(w) for ws in words for w in ws), np.uint64, int(n.sum()))
        owner = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        whole = at + NGRAM <= n[owner]
        g = np.zeros(max(0, len(h) - NGRAM + 1), np.uint64)
        for k in range(NGRAM):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)]
        g ^= g >> np.uint64(31)
        whole = whole[: len(g)]
        return words, g[whole].view(np.int64), owner[: len(g)][whole], at[: len(g)][whole].astype(np.int32)


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind) -> pa.ListArray:
    """values as one list for each owner 0..n-1 (owners in order)."""
    ends = np.searchsorted(owner, np.arange(n), side="right")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _folded_items(batches):
    grams = Grams()
    for b in batches:
        words, g, owner, _ = grams(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([" ".join(w) for w in words], pa.string()), _lists(g, owner, len(words), pa.int64())], ["item_id", "item", "grams"])


def _filter_of(seeds: DataFrame) -> bytes:
    """The bit filter of the seeds' hashes: at most 2 ** FILTER_BITS / 32768 partial bitmaps reach the driver."""
    x = F.pmod("g", F.lit(1 << FILTER_BITS)) + 1
    parts = seeds.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in parts:
        out[(r.k - 1) << 12 : r.k << 12] = r.bits
    return bytes(out)


# ---- alignment -------------------------------------------------------------------
def _close(a: str, b: str) -> bool:
    """Words of four letters or more with one first letter that differ by one inserted, dropped or replaced letter."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4 or a[0] != b[0]:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _near_words(some: set[str], others: set[str], number: dict[str, int]) -> dict[int, list[int]]:
    """Numbers of the words of `others` that are close to each word of `some`; words meet at what one dropped letter leaves."""
    def left(w: str) -> set[str]:
        return {w} | {w[:i] + w[i + 1 :] for i in range(1, len(w))} if len(w) >= 4 else set()

    met: dict[str, list[str]] = {}
    for w in some:
        for x in left(w):
            met.setdefault(x, []).append(w)
    out: dict[int, set[int]] = {}
    for v in others:
        for x in left(v):
            for w in met.get(x, ()):
                if w != v and _close(w, v):
                    out.setdefault(number[w], set()).add(number[v])
    return {k: sorted(v) for k, v in out.items()}


def _sweep(a: np.ndarray, b: np.ndarray, near: dict[int, list[int]], has_near: np.ndarray) -> np.ndarray:
    """Rows (score, start, end, longest run) of pairs; a: items, b: parts, as padded word numbers.

    A cell holds score * 2**32 + start, so of equal scores the later start wins.
    """
    one = np.int64(1 << 32)
    size, wide = b.shape
    places = np.arange(wide + 1, dtype=np.int64)
    h = np.broadcast_to(places, (size, wide + 1)).copy()
    run = np.zeros((size, wide + 1), np.int32)
    best, end, longest = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int32)
    for i in range(a.shape[1]):
        same = b == a[:, i : i + 1]
        s = np.where(same, MATCH, MISMATCH).astype(np.int64)
        for p in np.flatnonzero(has_near[a[:, i]]):
            for v in near[int(a[p, i])]:
                s[p, b[p] == v] = NEAR
        t = np.empty_like(h)
        t[:, 0] = 0
        np.maximum(h[:, :-1] + s * one, h[:, 1:] + GAP * one, out=t[:, 1:])
        t = np.where(t < one, places, t)
        t -= GAP * one * places
        np.maximum.accumulate(t, axis=1, out=t)
        t += GAP * one * places
        h = np.where(t < one, places, t)
        new = np.zeros_like(run)
        new[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        run = new
        np.maximum(longest, run.max(1), out=longest)
        at = (h >> 32).argmax(1)
        v = h[np.arange(size), at]
        more = (v >> 32) > (best >> 32)
        best[more], end[more] = v[more], at[more]
    return np.stack([best >> 32, best & (one - 1), end, longest.astype(np.int64)], 1)


def align_many(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """Smith-Waterman over words for each (item, part): score, start and end of the stretch in part, longest shared run."""
    out = np.zeros((len(pairs), 4), np.int64)
    number: dict[str, int] = {}
    coded = [tuple(np.fromiter((number.setdefault(w, len(number)) for w in x), np.int64, len(x)) for x in p) for p in pairs]
    near = _near_words({w for a, _ in pairs for w in a}, {w for _, b in pairs for w in b}, number)
    has_near = np.zeros(len(number) + 1, bool)  # the last place stands for padding
    has_near[list(near)] = True
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * (len(pairs[order[at + n]][1]) + 1) <= ROW_CELLS:
            n += 1
        pick = order[at : at + n]
        at += n
        a = np.full((n, max(len(coded[k][0]) for k in pick)), -1, np.int64)
        b = np.full((n, max(len(coded[k][1]) for k in pick)), -2, np.int64)
        for r, k in enumerate(pick):
            a[r, : len(coded[k][0])], b[r, : len(coded[k][1])] = coded[k]
        out[pick] = _sweep(a, b, near, has_near)
    return out


def align(item: list[str], part: list[str]) -> tuple[int, int, int]:
    """Smith-Waterman over words: (best score, start and end of the aligned stretch in part)."""
    return tuple(map(int, align_many([(item, part)])[0, :3]))


def longest_run(item: list[str], part: list[str]) -> int:
    """Most consecutive words shared, consecutive in both."""
    return int(align_many([(item, part)])[0, 3])


_FOUND = "doc_id long, item_id long, score int, similarity double, run_words int, from_word int, to_word int"


def _align_batches(batches):
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("doc_id", "item_id", "item", "part", "lo", "at")]
        pairs, source = [], []  # stretches around seeds that lie near one another
        for k, (item, part, lo, at) in enumerate(zip(*cols[2:])):
            words, w, at, i = item.split(" "), part.split(" "), sorted(set(at)), 0
            while i < len(at):
                j = i
                while j + 1 < len(at) and at[j + 1] - at[j] <= 2 * len(words):
                    j += 1
                a = max(0, at[i] - lo - 2 * len(words))
                pairs.append((words, w[a : at[j] - lo + 2 * len(words)]))
                source.append((k, lo + a))
                i = j + 1
        best: dict[int, tuple] = {}
        for (k, off), (s, a, e, run) in zip(source, align_many(pairs).tolist()):
            old = best.get(k, (0, 0, 0, 0))
            best[k] = (*((s, off + a, off + e) if s > old[0] else old[:3]), max(run, old[3]))
        rows = []
        for k, (s, a, e, run) in best.items():
            if run >= RUN or s >= MATCH * LEAST_WORDS:
                n = cols[2][k].count(" ") + 1
                rows.append((cols[0][k], cols[1][k], s, s / (MATCH * n), run, a, e))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


# ---- the operator ------------------------------------------------------------------
def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> the items each document contains, with alignment score.

    similarity: score against that of a whole unchanged copy; run_words: the most
    consecutive words shared; from_word, to_word: the aligned stretch of the document.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    folded = texts.mapInArrow(_folded_items, "item_id long, item string, grams array<long>").where("size(grams) > 0").withColumn("ik", F.xxhash64("item"))
    seeds = folded.select("item_id", "ik", F.explode(F.array_distinct("grams")).alias("g"))
    sent = spark.sparkContext.broadcast(_filter_of(seeds))  # 4 MB

    def scan(batches):
        grams, bits = Grams(), np.frombuffer(sent.value, np.uint8)
        for b in batches:
            words, g, owner, at = grams(b.column("text").to_pylist())
            x = g & ((1 << FILTER_BITS) - 1)
            hit = (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
            g, owner, at = g[hit], owner[hit], at[hit]
            kept, place = np.unique(owner, return_inverse=True)
            arrays = [b.column("doc_id").take(pa.array(kept)), pa.array([" ".join(words[k]) for k in kept], pa.string()), _lists(g, place, len(kept), pa.int64()), _lists(at, place, len(kept), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "words", "grams", "at"])

    read = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    kept = cut(read.mapInArrow(scan, "doc_id long, words string, grams array<long>, at array<int>")).withColumn("dk", F.xxhash64("words"))
    hits = kept.select("doc_id", "dk", F.explode(F.arrays_zip("grams", "at")).alias("h")).select("doc_id", "dk", F.col("h.grams").alias("g"), F.col("h.at").alias("at"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = hits.join(salted, ["g", "salt"]).groupBy("doc_id", "dk", "item_id", "ik").agg(F.collect_set("at").alias("at"))  # at most the words of one document
    pairs = pairs.join(folded.select("item_id", "ik", "item").distinct(), ["item_id", "ik"]).withColumn("n", F.regexp_count("item", F.lit(" ")) + 1)
    pairs = pairs.withColumn("lo", F.greatest(F.array_min("at") - 2 * F.col("n"), F.lit(0))).withColumn("hi", F.array_max("at") + 2 * F.col("n"))
    part = F.array_join(F.slice(F.split("words", " "), F.col("lo") + 1, F.col("hi") - F.col("lo")), " ")
    near = pairs.join(kept.select("doc_id", "dk", "words").distinct(), ["doc_id", "dk"]).select("doc_id", "item_id", "item", part.alias("part"), "lo", "at")
    return near.mapInArrow(_align_batches, _FOUND)


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Leaked items: item_id, origin, documents, whole_copies, longest_run."""
    by_item = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(F.col("similarity") >= 0.95, F.col("doc_id"))).alias("whole_copies"), F.max("run_words").alias("longest_run"))
    return items.select("item_id", "origin").distinct().join(by_item, "item_id")
