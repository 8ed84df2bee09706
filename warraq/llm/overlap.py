"""Same or nearly same records across splits: sharded index of seeds.

Evaluation references are cut into so few parts that, by the pigeonhole principle,
a training text within the allowed edit distance has at least one part with at most
one edit. Of that part's four quarters three are unchanged: the first three or the last
three in a row, or the others around a gap that is one symbol off at most. These are
the seeds, a dozen symbols long, so chance finds few of them however many references
there are; half of the fourth quarter must be met as well. The distinct references are sharded by length and hash; each shard is one
index of seed hashes, in which the windows of every training text of a compatible
length are looked up. Pairs whose symbol counts are too far apart are out, as are
those with too few unchanged pieces (`covered`), and an exact bounded edit distance
(JVM side) decides the rest. A hash that collides adds a pair to check, and loses none.

Defined results: null texts match nothing; an empty sequence matches empty ones
only (distance 0); repeated rows give one pair; texts are processed whole.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import members

# The characters at which Python's str.split() divides.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Finds whether a text has other than single blanks between ASCII symbols; most have not, and stay as they are.
UNEVEN = "[^!-~ ]|  |^ | $"
#: References in one index (memory of a worker: about 24 seeds each, of 20 bytes).
SHARD_REFS = 150_000
#: Training texts that one task looks up in a shard before the shard is given to a further task, at least; and
#: at least so many texts a reference, so that copies of shards stay small beside the texts.
CHUNK_TEXTS, TEXTS_A_REF = 60_000, 3
#: Length classes grow by this factor, so there are at most a few hundred of them.
LENGTH_STEP = 1.12
#: Pieces beyond the pigeonhole minimum; each adds one to the matches that are required.
EXTRA_PIECES = 1
BINS = 64


def sequence(col: str | Column) -> Column:
    """A phoneme text with single blanks between its symbols; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.rlike(c, F.lit(UNEVEN)), F.trim(F.regexp_replace(c, WHITE, " "))).otherwise(c)


def seq_length(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "))) + 1)


def _length_class(c: Column) -> Column:
    return F.floor(F.log(c.cast("double") + 1) / math.log(LENGTH_STEP)).cast("int")


def max_edits(n: int) -> int:
    """Most edits between a reference of n symbols and any text within a tenth of it."""
    return (10 * n // 9) // 10


# Odd factors and random words of the hashes.
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)
_PLACE = np.random.default_rng(2).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each symbol of the texts, none of them empty, and the number of symbols of each text."""
    d = np.frombuffer("\n".join(texts).encode(), np.uint8)
    gap = (d == 32) | (d == 10)
    starts = np.concatenate([[0], np.flatnonzero(gap) + 1])
    place = np.arange(len(d)) - np.repeat(starts, np.diff(np.append(starts, len(d))))
    v = _mixed(np.add.reduceat(np.where(gap, np.uint64(0), _BYTE[d] * _PLACE[place & 63]), starts))
    first = np.concatenate([[0], np.flatnonzero(d[starts[1:] - 1] == 10) + 1])
    return v, np.diff(np.append(first, len(starts)))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.cumprod(np.full(n, x % 2**64, np.uint64)) for x in (_BASE, pow(_BASE, -1, 2**64)))
    return up, down


class _Windows:
    """Hashes of the windows of a row of symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        up, self.down = _powers(1 << max(10, self.n.bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * up[: self.n])])
        self.kept: dict[int, np.ndarray] = {}

    def plain(self, w: int) -> np.ndarray:
        """Of the w symbols from each place on."""
        if w not in self.kept:
            self.kept[w] = (self.sums[w:] - self.sums[: max(0, self.n + 1 - w)]) * self.down[: max(0, self.n + 1 - w)]
        return self.kept[w]

    def keys(self, x: int, gap: int, z: int) -> np.ndarray:
        """Keys of seeds from each place on: x symbols, a gap, z symbols."""
        m = max(0, self.n + 1 - x - gap - z)
        shape = np.uint64(x << 20 | z)  # not the gap, which may be one off
        return _mixed(self.plain(x)[:m] * _MIX + self.plain(z)[x + gap : x + gap + m] + shape)


def part_size(lengths: list[int]) -> int:
    """Symbols of a part that every reference of these lengths has; 0 if none allows an edit."""
    return min((n // (max_edits(n) // 2 + 1) for n in lengths if max_edits(n)), default=0)


def seeds(size: int) -> list[tuple[int, int, int, int, int]]:
    """Seeds of a part: place, symbols, gap, symbols after it, and the gap's place (of the quarter left out)."""
    e = size // 4
    h = (size - 2 * e) // 2
    ends = [0, e, e + h, size - e, size]
    return [(e, size - e, 0, 0, 0), (0, size - e, 0, 0, size - e), *((0, ends[i], ends[i + 1] - ends[i], size - ends[i + 1], ends[i]) for i in (1, 2))]


def _blocks(texts: list[str], rows: int, symbols: int):
    """(place, texts) in blocks of at most so many rows and about so many characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo == rows or size + len(t) > symbols):
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, texts[lo:]


_WHOLE = -(2**15)


def _counts(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Symbol counts in hashed bins; merging symbols only lowers a distance bound."""
    at = np.repeat(np.arange(len(n)), n) * BINS + (v % np.uint64(BINS)).astype(np.int64)
    c = np.bincount(at, minlength=len(n) * BINS).reshape(-1, BINS)
    return np.minimum(c, 2**14).astype(np.int16)  # a cap only lowers the bound too


def _twos(v: np.ndarray) -> np.ndarray:
    """16 bits of each symbol and the next."""
    h = v >> np.uint64(20)
    return ((h + np.append(h[1:], h[:1]) * np.uint64(31)) & np.uint64(0xFFFF)).astype(np.uint16)


class Index:
    """One shard: its references, their seeds, and the search of a batch of texts."""

    def __init__(self, refs: list[str]):
        self.blank = "" in refs
        self.refs = [r for r in refs if r]
        self.codes: dict[str, str] = {}
        self.some = bool(self.refs)
        if not self.some:
            return
        blocks = [(lo, *_symbols(block)) for lo, block in _blocks(self.refs, 20_000, 500_000)]
        self.length = np.concatenate([n for _, _, n in blocks])
        self.begin = np.cumsum(self.length) - self.length
        sizes = np.unique(self.length).tolist()
        self.part = part_size(sizes)
        self.shapes = sorted({(x, g, z) for _, x, gap, z, _ in seeds(self.part) for g in ((gap - 1, gap, gap + 1) if z else (gap,))} if self.part else set()) + [(n, 0, 0) for n in sizes if not max_edits(n)]
        made, counts, twos = [], [], []
        while blocks:
            lo, v, n = blocks.pop(0)
            starts, w = np.cumsum(n) - n, _Windows(v)
            keys = functools.cache(w.keys)
            for size in np.unique(n).tolist():
                rows, k = np.flatnonzero(n == size), max_edits(size)
                for j in range(k // 2 + 1):
                    a = j * size // (k // 2 + 1)
                    for at, x, gap, z, hole in seeds(self.part) if k else [(0, size, 0, 0, -1)]:
                        key = keys(x, gap, z)[starts[rows] + a + at]
                        made.append((key, (rows + lo).astype(np.int32), *(np.full(len(rows), c, t) for c, t in ((a + at, np.int32), (gap, np.int16), (hole - at if hole >= 0 else _WHOLE, np.int16)))))
            counts.append(_counts(v, n))
            twos.append(_twos(v))
        self.counts, self.twos = np.concatenate(counts), np.concatenate([*twos, np.zeros(1, np.uint16)])
        columns = [list(c) for c in zip(*made)]
        made.clear()

        def joined(i: int) -> np.ndarray:
            x = np.concatenate(columns[i])
            columns[i].clear()
            return x

        keys = joined(0)
        order = np.argsort(keys).astype(np.int32)
        keys, self.owner, self.at, self.gap, self.hole = keys[order], *(joined(i)[order] for i in range(1, 5))
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.first = keys[new], np.append(new, len(keys))
        # a bit for each key, so that most windows are not looked up
        self.shift = np.uint64(64 - min(27, max(13, (16 * len(self.keys)).bit_length())))
        bit = self.keys >> self.shift
        byte = (bit >> np.uint64(3)).astype(np.int64)
        run = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        self.bits = np.zeros(1 << (61 - int(self.shift)), np.uint8)
        self.bits[byte[run]] = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (bit & np.uint64(7)).astype(np.uint8)), run)

    def _encode(self, text: str, new: bool) -> str:
        """One character a symbol; a symbol that no reference has is \x02."""
        if new:
            for x in text.split(" "):
                if x not in self.codes:
                    cp = 0x21 + len(self.codes)
                    self.codes[x] = chr(cp if cp < 0xD800 else cp + 0x800)
        return "".join([self.codes.get(x, "\x02") for x in text.split(" ")])

    def _pairs(self, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Text times number of references plus reference, of the pairs with a common seed at a place that the edits allow."""
        w, starts, met = _Windows(v), np.cumsum(n) - n, []
        for x, gap, z in self.shapes:
            key = w.keys(x, gap, z)
            bit = key >> self.shift
            there = np.flatnonzero(self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            k = np.searchsorted(self.keys, key[there])
            there, k = (c[self.keys[np.minimum(k, len(self.keys) - 1)] == key[there]] for c in (there, k))
            t = np.searchsorted(starts, there, side="right") - 1
            whole = there + x + gap + z <= starts[t] + n[t]
            met.append((t[whole], there[whole], k[whole], np.full(int(whole.sum()), gap)))
        text, place, k, gap = (np.concatenate(c) for c in zip(*met))
        at = place - starts[text]
        two, last = np.append(_twos(v), np.uint16(0)), len(v)
        ends, out, lo = np.cumsum(self.first[k + 1] - self.first[k]), [np.zeros(0, np.int64)], 0
        while lo < len(k):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, side="right")))
            c = self.first[k[lo:hi] + 1] - self.first[k[lo:hi]]
            row = np.repeat(np.arange(lo, hi), c)
            post = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.first[k[lo:hi]], c)
            ref = self.owner[post].astype(np.int64)
            length, m = self.length[ref], n[text[row]]
            longest = np.maximum(length, m)
            ok = np.flatnonzero((np.abs(at[row] - self.at[post]) * 10 <= longest) & (np.abs(length - m) * 10 <= longest) & (np.abs(gap[row] - self.gap[post]) <= 1))
            ref, row, post = ref[ok], row[ok], post[ok]
            ok = self._half(self.begin[ref] + self.at[post], self.hole[post].astype(np.int64), self.gap[post], place[row], gap[row], two, last)
            out.append(np.unique(text[row][ok] * len(self.refs) + ref[ok]))
            lo = hi
        return np.unique(np.concatenate(out))

    def _half(self, a, hole, gap, b, other, two, last) -> np.ndarray:
        """Whether the quarter left out, with one edit at most, has its first or its last two symbols in the text.

        A seed at `a` of the references and `b` of the text; `hole` is the quarter's
        place from the seed on, `gap` its size within a seed, `other` that in the text.
        """
        e = self.part // 4
        if e < 4:  # one edit may touch both halves
            return np.ones(len(a), bool)
        size = np.where(gap > 0, gap, e)
        at = lambda i: two[np.clip(i, 0, last)]
        head, tail = self.twos[np.clip(a + hole, 0, len(self.twos) - 1)], self.twos[np.clip(a + hole + size - 2, 0, len(self.twos) - 1)]
        h, t = b + hole, b + hole + size - 2
        same = (hole == _WHOLE) | (head == at(h)) | (tail == at(t))
        inner = gap > 0
        shift = other - gap
        same |= inner & (tail == at(t + shift))
        for s in (-1, 1):  # the free end may be one off
            same |= ~inner & np.where(hole < 0, head == at(h + s), tail == at(t + s))
        return same

    def candidates(self, texts: list[str]):
        """(text index, reference, encoded reference, encoded text, allowed edits, covered symbols) of the pairs that may be near."""
        full = [i for i, t in enumerate(texts) if t]
        if not self.some or not full:
            return
        v, n = _symbols([texts[i] for i in full])
        pairs = self._pairs(v, n)
        tb = _counts(v, n)
        encoded: dict[int, str] = {}
        for lo in range(0, len(pairs), 20_000):
            text, ref = pairs[lo : lo + 20_000] // len(self.refs), pairs[lo : lo + 20_000] % len(self.refs)
            edits = np.maximum(self.length[ref], n[text]) // 10
            apart = np.abs(self.counts[ref] - tb[text]).sum(1, dtype=np.int64)
            near = apart + np.abs(self.length[ref] - n[text]) <= 2 * edits  # twice the larger of what either has more
            for t, r, e in zip(text[near].tolist(), ref[near].tolist(), edits[near].tolist()):
                if r not in encoded:
                    if len(encoded) > 50_000:
                        encoded.clear()
                    encoded[r] = self._encode(self.refs[r], True)
                a, b = encoded[r], self._encode(texts[full[t]], False)
                # unchanged pieces near their place: pieces are disjoint, so coverage is the sum over different ones
                q, hits, cover = min(len(a), max_edits(len(a)) + 1 + EXTRA_PIECES), 0, 0
                for j in range(q):
                    at, end = j * len(a) // q, (j + 1) * len(a) // q
                    if b.find(a[at:end], max(0, at - e), end + e) >= 0:
                        hits, cover = hits + 1, cover + end - at
                if hits >= q - e:
                    yield full[t], self.refs[r], a, b, e, cover


_OUT = T.StructType([T.StructField(n, T.StringType()) for n in ("ref", "train_key", "a", "b")] + [T.StructField("edits", T.IntegerType()), T.StructField("covered", T.IntegerType())])


def _scan(batches):
    """Rows of a partition, references (side 0) before texts of each group; one index at a time."""
    group, refs, index = None, [], None
    for b in batches:
        t = pa.Table.from_batches([b])
        g, side = t.column("g").to_numpy(), t.column("side").to_numpy()
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(g)]
        for lo, hi in itertools.pairwise(cuts):
            if lo == hi:
                continue
            if g[lo] != group:
                group, refs, index = g[lo], [], None
            part = t.slice(lo, hi - lo)
            if side[lo] == 0:
                refs += part.column("seq").to_pylist()
                continue
            if not refs:
                continue
            if index is None:
                index = Index(refs)
            texts, keys = part.column("seq").to_pylist(), part.column("train_key").to_pylist()
            for at, block in _blocks(texts, 2000, 1_000_000):
                rows = [(r, keys[at + x], a, b, e, c) for x, r, a, b, e, c in index.candidates(block)]
                rows += [("", keys[at + x], "", "", 0, 0) for x, s in enumerate(block) if not s and index.blank]
                if rows:
                    yield from pa.Table.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), (pa.string(),) * 4 + (pa.int32(),) * 2)], names=_OUT.names).to_batches()


def near_pairs(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """refs(seq), texts(train_key, seq) -> ref, train_key, distance, covered (symbols in unchanged pieces).

    Every pair whose symbol edit distance times ten is at most the longer length.
    Both inputs hold sequences as made by `sequence`; nulls are dropped.
    """
    spark = refs.sparkSession
    ship_package(spark)
    refs = refs.where("seq is not null").select("seq").distinct().select("seq", seq_length("seq").alias("n")).withColumn("cls", _length_class(F.col("n")))
    texts = texts.where("seq is not null and train_key is not null").select("train_key", "seq", seq_length("seq").alias("n")).withColumn("cls", _length_class(F.col("n")))
    # two histograms of at most a few hundred length classes
    r = {x.cls: x for x in refs.groupBy("cls").agg(F.count("*").alias("rows"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect()}
    t = {x.cls: x.rows for x in texts.groupBy("cls").agg(F.count("*").alias("rows")).collect()}
    plan, ref_plan, groups = [], [], 0
    for cls, x in sorted(r.items()):
        lo, hi = -(-9 * x.lo // 10), 10 * x.hi // 9
        near = [c for c in t if LENGTH_STEP**c - 1 <= hi + 1 and LENGTH_STEP ** (c + 1) - 1 >= lo - 1]
        total = sum(t[c] for c in near)
        if not total:
            continue
        shards = -(-x.rows // SHARD_REFS)
        chunks = -(-total // max(CHUNK_TEXTS, int(TEXTS_A_REF * x.rows / shards)))
        plan += [(c, lo, hi, groups, shards, chunks) for c in near]
        ref_plan.append((cls, groups, shards, chunks))
        groups += shards * chunks
    empty = "ref string, train_key string, distance int, covered int"
    if not groups:
        return spark.createDataFrame([], empty)
    plan_df = F.broadcast(spark.createDataFrame(plan, "cls int, lo long, hi long, base long, shards long, chunks long"))
    ref_df = F.broadcast(spark.createDataFrame(ref_plan, "cls int, base long, shards long, chunks long"))
    left = refs.join(ref_df, "cls").select((F.col("base") + F.pmod(F.xxhash64("seq"), "shards") * F.col("chunks")).alias("g0"), "chunks", "seq")
    left = left.select(F.explode(F.expr("sequence(g0, g0 + chunks - 1)")).alias("g"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("train_key"), "seq")
    right = texts.join(plan_df, "cls").where("n between lo and hi").select(F.expr("transform(sequence(0, shards - 1), s -> base + s * chunks + pmod(xxhash64(train_key, seq, 7), chunks))").alias("gs"), "train_key", "seq")
    right = right.select(F.explode("gs").alias("g"), F.lit(1).alias("side"), "train_key", "seq")
    placed = left.unionByName(right).repartitionById(groups, F.col("g").cast("int")).sortWithinPartitions("g", "side")
    found = placed.mapInArrow(_scan, _OUT)
    return found.withColumn("distance", F.expr("levenshtein(a, b, edits)")).where("distance >= 0").select("ref", "train_key", "distance", "covered")


def named_id(col: Column) -> Column:
    """The id that a holdout entry names: bare, padded, or as the clip's file name or path."""
    s = F.regexp_replace(F.regexp_replace(col, "^" + WHITE, ""), WHITE + "$", "")
    clip = F.regexp_extract(s, r"(?:^|/)audio_(.+)\.wav$", 1)
    return F.when(clip != "", clip).otherwise(s)


def eval_entries(holdout: DataFrame, pilot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references: eval_key, eval_set, seq; named ids: eval_key, eval_set, train_key)."""
    def entries(column: str, tag: str) -> DataFrame:
        return holdout.select("block", "eval_set", F.posexplode(column).alias("p", "x")).where("x is not null").select(F.concat_ws(":", "block", F.lit(tag), F.col("p").cast("string")).alias("eval_key"), "eval_set", "x")

    refs = entries("holdout_phoneme_refs", "r").select("eval_key", "eval_set", sequence("x").alias("seq"))
    refs = refs.unionByName(pilot.where("phoneme_ref is not null and id is not null").select(F.col("id").alias("eval_key"), F.lit("pilot").alias("eval_set"), sequence("phoneme_ref").alias("seq")))
    ids = entries("holdout_train_ids", "t").unionByName(entries("holdout_dev_ids", "d")).select("eval_key", "eval_set", named_id(F.col("x")).alias("train_key"))
    return refs, ids


def training_texts(train: DataFrame, tts: DataFrame) -> DataFrame:
    """train_key, source, seq of the training side; a tts row gives a text for either reading."""
    a = train.where("split = 'train'").select(F.col("id").alias("train_key"), F.col("source"), sequence("phoneme_ref").alias("seq"))
    key = F.concat(F.lit("iqra_tts_"), F.col("row_no").cast("string")).alias("train_key")
    b = tts.select(key, F.lit("iqra_tts").alias("source"), F.explode(F.array("phoneme_ref", "phoneme_mis")).alias("x")).select("train_key", "source", sequence("x").alias("seq"))
    return a.unionByName(b)


def text_pairs(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """refs(seq), texts(seq) -> ref, seq, distance, covered: near pairs of different sequences, each compared once."""
    distinct = texts.where("seq is not null").select(F.col("seq").alias("train_key"), "seq").distinct()
    return near_pairs(refs, distinct).groupBy("ref", "train_key").agg(F.min("distance").alias("distance"), F.max("covered").alias("covered")).withColumnRenamed("train_key", "seq")


def cross_split_pairs(train: DataFrame, tts: DataFrame, holdout: DataFrame, pilot: DataFrame) -> DataFrame:
    """All overlapping pairs: eval_key, eval_set, train_key, how (id, text).

    Different sequences are compared; the records of either side join last, in
    shares where one sequence has many, so copies are scanned once and nothing but
    results is made of them.
    """
    refs, ids = eval_entries(holdout, pilot)
    texts = training_texts(train, tts)
    keys = texts.select("train_key").where("train_key is not null").distinct()
    by_id = ids.join(keys, "train_key").select("eval_key", "eval_set", "train_key", F.lit("id").alias("how"))
    a = refs.where("seq is not null").select("eval_key", "eval_set", *members.digest("seq", "r")).distinct()
    b = texts.where("seq is not null and train_key is not null").select("train_key", *members.digest("seq", "t")).distinct()
    near = text_pairs(refs.select("seq"), texts.where("train_key is not null").select("seq")).select(*members.digest("ref", "r"), *members.digest("seq", "t"))
    large = lambda x, k: members.large_keys(x.groupBy(*k).agg(F.count(F.lit(1)).alias("n")), k, "n")
    found = members.join_divided(near, b, ["t1", "t2"], large(b, ["t1", "t2"]), "train_key")
    found = members.join_divided(found.select("r1", "r2", "train_key"), a, ["r1", "r2"], large(a, ["r1", "r2"]), "eval_key")
    return by_id.unionByName(found.select("eval_key", "eval_set", "train_key", F.lit("text").alias("how"))).distinct()


def overlap_classes(train: DataFrame, tts: DataFrame, holdout: DataFrame, pilot: DataFrame) -> DataFrame:
    """Pairs of representatives (ref, text: digests of sequences) with their distance and the records on either side."""
    refs, _ = eval_entries(holdout, pilot)
    texts = training_texts(train, tts)
    digest = lambda c, n: F.sha2(c, 256).alias(n)
    evals = refs.where("seq is not null").groupBy(digest("seq", "ref")).agg(F.count_distinct("eval_key").alias("eval_records"))
    trains = texts.where("seq is not null and train_key is not null").groupBy(digest("seq", "text")).agg(F.count_distinct("train_key").alias("train_records"))
    near = text_pairs(refs.select("seq"), texts.where("train_key is not null").select("seq")).select(digest("ref", "ref"), digest("seq", "text"), "distance", "covered")
    return near.join(evals, "ref").join(trains, "text")


def overlap_report(train: DataFrame, tts: DataFrame, holdout: DataFrame, pilot: DataFrame) -> DataFrame:
    """Counts per eval set and training source: eval_set, source, eval_records, train_records, pairs."""
    pairs = cross_split_pairs(train, tts, holdout, pilot)
    sources = training_texts(train, tts).groupBy("train_key").agg(F.min("source").alias("source"))
    return pairs.join(sources, "train_key").groupBy("eval_set", "source").agg(F.countDistinct("eval_key").alias("eval_records"), F.countDistinct("train_key").alias("train_records"), F.countDistinct("eval_key", "train_key").alias("pairs"))
