"""Global alignment of token sequences, many pairs at a time.

Match +1, mismatch and gap -1; among equal paths the trace back prefers the
diagonal, then a gap in the second sequence, then a gap in the first. Rows of the
score matrix are computed for a whole batch at once; the dependence on the left
neighbour is a running maximum. Only one byte of direction is kept for a cell.

Null sequences count as empty; the gap token itself, met in an input, is dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = "<eps>"
#: Cells of direction held at a time (one byte each).
CELLS = 48_000_000
DIAGONAL, LEFT, UP = 0, 1, 2


def number_tokens(*columns) -> list[list[np.ndarray]]:
    """Each column's sequences as arrays of numbers of one common dictionary."""
    known: dict[str, int] = {}
    out = []
    for col in columns:
        out.append([np.array([known.setdefault(t, len(known)) for t in (s if s is not None else ()) if t != GAP], np.int32) for s in col])
    return out


def _padded(seqs: list[np.ndarray], width: int) -> np.ndarray:
    m = np.full((len(seqs), max(1, width)), -1, np.int32)
    for i, s in enumerate(seqs):
        m[i, : len(s)] = s
    return m


def _next_row(row: np.ndarray, a: np.ndarray, symbol: np.ndarray, i: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i of the scores from the one before, and its diagonal candidates."""
    diag = row[:, :-1] + np.where(a == symbol, 1, -1)
    new = np.empty_like(row)
    new[:, 0] = -i
    np.maximum(diag, row[:, 1:] - 1, out=new[:, 1:])
    new += steps
    np.maximum.accumulate(new, axis=1, out=new)
    new -= steps
    return new, diag


def _ways(new: np.ndarray, diag: np.ndarray) -> np.ndarray:
    return np.where(new[:, 1:] == diag, DIAGONAL, np.where(new[:, 1:] == new[:, :-1] - 1, LEFT, UP))


def _align_block(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, wide, tall = len(a), int(n.max()), int(m.max())
    steps = np.arange(wide + 1, dtype=np.int32)
    way = np.zeros((size, tall + 1, wide + 1), np.uint8)
    row = np.broadcast_to(-steps, (size, wide + 1)).copy()
    for i in range(1, tall + 1):
        row, diag = _next_row(row, a[:, :wide], b[:, i - 1 : i], i, steps)
        way[:, i, 1:] = _ways(row, diag)
    to_b, to_a = np.full((size, max(1, wide)), -1, np.int32), np.full((size, max(1, tall)), -1, np.int32)
    i, j, at = m.astype(np.int64).copy(), n.astype(np.int64).copy(), np.arange(size)
    live = (i > 0) & (j > 0)
    while live.any():
        k = at[live]
        w = way[k, i[k], j[k]]
        d = k[w == DIAGONAL]
        to_b[d, j[d] - 1] = i[d] - 1
        to_a[d, i[d] - 1] = j[d] - 1
        i[k[w != LEFT]] -= 1
        j[k[w != UP]] -= 1
        live = (i > 0) & (j > 0)
    return to_b, to_a


def _align_long(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pair of any length: score rows are kept at intervals, and directions made again for one interval at a time."""
    n, m = len(a), len(b)
    rows = max(1, min(m, CELLS // (n + 1)))
    steps, wide = np.arange(n + 1, dtype=np.int32), a[None, :]
    row, kept = -steps[None, :].copy(), []
    for i in range(1, m + 1):
        if (i - 1) % rows == 0:
            kept.append(row)
        row, _ = _next_row(row, wide, b[i - 1], i, steps)
    to_b, to_a = np.full(n, -1, np.int32), np.full(m, -1, np.int32)
    i, j = m, n
    for block in range(len(kept) - 1, -1, -1):
        row, first = kept.pop(), block * rows + 1
        way = np.zeros((max(0, i - first + 1), n + 1), np.uint8)
        for k in range(first, i + 1):
            row, diag = _next_row(row, wide, b[k - 1], k, steps)
            way[k - first, 1:] = _ways(row, diag)[0]
        while i >= first and j > 0:
            w = way[i - first, j]
            if w == DIAGONAL:
                to_b[j - 1], to_a[i - 1] = i - 1, j - 1
            i -= w != LEFT
            j -= w != UP
        if j == 0:
            break
    return to_b, to_a


def _same_end(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens the two have in common at their ends: there the diagonal is always preferred, so they stand opposite one another."""
    m = min(len(a), len(b))
    differs = a[len(a) - m :] != b[len(b) - m :]
    return m if not differs.any() else int(differs[::-1].argmax())


def align(first: list[np.ndarray], second: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each pair: the partner in second of each token of first (-1: a gap), and the reverse.

    Equal ends need no matrix, so equal sequences need none at all.
    """
    ends = [_same_end(a, b) for a, b in zip(first, second)]
    heads = [[s[: len(s) - e] for s, e in zip(side, ends)] for side in (first, second)]
    n, m = (np.fromiter(map(len, s), np.int64, len(s)) for s in heads)
    one: list = [np.full(k, -1, np.int32) for k in n]
    two: list = [np.full(k, -1, np.int32) for k in m]
    order = np.lexsort((m, n))
    order = order[(n[order] > 0) & (m[order] > 0)]
    at = 0
    while at < len(order):
        count, k = 1, order[at]
        if (n[k] + 1) * (m[k] + 1) > CELLS:
            one[k], two[k] = _align_long(heads[0][k], heads[1][k])
            at += 1
            continue
        while at + count < len(order) and (count + 1) * (n[order[at + count]] + 1) * (m[order[at : at + count + 1]].max() + 1) <= CELLS and count < 2048:
            count += 1
        pick = order[at : at + count]
        at += count
        a, b = _padded([heads[0][k] for k in pick], int(n[pick].max())), _padded([heads[1][k] for k in pick], int(m[pick].max()))
        b[b == -1] = -2
        to_b, to_a = _align_block(a, b, n[pick], m[pick])
        for r, k in enumerate(pick):
            one[k], two[k] = to_b[r, : n[k]], to_a[r, : m[k]]
    for k, e in enumerate(ends):
        if e:
            tail = np.arange(e, dtype=np.int32)
            one[k], two[k] = np.concatenate([one[k], m[k].astype(np.int32) + tail]), np.concatenate([two[k], n[k].astype(np.int32) + tail])
    return one, two


def gapped(seq1: list[str], seq2: list[str], to_b: np.ndarray, to_a: np.ndarray) -> list[tuple[str, str]]:
    """The alignment as columns: gaps of both sides between two matches come first side first."""
    out, i, j = [], 0, 0
    while i < len(seq1) or j < len(seq2):
        if i < len(seq1) and to_b[i] < 0 and (j >= len(seq2) or to_a[j] >= 0):
            out.append((seq1[i], GAP))
            i += 1
        elif j < len(seq2) and to_a[j] < 0 and (i >= len(seq1) or to_b[i] >= 0):
            out.append((GAP, seq2[j]))
            j += 1
        elif i < len(seq1) and to_b[i] < 0:
            out.append((seq1[i], GAP))
            i += 1
        else:
            out.append((seq1[i], seq2[j]))
            i, j = i + 1, j + 1
    return out


OPS = T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("op", T.StringType())]))


@F.pandas_udf(OPS)
def alignment(first: pd.Series, second: pd.Series) -> pd.Series:
    """array<struct<a, b, op>>: aligned tokens with C, S, I or D."""
    s1 = [[t for t in (x if x is not None else ()) if t != GAP] for x in first]
    s2 = [[t for t in (x if x is not None else ()) if t != GAP] for x in second]
    to_b, to_a = align(*number_tokens(s1, s2))
    out = []
    for x, y, p, q in zip(s1, s2, to_b, to_a):
        out.append([{"a": a, "b": b, "op": "D" if b == GAP else "I" if a == GAP else "C" if a == b else "S"} for a, b in gapped(x, y, p, q)])
    return pd.Series(out, dtype=object)


PLACES = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


@F.pandas_udf(PLACES)
def alignment_places(first: pd.Series, second: pd.Series) -> pd.Series:
    """array<struct<i, j>>: the columns of the alignment as places in the two sequences, null for a gap."""
    seqs = [[list(x) if x is not None else [] for x in s] for s in (first, second)]
    out = []
    for to_b, to_a in zip(*align(*number_tokens(*seqs))):
        cols = gapped(list(range(len(to_b))), list(range(len(to_a))), to_b, to_a)
        out.append([{"i": None if i == GAP else i, "j": None if j == GAP else j} for i, j in cols])
    return pd.Series(out, dtype=object)


def aligned_elements(first: Column, second: Column, field: str) -> Column:
    """array<struct<a, b>>: two arrays of structs aligned by one field; whole elements come out, null for a gap."""
    key = lambda c: F.transform(c, lambda e: e[field])
    return F.transform(alignment_places(key(first), key(second)), lambda p: F.struct(F.get(first, p["i"]).alias("a"), F.get(second, p["j"]).alias("b")))


COUNTS = ("ta", "fr", "fa", "tr", "cd", "ed")
COUNTS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def _joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All arrays as one; the number of each element's array; where each array begins."""
    n = np.fromiter(map(len, arrays), np.int64, len(arrays))
    flat = np.concatenate(arrays).astype(np.int64) if len(arrays) else np.zeros(0, np.int64)
    return flat, np.repeat(np.arange(len(arrays)), n), np.cumsum(n) - n


def detection_counts(canon: list[np.ndarray], said: list[np.ndarray], heard: list[np.ndarray]) -> np.ndarray:
    """Six counts for each triple of canonical, annotated and predicted sequence, all triples at once.

    Each annotated token is looked up in both alignments; canonical tokens that the
    annotation leaves out are looked up in the third.
    """
    canon_said, said_canon = align(canon, said)
    said_heard, _ = align(said, heard)
    canon_heard, _ = align(canon, heard)
    (c, c_of, c_at), (a, a_of, _), (p, _, p_at) = _joined(canon), _joined(said), _joined(heard)

    def token(values: np.ndarray, starts: np.ndarray, partner: np.ndarray, owner: np.ndarray, gap: int) -> np.ndarray:
        """The partners' tokens, `gap` where there is none."""
        out = np.full(len(partner), gap, np.int64)
        has = partner >= 0
        out[has] = values[starts[owner[has]] + partner[has]]
        return out

    want = token(c, c_at, _joined(said_canon)[0], a_of, -1)
    got = token(p, p_at, _joined(said_heard)[0], a_of, -2)
    third = token(p, p_at, _joined(canon_heard)[0], c_of, -2)
    there, found, heard_some, gone = want >= 0, got == a, got >= 0, _joined(canon_said)[0] < 0
    right, swapped, added = want == a, there & (want != a), ~there
    count = lambda of, mask: np.bincount(of[mask], minlength=len(canon)).astype(np.int64)
    ta, fr = count(a_of, right & found), count(a_of, right & ~found)
    cd = count(a_of, (swapped | added) & found) + count(c_of, gone & (third < 0))
    fa = count(a_of, swapped & ~found & (want == got)) + count(a_of, added & ~heard_some) + count(c_of, gone & (third == c))
    ed = count(a_of, swapped & ~found & (want != got)) + count(a_of, added & heard_some & ~found) + count(c_of, gone & (third >= 0) & (third != c))
    return np.stack([ta, fr, fa, cd + ed, cd, ed], 1)


@F.pandas_udf(COUNTS_TYPE)
def mdd_counts(canon: pd.Series, said: pd.Series, heard: pd.Series) -> pd.DataFrame:
    """struct(ta, fr, fa, tr, cd, ed) of one utterance."""
    return pd.DataFrame(detection_counts(*number_tokens(canon, said, heard)), columns=list(COUNTS))
