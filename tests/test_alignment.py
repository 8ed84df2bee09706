import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.functions import alignment as A
from warraq.functions import rates as R
from warraq.operators import detection as D


def plain_align(a, b):
    """Textbook dynamic programme with the stated preferences."""
    s = {(i, j): -(i + j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i, j] = max(s[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
    i, j, cols = len(a), len(b), []
    while i or j:
        if i and j and s[i, j] == s[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            cols.append((a[i], b[j]))
        elif i and (not j or s[i, j] == s[i - 1, j] - 1):
            i -= 1
            cols.append((a[i], A.GAP))
        else:
            j -= 1
            cols.append((A.GAP, b[j]))
    return cols[::-1]


def plain_counts(c, a, p):
    """Counts from three alignments, written from the definition of the cells."""
    out = dict.fromkeys(A.COUNTS, 0)
    heard = iter([y for x, y in plain_align(a, p) if x != A.GAP])
    for want, said in plain_align(c, a):
        if said == A.GAP:
            continue
        got = next(heard)
        if want == said:
            out["ta" if got == said else "fr"] += 1
        elif got == said:
            out["cd"] += 1
        elif want == A.GAP:
            out["fa" if got == A.GAP else "ed"] += 1
        else:
            out["fa" if got == want else "ed"] += 1
    third = iter([y for x, y in plain_align(c, p) if x != A.GAP])
    for want, said in plain_align(c, a):
        if want == A.GAP:
            continue
        got = next(third)
        if said == A.GAP:
            out["cd" if got == A.GAP else "fa" if got == want else "ed"] += 1
    out["tr"] = out["cd"] + out["ed"]
    return [out[k] for k in A.COUNTS]


GOLD = [
    ("b a", "b a", "b a", {"ta": 2}),
    ("b a", "b a", "b u", {"ta": 1, "fr": 1}),
    ("b a", "b u", "b u", {"ta": 1, "tr": 1, "cd": 1}),
    ("b a", "b u", "b i", {"ta": 1, "tr": 1, "ed": 1}),
    ("b a", "b u", "b a", {"ta": 1, "fa": 1}),
    ("b a t", "b t", "b t", {"ta": 2, "tr": 1, "cd": 1}),
    ("b a t", "b t", "b a t", {"ta": 2, "fa": 1}),
    ("b t", "b a t", "b a t", {"ta": 2, "tr": 1, "cd": 1}),
    ("b a t", "b u t", "b u x", {"ta": 1, "tr": 1, "fr": 1, "cd": 1}),
]


@pytest.mark.parametrize("c,a,p,want", GOLD)
def test_golden_counts(c, a, p, want):
    got = A.detection_counts(*A.number_tokens([c.split()], [a.split()], [p.split()]))[0]
    assert dict(zip(A.COUNTS, got)) == dict.fromkeys(A.COUNTS, 0) | want


def test_random_against_plain():
    r = random.Random(4)
    rows = [[[r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(3)] for _ in range(400)]
    got = A.detection_counts(*A.number_tokens(*zip(*rows)))
    assert [list(x) for x in got] == [plain_counts(*x) for x in rows]
    to_b, to_a = A.align(*A.number_tokens([x[0] for x in rows], [x[1] for x in rows]))
    for x, p, q in zip(rows, to_b, to_a):
        assert A.gapped(x[0], x[1], p, q) == plain_align(x[0], x[1])


def test_long_and_short_in_one_batch():
    a, b = list("ab" * 900), list("ba" * 900)
    to_b, _ = A.align(*A.number_tokens([a, ["x"], []], [b, [], ["y"]]))
    assert len(to_b[0]) == 1800 and (to_b[0] >= 0).sum() == 1799 and to_b[1].tolist() == [-1] and to_b[2].tolist() == []


def test_pairs_beyond_the_matrix_bound(monkeypatch):
    """A pair too long for one matrix is traced back interval by interval: the same alignment."""
    r = random.Random(9)
    pairs = [([r.choice("abc") for _ in range(r.randrange(0, 40))], [r.choice("abc") for _ in range(r.randrange(0, 40))]) for _ in range(120)]
    want = A.align(*A.number_tokens(*zip(*pairs)))
    monkeypatch.setattr(A, "CELLS", 60)
    got = A.align(*A.number_tokens(*zip(*pairs)))
    assert all((p == q).all() for a, b in zip(want, got) for p, q in zip(a, b))


def test_aligned_elements(spark):
    row = [([("a", 1), ("b", 2), ("c", 3)], [("a", 7), ("c", 8), ("d", 9)]), (None, [("a", 1)]), ([], [])]
    df = spark.createDataFrame(row, "x array<struct<t: string, n: int>>, y array<struct<t: string, n: int>>")
    got = [[(p.a and p.a.n, p.b and p.b.n) for p in r[0]] for r in df.select(A.aligned_elements(F.col("x"), F.col("y"), "t")).collect()]
    assert got[0] == [(1, 7), (2, None), (3, 8), (None, 9)] and got[2] == []


def test_counts_null_empty_repeated_and_clashing(spark):
    rows = [("a b", "a b", "a c", "x", 1)] * 3 + [(None, "a", "", "x", 2), ("", "", "", "y", 3)]
    df = spark.createDataFrame(rows, "c string, s string, h string, speaker string, n int")
    got = {r.speaker: r for r in D.pooled(D.utterance_counts(df, "c", "s", "h", ["speaker"]), ["speaker"]).collect()}
    assert (got["x"].ta, got["x"].fr, got["x"].utterances) == (3, 3, 4) and got["x"].fa == 1 and got["y"].ta == 0
    assert D.pooled(D.utterance_counts(df.limit(0), "c", "s", "h", ["speaker"]), ["speaker"]).count() == 0


def test_rates_follow_the_policy(spark):
    df = spark.createDataFrame([(1, 0, 1, 0, 0, 0), (1, 1, 0, 1, 1, 0), (0, 0, 0, 0, 0, 0)], "ta long, fr long, fa long, tr long, cd long, ed long")
    a, b, c = D.with_rates(df).collect()
    assert np.isnan(a.precision) and a.recall == 0 and np.isnan(a.f1)
    assert (b.precision, b.recall, b.frr) == (0.5, 1.0, 0.5) and abs(b.f1 - 2 / 3) < 1e-12
    assert np.isnan(c.accuracy)
    z = D.with_official_rates(df).collect()[2]
    assert z.precision == 0 and z.far == 1 and z.per == 1


def test_nan_never_passes_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (0.15,), (0.16,), (None,)], "x double")
    assert [r[0] for r in df.select(R.above("x", 0.15)).collect()] == [False, False, True, False]
    assert [r[0] for r in df.select(R.within("x", 0.15, 0.001)).collect()] == [False, True, False, False]


def test_collapse_and_verdict(spark):
    df = spark.createDataFrame([("a b", "a b", "a c"), ("a c", "a b", "a c"), ("x", "a b", "a c"), ("a b", "a b", "a b")], "p string, c string, t string")
    r = D.collapse_report(df.withColumn("arm", F.lit(0)), "p", "c", "t", ["arm"]).first()
    assert (r.utterances, r.copy_rate, r.informative_utterances) == (4, 0.5, 3) and abs(r.canonical_preference - 1 / 3) < 1e-12
    none = D.collapse_report(df.where("c = t").withColumn("arm", F.lit(0)), "p", "c", "t", ["arm"]).first()
    assert np.isnan(none.canonical_preference)
    mk = lambda n, v, s="dev": spark.createDataFrame([(s, n, v)], "split string, informative_utterances long, canonical_preference double")
    verdict = lambda a, b: D.collapse_verdict(a, b, "split").collect()
    assert verdict(mk(300, 0.9), mk(300, 0.1))[0].fires
    assert not verdict(mk(200, 0.25), mk(300, 0.1 + 1e-17))[0].fires
    assert not verdict(mk(199, 0.9), mk(300, 0.1))[0].powered
    assert not verdict(mk(300, float("nan")), mk(300, 0.1))[0].fires
    assert verdict(mk(300, 0.9), mk(300, 0.1, "test")) == []


def test_final_token(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a"],), (["b", "aa"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(D.drop_final(F.col("t"), F.col("t"))).collect()] == [["b"], ["a"], ["b", "aa"], []]


def test_last_row_of_a_key_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, o int, v string")
    assert {r.id: r.v for r in D.last_by_key(df, "id", "o").collect()} == {"a": "y", "b": "z"}
