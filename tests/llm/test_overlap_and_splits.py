import collections
import random

import pytest
from pyspark.sql import functions as F

from warraq.llm import graph, overlap, splits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        k = r.randrange(3)
        at = r.randrange(len(s) + (k == 0)) if s or k == 0 else 0
        if k == 0:
            s.insert(at, r.choice("abcdefgh"))
        elif s and k == 1:
            del s[at]
        elif s:
            s[at] = r.choice("abcdefgh")
    return s


@pytest.mark.parametrize("shard,chunk", [(12_000, 150_000), (7, 11)])
def test_near_pairs_equal_brute_force(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(overlap, "SHARD_REFS", shard)
    monkeypatch.setattr(overlap, "CHUNK_TEXTS", chunk)
    r = random.Random(3)
    refs = [[r.choice("abcdefgh") for _ in range(n)] for n in [0, 1, 2, 5, 9, 10, 11, 19, 20, 21, 30, 40, 55, 90, 120] for _ in range(3)]
    texts = [edited(r, s, r.randrange(0, 2 + len(s) // 8)) for s in refs for _ in range(6)] + [[], ["a"], ["zz", "a"]]
    a = spark.createDataFrame([(" ".join(s),) for s in refs] * 2 + [(None,)], "seq string")
    b = spark.createDataFrame([(f"t{i}", " ".join(s)) for i, s in enumerate(texts)] + [("n", None), ("t0", " ".join(texts[0]))], "train_key string, seq string")
    got = {(x.ref, x.train_key) for x in overlap.near_pairs(a, b).collect()}
    want = {(" ".join(s), f"t{i}") for s in refs for i, t in enumerate(texts) if 10 * distance(s, t) <= max(len(s), len(t))}
    assert got == want and len(want) > 60


def test_index_meets_every_near_text_and_few_others():
    """of texts made of the same word patterns, the index leaves few pairs to compare and loses none that is near."""
    r = random.Random(9)
    roots = "b t ^ j H x d * r z s S D T Z E g f q k l m n h w y".split()
    patterns = "l m u t a 1 aa 2 i 3 u|l 1 a 2 ii 3 i|y u 1 a 2 i 3 u|1 a 2 a 3 a|l < i 1 2 aa 3 a".split("|")

    def word():
        one = dict(zip("123", r.choices(roots, k=3)))
        return [one.get(x, x) for x in r.choice(patterns).split()]

    text = lambda n: [x for _ in range(n) for x in word()]
    refs = [text(n)[: r.randrange(1, 9 * n)] for n in range(1, 15) for _ in range(40)] + [text(12) for _ in range(1000)]
    near = [edited(r, s, r.choice([0, overlap.max_edits(len(s)), len(s) // 10])) for s in refs]
    far = [text(12) for _ in range(1000)]
    seqs = [" ".join(s) for s in near + far]
    index = overlap.Index([" ".join(s) for s in refs])
    found = {(x, index_ref, e) for x, index_ref, _, _, e, _ in index.candidates(seqs)}
    at = {(x, y) for x, y, _ in found}
    true = [(i, " ".join(s)) for i, s in enumerate(refs) if near[i] and 10 * distance(s, near[i]) <= max(len(s), len(near[i]))]
    assert len(true) > 900 and set(true) <= at
    full = [s for s in seqs[-1000:] if s]
    pairs = index._pairs(*overlap._symbols(full))
    assert len(pairs) < 0.02 * len(full) * len(refs)


def test_very_long_and_hot_texts(spark):
    r = random.Random(5)
    long = [r.choice("abcdefgh") for _ in range(6000)]
    a = spark.createDataFrame([(" ".join(long),), ("a b c",)], "seq string")
    b = spark.createDataFrame([("near", " ".join(edited(r, long, 500))), ("far", " ".join(edited(r, long, 3000)))] + [(f"h{i}", "a b c") for i in range(300)], "train_key string, seq string")
    got = [x.train_key for x in overlap.near_pairs(a, b).collect()]
    assert "near" in got and "far" not in got and len(got) == 301


def test_named_ids(spark):
    df = spark.createDataFrame([("12",), (" 12\t",), ("audio_12.wav",), ("train/wav/audio_12.wav",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(overlap.named_id(F.col("x"))).collect()] == ["12", "12", "12", "12", "", None]


TRAIN = "id string, phoneme_ref string, split string, source string, train_key string, g int, side int"
TTS = "row_no long, phoneme_ref string, phoneme_mis string, seq string"
HOLD = "block string, eval_set string, holdout_train_ids array<string>, holdout_dev_ids array<string>, holdout_phoneme_refs array<string>, p int"
PILOT = "id string, stratum string, sentence string, phoneme_ref string, client_id string, seq string, rec string"


def tables(spark):
    train = spark.createDataFrame([("1", "a b c", "train", "s", "k", 0, 0), ("1", "a b c", "train", "s", "k", 0, 0), ("2", "a b c", "dev", "s", "k", 0, 0), ("3", None, "train", None, "k", 0, 0), (None, "a b c", "train", "s", "k", 0, 0)], TRAIN)
    tts = spark.createDataFrame([(5, "x", "a  b c", "q"), (5, "x", "a  b c", "q"), (6, None, None, None)], TTS)
    hold = spark.createDataFrame([("b0", "e", [" 1", None, "9"], ["audio_3.wav", "2"], ["a b c", None, "z"], 0), ("b1", "e", None, None, None, 0)], HOLD)
    pilot = spark.createDataFrame([("p1", "u", "كَتَبَ رجل", "a b c", "s1", "x", "y"), ("p1", "u", "كَتَبَ رجل", "a b c", "s1", "x", "y"), ("p2", None, None, None, " ", None, None)], PILOT)
    return train, tts, hold, pilot


def test_cross_split_pairs_with_dirt(spark):
    got = {(r.eval_key, r.train_key) for r in overlap.cross_split_pairs(*tables(spark)).collect()}
    assert got == {("b0:t:0", "1"), ("b0:d:0", "3"), ("b0:r:0", "1"), ("b0:r:0", "iqra_tts_5"), ("p1", "1"), ("p1", "iqra_tts_5")}
    report = {(r.eval_set, r.source): r.pairs for r in overlap.overlap_report(*tables(spark)).collect()}
    assert report["pilot", "iqra_tts"] == 1 and report["e", "s"] == 2


def test_empty_tables(spark):
    t = [x.limit(0) for x in tables(spark)]
    assert overlap.cross_split_pairs(*t).count() == 0
    recs = splits.records(t[3], t[2])
    assert splits.tied_groups(recs).count() == 0 and splits.assign(recs).count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(7)
    ties = [(f"r{r.randrange(400):03}", f"a{r.randrange(260)}") for _ in range(420)] + [(f"c{i:03}", f"x{i + j}") for i in range(120) for j in (0, 1)] + [(f"h{i:03}", "hot") for i in range(300)]
    got = {(x.rec, x.root) for x in graph.components(graph.star_edges(spark.createDataFrame(ties, "rec string, attr string"))).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first = {}
    for rec, attr in ties:
        a, b = find(first.setdefault(attr, rec)), find(rec)
        up[max(a, b)] = min(a, b)
    groups = collections.defaultdict(set)
    for rec, _ in ties:
        groups[find(rec)].add(rec)
    assert got == {(x, min(g)) for g in groups.values() if len(g) > 1 for x in g}


def test_ties(spark):
    _, _, hold, pilot = tables(spark)
    more = spark.createDataFrame([("p3", "u", "كتب، رجل!", None, None, None, None), ("p4", "u", None, None, " ", None, None), ("p5", "u", "؟", "q", "s1 ", None, None), ("p6", "u", "!", None, "", None, None)], PILOT)
    got = {(r.rec, r.root) for r in splits.tied_groups(splits.records(pilot.unionByName(more), hold)).collect()}
    assert got == {(x, "b0:r:0") for x in ("b0:r:0", "p1", "p3")}


def test_related_records_share_a_split(spark):
    r = random.Random(2)
    rows = [(f"p{i:04}", f"st{i % 3}", None, None, f"s{r.randrange(150)}" if i % 3 else None, None, None) for i in range(900)] + [(f"q{i:03}", "u", None, None, "hot", None, None) for i in range(450)]
    _, _, hold, _ = tables(spark)
    out = splits.assign(splits.records(spark.createDataFrame(rows, PILOT), hold), (0.5, 0.25, 0.25)).collect()
    assert len(out) == len({x.rec for x in out}) == 1350 + 3
    of = collections.defaultdict(set)
    for x in out:
        of[x.group_key].add(x.split)
    assert all(len(v) == 1 for v in of.values())
    n = collections.Counter(x.split for x in out)
    for name, share in (("train", 0.5), ("validation", 0.25), ("test", 0.25)):
        assert abs(n[name] / len(out) - share) < 0.03


def test_annealing_never_worsens():
    import numpy as np

    rng = np.random.default_rng(0)
    s, l = rng.integers(1, 20, 200).astype(float), rng.integers(0, 5, (200, 4)).astype(float)
    start, want = rng.integers(0, 3, 200), np.array([0.8, 0.1, 0.1]) * 1.0
    w, wl = want * s.sum(), want[:, None] * l.sum(0)[None]

    def cost(x):
        have = np.bincount(x, weights=s, minlength=3)
        hl = np.stack([l[x == j].sum(0) for j in range(3)])
        return np.abs(have - w).sum() + 0.5 * np.abs(hl - wl).sum()

    starts = np.stack([start, rng.integers(0, 3, 200)])
    for before, best in zip(starts, splits._anneal(s, l, starts, w, wl, rng, 12)):
        assert cost(best) < 0.2 * cost(before)
    alone = splits._anneal(np.array([5.0]), np.ones((1, 4)), np.array([[1]]), want * 5, want[:, None] * np.ones((3, 4)), rng, 12)
    assert alone.tolist() == [[0]]


def test_every_partition_works_on_all_of_its_components(spark, monkeypatch):
    """Sizes of all classes, one group with a third of the rows, several partitions: shares are met and the work follows the components."""
    monkeypatch.setattr(splits, "PART_COMPONENTS", 150)
    r = random.Random(8)
    rows = [(f"h{i:04}", "u", None, None, "hot", None, None) for i in range(900)]
    rows += [(f"g{g}x{i:03}", f"st{g % 4}", None, None, f"g{g}", None, None) for g in range(60) for i in range(r.choice([2, 3, 6, 20, 40]))]
    rows += [(f"s{i:04}", f"st{i % 4}", None, None, None, None, None) for i in range(900)]
    _, _, hold, _ = tables(spark)
    recs = splits.records(spark.createDataFrame(rows, PILOT), hold.limit(0))
    for want in ((0.8, 0.1, 0.1), (0.5, 0.3, 0.2)):
        out = splits.assign(recs, want)
        got = {x.split: x.share for x in splits.split_report(out).collect()}
        assert all(abs(got[n] - w) < 0.01 for n, w in zip(splits.NAMES, want)), got
        of = collections.defaultdict(set)
        for x in out.collect():
            of[x.group_key].add(x.split)
        assert all(len(v) == 1 for v in of.values())


def test_hot_keys_are_divided(spark, monkeypatch):
    from warraq.llm import members

    monkeypatch.setattr(members, "SHARE", 25)
    monkeypatch.setattr(members, "MOST_LARGE", 2)
    ties = [(f"h{i:03}", "hot") for i in range(200)] + [(f"h{i:03}", "warm") for i in range(150, 400)] + [(f"z{i:03}", "mild") for i in range(60)] + [(f"z{i:03}", f"own{i}") for i in range(60)]
    got = {(x.rec, x.root) for x in graph.components(graph.star_edges(spark.createDataFrame(ties, "rec string, attr string"))).collect()}
    assert got == {(f"h{i:03}", "h000") for i in range(400)} | {(f"z{i:03}", "z000") for i in range(60)}


def test_pairs_of_hot_sequences(spark, monkeypatch):
    """One sequence holds a third of the training rows and many references: compared once, expanded last."""
    from warraq.llm import members

    monkeypatch.setattr(members, "SHARE", 30)
    hot = " ".join("abcdefghij" * 2)
    train = spark.createDataFrame([(f"t{i:03}", hot, "train", "s", "k", 0, 0) for i in range(200)] + [(f"u{i:03}", hot + f" x{i % 7}", "train", "s", "k", 0, 0) for i in range(100)], TRAIN)
    _, tts, hold, _ = tables(spark)
    pilot = spark.createDataFrame([(f"p{i:02}", "u", None, hot, None, None, None) for i in range(40)], PILOT)
    none = hold.limit(0)
    got = {(r.eval_key, r.train_key) for r in overlap.cross_split_pairs(train, tts.limit(0), none, pilot).collect()}
    assert len(got) == 40 * 300
    classes = overlap.overlap_classes(train, tts.limit(0), none, pilot).collect()
    assert sorted((c.distance, c.eval_records, c.train_records) for c in classes) == [(0, 40, 200)] + sorted((1, 40, n) for n in [15, 15, 14, 14, 14, 14, 14])
