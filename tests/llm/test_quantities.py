import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.llm import mixture, pieces, quota, thresholds

PILOT = "id string, stratum string, disagreement double, c0 int, sig string, h long"
TARGETS = "category string, stratum string, band_low double, band_high double, target_share double, min_rows int, sample_rows long"


def pilot(spark, n=3000):
    r = random.Random(1)
    rows = [(f"{i:05}", r.choice(["a", " A", "b ", "B", "c", None]), r.choice([0.1, 0.3, 0.7, float("nan"), None]), 1, "x", 2) for i in range(n)]
    return spark.createDataFrame(rows + rows[:50] + [(None, "a", 0.1, 1, "x", 2)], PILOT), rows


def test_sample_follows_the_targets(spark):
    df, rows = pilot(spark)
    cats = [("a0", "a", 0.0, 0.2, 0.5, 5, 300), ("a1", "a", 0.2, 0.5, 0.2, 5, 300), ("b0", "b", 0.0, 99.0, 0.3, 5, 300), ("c9", "c", 5.0, 9.0, 0.0, 3, 300), ("d", "d", 0.0, 1.0, 0.0, 0, 300)]
    sample, report = quota.draw(df, spark.createDataFrame(cats, TARGETS))
    rep = {r.category: r for r in report.collect()}
    got = [r.id for r in sample.collect()]
    assert len(got) == len(set(got)) == 300
    assert [k for k, r in rep.items() if r.falls_short] == ["c9"]
    assert (rep["a0"].drawn_rows, rep["a1"].drawn_rows, rep["b0"].drawn_rows) == (150, 60, 90)
    supply = sum(1 for _, s, x, *_ in rows if s and s.strip().lower() == "a" and x == 0.1)
    assert rep["a0"].supply == supply
    again = [r.id for r in quota.draw(df.orderBy(F.rand(3)), spark.createDataFrame(cats, TARGETS))[0].collect()]
    assert sorted(again) == sorted(got)


def test_sample_edges(spark):
    df, _ = pilot(spark, 60)
    cats = spark.createDataFrame([("a0", "a", 0.0, 0.2, 0.9, 2, 1000), (None, "a", 0.0, 0.2, 0.9, 2, 1000), ("n", None, None, None, 0.1, 0, 1000)], TARGETS)
    sample, report = quota.draw(df, cats)
    assert sample.count() == 60 and {r.category: r.falls_short for r in report.collect()} == {"a0": True, "n": True}
    sample, report = quota.draw(df.limit(0), cats)
    assert sample.count() == 0 and report.count() == 2
    sample, report = quota.draw(df, cats.limit(0))
    assert sample.count() == 0 and report.count() == 0


def test_repair_keeps_floors_and_overlapping_categories():
    rng = np.random.default_rng(3)
    supply = np.array([500, 40, 300, 5, 200])
    member = np.array([[1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 1, 1], [0, 0, 0]])
    want, floors = np.array([50.0, 50.0, 2.0]), np.array([10, 10, 4])
    start = quota.floor_start(supply, member, floors, 100, rng)
    assert start.sum() == 100 and (member.T @ start >= floors).all() and (start <= supply).all()
    end = quota.repair(start, supply, member, want, floors)
    off = lambda t: np.abs(member.T @ t - want).sum()
    assert end.sum() == 100 and off(end) <= off(start) and (member.T @ end >= floors).all() and off(end) <= 2


def test_thresholds_are_exact(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("grp"), thresholds.hash_order("id").alias("h"), (F.col("id") % 7 + 1).alias("w"), "id")
    rows = df.collect()
    cut = thresholds.prefix_thresholds(df, {"0": 1234.0, "1": 0.0, "2": 1e9, "none": 5.0})
    for g, budget in (("0", 1234), ("1", 0), ("2", 1e9)):
        own = sorted((r.h, r.w) for r in rows if r.grp == g)
        total, n = 0, 0
        for _, w in own:
            if total + w > budget:
                break
            total, n = total + w, n + 1
        assert sum(h < cut[g] for h, _ in own) == n
    kept = thresholds.with_below(df, cut, "_in").where("_in").groupBy("grp").agg(F.sum("w").alias("w")).collect()
    assert {r.grp: r.w for r in kept if r.grp == "0"}["0"] <= 1234
    many = {f"g{i}": 5.0 for i in range(1500)} | {"0": 100.0}
    assert thresholds.prefix_thresholds(df, many)["0"] == thresholds.prefix_thresholds(df, {"0": 100.0})["0"]


def test_mixture(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choices(["read", "the", "كتب", "line"], k=r.randrange(1, 40))), r.choice(["a", "a", "b", "c", None, " ", "x"]), 1) for i in range(3000)] + [(9001, None, "a", 1), (9002, "", "a", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, h int")
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.5, 3), ("c", 0.3, 1), ("gone", 0.0001, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixture.mix(df, targets)
    rep = {x.source: x for x in report.collect()}
    total = sum(x.tokens for x in mixture.token_sizes(df).where("source is not null").collect())
    longest = 60
    assert rep["a"].wanted_tokens == pytest.approx(0.2 * total)
    for s, most in (("a", 2), ("b", 3), ("c", 1)):
        x = rep[s]
        assert x.falls_short == (x.tokens * most < x.target_share * total)
        assert (x.mixed_tokens == x.tokens * most) if x.falls_short else (0 <= x.wanted_tokens - x.mixed_tokens <= longest)
    assert rep["gone"].falls_short and rep["gone"].tokens == 0
    m = mix.collect()
    assert {x.source for x in m} == {"a", "b", "c"} and max(x.repeats for x in m if x.source == "b") <= 3 and len({x.doc_id for x in m}) == len(m)
    assert sum(x.tokens * x.repeats for x in m if x.source == "b") == rep["b"].mixed_tokens
    mix, report = mixture.mix(df.limit(0), targets)
    assert mix.count() == 0 and report.count() == 4


def test_balanced_mixture(spark):
    """The largest mix whose shares hold: one source is used up, all reached shares are the targets'."""
    r = random.Random(4)
    docs = [(i, " ".join(r.choices(["read", "the", "كتب", "line"], k=r.randrange(1, 40))), r.choice(["a"] * 6 + ["b"] * 2 + ["c"])) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.4, 3), ("c", 0.2, 1), ("gone", 0.1, 4), ("zero", 0.0, 4)], "source string, target_share double, max_repeats int")
    rep = {x.source: x for x in mixture.mix(df, targets, balanced=True)[1].collect()}
    for s, share in (("a", 3 / 9), ("b", 4 / 9), ("c", 2 / 9)):
        assert rep[s].target_share == pytest.approx(share) and rep[s].mixed_share == pytest.approx(share, abs=0.01) and not rep[s].unmet
    assert rep["c"].mixed_tokens == rep["c"].tokens and rep["gone"].mixed_tokens == 0 and rep["gone"].falls_short and rep["zero"].falls_short
    plain = {x.source: x for x in mixture.mix(df, targets)[1].collect()}
    assert plain["c"].unmet and plain["c"].falls_short and plain["c"].largest_mix_tokens == pytest.approx(plain["c"].tokens / 0.2) and plain["zero"].largest_mix_tokens is None


def test_token_counts(monkeypatch):
    from pathlib import Path

    count = mixture.TokenCounter(Path(mixture.TOKENIZER).read_bytes())
    assert count(None) == count("") == 0 and count("read the line") > 0
    r = random.Random(1)
    texts = ["".join(r.choice(["كتاب", "abc", "reading", "é", "\U0001f600", "7" * 9, "...", "  ", "\n", " ", "'s"]) for _ in range(r.randrange(1, 80))) for _ in range(400)]
    whole = [len(count.encode(t)) for t in texts]
    assert count("x " + "ab" * 3000 + " y") == len(count.encode("x " + "ab" * 3000 + " y"))
    assert count("z" * 200_000) > 10_000
    monkeypatch.setattr(mixture, "LONG_RUN", 5)
    short = mixture.TokenCounter(Path(mixture.TOKENIZER).read_bytes())
    assert [short(t) for t in texts] == whole


def test_conflicting_targets_are_reported(spark):
    """Enough rows of both categories, but the sample is too small for both: neither target is met."""
    df = spark.createDataFrame([(f"{i:03}", "a" if i % 2 else "b", 0.1) for i in range(200)], "id string, stratum string, disagreement double")
    cats = spark.createDataFrame([(c, c, 0.0, 1.0, 0.8, floor, 50) for c, floor in (("a", 20), ("b", 5))], TARGETS)
    sample, report = quota.draw(df, cats)
    rep = {r.category: r for r in report.collect()}
    assert sample.count() == 50 and sum(r.drawn_rows for r in rep.values()) == 50 and rep["a"].drawn_rows >= 20
    assert any(r.unmet for r in rep.values()) and all(r.unmet == (r.drawn_rows < 40) for r in rep.values()) and not any(r.falls_short for r in rep.values())
    floors = spark.createDataFrame([(c, c, 0.0, 1.0, 0.5, 45, 50) for c in "ab"], TARGETS)
    sample, report = quota.draw(df, floors)
    assert sample.count() == 50 and [r.unmet for r in report.collect()].count(True) >= 1


@pytest.mark.parametrize("seed", range(6))
def test_pieces(seed):
    r = random.Random(seed)
    for _ in range(60):
        text = "".join(r.choice(["كتب", "a", "word", "\U0001ee01", "x" * r.randrange(1, 90), "بَّ"]) + r.choice([" ", " ", "\n", ". ", "، ", " ", "", "  "]) for _ in range(r.randrange(1, 120)))
        limit, overlap = r.choice([1, 2, 7, 40, 100, 320]), r.choice([0, 1, 5, 12])
        cuts = pieces.split_item(text, limit, overlap)
        assert "".join(text[s:e] for _, s, e in cuts) == text
        assert all(e - o <= limit and o <= s < e for o, s, e in cuts) or len(text) == 0
        assert len(cuts) == 1 if len(text) <= limit else len(cuts) > 1
        for (o0, _, e0), (o, s, _) in zip(cuts, cuts[1:]):
            assert e0 == s and o >= o0
            words = text[o:s].split()
            assert len(words) <= overlap and (overlap == 0 or limit < 100 or len(words) == min(overlap, len(text[o0:s].split())) or len(" ".join(text[o0:s].split()[-overlap:])) > limit // 2 - 8)


def test_cuts_fall_on_natural_boundaries():
    text = ("one two three. " * 30).strip()
    for _, s, _ in pieces.split_item(text, 100, 2)[1:]:
        assert text[:s].endswith(". ")
    run = pieces.split_item("a" * 10, 4, 3)
    assert [e for _, _, e in run][-1] == 10 and all(e - o <= 4 for o, _, e in run) and all(a[2] == b[1] for a, b in zip(run, run[1:]))
    assert pieces.split_item("a" * 10, 4, 0) == [(0, 0, 2), (2, 2, 5), (5, 5, 7), (7, 7, 10)]
    assert pieces.split_item("", 4, 3) == [(0, 0, 0)]
    s = "بَّ" * 40
    assert all(s[c] == "ب" for _, c, _ in pieces.split_item(s, 30, 0))


def test_items(spark):
    limits = pieces.load_limits(spark.createDataFrame([("catt", 10, 1), ("free", None, 0)], "tool string, max_input_chars int, overlap_words int"))
    b = spark.createDataFrame([(1, " CATT ", ["short", None, "a long text here", ""], [0, 5]), (1, " CATT ", ["short", None, "a long text here", ""], [0, 5]), (2, "free", ["a long text here"], None), (3, None, ["a long text here"], [1]), (4, "catt", None, None)], "batch_id long, tool string, texts array<string>, seams array<int>").withColumn("piece", F.lit(1))
    v = spark.createDataFrame([(7, "one two three four"), (8, None), (9, "x")], "verse_id long, text string").withColumn("t", F.lit(1))
    items = pieces.batch_items(b, limits).unionByName(pieces.verse_items(v, limits))
    cutp = pieces.cut_pieces(items).distinct().collect()
    assert {(r.tool, r.item_key) for r in cutp} == {("catt", "1:2"), ("catt", "v7")} and all(len(r.piece) <= 10 for r in cutp)
    every = pieces.pieces(items).distinct().collect()
    assert {r.item_key for r in every} == {"1:0", "1:2", "1:3", "2:0", "3:0", "v7", "v9"}
    assert {r.item_key: r.recorded for r in every}["1:2"] is None and {r.item_key: r.recorded for r in every}["3:0"] == 1
    assert pieces.pieces(items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.load_limits(spark.createDataFrame([("t", 0, 0)], "tool string, max_input_chars int, overlap_words int"))
    assert pieces.cut_pieces(pieces.batch_items(b, [])).count() == 0 and pieces.verse_items(v, []).count() == 0
