import math

import pytest
from pyspark.sql import functions as F

from warraq.functions import g2p
from warraq.operators import comparison as K
from warraq.operators import resampling as B
from warraq.sources import readers as R
from warraq.sources import writers as W


def ark(spark, rows):
    return spark.createDataFrame(rows, "id string, tokens array<string>")


def test_three_way_guard(spark):
    a = ark(spark, [("x", ["a"]), ("y", [])])
    assert sorted(r.id for r in K.three_way(a, a, a).collect()) == ["x", "y"]
    with pytest.raises(ValueError, match="same id"):
        K.three_way(a, a, a.where("id = 'x'"))


def test_ordinals(spark):
    a, b = spark.createDataFrame([(0, "a"), (1, "b")], "n int, x string"), spark.createDataFrame([(1, "q"), (0, "p")], "n int, y string")
    assert sorted(tuple(r) for r in K.zip_by_ordinal(a, b, "n").collect()) == [(0, "a", "p"), (1, "b", "q")]
    with pytest.raises(ValueError):
        K.zip_by_ordinal(a, b.limit(1), "n")


def test_differences(spark):
    a = spark.createDataFrame([("1", "exact", "a b"), ("2", "exact", None), ("3", "near", "a b c")], "id string, kind string, v string")
    b = spark.createDataFrame([("1", "a  b"), ("2", "x"), ("3", "a c")], "id string, v string")
    got = {r.kind: (r.rows, r.different, r.distance) for r in K.label_differences(a, b, "id", "v", "kind").collect()}
    assert got == {"exact": (2, 1, 1), "near": (1, 1, 1)}
    m = spark.createDataFrame([("s", 0.5, float("nan"))], "k string, f1 double, der double")
    n = spark.createDataFrame([("s", 0.502, float("nan"))], "k string, f1 double, der double")
    assert {r.metric: r.agrees for r in K.metric_deltas(m, n, "k", ["f1", "der"], 0.001).collect()} == {"f1": False, "der": True}
    sign = lambda xs: K.uniform_sign(spark.createDataFrame([(x,) for x in xs], "v double"), "v", 0.5).first()[0]
    assert [sign([0.1, -0.4]), sign([0.6, 0.1, float("nan")]), sign([-0.6, 0.1, None])] == ["within", "shifted", "mixed"]


def test_orders_and_guards(spark):
    x = spark.createDataFrame([("a", 1), ("b", 5), ("c", None)], "k string, d int")
    assert [(r.k, r.tier) for r in K.tiered_order(x, [F.col("k") == "c"], "d", "k").collect()] == [("c", 0), ("b", 1), ("a", 1)]
    b = x.withColumn("seed", F.lit(3))
    assert K.require_identity(b, 3, 3) is b
    with pytest.raises(ValueError):
        K.require_identity(b, 4, 3)
    s = K.recovery_summary(spark.createDataFrame([("a", 1), ("b", 2)], "k string, candidates long"), x, "k").first()
    assert (s.queries, s.located, s.unique_place, s.ambiguous, s.missing) == (3, 2, 1, 1, 1)
    w = ark(spark, [("x", ["a"] * 8), ("y", ["a"] * 7), ("z", ["a"] * 41)])
    assert [r.id for r in K.length_band(w, "tokens", 8, 40).collect()] == ["x"]


def test_correct_rates(spark):
    x = spark.createDataFrame([("a b c d", "a x c d e")] * 2 + [("", "q"), (None, "q")], "r string, h string").withColumn("g", F.lit(1))
    r = K.correct_rates(x, "r", "h", ["g"]).first()
    assert (r.tokens, r.substitutions, r.insertions, r.deletions, r.correct_rate, r.accuracy) == (8, 2, 2, 0, 0.75, 0.5)


def test_confidence(spark):
    x = spark.createDataFrame([(["a", " "], ["m", "z"], [[0.0, math.log(3.0)], [1000.0, 1000.0]])], "l array<string>, m array<string>, g array<array<double>>")
    got = x.select(K.positions_with_confidence("l", "m", "g")).first()[0]
    assert [(p.letter, p.mark, round(p.confidence, 6), p.forced) for p in got] == [("a", "m", 0.75, False), (" ", "", 0.5, True)]
    assert K.provenance(seed=3)["seed"] == "3"


def test_conditions_and_resampling(spark):
    t = spark.createDataFrame([("gold", "1", "كِتَابٌ"), ("auto", "1", "كِتَابٌ")], "condition string, id string, text string")
    assert [r.phonemes for r in g2p.phonetize_conditions(t, "condition", "text").collect()] == ["k i t aa b".split()] * 2
    with pytest.raises(ValueError, match="blank"):
        g2p.phonetize_conditions(t.withColumn("text", F.lit(" ")), "condition", "text")
    c = spark.createDataFrame([("p1", 3, 1, 5, 4), ("p2", 1, 2, 4, 2)], "c string, fr int, fa int, tr int, clips int")
    assert B.clip_equivalent_se(c, "c", "clips", 6, 100, 1).first().se > 0


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([("007", "كَتَبَ")], "id string, sentence string")
    W.write_jsonl(df, str(tmp_path / "j"))
    assert R.jsonl(spark, str(tmp_path / "j")).first().id == "007"
    (tmp_path / "w").mkdir()
    for n in ("audio_1.wav", "audio_2.wav"):
        (tmp_path / "w" / n).write_bytes(b"x")
    assert W.copy_listed(R.binary_files(spark, str(tmp_path / "w")), spark.createDataFrame([("1",)], "id string"), str(tmp_path / "o")) == 1
    assert (tmp_path / "o/audio_1.wav").exists()
    W.write_packet(spark.createDataFrame([(1, "كَتَبَ")], "item int, text string"), str(tmp_path / "p"), "mark it")
    assert "كتب\n" in (tmp_path / "p/blank.txt").read_text()
    lines = R.numbered_lines(spark, str(tmp_path / "p/blank.txt"))
    assert R.submission(lines).count() == 0
