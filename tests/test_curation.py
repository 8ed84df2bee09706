import random

import pytest
from pyspark.sql import functions as F

from warraq.operators import annotation as A
from warraq.operators import curation as C
from warraq.operators import profile as H
from warraq.operators import resampling as B
from warraq.operators import sampling as S

POOL = "id string, sentence string, tashkeel_sentence string"


def test_pool_keeps_the_eligible_member(spark):
    rows = [("1", "كَتَبَ رَجُلٌ دَرْسًا", "كَتَبَ رَجُلٌ دَرْسًا"), ("2", "كتب رجل درسا", "كَتَبَ رَجُلٌ دَرْسًا"), ("3", None, None), ("4", "abc 12", "x"), ("5", "نعم", "نعم")]
    got = {r.id: r for r in C.build_pool(spark.createDataFrame(rows, POOL)).collect()}
    assert got["2"].eligible and "duplicate" in got["1"].flags and not got["1"].eligible
    assert set(got["3"].flags) >= {"no_arabic", "no_tashkeel", "short"}
    assert {"latin", "digits", "no_arabic"} <= set(got["4"].flags) and got["5"].flags == ["short"]
    assert C.build_pool(spark.createDataFrame([], POOL)).count() == 0
    n = {r.flag: r.rows for r in C.flag_counts(C.build_pool(spark.createDataFrame(rows, POOL))).collect()}
    assert n["duplicate"] == 1 and n["partially_vowelized"] == 0 and len(n) == 9


def test_overlap_lists_all_copies(spark):
    train = spark.createDataFrame([("a", "كَتَبَ"), ("b", "كتب."), ("c", "نعم"), ("d", None)], "id string, sentence string")
    pilot = spark.createDataFrame([("كتب",), (None,), ("",)], "sentence string")
    assert sorted(r.id for r in C.skeleton_overlap(train, pilot).collect()) == ["a", "b"]
    sets = pilot.withColumn("eval_set", F.lit("p"))
    r = C.contamination(sets, train).first()
    assert (r.skeletons, r.hit_skeletons, r.hit_train_rows, r.raw_hits) == (1, 1, 2, 0)


def test_holdout_filter(spark):
    hold = spark.createDataFrame([(["audio_1.wav", " 2 "], ["x/audio_9.wav", None], ["a  b", None])], "t array<string>, d array<string>, holdout_phoneme_refs array<string>")
    ids, refs = C.holdout_keys(hold, ["t", "d"])
    rows = spark.createDataFrame([("1", "a b"), ("2", "z"), ("3", " a\tb"), ("4", None), ("9", "q"), ("3", "z")], "id string, phoneme_ref string")
    got = sorted((r.id, r.verdict) for r in C.holdout_filter(rows, ids, refs).collect())
    assert got == [("1", "id"), ("2", "id"), ("3", "keep"), ("3", "phoneme"), ("4", "keep"), ("9", "id")]
    with pytest.raises(ValueError, match="empty"):
        C.require_rows(ids.limit(0), "the hold-out")


def test_canonical_policy(spark):
    rows = [("w/wav/audio_12.wav", " a  b ", None), ("w/wav/audio_Am_1.wav", "s", None), ("w/wav/audio_Am_2.wav", "s", ""), ("w/wav/audio_3.wav", " ", "k"), ("x.flac", "s", "k")]
    df = spark.createDataFrame(rows, "path string, sentence string, given string")
    files = spark.createDataFrame([("w/canonicals/canonical_Am_1.txt", "q  r\n"), ("w/canonicals/canonical_Am_2.txt", " ")], "path string, content string")
    got = {r.path: (r.provenance, r.canonical) for r in C.canonical_policy(df, files, canonical="given").collect()}
    assert got == {
        "w/wav/audio_12.wav": ("from_sentence", "a b"), "w/wav/audio_Am_1.wav": ("from_file", "q r"), "w/wav/audio_Am_2.wav": ("missing_canonical", None),
        "w/wav/audio_3.wav": ("empty_transcript", None), "x.flac": ("passed_through", "k"),
    }


def test_key_reports(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "id string") for s in ("aabc", "cd"))
    r = C.key_report(a, b, "id").first()
    assert (r.shared, r.only_left, r.only_right) == (1, 2, 1)
    assert sorted(x.id for x in C.clean_keys(a, b.where("id = 'c'"), "id").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        C.clean_keys(a, b, "id")
    assert sorted(x.id for x in C.union_of(a, b, "id").collect()) == list("abcd")


def test_spans_cross_lines(spark):
    corpus = spark.createDataFrame([("e", 1, "كتب رجل"), ("e", 2, "درسا كَتَبَ"), ("e", 3, "رجل درسا"), ("f", 1, "كتب")], "ed string, n int, text string")
    q = spark.createDataFrame([("q1", "رجل درسا"), ("q2", "كتب"), ("q3", "لا"), ("q4", None)], "q string, t string")
    m = C.span_matches(corpus, q, ["ed"], ["n"], "text", "q", "t")
    got = sorted((r.q, r.ed, r.position) for r in m.collect())
    assert got == [("q1", "e", 1), ("q1", "e", 4), ("q2", "e", 0), ("q2", "e", 3), ("q2", "f", 0)]
    first = {r.q: r for r in C.recovery_choice(m, "q", ["ed"]).collect()}
    assert first["q2"].candidates == 3 and '"position":0' in first["q2"].primary
    assert C.span_matches(corpus.limit(0), q, ["ed"], ["n"], "text", "q", "t").count() == 0


def test_draws(spark):
    pool = spark.createDataFrame([(str(i),) for i in range(40)], "id string")
    a = [(r.rank, r.id) for r in S.draw(pool, 10, 3).orderBy("rank").collect()]
    b = [(r.rank, r.id) for r in S.draw(pool.orderBy(F.desc("id")), 10, 3).orderBy("rank").collect()]
    assert a == b and [x for _, x in a] == random.Random(3).sample(sorted(map(str, range(40))), 10)
    with pytest.raises(ValueError):
        S.draw(pool, 41, 3)
    assert S.hash_draw(pool, 5, 1).count() == 5
    scored = pool.withColumn("s", F.when(F.col("id") == "3", F.lit(float("nan"))).otherwise(F.col("id").cast("double")))
    x = S.stratified_pick(scored, "s", 3, 5).collect()
    assert len({r.id for r in x}) == 6 and all(float(r.id) >= 28 for r in x if r.stratum_pick == "high")
    every = S.stratified_pick(scored, "s", 20, 5)  # the second half comes from all that the first has left
    assert every.count() == every.select("id").distinct().count() == 40
    g, ids = random.Random(5), sorted(map(str, range(40)), key=lambda i: (i == "3", -float(i)))
    high = g.sample(ids[:12], 3)
    want = high + g.sample([i for i in ids if i not in high], 3)
    assert [r.id for r in S.stratified_draw(scored, "s", 6, 5).orderBy("rank").collect()] == want
    assert S.stratified_draw(scored.limit(0), "s", 6, 5).count() == 0 and S.stratified_draw(scored, "s", 500, 5).count() == 40


def test_batches_and_order(spark):
    df = spark.createDataFrame([(i, i % 2, i) for i in range(9)], "id int, b int, n int")
    got = {r.id: r.batch for r in S.length_batches(df, "n", 2, "b").collect()}
    assert got == {8: 0, 6: 0, 4: 1, 2: 1, 0: 2, 7: 0, 5: 0, 3: 1, 1: 1}
    assert sorted(r.id for r in S.nth_of(df, "b", "id", 6).collect()) == [2, 5]
    r = H.order_summary(df, "n").first()
    assert (r.n, r.least, r.p05, r.median, r.p90, r.p95, r.most) == (9, 0, 0, 4, 8, 8, 8)
    assert {(x.bucket, x.n) for x in H.bucket_histogram(df, "n", [2, 5]).collect()} == {(-1, 2), (0, 3), (1, 4)}


def test_places_over_ranges(spark):
    """A group with a third of all rows, nulls in the order, ties told apart by the id: the places of one sort."""
    from warraq.operators.ranking import with_place

    r = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else r.choice("abc"), r.choice([None, 1, 2, 3, 50])) for i in range(900)] + [(900, None, 1)]
    x = with_place(spark.createDataFrame(rows, "id int, g string, n int").repartition(7), ["g"], [F.col("n"), F.col("id")], "place")
    want = {}
    for g in {g for _, g, _ in rows}:
        own = sorted((n is not None, n or 0, i) for i, h, n in rows if h == g)
        want |= {i: k for k, (_, _, i) in enumerate(own)}
    assert x.columns == ["id", "g", "n", "place"] and {y.id: y.place for y in x.collect()} == want
    assert with_place(spark.createDataFrame([], "id int, g string, n int"), ["g"], [F.col("n")], "place").count() == 0


def test_order_summary_over_ranges(spark):
    r = random.Random(5)
    rows = [("a", float(r.choice([1, 2, 2, 3, 1000, r.random()]))) for _ in range(777)] + [("b", 5.0)] * 40 + [("c", None)] + [(None, float(i)) for i in range(41)]
    got = {x.g: tuple(x)[1:] for x in H.order_summary(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        v = sorted(x for h, x in rows if h == g and x is not None)
        n = len(v)
        assert got[g] == (n, v[0], v[n // 20], v[n // 2], v[9 * n // 10], v[n + (-n // 20)], v[-1])


def test_halved_batches_and_prefix(spark):
    df = spark.createDataFrame([(0, 9, 0), (1, 4, 0), (2, 3, 0), (3, 2, 1), (4, 99, 2)], "id int, n int, b int")
    assert sorted(x.id for x in S.halve_oversized(df, "n", ["b"], 5).collect()) == [0, 3, 4]
    assert [x.id for x in S.key_prefix(df, "n", 2).collect()] == [3, 2] and S.key_prefix(df, "n", None).count() == 5


def test_bootstrap(spark, monkeypatch):
    a = spark.createDataFrame([("p1", 3, 5, 1), ("p2", 1, 2, 4), ("p3", 0, 2, 2)], "c string, fr int, fa int, tr int")
    b = spark.createDataFrame([("p1", 3, 1, 5), ("p2", 1, 1, 5), ("p3", 0, 1, 3)], "c string, fr int, fa int, tr int")
    x, y = (B.paired_bootstrap(a, b, "c", 200, s).first() for s in (1, 1))
    assert x == y and x.low <= x.delta <= x.high and x.excludes_zero and x.clusters == 3
    same = B.paired_bootstrap(a, a, "c", 50, 1).first()
    assert same.delta == same.low == same.high == 0 and not same.excludes_zero
    with pytest.raises(ValueError):
        B.paired_bootstrap(a.limit(0), b, "c", 10, 1)
    assert B.cluster_se(a, "c", 100, 1).first().se > 0
    # one generator draws for all replicates in turn
    g, n, f1 = random.Random(7), {"p1": (3, 5, 1, 1, 5), "p2": (1, 2, 4, 1, 5), "p3": (0, 2, 2, 1, 3)}, lambda fr, fa, tr: 2 * tr / (2 * tr + fr + fa)
    deltas = []
    for _ in range(200):
        draw = [sorted(n)[g.randrange(3)] for _ in range(3)]
        s = [sum(n[p][i] for p in draw) for i in range(5)]
        deltas.append(f1(s[0], s[3], s[4]) - f1(s[0], s[1], s[2]))
    deltas.sort()
    r = B.paired_bootstrap(a, b, "c", 200, 7).first()
    assert (r.low, r.high) == (pytest.approx(deltas[5]), pytest.approx(deltas[195]))
    monkeypatch.setattr(B, "BLOCK_CELLS", 10)
    assert B.paired_bootstrap(a, b, "c", 200, 7).first() == r
    d = {x.c: x.delta for x in B.delta_by_cluster(a, b, "c").collect()}
    assert d["p1"] == pytest.approx(f1(3, 1, 5) - f1(3, 5, 1))
    monkeypatch.setattr(B, "MOST_DRAWS", 10)
    with pytest.raises(ValueError, match="at most"):
        B.paired_bootstrap(a, b, "c", 200, 7)


def test_queue_and_validation(spark):
    block = spark.createDataFrame([(f"r{i}", i, i in (4, 30), "s") for i in (0, 1, 4, 30)], "id string, rank int, crossover boolean, sentence string")
    a = A.assignments(block)
    got = {(r.annotator, r.queue_place): (r.id, r.condition) for r in a.collect()}
    assert got == {("a1", 0): ("r4", "anchored"), ("a1", 1): ("r30", "blank"), ("a1", 2): ("r0", "anchored"), ("a2", 0): ("r4", "blank"), ("a2", 1): ("r30", "anchored"), ("a2", 2): ("r1", "anchored")}
    rec = [("r4", "a1", "anchored", "d", "1"), ("r4", "a1", "anchored", "d", "2"), ("r4", "a2", "anchored", "d", "1"), ("r30", "a1", "blank", "d", "1"), ("zz", "a1", "blank", None, "1")]
    df = spark.createDataFrame(rec, "id string, annotator string, condition string, suggested string, finished_at string").withColumn("final", F.lit("x"))
    got = sorted((r.id, r.annotator, r.finished_at, r.problem) for r in A.validate(df, a).collect())
    assert got == [("r30", "a1", "1", "unblinded"), ("r4", "a1", "1", "ok"), ("r4", "a1", "2", "duplicate"), ("r4", "a2", "1", "wrong_condition"), ("zz", "a1", "1", "unknown")]


def test_records(spark):
    cols = "id string, rank int, annotator string, condition string, suggested string, final string, flagged_words array<int>, ambiguous array<string>, status string, unusable_reason string, note string, started_at string, finished_at string, adjudicated string, tool_version string, protocol_version string"
    row = ("a", 1, "a1", "blank", "draft", "f", [3, 1, 3], None, "done", None, None, "2025-01-01T00:00:00", "2025-01-01T00:00:10", None, "1", "2")
    df = spark.createDataFrame([row], cols)
    r = A.build_records(df).first()
    assert r.suggested is None and r.flagged_words == [1, 3] and tuple(r.asDict()) == A.FIELDS
    with pytest.raises(Exception, match="needs a reason"):
        A.build_records(df.withColumn("status", F.lit("unusable"))).collect()
    assigned = spark.createDataFrame([("a", 1, "a1", "blank", True, "f")], "id string, rank int, annotator string, condition string, crossover boolean, sentence string")
    rep = A.file_report(A.checked_records(df, assigned)).first()
    assert (rep.rows, rep.done, rep.crossover_done, rep.breaches, rep.blocking, rep.flagged, rep.median_seconds, rep.extend) == (1, 1, 1, 1, 0, 3, 10.0, False)
    two = df.unionByName(df.withColumn("final", F.lit("g")))
    wanted = spark.createDataFrame([("a",), ("b",)], "id string")
    g = {x.id: x for x in A.gold_texts(two, wanted).collect()}
    assert g["a"].conflict and g["b"].missing
    assert not {x.id: x for x in A.gold_texts(two.withColumn("adjudicated", F.lit("h")), wanted).collect()}["a"].conflict


@pytest.mark.parametrize("cross_done,cross_bad,other_bad,want", [(44, 6, 0, True), (45, 5, 0, False), (44, 5, 40, False), (30, 0, 30, False), (0, 50, 0, True)])
def test_only_crossover_rows_count_for_the_extension(spark, cross_done, cross_bad, other_bad, want):
    rows = [("c", i, "done") for i in range(cross_done)] + [("c", 100 + i, "unusable") for i in range(cross_bad)] + [("o", 200 + i, "unusable") for i in range(other_bad)] + [("o", 300 + i, "done") for i in range(20)]
    block = spark.createDataFrame([(f"{k}{i}", "a1", "anchored", k == "c", "x") for k, i, _ in rows], "id string, annotator string, condition string, crossover boolean, sentence string")
    rec = spark.createDataFrame([(f"{k}{i}", "a1", "anchored", "x", "x", s, None, None, "2025-01-01T00:00:00", "2025-01-01T00:00:05") for k, i, s in rows], "id string, annotator string, condition string, suggested string, final string, status string, flagged_words array<int>, ambiguous array<string>, started_at string, finished_at string")
    r = A.file_report(A.checked_records(rec, block)).first()
    assert (r.crossover_done, r.crossover_unusable, r.extend) == (cross_done, cross_bad, want)


def test_ingest_checks(spark):
    block = spark.createDataFrame([("r1", "a1", "anchored", False, "مِنْ الْبَيْتِ"), ("r2", "a1", "blank", True, "كتب")], "id string, annotator string, condition string, crossover boolean, sentence string")
    rows = [("r1", "anchored", "مِنْ الْبَيْتِ", "مِنَ الْبَيْتِ", "done"), ("r1", "anchored", None, "من", "done"), ("r2", "blank", "x", "كَتَبَ", "done"), ("r2", "anchored", None, "q", "done"), ("zz", "blank", None, None, "done"), ("r2", "blank", None, None, "unusable")]
    rec = spark.createDataFrame([(i, "a1", c, s, f, st, [1, 2], None, "x", str(k)) for k, (i, c, s, f, st) in enumerate(rows)], "id string, annotator string, condition string, suggested string, final string, status string, flagged_words array<int>, ambiguous array<string>, started_at string, finished_at string")
    refs = spark.createDataFrame([("r2", "كتب")], "id string, reference string")
    x = A.checked_records(rec, block, refs)
    got = {int(r.finished_at): (r.duplicate, r.unknown, r.wrong_condition, r.breach, r.blocking, r.liaison) for r in x.collect()}
    assert got == {0: (False, False, False, False, False, 1), 1: (True, False, False, False, True, 0), 2: (False, False, False, True, False, 0), 3: (False, False, True, False, False, 0), 4: (False, True, False, False, False, 0), 5: (True, False, False, False, False, 0)}
    r = A.file_report(x).first()
    assert (r.rows, r.done, r.unusable, r.duplicates, r.unknown, r.wrong_condition, r.breaches, r.blocking, r.liaison_rows, r.liaison_breaks, r.flagged, r.ambiguous, r.median_seconds) == (6, 3, 1, 2, 1, 1, 1, 1, 1, 1, 6, 0, None)
    assert A.checked_records(rec.limit(0), block).count() == 0


def test_confusions_and_base_rates(spark):
    df = spark.createDataFrame([("كَتَبَ", "كِتَبَ")] * 3 + [("كَتَبَ", "كَتَب"), ("كَتَبَ", "كَتَبَ كَ"), (None, "x")], "g string, h string")
    got = [(r.gold, r.written, r.n, r.place) for r in A.mark_confusions(df, "g", "h").orderBy("place").collect()]
    assert got == [("\u064e", "\u0650", 3, 1), ("\u064e", "", 1, 2)]
    assert len(A.mark_confusions(df, "g", "h", 1).collect()) == 1
    rows = [("s", "error", [([0, 1], ["dialect"]), ([1, 2], [])], 5), ("s", "error", [([3], ["case"])], 5), ("s", "clean", None, 5), ("s", "unusable", [([1], [])], 5)]
    x = spark.createDataFrame(rows, "g string, verdict string, errors array<struct<words: array<int>, tags: array<string>>>, n_words int")
    r = A.base_rates(x, ["g"]).first()
    assert (r.utterances, r.strict_utterances, r.lenient_utterances, r.words, r.strict_words, r.lenient_words) == (3, 2, 1, 15, 4, 2) and r.low < 2 / 15 < r.high


def test_liaison(spark):
    df = spark.createDataFrame([("مِنْ الْبَيْتِ", "مِنَ الْبَيْتِ"), ("مِنْ بَيْتٍ", "مِنَ بَيْتٍ"), ("مِنْ الْبَيْتِ", "مِنَ")], "r string, f string")
    got = [(r.sites, r.breaks, r.blocking) for r in A.submission_checks(df, "r", "f", "r").collect()]
    assert got == [([0], [0], False), ([], [], False), ([0], [], True)]


def test_mark_errors(spark):
    df = spark.createDataFrame([("كَتَبَ رَجُلٌ", "كَتِبُ رَجُلٌ"), ("كَتَبَ رَجُلٌ", "كَتَبَ")], "g string, h string")
    got = {r.bucket: r for r in A.mark_errors(df, "g", "h").collect()}
    assert (got["A"].scored, got["A"].substitutions, got["A"].spurious) == (5, 1, 1)
    assert (got["B"].scored, got["B"].substitutions, got["B"].spurious) == (2, 1, 1) and got["free"].errors == 0


def test_punctuation_is_restored(spark):
    df = spark.createDataFrame([("كتب، رجُل.", "كَتَبَ رَجَل"), ("كتب،", "لا"), (None, "x")], "s string, d string")
    got = [r.o for r in A.with_punctuation(df, "s", "d", "o").collect()]
    assert got == ["كَتَبَ، رَجَل.", "لا", "x"]
    r = random.Random(3)
    for _ in range(15):  # a draft that adds marks and drops all else: nothing of the source is lost, and its marks are the draft's
        words = ["".join(r.choice("بتكلم") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 6))]
        marked = ["".join(c + r.choice(["", "َ", "ُّ"]) for c in w) for w in words]
        gaps = [r.choice([" ", "، ", "... ", " «"]) for _ in words]
        source, want = ("«" + "".join(w + g for w, g in zip(ws, gaps)) for ws in (words, marked))
        got = A.with_punctuation(spark.createDataFrame([(source, " ".join(marked))], "s string, d string"), "s", "d", "o").first().o
        assert got == want


def test_small_profiles(spark):
    df = spark.createDataFrame([("a ☺☺، 1", "x")], "t string, arm string")
    names = {r.ch: (r["class"], r.name) for r in H.character_audit(df, "t", names=True).collect()}
    assert names == {"a": ("latin", None), "☺": ("other", "WHITE SMILING FACE"), "،": ("punctuation", None), "1": ("digit", None)}
    arms = spark.createDataFrame([("a", "كَتَبَ", "k a t a b a"), ("b", "كَتَبَ", "k a t a b"), ("b", None, "k")], "arm string, t string, p string")
    assert sorted(tuple(r) for r in H.final_marks(arms, "t", "p", ["arm"]).collect()) == [("a", "fatha", "short", 1), ("b", "fatha", "consonant", 1)]
    m = spark.createDataFrame([("x", 5.42), ("y", 9.0), ("z", float("nan"))], "name string, value double")
    t = spark.createDataFrame([("x", 5.425, 0.5, True), ("y", 5.0, 0.5, False), ("z", 5.0, 0.5, False), ("w", 1.0, 0.5, True)], "name string, centre double, band double, decisive boolean")
    got = {r.name: (r.in_band, r.decisive) for r in H.target_verdicts(m, t).collect()}
    assert got == {"x": (True, True), "y": (False, False), "z": (False, False), "w": (False, True)}
    assert H.overall_verdict(H.target_verdicts(m, t)).first().passed is False
    assert H.overall_verdict(H.target_verdicts(m, t.where("name != 'w'"))).first().passed is True


def test_prompts_and_fairness(spark):
    clips = spark.createDataFrame([("s_12345[2]",), ("s_99999",), ("plain",)], "id string")
    canon = spark.createDataFrame([("12345", "a b")], "prompt string, canonical string")
    assert [(r.id, r.prompt, r.canonical) for r in C.join_on_prompt(clips, canon).collect()] == [("s_12345[2]", "12345", "a b")]
    rows = spark.createDataFrame([(1, "كتب"), (2, "كتب ok"), (3, "چ"), (4, None)], "id int, t string")
    assert sorted(r.id for r in C.fair_rows(rows, "t").collect()) == [1]


def test_pilot_groups(spark):
    schema = "id string, errors array<struct<words: array<int>, tags: array<string>>>"
    df = spark.createDataFrame([("a", [([1, 2], ["case"]), ([2, 3], ["case", "vowel"]), ([5], [])]), ("b", [])], schema)
    assert [r[0] for r in df.select(A.lenient_error_words(F.col("errors"))).collect()] == [[2, 3, 5], []]
    m = spark.createDataFrame([("a", {1: ["x", "y"], 2: ["y", "x"], 3: []})], "id string, tags map<int, array<string>>")
    assert {(tuple(r.t), tuple(r.words)) for r in A.group_by_tags(m, "id", "tags").collect()} == {(("x", "y"), (1, 2)), ((), (3,))}


def test_log_keeps_history(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, at int")
    assert {(r.k, r.at): r.superseded for r in A.latest_decisions(df, "k", "at").collect()} == {("a", 1): True, ("a", 2): False, ("b", 1): False}


def test_monotone(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.2)], "o int, v double")
    assert not H.monotone(df, "o", "v").first()[0] and H.monotone(df.where("o < 3"), "o", "v").first()[0]


def test_span_counts_are_the_places_of_each_query(spark):
    """the places are counted by phrase; a query and a place never make a row, and nothing is broadcast."""
    words = ["من", "بيت", "دار", "قلم"]
    corpus = spark.createDataFrame([(e, n, " ".join(words[(n * k + e) % 4] for k in range(n % 7 + 3))) for e in (1, 2) for n in range(40)] + [(None, 1, "من بيت"), (1, 99, None)], "ed int, n int, t string")
    long = " ".join(r.t for r in corpus.where("ed = 1").orderBy("n").collect() if r.t).split(" ")
    texts = ["من", "من بيت", " ".join(long[5:13]), " ".join(long[5:14]), " ".join(long[20:61]), "غريب", " ", None]
    q = spark.createDataFrame([(f"{i}-{c}", x) for i, x in enumerate(texts) for c in range(3)] + [("0-0", "بيت"), ("0-0", "من")], "q string, t string")
    args = (corpus, q, ["ed"], ["n"], "t", "q", "t")
    found = C.span_counts(*args)
    want = {r.q: r["count"] for r in C.span_matches(*args).groupBy("q").count().collect()}
    assert {r.q: r.candidates for r in found.collect()} == want
    assert len(want) == 15 and max(want.values()) > 50
    assert C.span_counts(corpus.limit(0), *args[1:]).count() == C.span_counts(corpus, q.limit(0), *args[2:]).count() == 0
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_span_recovery_sends_no_table_to_the_driver(spark, sf):
    from warraq.plans import queries as Q

    x = Q.span_recovery(spark, sf)
    x.collect()
    assert "BroadcastExchange" not in x._jdf.queryExecution().executedPlan().toString()
