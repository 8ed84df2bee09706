import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from warraq.functions import g2p
from warraq.functions import phonemes as P
from warraq.functions import rates as R
from warraq.functions import text as X
from warraq.operators import diacritics as M
from warraq.operators import profile as H


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize(
    "text,want,flags",
    [
        ("فِي—الشَّمْسِ", "فِي الشَّمْسِ", ["punctuation"]),
        ("ی ک ھ", "ي ك ه", ["script_variant"]),
        ("چ", "", ["no_msa_equivalent"]),
        ("ﻻ", "لا", ["presentation_form"]),
        ("نعم ok", "نعم", ["latin", "unsupported_character"]),
        ("نعم 3", "نعم", ["digits", "unsupported_character"]),
        ("نـعم", "نعم", ["non_phonemic_mark"]),
        ("أۖبٰ  چ؟", "أبٰ", ["no_msa_equivalent", "non_phonemic_mark", "punctuation"]),
        ("۱² ☺", "", ["digits", "unsupported_character"]),
        ("", "", []),
    ],
)
def test_cleaning(spark, text, want, flags):
    got = one(spark, text, X.clean("x"))
    assert (got.text, got.flags) == (want, flags)
    again = one(spark, got.text, X.clean("x"))
    assert again.text == got.text and not again.dropped


def test_fair(spark):
    df = spark.createDataFrame([(["latin"],), (["punctuation"],), ([],)], "f array<string>")
    assert [r[0] for r in df.select(X.fair("f")).collect()] == [False, True, True]


@pytest.mark.parametrize("path,want", [("train/wav/audio_12345.wav", "12345"), ("x/audio_Amer_17.wav", "Amer_17"), ("train/wav/00123.flac", None)])
def test_ids(spark, path, want):
    assert one(spark, path, X.utterance_id("x")) == want


def test_paths_and_prompts(spark):
    assert one(spark, "train/wav/audio_A_1.wav", X.canonical_path("x")) == "train/canonicals/canonical_A_1.txt"
    assert one(spark, "s_12345[2]", X.prompt_index("x")) == "12345" and one(spark, "plain", X.prompt_index("x")) is None
    with pytest.raises(Exception, match="no utterance id"):
        one(spark, "x.flac", X.canonical_path("x"))


def test_white_space(spark):
    assert one(spark, "  w a   l aa\t", X.squeeze("x")) == "w a l aa"
    assert one(spark, " a b　c\x1cd ", P.tokens("x")) == ["a", "b", "c", "d"]
    assert one(spark, "", P.tokens("x")) == [] and one(spark, None, P.tokens("x")) is None


def test_skeleton_merges_across_punctuation(spark):
    assert one(spark, "نَعَم—لَا، لا", X.skeleton("x")) == "نعملا لا"
    assert one(spark, "نَعَم—لَا", X.arabic_words("x")) == ["نَعَم", "لَا"]


def test_marked_letters_keep_every_letter(spark):
    r = random.Random(1)
    for _ in range(20):
        w = "".join(r.choice("بتكلم") + "".join(r.sample("َُّْ", r.randrange(3))) for _ in range(r.randrange(1, 6)))
        got = one(spark, w, X.marked_letters("x"))
        assert "".join(p.letter for p in got) == one(spark, w, X.strip_marks("x"))
    assert [tuple(p.marks) for p in one(spark, "َبَّ", X.marked_letters("x"))] == [("َ", "ّ")]


def test_rate_and_counts(spark):
    assert one(spark, "كَتب", X.diacritization_rate("x")) == pytest.approx(1 / 3)
    assert one(spark, "abc", X.diacritization_rate("x")) is None
    assert one(spark, "بَُِ", X.stacked_marks("x")) == 2
    assert one(spark, "a، b! 3", X.punctuation_of("x")) == ["،", "!"]
    df = spark.createDataFrame([("ab ث",), (None,)], "t string")
    assert {(r.ch, r["class"], r.n) for r in H.character_audit(df, "t").collect()} == {("a", "latin", 1), ("b", "latin", 1)}


def test_seconds(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00", "2025-01-01T00:01:30"), ("2025-01-02T00:00:00", "2025-01-01T00:00:00"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(X.seconds_between("a", "b")).collect()] == [90.0, None, None]


def test_codec(spark):
    v = ["p", "q"]
    assert one(spark, ["p", "z"], P.encode("x", v), "array<string>") == [3, 2, 1]
    assert one(spark, [3, 0, 3, 3, 1, 4], P.decode("x", v, True), "array<int>") == ["p", "p"]
    assert one(spark, [3, 0, 3, 3, 1, 4], P.decode("x", v), "array<int>") == ["p", "p", "p"]
    assert one(spark, [], P.decode("x", v), "array<int>") == []
    with pytest.raises(ValueError):
        P.encode("x", ["p", "p"])


def test_token_distance(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    r = random.Random(2)
    rows = [([r.choice(["a", "aa", "<", "zz", "é"]) for _ in range(r.randrange(8))], [r.choice(["a", "aa", "<", "zz", "é"]) for _ in range(r.randrange(8))]) for _ in range(100)]
    got = [x[0] for x in spark.createDataFrame(rows, "a array<string>, b array<string>").select(P.token_distance("a", "b")).collect()]
    assert got == [plain(*x) for x in rows]


def test_first_difference(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"]), (["a"], ["a"]), (["a"], ["a", "b"])], "p array<string>, r array<string>")
    got = [r[0] for r in df.select(P.first_difference("p", "r")).collect()]
    assert got[0].at == 1 and got[1] is None and got[2].at == 1


def test_silence_and_stress(spark):
    assert one(spark, ["a", "<sil>", "a", "sil"], P.without_silence("x"), "array<string>") == ["a", "a"]
    assert one(spark, ["i0", "sil", "b"], P.collapse_stress("x"), "array<string>") == ["i", "b"]


def _der(spark, ref, hyp, variant):
    df = spark.createDataFrame([(ref, hyp)], "r string, h string").withColumn("g", F.lit(1))
    return next(r for r in M.scores(df, "r", "h", ["g"]).collect() if r.variant == variant)


F_, D_, S_ = "َ", "ُ", "ّ"


@pytest.mark.parametrize(
    "ref,hyp,variant,positions,errors",
    [
        (f"كت{F_}ب{F_}", f"كت{F_}ب{F_}", "ce_all", 3, 0),
        (f"ك{F_}ت{F_}ب", f"ك{F_}ت{F_}ب", "ce_markedonly", 2, 0),
        (f"ك{F_}تب", f"ك{F_}ت{D_}ب", "ce_markedonly", 1, 0),
        (f"ك{F_}تب", f"ك{F_}ت{D_}ب", "ce_all", 3, 1),
        (f"ك{F_}ت{F_}ب{F_}", f"ك{F_}ت{F_}ب{D_}", "ce_all", 3, 1),
        (f"ك{F_}ت{F_}ب{F_}", f"ك{F_}ت{F_}ب{D_}", "noce_all", 2, 0),
        (f"ك{S_}{F_}", f"ك{F_}{S_}", "ce_all", 1, 0),
        ("هٰذا", "هذا", "ce_all", 3, 1),
        ("كۖ", "ك", "ce_all", 1, 0),
    ],
)
def test_der(spark, ref, hyp, variant, positions, errors):
    r = _der(spark, ref, hyp, variant)
    assert (r.positions, r.errors, r.skeleton_mismatch) == (positions, errors, 0)


def test_der_mismatch_and_empty(spark):
    r = _der(spark, "كتب كتب", "كتب", "ce_all")
    assert (r.positions, r.skeleton_mismatch, r.der) == (0, 1, 0.0)
    r = _der(spark, None, "", "ce_all")
    assert (r.positions, r.der) == (0, 0.0)


def test_published_labels(spark):
    a = one(spark, "كَتَبَ", M.published_labels("x"))
    assert a == ["<BOS>", "َ", "َ", "َ", "<EOS>"]
    assert len(one(spark, "كَتَبَ كَتَبَ", M.published_labels("x"))) == len(a) + 1 + 3
    no = one(spark, "كَتَبَ كَتَبَ", M.published_labels("x", False))
    assert len(no) == 9 and no[3] == "" and no[7] == "َ"
    assert one(spark, "كَتَبَ،", M.published_labels("x")) == a


def test_g2p(spark):
    assert one(spark, "فِي الشَّمْسِ", g2p.phonemes("x")) == "f ii $$ a m s i".split()
    assert one(spark, "مُقَبِّلًا", g2p.phonemes("x")) == "m u q A bb i l a n".split()
    assert one(spark, "كِتَابٌ", g2p.phonemes("x", "pausal")) == "k i t aa b".split()
    assert one(spark, "لَكِنْ", g2p.phonemes("x")) == "l aa k i n".split()
    assert one(spark, "", g2p.phonemes("x")) == [] and one(spark, None, g2p.phonemes("x")) is None
    df = spark.createDataFrame([("كِتَابٌ",), ("كِتَابٌ",), (None,)], "t string")
    assert [r.phonemes for r in g2p.phonetize_distinct(df, "t").collect()].count(None) == 1


def test_nfc_is_composed(spark):
    s = "أ"
    assert one(spark, s, X.nfc("x")) == unicodedata.normalize("NFC", s)


@pytest.mark.parametrize(
    "word,want",
    [("كِتَابًا", "tanwin fath"), ("كَتَبَ", "fatha"), ("مِنْ", "sukun"), ("كتب", "(bare)"), ("رَبِّ", "kasra"), ("رَبّ", "fatha"), ("عَلَى", "fatha"), ("هٰذا", "superscript alef"), ("بَيْتٌ", "tanwin damm"), ("", "(bare)"), (None, None)],
)
def test_final_mark_is_the_last_one_in_the_word(spark, word, want):
    assert one(spark, word, P.final_mark("x")) == want


def test_published_word_rate_follows_the_convention(spark):
    rows = [("كَتَبَ الْوَلَدُ أَمْسِ", "كَتَبُ الْوَلَدُ أَمْسِ"), ("كَتَبَ", "كَتَبُ"), ("كَتَبَ الْوَلَدُ", "كَتَبَ"), ("الرَّحْمَٰنِ", "الرَّحْمَنِ"), ("كَتَبَ (Reuters)", "كَتَبَ")]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)] * 2, "g string, r string, h string")
    got = {(x.g, x.case_endings): (x.label_distance // 2, x.labels // 2, x.word_distance // 2, x.words // 2) for x in M.published_scores(df, "r", "h", ["g"]).collect()}
    assert got["0", True] == (1, 15, 1, 3) and got["0", False] == (0, 15, 0, 3)  # a case ending before a blank is free
    assert got["1", True][0] == got["1", False][0] == 1 and got["1", False][2] == 1  # the last word keeps its ending
    assert got["2", True] == (6, 11, 1, 2) and got["3", True][0] == 0 and got["4", True] == (0, 5, 0, 1)
    assert one(spark, "كَتَبَ الْوَلَدُ", M.published_words("x", False))[0] == "كَتَب"


def test_conversion_conventions(spark):
    say = lambda t, c="prescriptive": one(spark, t, g2p.phonemes("x", c))
    full = say("ذَهَبَ الْوَلَدُ")
    assert full[-1] == "u" and say("ذَهَبَ الْوَلَدُ", "pausal") == full[:-1]
    assert "n" in say("بَيْتٌ كَبِيرٌ") and "n" not in say("بَيْتٌ كَبِيرٌ", "pausal")
    assert "aa" in say("شُكْرًا", "pausal") and say("شُكْرًا", "pausal") == "$ u k r aa".split() and say("شُكْرًا")[-2:] == ["a", "n"] == say("شُكْراً")[-2:]
    city = say("فِي الْمَدِينَةِ")
    assert city[-2:] == ["t", "i"] and say("فِي الْمَدِينَةِ", "pausal") == city[:-2]
    assert "yy" in say("أَيَّ") and say("الرَّحْمَٰنِ") == say("الرَّحْمَنِ") and "aa" not in say("الرَّحْمَٰنِ")
    shadda_first, vowel_first = "\u0625\u0650\u0646\u0651\u064e", "\u0625\u0650\u0646\u064e\u0651"
    assert say(shadda_first, "pausal") == say(vowel_first, "pausal") and "nn" in say(vowel_first, "pausal")
    assert say("بَيْتٌ\nبَيْتٌ") == say("بَيْتٌ بَيْتٌ") and say("   \n  ") == [] and "rr" in say("الرَّحِيمِ")
    for t in ("إِلاَّ", "عَلَىٍّ", "دُجَىٌّ"):
        assert set(say(t, "pausal")) <= set(P.INVENTORY)
    assert say("كَتَبُوا") == "k a t a b uu".split()


def test_power_and_recommendation(spark):
    row = spark.range(1).select(R.did_error(F.lit(2.0), F.lit(1.0), F.lit(0.5)).alias("se"), R.recommendation(F.lit(0.0907), F.lit(0.1635)).alias("a"), R.recommendation(F.lit(0.2), F.lit(0.1635)).alias("b"), R.recommendation(F.lit(float("nan")), F.lit(1.0)).alias("c")).first()
    assert row.se == pytest.approx(2.0) and row.a.decision == "keep" and row.a.margin == pytest.approx(0.1635 / 0.0907) and row.b.decision == row.c.decision == "cut"


def test_intervals(spark):
    df = spark.createDataFrame([(16, 1363), (42, 293), (0, 0), (0, 10), (10, 10)], "k long, n long")
    lo, hi = R.wilson("k", "n")
    got = [(round(r[0], 2), round(r[1], 2)) for r in df.select(lo, hi).collect()]
    assert got[:3] == [(0.72, 1.90), (10.78, 18.81), (0.0, 0.0)]
    cp = [r[0] for r in df.select(R.clopper_pearson("k", "n")).collect()]
    assert (cp[2].low, cp[2].high) == (0, 1) and cp[3].low == 0 and cp[4].high == 1 and cp[3].high == pytest.approx(1 - 0.025 ** (1 / 10))


def test_detectable(spark):
    assert spark.range(1).select(R.detectable(F.lit(1.0), F.lit(2.0), F.lit(0.0))).first()[0] == pytest.approx(2.8015852 * 3**0.5)
