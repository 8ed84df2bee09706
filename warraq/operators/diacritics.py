"""Diacritization error: own and published convention, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonemes as P
from ..functions import rates as R
from ..functions import text as X

#: name -> (case endings scored, only positions that the reference marks)
VARIANTS = {"ce_all": (True, False), "noce_all": (False, False), "ce_markedonly": (True, True), "noce_markedonly": (False, True)}
SCORE = ("positions", "errors", "words", "word_errors", "skeleton_mismatch")


#: Codes of a scored letter, by whether the reference marks it and whether the marks differ.
BARE, MARKED, BARE_WRONG, MARKED_WRONG = "0123"


def _units(words: Column) -> Column:
    """Letters with their scored marks, and the blanks between words, of all words as one list."""
    text = F.regexp_replace(F.array_join(words, " "), f"[\\x{{0653}}-\\x{{0655}}\\x{{06D6}}-\\x{{06ED}}{X.TATWEEL}]", "")
    return F.regexp_extract_all(F.regexp_replace(text, f"(^| )[{X.SCORED}]+", "$1"), F.lit(f"([^{X.SCORED}][{X.SCORED}]*)"), 1)


def letter_codes(reference: Column, hypothesis: Column) -> Column:
    """A character for each letter of the reference, words divided by blanks; null where the two differ in letters.

    reference, hypothesis: lists of words. Marks are compared as sets, which only
    letters with different strings need.
    """
    marks = lambda u: F.sort_array(F.array_distinct(F.split(F.substring(u, 2, 2**30), "")))

    def code(r: Column, h: Column) -> Column:
        marked, wrong = F.length(r) > 1, (r != h) & (marks(r) != marks(h))
        return F.when(r == " ", " ").when(r == h, F.when(marked, MARKED).otherwise(BARE)).when(wrong, F.when(marked, MARKED_WRONG).otherwise(BARE_WRONG)).otherwise(F.when(marked, MARKED).otherwise(BARE))

    same = F.transform(reference, X.strip_marks) == F.transform(hypothesis, X.strip_marks)
    return F.when(same, F.array_join(F.zip_with(_units(reference), _units(hypothesis), code), ""))


def variant_score(codes: Column, case_endings: bool, marked_only: bool) -> Column:
    """struct of counts for one variant, from letter_codes; a mismatch scores no position."""
    c = codes if case_endings else F.regexp_replace(codes, "[^ ](?= |$)", "")
    if marked_only:
        c = F.translate(c, BARE + BARE_WRONG, "")
    n = lambda pattern: F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("long")
    bad = BARE_WRONG + MARKED_WRONG
    return F.struct(n("[^ ]").alias("positions"), n(f"[{bad}]").alias("errors"), n("[^ ]+").alias("words"), n(f"[^ ]*[{bad}][^ ]*").alias("word_errors"), codes.isNull().cast("long").alias("skeleton_mismatch"))


def scores(rows: DataFrame, reference: str, hypothesis: str, by: list[str], variants: dict[str, tuple[bool, bool]] = VARIANTS) -> DataFrame:
    """by..., variant, pooled counts and rates. Variants are rows, so pooling never mixes them. Null texts count as empty."""
    words = lambda c: X.arabic_words(F.coalesce(F.col(c), F.lit("")))
    x = rows.select(*by, words(reference).alias("_r"), words(hypothesis).alias("_h")).select(*by, letter_codes(F.col("_r"), F.col("_h")).alias("_codes"))
    sums = [F.sum(v[c]).alias(f"{n}_{c}") for n, spec in variants.items() for v in [variant_score(F.col("_codes"), *spec)] for c in SCORE]
    g = x.groupBy(*by).agg(F.count("*").alias("rows"), *sums)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), *(F.col(f"{n}_{c}").alias(c) for c in SCORE)) for n in variants))).alias("v")
    out = g.select(*by, "rows", each).select(*by, "v.variant", "rows", *(f"v.{c}" for c in SCORE))
    return out.select("*", R.ratio("errors", "positions", "zero").alias("der"), R.ratio("word_errors", "words", "zero").alias("wer"))


def _published_units(x: str | Column) -> Column:
    """array<struct<letter, label>>: each letter and each blank between words with its sorted marks.

    The dagger alef is deleted; what is neither letter nor mark divides words.
    """
    clean = X.squeeze(F.regexp_replace(F.regexp_replace(X._c(x), f"[{X.DAGGER_ALEF}{X.TATWEEL}]", ""), f"[^{X.LETTER}{X.MARKS}]", " "))
    units = F.regexp_extract_all(clean, F.lit(f"([^{X.MARKS}][{X.MARKS}]*)"), 1)
    marks = lambda u: F.array_join(F.sort_array(F.filter(F.split(F.substring(u, 2, 2**30), ""), lambda m: m != "")), "")
    return F.transform(units, lambda u: F.struct(F.substring(u, 1, 1).alias("letter"), marks(u).alias("label")))


def _without_endings(units: Column) -> Column:
    """The label of a letter before a blank is emptied; the length stays."""
    masked = lambda us: F.transform(us, lambda u, i: F.struct(u["letter"].alias("letter"), F.when(F.coalesce(F.get(us, i + 1)["letter"], F.lit("")) == " ", "").otherwise(u["label"]).alias("label")))
    return X.let(units, masked)


def _labels_of(units: Column) -> Column:
    return F.concat(F.array(F.lit("<BOS>")), F.transform(units, lambda u: u["label"]), F.array(F.lit("<EOS>")))


def _words_of(units: Column) -> Column:
    return F.split(F.array_join(F.transform(units, lambda u: F.concat(u["letter"], u["label"])), ""), " ")


def published_labels(x: str | Column, case_endings: bool = True) -> Column:
    """<BOS>, a label for each letter and each blank, <EOS>; without case endings the letter before a blank has an empty one."""
    units = _published_units(x)
    return _labels_of(units if case_endings else _without_endings(units))


def published_words(x: str | Column, case_endings: bool = True) -> Column:
    """Words as units of the word error rate: their letters with the labels that count; a text without letters is one empty word."""
    units = _published_units(x)
    return _words_of(units if case_endings else _without_endings(units))


def published_scores(rows: DataFrame, reference: str, hypothesis: str, by: list[str]) -> DataFrame:
    """by..., case_endings, edit distances over labels and words with their rates.

    Each different pair of texts is read and scored once, under both conventions.
    """
    x = rows.where(F.col(reference).isNotNull() & F.col(hypothesis).isNotNull()).groupBy(*by, F.col(reference).alias("_r"), F.col(hypothesis).alias("_h")).agg(F.count("*").alias("_n"))
    x = x.select(*by, "_n", _published_units("_r").alias("_r"), _published_units("_h").alias("_h"))
    arms = F.array(F.struct(F.lit(True).alias("case_endings"), F.col("_r").alias("r"), F.col("_h").alias("h")), F.struct(F.lit(False).alias("case_endings"), _without_endings(F.col("_r")).alias("r"), _without_endings(F.col("_h")).alias("h")))
    x = x.select(*by, "_n", F.explode(arms).alias("a")).select(*by, "_n", "a.case_endings", _labels_of(F.col("a.r")).alias("r"), _labels_of(F.col("a.h")).alias("h"), _words_of(F.col("a.r")).alias("rw"), _words_of(F.col("a.h")).alias("hw"))
    total = lambda c: F.sum(c.cast("long") * F.col("_n"))
    g = x.groupBy(*by, "case_endings").agg(total(P.token_distance("r", "h")).alias("label_distance"), total(F.size("r")).alias("labels"), total(P.token_distance("rw", "hw")).alias("word_distance"), total(F.size("rw")).alias("words"))
    return g.select("*", R.ratio("label_distance", "labels", "zero").alias("der"), R.ratio("word_distance", "words", "zero").alias("wer"))


def dagger_survival(rows: DataFrame, source: str, output: str) -> DataFrame:
    """2 x 2 counts of the dagger alef's presence in source and output."""
    return rows.groupBy(F.contains(source, F.lit(X.DAGGER_ALEF)).alias("in_source"), F.contains(output, F.lit(X.DAGGER_ALEF)).alias("in_output")).agg(F.count("*").alias("rows"))


def reference_variants(rows: DataFrame, reference: str, tag: str = "variant") -> DataFrame:
    """Each row twice: with its reference as it is, and without the dagger alef."""
    plain = rows.withColumn(reference, F.replace(reference, F.lit(X.DAGGER_ALEF), F.lit("")))
    return rows.withColumn(tag, F.lit("as_written")).unionByName(plain.withColumn(tag, F.lit("no_dagger_alef")))
