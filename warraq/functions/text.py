"""Text functions: Column -> Column, built-in expressions wherever Spark has them.

Only character names need an Arrow UDF; everything else stays in the JVM. Null in,
null out, unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: the character classes of the writing system -------------
MARKS = r"\x{064B}-\x{0655}\x{0670}\x{06D6}-\x{06ED}"  # vowel and recitation marks
SCORED = r"\x{064B}-\x{0652}\x{0670}"  # marks that a diacritizer answers for
LETTER = r"\x{0621}-\x{063A}\x{0641}-\x{064A}\x{0671}\x{0675}"
WIDE_LETTER = r"\x{0621}-\x{064A}"  # the looser test, stretching included
TATWEEL, DAGGER_ALEF, SHADDA, SUKUN = "ـ", "ٰ", "ّ", "ْ"
TANWIN = "ًٌٍ"
SHORT_VOWELS = "َُِ"
SUPPORTED_LETTERS = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي"
SUPPORTED_MARKS = "ًٌٍَُِّْ"
SCRIPT_VARIANTS = {"ی": "ي", "ک": "ك", "ھ": "ه"}
FOREIGN_LETTERS = "چڨ"
LATIN = r"[A-Za-z\x{00C0}-\x{024F}]"
PRESENTATION = r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
# The separators of a wide whitespace split.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest(c: str | Column, name: str) -> list[Column]:
    """128 bits of a text as two numbers, for joins that need not carry the text."""
    return [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit(7), c).alias(f"{name}2")]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- Unicode normalization ---------------------------------------------------
# Spark ships ICU for its collations; its compose function is called in the JVM.
# Such a call counts as non-deterministic for the optimizer, so it is computed
# once, in a projection, and has to be projected before an aggregate uses it.
def _composed(x: str | Column, compatibility: bool) -> Column:
    c = _c(x)
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(compatibility)))


def nfc(x: str | Column) -> Column:
    return _composed(x, False)


def nfkc(x: str | Column) -> Column:
    return _composed(x, True)


@F.pandas_udf(T.StringType())
def first_character_name(s: pd.Series) -> pd.Series:
    """Unicode name of the first character; empty where it has none."""
    return s.map(lambda x: unicodedata.name(x[0], "") if x else "", na_action="ignore").astype(object)


# ---- White space, words, keys ----------------------------------------------
def squeeze(x: str | Column) -> Column:
    """One blank between words, none at the ends; marks are kept."""
    return F.trim(F.regexp_replace(_c(x), SPACE + "+", " "))


def words(x: str | Column) -> Column:
    """Blank-separated tokens; an empty text has none."""
    return F.filter(F.split(squeeze(x), " "), lambda w: w != "")


def strip_marks(x: str | Column) -> Column:
    """Without marks and stretching."""
    return F.regexp_replace(_c(x), f"[{MARKS}{TATWEEL}]", "")


def skeleton(x: str | Column, normalized: bool = False) -> Column:
    """The key for duplicates and matches: composed, without marks and punctuation, blanks squeezed.

    Punctuation is deleted here, so words that only it divides are merged.
    """
    base = _c(x) if normalized else nfc(_c(x))
    return squeeze(F.regexp_replace(strip_marks(base), r"\p{P}", ""))


def depunctuated(x: str | Column) -> Column:
    """Without punctuation, blanks squeezed; marks are kept."""
    return squeeze(F.regexp_replace(_c(x), r"\p{P}", ""))


def has_letter(x: str | Column) -> Column:
    return F.rlike(_c(x), F.lit(f"[{LETTER}]"))


def arabic_tokens(x: str | Column) -> Column:
    """Blank-separated tokens with a letter; punctuation does not divide."""
    return F.filter(words(x), lambda w: F.rlike(w, F.lit(f"[{LETTER}]")))


def arabic_words(x: str | Column, normalized: bool = False) -> Column:
    """Words with a letter, marks kept; here punctuation divides words."""
    base = _c(x) if normalized else nfc(_c(x))
    return F.filter(words(F.regexp_replace(base, r"\p{P}", " ")), lambda w: F.rlike(w, F.lit(f"[{LETTER}]")))


def marked_words(x: str | Column) -> Column:
    """Words that hold a mark or any letter, punctuation divides."""
    return F.filter(words(F.regexp_replace(_c(x), r"\p{P}", " ")), lambda w: F.rlike(w, F.lit(f"[{MARKS}\\p{{L}}]")))


def marked_letters(word: str | Column) -> Column:
    """array<struct<letter, marks>>: each letter with the sorted set of its scored marks.

    Marks before the first letter are dropped; unscored marks and stretching are ignored.
    """
    clean = F.regexp_replace(F.regexp_replace(_c(word), f"[\\x{{0653}}-\\x{{0655}}\\x{{06D6}}-\\x{{06ED}}{TATWEEL}]", ""), f"^[{SCORED}]+", "")
    groups = F.regexp_extract_all(clean, F.lit(f"([^{SCORED}][{SCORED}]*)"), 1)
    return F.transform(groups, lambda g: F.struct(F.substring(g, 1, 1).alias("letter"), F.sort_array(F.array_distinct(F.filter(F.split(F.substring(g, 2, 2**30), ""), lambda m: m != ""))).alias("marks")))


# ---- Rates, flags, histograms ----------------------------------------------
def diacritization_rate(x: str | Column) -> Column:
    """Letters directly followed by a mark over letters; null without letters."""
    c = _c(x)
    n = F.regexp_count(c, F.lit(f"[{LETTER}]"))
    return F.when(n > 0, F.regexp_count(c, F.lit(f"[{LETTER}][{MARKS}]")) / n)


def has_latin(x: str | Column) -> Column:
    return F.rlike(_c(x), F.lit(r"\p{IsLatin}"))


def has_digits(x: str | Column) -> Column:
    """Decimal digits and superscripts of any script."""
    return F.rlike(_c(x), F.lit(r"[\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"))


def flag_set(*pairs: tuple[str, Column]) -> Column:
    """Sorted array of the names whose condition holds; a null condition doesn't hold."""
    return F.sort_array(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs))))


def unsupported(x: str | Column) -> Column:
    """Characters that later steps would drop, in order."""
    keep = f"[{SUPPORTED_LETTERS}{SUPPORTED_MARKS}{DAGGER_ALEF}]|{SPACE}"
    return F.filter(F.split(F.regexp_replace(_c(x), keep, ""), ""), lambda c: c != "")


def character_class(ch: str | Column) -> Column:
    c = _c(ch)
    return F.when(F.rlike(c, F.lit(r"^\p{P}")), "punctuation").when(F.rlike(c, F.lit(r"^\p{Nd}")), "digit").when(F.rlike(c, F.lit("^[A-Za-z]")), "latin").otherwise("other")


def stacked_marks(x: str | Column, exclusive: str = SHORT_VOWELS + TANWIN + SUKUN) -> Column:
    """Adjacent pairs of marks that exclude one another (overlapping pairs count)."""
    return F.regexp_count(_c(x), F.lit(f"[{exclusive}](?=[{exclusive}])"))


def punctuation_of(x: str | Column) -> Column:
    """Characters that are neither letter, number, blank nor mark, in order."""
    return F.filter(F.split(F.regexp_replace(_c(x), f"[\\p{{L}}\\p{{N}}{MARKS}]|{SPACE}", ""), ""), lambda c: c != "")


def numbered(ws: str | Column) -> Column:
    """Words with their 0-based numbers."""
    return F.transform(_c(ws), lambda w, i: F.struct(i.alias("i"), w.alias("word")))


def kept_share(source: str | Column, output: str | Column) -> Column:
    """Words of the output over words of the source; null if the source has none."""
    n = F.size(arabic_tokens(source))
    return F.when(n > 0, F.size(arabic_tokens(output)) / n)


# ---- The cleaning contract --------------------------------------------------
UNFAIR = ("latin", "digits", "no_msa_equivalent")
_KEPT = f"{SUPPORTED_LETTERS}{SUPPORTED_MARKS}{DAGGER_ALEF}{SPACE[1:-1]}"
_OTHER_MARK = f"[{TATWEEL}[\\p{{Mn}}&&[^{_KEPT}]]]"
#: flag -> the characters that raise it, of the text as given and of its composed compatibility form.
RAW_FLAGS = {"latin": LATIN, "presentation_form": PRESENTATION}
FORM_FLAGS = {
    "script_variant": f"[{''.join(SCRIPT_VARIANTS)}]",
    "non_phonemic_mark": _OTHER_MARK,
    "no_msa_equivalent": f"[{FOREIGN_LETTERS}]",
    "punctuation": r"\p{P}",
    "unsupported_character": f"[^{_KEPT}{''.join(SCRIPT_VARIANTS)}{FOREIGN_LETTERS}{TATWEEL}\\p{{Mn}}\\p{{P}}]",
}
_DROPPED = f"[^{_KEPT}{''.join(SCRIPT_VARIANTS)}\\p{{P}}]"


def clean(x: str | Column) -> Column:
    """struct(text, flags, dropped): folded text, what had to be done, and the characters that went, in order.

    Punctuation becomes a blank, variants of letters the usual letter; all other
    characters that are not supported go.
    """
    raw = _c(x)

    def of(form: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(form, _DROPPED, ""), r"\p{P}", " ")
        flags = flag_set(*((n, F.rlike(raw, F.lit(p))) for n, p in RAW_FLAGS.items()), ("digits", has_digits(raw)), *((n, F.rlike(form, F.lit(p))) for n, p in FORM_FLAGS.items()))
        return F.struct(squeeze(F.translate(text, "".join(SCRIPT_VARIANTS), "".join(SCRIPT_VARIANTS.values()))).alias("text"), flags.alias("flags"), F.regexp_extract_all(form, F.lit(f"({_DROPPED})"), 1).alias("dropped"))

    return F.when(raw.isNotNull(), let(nfkc(raw), of))


def fair(flags: str | Column) -> Column:
    """False where the speech holds what the reference has no phonemes for."""
    return ~F.arrays_overlap(_c(flags), F.array(*map(F.lit, UNFAIR)))


# ---- Ids and paths -----------------------------------------------------------
def utterance_id(path: str | Column) -> Column:
    """The id in a clip's file name; null where there is none."""
    m = F.regexp_extract(_c(path), r"audio_(.+)\.wav$", 1)
    return F.when(m != "", m)


def is_numeric_id(path: str | Column) -> Column:
    return F.coalesce(F.rlike(utterance_id(path), F.lit(r"^\p{Nd}+$")), F.lit(False))


def canonical_path(path: str | Column) -> Column:
    """Where a clip's canonical text lies: wav/audio_X.wav -> canonicals/canonical_X.txt; an error without an id."""
    c = _c(path)
    moved = F.regexp_replace(F.regexp_replace(c, r"(^|/)wav/(?=audio_[^/]*$)", "$1canonicals/"), r"audio_([^/]+)\.wav$", "canonical_$1.txt")
    return F.when(utterance_id(c).isNotNull(), moved).otherwise(F.raise_error(F.concat(F.lit("no utterance id in path "), c)))


def prompt_index(id_: str | Column) -> Column:
    """Second part of the id, first five characters; null if there is no second part."""
    p = F.split_part(_c(id_), F.lit("_"), F.lit(2))
    return F.when(p != "", F.substring(p, 1, 5))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Seconds between two ISO timestamps in text; null where unreadable or negative."""
    d = (F.unix_micros(F.try_to_timestamp(_c(end))) - F.unix_micros(F.try_to_timestamp(_c(start)))) / 1_000_000
    return F.when(d >= 0, d)
