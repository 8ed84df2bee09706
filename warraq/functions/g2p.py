"""Letters to phonemes of fully marked Arabic, by a small set of phonological rules.

A rule-based converter written from general descriptions of Arabic phonology:
each letter is a consonant, a lengthening of the vowel before it, or silent;
emphatic consonants back the vowel after them; a doubled consonant is written
twice. It works on distinct texts, so a repeated text is converted once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

# The consonants' symbols.
CONSONANTS = dict(zip("بتثجحخدذرزسشصضطظعغفقكلمنهويةءأإؤئ", "b t ^ j H x d * r z s $ S D T Z E g f q k l m n h w y t < < < < <".split()))
# Consonants after which vowels are backed.
EMPHATIC = frozenset("DSTZgxq")
VOWELS = {"َ": "a", "ُ": "u", "ِ": "i"}
NUNATION = {"ً": "a", "ٌ": "u", "ٍ": "i"}
# Common words whose first long a is not written.
UNWRITTEN_A = frozenset("لكن لكنه لكنها هذا هذه هذان ذلك هؤلاء".split())
CONVENTIONS = ("prescriptive", "pausal")
_ALL_MARKS = X.SUPPORTED_MARKS


def phonetizer_input(x: str | Column, convention: str = "prescriptive") -> Column:
    """Text as the converter takes it; composition must not run after this."""
    if convention not in CONVENTIONS:
        raise ValueError(f"convention must be one of {CONVENTIONS}")
    c = X.squeeze(x)
    c = F.regexp_replace(c, f"([{X.TANWIN}{X.SHORT_VOWELS}]){X.SHADDA}", f"{X.SHADDA}$1")
    c = F.regexp_replace(c, f"([اى]){X.SHADDA}", "$1")
    c = F.regexp_replace(c, X.DAGGER_ALEF, "")
    if convention == "pausal":
        c = F.regexp_replace(F.regexp_replace(c, f"[{X.TANWIN}]", ""), f"[{X.SHORT_VOWELS}{X.SUKUN}]+$", "")
    return F.trim(c)


def _units(word: str) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for ch in word:
        if ch in _ALL_MARKS:
            if out:
                out[-1][1] += ch
        else:
            out.append([ch, ""])
    return [(a, b) for a, b in out]


def convert_word(word: str) -> list[str]:
    phones: list[str] = []
    units = _units(word)
    lengthen = "".join(c for c, _ in units) in UNWRITTEN_A
    vowel = ""  # quality of the vowel just written, if it can still be lengthened
    backed = bare = False  # bare: the consonant just written has no mark

    def say(quality: str) -> None:
        nonlocal vowel
        phones.append(quality.upper() if backed else quality)
        vowel = quality

    for k, (ch, marks) in enumerate(units):
        plain = not set(marks) - {X.SUKUN}
        was_bare, bare = bare, False
        if ch == "ة" and not set(marks) & (VOWELS.keys() | NUNATION.keys()):
            vowel = ""
            continue  # silent where no ending is read after it
        if ch in "اى" or (ch == "و" and vowel == "u" and not marks) or (ch == "ي" and vowel == "i" and not marks):
            if ch in "اى" and not plain:  # a connecting alef that carries its own vowel
                if k == 0 and marks[0] in VOWELS:
                    backed = False
                    phones.append("<")
                    say(VOWELS[marks[0]])
                elif k and any(m in NUNATION for m in marks):
                    for m in marks:
                        if m in NUNATION:
                            say(NUNATION[m])
                            phones.append("n")
                    vowel = ""
                continue
            if k and ch in "اى" and was_bare:  # the vowel before it is not written
                say("a")
            if phones and (vowel == "a" and ch in "اى" or vowel == "u" and ch == "و" or vowel == "i" and ch == "ي"):
                phones[-1] *= 2
            vowel = ""
            continue
        if ch == "آ":
            phones += ["<", "aa"]
            vowel, backed = "", False
            continue
        symbol = CONSONANTS.get(ch)
        if symbol is None:
            continue
        if ch == "ل" and not marks and k == 1 and units[0][0] == "ا" and k + 1 < len(units) and X.SHADDA in units[k + 1][1]:
            continue  # the article's l is taken up by the doubled letter
        phones.append(symbol * 2 if X.SHADDA in marks else symbol)
        backed, vowel, bare = symbol in EMPHATIC, "", not marks
        for m in marks:
            if m in VOWELS:
                say(VOWELS[m])
                if lengthen and k == 0:
                    phones[-1] *= 2
            elif m in NUNATION:
                say(NUNATION[m])
                phones.append("n")
                vowel = ""
    return phones


class Converter:
    """Converts texts; words are remembered up to a bound."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.known = keep, {}

    def __call__(self, text: str) -> list[str]:
        out: list[str] = []
        for w in text.split():
            got = self.known.get(w)
            if got is None:
                if len(self.known) >= self.keep:
                    self.known.clear()
                got = self.known[w] = convert_word(w)
            out += got
        return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _phonemes(s: pd.Series) -> pd.Series:
    one = Converter()
    return pd.Series([None if x is None else one(x) for x in s], dtype=object)


def phonemes(x: str | Column, convention: str = "prescriptive") -> Column:
    """array<string> of symbols; an empty text has none; null stays null."""
    return _phonemes(phonetizer_input(x, convention))


def phonetize_distinct(rows: DataFrame, text: str, out: str = "phonemes", convention: str = "prescriptive") -> DataFrame:
    """Adds the phonemes of `text`, converting each different text once."""
    texts = rows.select(F.col(text).alias("_t")).where("_t is not null").distinct().withColumn(out, phonemes("_t", convention))
    return rows.drop(out).join(texts, F.col(text) == F.col("_t"), "left").drop("_t")


def phonetize_conditions(texts: DataFrame, condition: str, text: str, convention: str = "pausal") -> DataFrame:
    """A long table (condition, id, text) with phonemes; a blank text is an error before anything is converted."""
    blank = texts.where(F.coalesce(X.squeeze(text), F.lit("")) == "")
    if not blank.isEmpty():
        raise ValueError(f"blank text in condition {blank.first()[condition]}")
    return phonetize_distinct(texts, text, "phonemes", convention)


def provenance(convention: str) -> dict[str, str]:
    return {"converter": "rules", "convention": convention}
