"""Phoneme sequences: parsing, classes, vocabulary codec, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Vowels, and the tokens of silence and of the unknown.
SHORT = ("a", "i", "u", "A", "I", "U")
LONG = ("aa", "ii", "uu", "AA", "II", "UU")
SILENCE = ("sil", "<sil>", "<unk>")
# The 68 symbols of the closed inventory.
INVENTORY = tuple("< << b bb t tt ^ ^^ j jj H HH x xx d dd * ** r rr z zz s ss $ $$ S SS D DD T TT Z ZZ E EE g gg f ff q qq k kk l ll m mm n nn h hh w ww y yy a aa A AA i ii I II u uu U UU".split())
#: Reserved numbers of the codec: blank and padding, end, unknown.
BLANK, END, UNKNOWN, FIRST = 0, 1, 2, 3


def tokens(x: str | Column) -> Column:
    """array<string> of the symbols; an empty text gives an empty array."""
    return X.words(x)


def without_silence(ts: str | Column) -> Column:
    """Drops silence and unknown tokens; duplicates of others stay."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.filter(c, lambda t: ~t.isin(*SILENCE))


def collapse_stress(ts: str | Column) -> Column:
    """Drops silence and the stress digit at a symbol's end."""
    return F.transform(F.filter(ts, lambda t: t != "sil"), lambda t: F.regexp_replace(t, "[01]$", ""))


def phoneme_class(t: str | Column) -> Column:
    c = F.col(t) if isinstance(t, str) else t
    return F.when(c.isin(*SHORT), "short").when(c.isin(*LONG), "long").otherwise("consonant")


# Names of the marks by which a word's ending is told.
MARK_NAMES = {"\u064b": "tanwin fath", "\u064c": "tanwin damm", "\u064d": "tanwin kasr", "\u064e": "fatha", "\u064f": "damma", "\u0650": "kasra", "\u0652": "sukun", "\u0670": "superscript alef"}


def final_mark(word: str | Column) -> Column:
    """Name of the last mark that a word carries anywhere, shadda not counted; '(bare)' without any.

    Tanwin is written on the letter before a final alef, so the last mark need not
    stand on the last letter. Null stays null.
    """
    c = F.col(word) if isinstance(word, str) else word
    last = F.regexp_extract(c, f"([{''.join(MARK_NAMES)}])[^{''.join(MARK_NAMES)}]*$", 1)
    names = F.create_map(*(F.lit(x) for pair in MARK_NAMES.items() for x in pair))
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(names, last), F.lit("(bare)")))


# ---- codec -------------------------------------------------------------------
def _numbers(vocabulary: list[str]) -> Column:
    if len(set(vocabulary)) != len(vocabulary) or not vocabulary:
        raise ValueError("a vocabulary is a non-empty list of different tokens")
    return F.create_map(*(x for i, t in enumerate(vocabulary) for x in (F.lit(t), F.lit(FIRST + i))))


def encode(ts: str | Column, vocabulary: list[str]) -> Column:
    """Numbers of the tokens, unknown ones as UNKNOWN, END at the end."""
    m = _numbers(vocabulary)
    return F.concat(F.transform(ts, lambda t: F.coalesce(F.try_element_at(m, t), F.lit(UNKNOWN))), F.array(F.lit(END)))


def decode(ids: str | Column, vocabulary: list[str], collapse: bool = False) -> Column:
    """Tokens up to the first END; blanks dropped, and repeats of the number right before if collapse."""
    c = F.col(ids) if isinstance(ids, str) else ids
    end = F.array_position(c, F.lit(END)).cast("int")
    upto = F.when(end > 0, F.slice(c, 1, end - 1)).otherwise(c)
    names = F.array(*map(F.lit, vocabulary))

    def tokens_of(ids: Column) -> Column:
        def stays(x: Column, i: Column) -> Column:
            ok = x != BLANK
            if collapse:
                ok = ok & ((i == 0) | (x != F.coalesce(F.get(ids, i - 1), F.lit(-1))))
            return ok

        return F.transform(F.filter(ids, stays), lambda x: F.when(x == UNKNOWN, F.lit("<unk>")).otherwise(F.get(names, x - FIRST)))

    return X.let(upto, tokens_of)


# ---- distances ----------------------------------------------------------------
def token_distance(a: str | Column, b: str | Column) -> Column:
    """Unit-cost edit distance over tokens, in the JVM; tokens outside any inventory differ too."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))

    def distance(both: Column) -> Column:
        # one character a token, beyond the basic plane, by its place in the pair's own dictionary
        place = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(both, t) + 0x10000), 8, "0")), "UTF-32")
        return F.levenshtein(F.array_join(F.transform(x, place), ""), F.array_join(F.transform(y, place), ""))

    return F.when(x == y, F.lit(0)).otherwise(X.let(F.array_distinct(F.concat(x, y)), distance))


def first_difference(p: str | Column, r: str | Column, around: int = 3) -> Column:
    """struct(at, left, right): first differing place and its surroundings; null where equal."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (p, r))
    at = F.array_position(F.zip_with(x, y, lambda a, b: F.coalesce(a != b, F.lit(True))), True).cast("int")
    cut = lambda s: F.slice(s, F.greatest(at - around, F.lit(1)), 2 * around + 1)
    return F.when(at > 0, F.struct((at - 1).alias("at"), cut(x).alias("left"), cut(y).alias("right")))
