"""Character tables built by rule from the Unicode database, and word keys.

Two readers share these tables: the embedded SQL of `lookalike` (one consistent
form in which texts that look the same are equal) and `words_of` (words that are
the same when their letters are).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Format characters that print something, and ignorable characters
# outside category Cf.
VISIBLE_FORMAT = [range(0x0600, 0x0606), range(0x06DD, 0x06DE), range(0x070F, 0x0710), range(0x0890, 0x0892), range(0x08E2, 0x08E3), range(0x110BD, 0x110BE), range(0x110CD, 0x110CE)]
IGNORABLE = [range(0x034F, 0x0350), range(0x115F, 0x1161), range(0x17B4, 0x17B6), range(0x180B, 0x1810), range(0x3164, 0x3165), range(0xFE00, 0xFE10), range(0xFFA0, 0xFFA1), range(0xE0100, 0xE01F0)]

# Letters of other alphabets that look like a Latin letter, and
# letters and digits of the Persian and Urdu alphabets that look like Arabic ones.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "ρ": "p", "օ": "o", "Օ": "O", "ս": "u", "Ս": "U", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ѵ": "v", "ɡ": "g", "ɑ": "a",
    "ک": "ك", "ڪ": "ك", "ی": "ي", "ھ": "ه", "ہ": "ه", "ە": "ه",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
}
# Code points outside these ranges are ideographs, syllables, private
# or unassigned ones, which have no shape, mark or invisible character to map.
SEARCHED = [range(0x0000, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x17000), range(0x1B000, 0x20000), range(0xE0000, 0xE0200)]
# Compatibility forms that show the same letter in the same place. Raised,
# lowered, encircled and squared forms, fractions and letters in brackets are other signs
# to the eye and stay as they are.
SHAPE_TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<font>")
HAMZA_ABOVE, HAMZA_BELOW, TATWEEL = "ٔ", "ٕ", "ـ"


_VISIBLE_FORMAT, _IGNORABLE = (frozenset(cp for r in ranges for cp in r) for ranges in (VISIBLE_FORMAT, IGNORABLE))


def is_blank(ch: str) -> bool:
    return ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch == "⠀"


def is_invisible(ch: str) -> bool:
    cat, cp = unicodedata.category(ch), ord(ch)
    return (cat == "Cf" and cp not in _VISIBLE_FORMAT) or cp in _IGNORABLE or (cat == "Cc" and not is_blank(ch))


def searched():
    return (chr(cp) for r in SEARCHED for cp in r)


@lru_cache(1)
def tables() -> dict:
    """Rule-built tables: blanks, invisible, shapes (one to one), ligatures (one to many), look_alike, composed, marks."""
    blanks, invisible, shapes, ligatures = [], [], {}, {}
    for ch in searched():
        if is_blank(ch):
            blanks.append(ch)
        elif is_invisible(ch):
            invisible.append(ch)
        else:
            tag, *rest = unicodedata.decomposition(ch).split() or [""]
            if tag in SHAPE_TAGS or (tag == "<compat>" and "\ufb00" <= ch <= "\ufb4f"):
                out = unicodedata.normalize("NFKC", ch)
                if out and not out[0].isspace() and out[0] != TATWEEL:
                    (shapes if len(out) == 1 else ligatures)[ch] = out
    look = dict(LOOK_ALIKE)
    for cp in range(0x370, 0x530):  # accented forms of the look-alikes follow their base
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in LOOK_ALIKE:
            out = unicodedata.normalize("NFC", LOOK_ALIKE[parts[0]] + parts[1:])
            if len(out) == 1:
                look[chr(cp)] = out
    composed = {}  # letters that carry marks: base and the marks in order
    for ch in searched():
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.category(ch)[0] == "L" and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            composed[ch] = parts
    marks: dict[int, list[str]] = {}  # combining marks by their class
    unseen = set(invisible)
    for ch in searched():
        if unicodedata.category(ch) == "Mn" and ch not in unseen:
            marks.setdefault(unicodedata.combining(ch), []).append(ch)
    return {"marks": marks, "composed": composed, "blanks": blanks, "invisible": invisible, "shapes": shapes, "ligatures": ligatures, "look_alike": look}


@lru_cache(1)
def _word_tables() -> tuple[dict, re.Pattern]:
    t = tables()
    gone = {ord(c): None for c in t["invisible"]} | {ord(TATWEEL): None}
    for ch in searched():
        if unicodedata.category(ch) in ("Mn", "Me") and ch not in (HAMZA_ABOVE, HAMZA_BELOW):
            gone[ord(ch)] = None
    same = {ord(a): b for a, b in t["look_alike"].items()} | {ord("ٱ"): "ا"}
    return gone | same, re.compile(r"[^\W_]+", re.UNICODE)


def word_form(token: str) -> list[str]:
    """Words of one blank-free token: letters and digits only, marks, stretching, invisible characters, case and letter variants folded."""
    table, word = _word_tables()
    s = unicodedata.normalize("NFKD", token).translate(table)
    s = unicodedata.normalize("NFC", s.casefold())
    if HAMZA_ABOVE in s or HAMZA_BELOW in s:  # a hamza left without a carrier that composes stays with its letter
        s = s.replace(HAMZA_ABOVE, "ء").replace(HAMZA_BELOW, "ء")
    return word.findall(s)


class Words:
    """Splits texts into folded words; remembers the tokens it has seen, up to a bound."""

    def __init__(self, keep: int = 300_000):
        self.keep, self.seen = keep, {}

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        out, seen = [], self.seen
        for token in text.split():
            words = seen.get(token)
            if words is None:
                if len(seen) >= self.keep:
                    seen.clear()
                words = word_form(token)
                if len(token) <= 64:
                    seen[token] = words
            out += words
        return out


def words_of(text: str | None) -> list[str]:
    return Words()(text)
