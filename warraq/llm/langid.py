"""Missing or wrong language labels: a byte convolutional network.

The network reads fixed-length windows of bytes: an embedding, filters of
several widths, the maximum of each over the window, and a softmax. It is
trained here in numpy on labelled lines (with phoneme symbols as the class of no
language), then trained further on a bounded sample of labelled documents whose
label the first network confirms, and applied to batches of the distinct words of a batch of documents;
a word longer than a window is read through overlapping ones. The best path over
the words of a document, with a price on changing the language, gives its
segments.

Defined results: null and empty texts, and texts without words, have no segment;
ties go to the alphabetically first language; documents of any length are
processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonemes import INVENTORY
from ..session import ship_package
from . import letters
from .thresholds import hash_order, prefix_thresholds, with_below

#: The classifier is fitted on at most so many labelled lines (all of them, if there are fewer).
MOST_SAMPLES = 20_000
#: Labelled documents of each language that the second training may use (all, if there are fewer).
DOCS_PER_LANGUAGE = 400
#: Longer documents (in characters) are not used for fitting, so the sample's size is bounded too.
MOST_CHARACTERS = 20_000
WINDOW, WIDTHS, FILTERS, EMBED = 32, (1, 2, 3, 4, 5), 24, 12
EPOCHS, MORE_EPOCHS, BATCH, RATE = 40, 12, 64, 0.004
SWITCH, LEAST = -8.0, -7.0
#: Running words that make a passage.
PASSAGE = 6
NONE = "zxx"
# The phoneme symbols.
SYMBOLS = INVENTORY

# Spellings of the languages, by two-letter code.
SPELLINGS = {
    "ar": "ar ara arb arz arabic",
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish",
    "fa": "fa fas per pes prs persian farsi",
    "fr": "fr fra fre french",
    "tr": "tr tur turkish",
    "ur": "ur urd urdu",
}


def _head(c: Column) -> Column:
    """The first run of letters of a label, in small letters."""
    return F.regexp_extract(F.lower(c), r"([\p{L}]+)", 1)


def label_language(col: str | Column, languages: list[str] | tuple[str, ...] = ()) -> Column:
    """The two-letter code that a label names in any spelling; null if it names none.

    Names and three-letter codes are known for the languages of SPELLINGS; of any other of `languages`,
    the code itself is, in any case, with a region and padded.
    """
    head = _head(F.col(col) if isinstance(col, str) else col)
    spelt = {n: code for code, names in SPELLINGS.items() for n in names.split()}
    spelt |= {x: x for x in languages if x not in spelt and x != NONE}
    return F.element_at(F.create_map(*(F.lit(x) for pair in spelt.items() for x in pair)), head)


def sample_language(col: str | Column) -> Column:
    """The language of a labelled line: as label_language has it, or else the code that is written."""
    head = _head(F.col(col) if isinstance(col, str) else col)
    return F.coalesce(label_language(col), F.when(F.length(head).between(2, 3), head))


@lru_cache(1)
def _table() -> dict:
    gone = {ord(c): None for c in letters.tables()["invisible"]} | {ord(letters.TATWEEL): None}
    for cp in (*range(0x0610, 0x061B), *range(0x064B, 0x0654), *range(0x0656, 0x0660), 0x0670, *range(0x06D6, 0x06EE)):
        if unicodedata.category(chr(cp)) == "Mn":
            gone[cp] = None
    return gone


_LETTERS = re.compile(r"[^\W\d_]+(?:[̀-ٕͯٔ]+[^\W\d_]*)*")
_SYMBOL = re.compile(r"[<$*^|~]+")


def token_words(token: str) -> list[str]:
    """The words of a blank-free token: letters only, lower case, without vowel marks; lone symbols are words of their own."""
    s = unicodedata.normalize("NFKC", token.translate(_table())).replace("İ", "i").lower()
    return _LETTERS.findall(s) or ([s] if _SYMBOL.fullmatch(s) else [])


def word_windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, index of each window's word)."""
    rows, owner = [], []
    step = WINDOW - max(WIDTHS) + 1
    for i, w in enumerate(words):
        b = b" " + w.encode("utf-8", "replace") + b" "
        for at in range(0, max(1, len(b) - max(WIDTHS) + 1), step):
            rows.append(b[at : at + WINDOW].ljust(WINDOW, b"\0"))
            owner.append(i)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(owner, np.int64)


class ByteNet:
    """Embedding, filters of several widths, ReLU, maximum over the window, softmax."""

    def __init__(self, classes: list[str], seed: int = 5):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"E": r.normal(0, 0.3, (256, EMBED)).astype(np.float32), "W": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32), "b": np.zeros(len(classes), np.float32)}
        self.p["E"][0] = 0
        for w in WIDTHS:
            self.p[f"C{w}"] = r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(FILTERS, np.float32)

    def features(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e = self.p["E"][x]  # n, WINDOW, EMBED
        n, out = len(x), []
        for w in WIDTHS:
            t = WINDOW - w + 1
            cols = np.lib.stride_tricks.as_strided(e, (n, t, w * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
            z = cols.reshape(n * t, w * EMBED) @ self.p[f"C{w}"] + self.p[f"c{w}"]
            z = z.reshape(n, t, FILTERS)
            if keep is not None:
                at = z.argmax(1)
                keep[w] = (cols, at)
                z = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
            else:
                z = z.max(1)
            out.append(np.maximum(z, 0))
        return np.concatenate(out, 1)

    def log_probs(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.p["W"] + self.p["b"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def step(self, x, y, weight, adam, t):
        keep: dict = {}
        h = self.features(x, keep)
        lp = self.log_probs(h)
        d = (np.exp(lp) - y) * weight[:, None] / weight.sum()
        g = {"W": h.T @ d, "b": d.sum(0), "E": np.zeros_like(self.p["E"])}
        dh = d @ self.p["W"].T * (h > 0)
        n = len(x)
        for i, w in enumerate(WIDTHS):
            cols, at = keep[w]
            dz = dh[:, i * FILTERS : (i + 1) * FILTERS]  # n, FILTERS
            picked = cols[np.arange(n)[:, None], at]  # n, FILTERS, w*EMBED
            g[f"C{w}"] = np.einsum("nf,nfk->kf", dz, picked)
            g[f"c{w}"] = dz.sum(0)
            de = dz[:, :, None] * self.p[f"C{w}"].T[None]  # n, FILTERS, w*EMBED
            for j in range(w):
                byte = x[np.arange(n)[:, None], at + j]
                cell = (byte[:, :, None].astype(np.int64) * EMBED + np.arange(EMBED)).ravel()
                g["E"] += np.bincount(cell, de[:, :, j * EMBED : (j + 1) * EMBED].ravel(), 256 * EMBED).reshape(256, EMBED).astype(np.float32)
        g["E"][0] = 0
        for k, v in self.p.items():
            m, s = adam.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
            grad = g[k] + 1e-5 * v
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            v -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)


def _variants(word: str) -> set[str]:
    """A word as it may be met: with other letters for the Arabic ones, and without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not "̀" <= c <= "ͯ")
    return {word, plain, plain.replace("ı", "i")}


def _counts(lines: list[tuple[str, str]]) -> dict[str, dict[str, float]]:
    """word -> language -> uses, the forms a word may be met in included."""
    out: dict[str, dict[str, float]] = {}
    for lang, text in lines:
        for w in (w for t in text.split() for w in token_words(t)):
            forms = _variants(w)
            if lang == "ar":
                forms |= {f.replace("ي", "ی").replace("ك", "ک") for f in forms} | {w.replace("ه", "ھ")}
            for f in forms:
                d = out.setdefault(f, {})
                d[lang] = d.get(lang, 0) + (1.0 if f == w else 0.5)
    return out


def _train_on(net: ByteNet, counts: dict[str, dict[str, float]], epochs: int, seed: int) -> None:
    """Soft targets: a word's languages by its share of each language's words."""
    total: dict[str, float] = {}
    for d in counts.values():
        for lang, n in d.items():
            total[lang] = total.get(lang, 0) + n
    for s in SYMBOLS:
        for f in token_words(s):
            counts.setdefault(f, {})[NONE] = 1.0
    total[NONE] = float(2 * len(SYMBOLS))
    mean = sum(total.values()) / len(total)
    words = sorted(counts)
    target = np.zeros((len(words), len(net.classes)), np.float32)
    for i, w in enumerate(words):
        for lang, n in counts[w].items():
            target[i, net.classes.index(lang)] = n / total[lang]
    weight = (target.sum(1) * mean) ** 0.6
    target = 0.98 * target / target.sum(1, keepdims=True) + 0.02 / len(net.classes)
    x, owner = word_windows(words)
    y, wt, rng = target[owner], weight[owner].astype(np.float32), np.random.default_rng(seed)
    adam, t = {}, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            t += 1
            net.step(x[at], y[at], wt[at], adam, t)


def train(lines: list[tuple[str, str]], seed: int = 5) -> ByteNet:
    """lines: (language, text)."""
    net = ByteNet(sorted({k for k, _ in lines} | {NONE}), seed)
    _train_on(net, _counts(lines), EPOCHS, seed)
    return net


def _is_arabic(word: str) -> bool:
    return any("\u0600" <= c <= "\u06ff" for c in word)


def arabic_script(lines: list[tuple[str, str]]) -> set[str]:
    """The languages most of whose words in the labelled lines are in Arabic script."""
    score: dict[str, int] = {}
    for lang, text in lines:
        score[lang] = score.get(lang, 0) + sum(1 if _is_arabic(w) else -1 for w in text.split())
    return {k for k, v in score.items() if v > 0}


def train_further(net: ByteNet, lines: list[tuple[str, str]], documents: list[tuple[str, str]], seed: int = 6) -> None:
    """Adds the words of documents most of whose words the network finds in the labelled language."""
    numbers: dict[str, int] = {}
    arabic = arabic_script(lines)
    rows = [np.array([numbers.setdefault(w, len(numbers)) for t in text.split() for w in token_words(t)], np.int64) for _, text in documents]
    full = [i for i, r in enumerate(rows) if len(r)]
    if not full:
        return
    paths = best_paths(word_scores(net, list(numbers)), [rows[i] for i in full])
    names = list(numbers)
    good = []
    for i, path in zip(full, paths):
        lang = documents[i][0]
        if lang in net.classes and (path == net.classes.index(lang)).mean() >= 0.7:
            right = lang in arabic
            good.append((lang, " ".join(names[k] for k in rows[i] if _is_arabic(names[k]) == right)))
    counts = _counts(good)
    for w, d in _counts(lines).items():
        own = counts.setdefault(w, {})
        for lang, n in d.items():
            own[lang] = own.get(lang, 0) + n
    _train_on(net, counts, MORE_EPOCHS, seed)


def word_scores(net: ByteNet, words: list[str]) -> np.ndarray:
    """Log-probabilities of each word's class, by batches of windows."""
    x, owner = word_windows(words)
    h = np.concatenate([net.features(x[i : i + 2048]) for i in range(0, len(x), 2048)])
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return np.maximum(net.log_probs(np.maximum.reduceat(h, first)), LEAST)


def best_paths(scores: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
    """The best class sequence of each document (row: word numbers), many documents at a time."""
    out: list = [None] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    k = scores.shape[1]
    at = 0
    while at < len(order):
        longest = len(rows[order[at]])
        n = max(1, min(len(order) - at, 400_000 // max(1, longest)))
        block = order[at : at + n]
        at += n
        lengths = np.array([len(rows[i]) for i in block])
        words = np.zeros((longest, n), np.int64)
        for c, i in enumerate(block):
            words[: len(rows[i]), c] = rows[i]
        come = np.zeros((longest, n, k), np.int8)
        v = scores[words[0]]
        for t in range(1, longest):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # documents longer than t come first
            if not live:
                break
            u = v[:live]
            top = u.argmax(1)
            jump = u[np.arange(live), top][:, None] + SWITCH
            stay = u >= jump
            come[t, :live] = np.where(stay, np.arange(k)[None], top[:, None])
            v[:live] = np.where(stay, u, jump) + scores[words[t, :live]]
        state = v.argmax(1)
        path = np.zeros((longest, n), np.int8)
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            path[t, :live] = state[:live]
            if t:
                state[:live] = come[t, np.arange(live), state[:live]]
        for c, i in enumerate(block):
            out[i] = path[: lengths[c], c]
    return out


def fit(samples: DataFrame, docs: DataFrame | None = None, most: int = MOST_SAMPLES, per_language: int = DOCS_PER_LANGUAGE) -> ByteNet:
    """The network, fitted on at most `most` labelled lines and `per_language` labelled documents of each language.

    Its classes are the languages that the lines have, whichever they are, and that
    of no language.
    """
    rows = samples.where("lang is not null and text is not null").select(sample_language("lang").alias("lang"), "text", F.xxhash64("sample_id").alias("h")).where("lang is not null").orderBy("h", "text").limit(most).collect()
    lines = [(r.lang, r.text) for r in rows]
    net = train(lines)
    if docs is not None and lines:
        names = sorted({k for k, _ in lines})
        labelled = docs.select("doc_id", label_language("lang", names).alias("grp"), hash_order("doc_id", seed=3).alias("h"), F.lit(1).alias("w"), "text").where(F.col("grp").isNotNull() & (F.length("text") <= MOST_CHARACTERS))
        cuts = prefix_thresholds(labelled.select("grp", "h", "w"), dict.fromkeys(names, per_language))
        train_further(net, lines, [(r.grp, r.text) for r in with_below(labelled, cuts, "_in").where("_in").select("grp", "text", "doc_id").orderBy("doc_id").collect()])
    return net


_SHAPE = "doc_id long, label string, segment_no int, lang string, from_word int, n_words int, confidence double"


def segments(docs: DataFrame, model: DataFrame | ByteNet) -> DataFrame:
    """documents(doc_id, text, lang) -> one row for each run of words of one language.

    model: a fitted network, or labelled lines to fit one on.

    label is the language that the document's own label names. Runs of phoneme
    symbols have lang 'zxx'. confidence is the mean probability of the words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    fitted = model if isinstance(model, ByteNet) else fit(model, docs)
    net = spark.sparkContext.broadcast(fitted)  # weights of fixed size, well under 1 MB
    names = [x.split()[0] for x in _SHAPE.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches):
        model, seen = net.value, {}
        number: dict[str, int] = {}
        scores = np.zeros((0, len(model.classes)), np.float32)
        for b in batches:
            if len(number) > 200_000:
                seen.clear()
                number.clear()
                scores = scores[:0]
            rows, fresh = [], []
            for t in b.column("text").to_pylist():
                ids: list[int] = []
                for token in t.split():
                    got = seen.get(token)
                    if got is None:
                        got = []
                        for w in token_words(token):
                            if w not in number:
                                number[w] = len(number)
                                fresh.append(w)
                            got.append(number[w])
                        seen[token] = got
                    ids += got
                rows.append(np.array(ids, np.int64))
            if fresh:
                scores = np.concatenate([scores, word_scores(model, fresh)])
            probs = np.exp(scores)
            full = [i for i, r in enumerate(rows) if len(r)]
            paths = best_paths(scores, [rows[i] for i in full]) if full else []
            ids, labels = b.column("doc_id").to_pylist(), b.column("label").to_pylist()
            out = []
            for i, path in zip(full, paths):
                cuts = np.flatnonzero(path[1:] != path[:-1]) + 1
                starts = [0, *cuts.tolist()]
                for s, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(path)])):
                    c = int(path[lo])
                    out.append((ids[i], labels[i], s, model.classes[c], lo, hi - lo, float(probs[rows[i][lo:hi], c].mean())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            if len(seen) > 400_000:
                seen.clear()

    return docs.where("text is not null and doc_id is not null").select("doc_id", label_language("lang", fitted.classes).alias("label"), "text").mapInArrow(run, _SHAPE)


def document_languages(segs: DataFrame, docs: DataFrame | None = None, net: ByteNet | None = None) -> DataFrame:
    """doc_id, lang (most words; ties to the first code), confidence, n_languages of passages, label_ok.

    A document of phoneme symbols only has lang 'zxx' and their mean probability.
    With docs, those without a word (null and blank texts too) are there as well:
    lang 'zxx', confidence 1.
    """
    spoken = F.col("lang") != NONE
    runs = segs.select("doc_id", "label", "lang", "n_words", "confidence")
    if docs is not None:
        every = docs.where("doc_id is not null").select("doc_id", label_language("lang", net.classes if net else ()).alias("label")).distinct()
        runs = runs.unionByName(every.select("doc_id", "label", F.lit(NONE).alias("lang"), F.lit(0).alias("n_words"), F.lit(0.0).alias("confidence")))
    per = runs.groupBy("doc_id", "label", "lang").agg(F.sum("n_words").alias("words"), F.max("n_words").alias("longest"), F.sum(F.col("confidence") * F.col("n_words")).alias("mass"))
    best = per.groupBy("doc_id", "label").agg(F.min_by(F.struct("lang", "words", "mass"), F.struct(~spoken, -F.col("words"), F.col("lang"))).alias("b"), F.coalesce(F.sum(F.when(spoken, F.col("words"))), F.max("words")).alias("all"), F.count_if(spoken & (F.col("longest") >= PASSAGE)).alias("n_languages"))
    return best.select("doc_id", "b.lang", F.when(F.col("all") > 0, F.col("b.mass") / F.col("all")).otherwise(1.0).alias("confidence"), "n_languages", F.coalesce(F.col("label") == F.col("b.lang"), F.lit(False)).alias("label_ok"))


def unlabelled_passages(segs: DataFrame) -> DataFrame:
    """(doc_id, lang) of passages of six or more running words that the label doesn't name."""
    return segs.where((F.col("lang") != NONE) & (F.col("n_words") >= PASSAGE) & (F.col("label").isNull() | (F.col("label") != F.col("lang")))).select("doc_id", "lang").distinct()
