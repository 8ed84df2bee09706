"""Mixing sources to target weights: hash-threshold histograms over token counts.

Each document's size is its number of tokens under a public tokenizer (the path
of its file is a parameter). The budget of a source is its share of the mix; as
many whole passes over the source as fit, at most max_repeats, are taken, and the
rest is the hash prefix of its documents that fits, found by nested histograms.

Defined results: null or empty text has no tokens; documents whose source is null
or blank are left out of the mix and of the total; a source without a target
counts in the total only; a source with a target, zero too, but no documents falls short.
Texts are tokenized whole; a piece of more than 4,096 characters is merged here by
the same rule, which the tokenizer would need quadratic time for.
"""

from __future__ import annotations

import base64
import heapq
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship_package
from .thresholds import hash_order, prefix_thresholds, with_below

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that belongs to the byte-level vocabulary files (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 4096
#: The target table is a small dimension; more rows than this are refused.
MOST_SOURCES = 2_000

_made: dict[int, object] = {}


def merged_length(data: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one piece: the adjacent pair of lowest rank, the leftmost of equals, is merged until none has a rank."""
    n = len(data)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the neighbouring parts
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    left = n
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not alive[i] or after[i] != j or j >= n or not alive[j] or after[j] != end:
            continue  # one of the two parts has changed
        alive[j] = 0
        left -= 1
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(data[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, end, after[end]))
        k = before[i]
        if k >= 0 and (r := ranks.get(data[k:end])) is not None:
            heapq.heappush(heap, (r, k, i, end))
    return left


class TokenCounter:
    """Counts tokens; built from the bytes of a vocabulary file."""

    def __init__(self, data: bytes):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(PATTERN)
        self.long = re.compile(r"\S{%d,}|\s{%d,}" % (LONG_RUN + 1, LONG_RUN + 1))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= LONG_RUN or not self.long.search(text):
            return len(self.encode(text))
        n = 0
        for m in self.pieces.finditer(text):
            p = m.group()
            n += len(self.encode(p)) if len(p) <= LONG_RUN else merged_length(p.encode("utf-8", "replace"), self.ranks)
        return n


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """documents -> doc_id, source (null where unknown), tokens, by batches of the text column."""
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())  # a file of fixed size, under 2 MB

    def run(batches):
        if "counter" not in _made:
            _made["counter"] = TokenCounter(vocabulary.value)
        count = _made["counter"]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([count(t) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "source", "tokens"])

    source = F.when(F.trim("source") != "", F.col("source")).alias("source")
    return docs.select("doc_id", source, "text").mapInArrow(run, "doc_id long, source string, tokens long")


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, mix_tokens: int | None = None, seed: int = 11, balanced: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mix: doc_id, source, tokens, repeats; report by source of targets).

    mix_tokens: size of the mix, by default as many tokens as all documents of
    known source have. Report: source, target_share, max_repeats, tokens,
    wanted_tokens, mixed_tokens, mixed_share, largest_mix_tokens (the size up to
    which the source can hold its share), unmet (the mix has less of it than wanted,
    by more than a document), falls_short.

    Sources that fall short leave the shares of the others too large. balanced
    gives the largest mix in which every source that has documents holds its share
    among those sources, to within a document.
    """
    spark = docs.sparkSession
    goals = targets.where("source is not null").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} source targets")
    sized = cut(token_sizes(docs, tokenizer).where("source is not null").withColumn("h", hash_order("doc_id", seed=seed)))
    known = spark.createDataFrame([(g.source,) for g in goals], "source string").distinct().withColumn("goal", F.lit(True))
    sums = sized.join(F.broadcast(known), "source", "left").groupBy(F.when(F.col("goal"), F.col("source")).alias("g")).agg(F.sum("tokens").alias("n"), F.max("tokens").alias("most")).collect()  # at most a row for each target, and one
    have, longest = {r.g: r.n or 0 for r in sums}, {r.g: r.most or 0 for r in sums}
    shares = {g.source: g.target_share or 0.0 for g in goals}
    reach = {g.source: have.get(g.source, 0) * (g.max_repeats or 0) for g in goals}
    if balanced:
        there = {s: v for s, v in shares.items() if v > 0 and reach[s] > 0}
        shares = {s: there.get(s, 0.0) / max(1e-12, sum(there.values())) for s in shares}
        total = min((reach[s] / shares[s] for s in there), default=0.0)
    else:
        total = mix_tokens if mix_tokens is not None else sum(have.values())
    whole, budgets, report, slack = [], {}, [], 1e-6 if balanced else 0.0
    for g in goals:
        n, want, most = have.get(g.source, 0), shares[g.source] * total, g.max_repeats or 0
        passes = min(most, int(want // n)) if n else 0
        whole.append((g.source, passes))
        if n and passes < most and want - passes * n > 0:
            budgets[g.source] = want - passes * n
        report.append((g.source, shares[g.source], g.max_repeats, n, want, reach[g.source] / shares[g.source] if shares[g.source] > 0 else None, g.source not in have or bool(reach[g.source] < want - slack)))
    cuts = prefix_thresholds(sized, budgets, group="source", weight="tokens")
    passes_of = F.broadcast(spark.createDataFrame(whole, "source string, _passes int").dropDuplicates(["source"]))
    mixed = with_below(sized.join(passes_of, "source"), cuts, "_more", group="source").withColumn("repeats", F.col("_passes") + F.col("_more").cast("int")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n")).collect()}
    all_mixed = sum(got.values())
    rows = [(s, share, most, n, float(want), got.get(s, 0), got.get(s, 0) / all_mixed if all_mixed else 0.0, largest, bool(want - got.get(s, 0) > max(longest.get(s, 0), 1e-6)), short) for s, share, most, n, want, largest, short in report]
    return mixed, spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens long, wanted_tokens double, mixed_tokens long, mixed_share double, largest_mix_tokens double, unmet boolean, falls_short boolean")
