"""Splits that keep related records together: component swap search.

Records that share a speaker, the words of their sentence or a phoneme sequence
form components. A start from hashed assignment is improved by moving whole
components and exchanging them between splits: several annealing chains run in
parallel over partitions of the components, each partition answering for its
share of the targets, with steps in proportion to its components, and the chain
with the least deviation of sizes and labels is kept. Components are searched by
classes of size, the largest first, each class for what the larger ones left of
the targets; every class is treated alike.

Defined results: null or blank speakers, and sentences without words, tie
nobody; a record whose fields are all null is a component of its own; repeated
rows of a record are one record; an empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship_package
from . import graph, members
from .letters import Words
from .overlap import sequence

#: Labels are counted in this many hashed bins.
LABEL_BINS = 16
#: Components per annealing partition (one partition is a few MB).
PART_COMPONENTS = 10_000
PROPORTIONS = (0.8, 0.1, 0.1)
NAMES = ("train", "validation", "test")


@F.pandas_udf(T.StringType())
def word_key(texts: pd.Series) -> pd.Series:
    """Folded words joined by single blanks; null where there are none."""
    words = Words()
    return pd.Series([" ".join(words(t)) or None for t in texts], dtype=object)


def records(pilot: DataFrame, holdout: DataFrame) -> DataFrame:
    """rec, label, speaker, words, seq of pilot rows and holdout references."""
    ship_package(pilot.sparkSession)
    speaker = F.when(F.trim(F.regexp_replace("client_id", r"[\s\x{a0}\x{2000}-\x{200f}\x{202f}\x{205f}\x{3000}\x{feff}]+", " ")) != "", F.col("client_id"))
    a = pilot.where("id is not null").select(F.col("id").alias("rec"), F.lower(F.trim("stratum")).alias("label"), speaker.alias("speaker"), word_key("sentence").alias("words"), sequence("phoneme_ref").alias("seq"))
    b = holdout.select("block", "eval_set", F.posexplode("holdout_phoneme_refs").alias("p", "x")).select(
        F.concat_ws(":", "block", F.lit("r"), F.col("p").cast("string")).alias("rec"), F.col("eval_set").alias("label"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("words"), sequence("x").alias("seq")
    )
    return a.unionByName(b)


def tied_groups(recs: DataFrame) -> DataFrame:
    """records -> (rec, root) of all records in groups of two or more."""
    def key(tag: str, c: str):
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(tag), F.sha2(F.col(c), 256)))

    ties = recs.select("rec", F.explode(F.array(key("c", "speaker"), key("w", "words"), key("p", "seq"))).alias("attr")).where("attr is not null").distinct()
    return graph.components(graph.star_edges(ties))


def _cost(have: np.ndarray, have_l: np.ndarray, want: np.ndarray, want_l: np.ndarray) -> np.ndarray:
    """Deviation of sizes and, at half their weight, of labels, for each chain."""
    return np.abs(have - want).sum(-1) + 0.5 * np.abs(have_l - want_l).sum((-2, -1))


def _anneal(sizes: np.ndarray, labels: np.ndarray, start: np.ndarray, want: np.ndarray, want_labels: np.ndarray, rng: np.random.Generator, sweeps: int) -> np.ndarray:
    """Moves and exchanges of whole components under a falling temperature, all chains in step.

    start: chains x components. Each chain proposes `sweeps` times as many steps as
    there are components; of the states at the end of each sweep, and the start, the
    best is kept.
    """
    chains, n = start.shape
    k = len(want)
    state, row = start.copy(), np.arange(chains)
    have = np.stack([np.bincount(x, weights=sizes, minlength=k) for x in state])
    have_l = np.zeros((chains, k, labels.shape[1]))
    for c in range(chains):
        np.add.at(have_l[c], state[c], labels)
    now = _cost(have, have_l, want, want_labels)
    best, kept = now.copy(), start.copy()
    steps = sweeps * n
    heat, cool = max(float(now.mean()) / n, 2.0 * float(sizes.mean())), 0.001 ** (1 / max(1, steps))
    for _ in range(sweeps):
        picks, partners, target = (rng.integers(0, top, (n, chains)) for top in (n, n, k))
        dice, kind = rng.random((n, chains)), rng.random((n, chains)) < 0.5
        for i in range(n):
            a, b = picks[i], partners[i]
            sa, sb_ = state[row, a], state[row, b]
            exchange = kind[i] & (sb_ != sa)
            sb = np.where(exchange, sb_, target[i])
            ds = sizes[a] - np.where(exchange, sizes[b], 0)
            dl = labels[a] - np.where(exchange[:, None], labels[b], 0)
            h, hl = have.copy(), have_l.copy()
            h[row, sa] -= ds
            h[row, sb] += ds
            hl[row, sa] -= dl
            hl[row, sb] += dl
            new = _cost(h, hl, want, want_labels)
            ok = (new <= now) | (dice[i] < np.exp(np.minimum(0.0, (now - new) / heat)))
            now = np.where(ok, new, now)
            have, have_l = np.where(ok[:, None], h, have), np.where(ok[:, None, None], hl, have_l)
            w = row[ok]
            state[w, a[ok]] = sb[ok]
            w = row[ok & exchange]
            state[w, b[w]] = sa[w]
            heat *= cool
        better = now < best
        best[better], kept[better] = now[better], state[better]
    return kept


def _annealed(pdf: pd.DataFrame, want: np.ndarray, want_l: np.ndarray, chains: int, seed: int, sweeps: int) -> np.ndarray:
    """Splits (chains x components) of one partition of a size class, from hashed assignment."""
    k = len(want)
    share = want / max(1e-9, want.sum())
    h = pdf["h"].to_numpy().astype(np.uint64)
    u = np.stack([((h * np.uint64(2 * c + 1)) >> np.uint64(11)).astype(float) / 2.0**53 for c in range(chains)])
    start = np.minimum(np.searchsorted(np.cumsum(share), u, side="right"), k - 1)
    return _anneal(pdf["size"].to_numpy(float), pdf[[f"l{i}" for i in range(LABEL_BINS)]].to_numpy(float), start, want, want_l, np.random.default_rng([seed, int(pdf["part"].iloc[0])]), sweeps)


def _search(share: np.ndarray, share_l: np.ndarray, chains: int, seed: int, sweeps: int):
    """The search of one partition: its components with their split in each chain."""
    cols = [f"l{i}" for i in range(LABEL_BINS)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_key", kind="stable")
        state = _annealed(pdf, share * float(pdf["size"].sum()), share_l * pdf[cols].to_numpy(float).sum(0)[None, :], chains, seed, sweeps)
        return pdf[["group_key", "size"]].assign(splits=list(state.T.tolist()), **{c: pdf[c] for c in cols})

    return run


def assign(recs: DataFrame, proportions=PROPORTIONS, names=NAMES, chains: int = 8, seed: int = 17, sweeps: int = 6) -> DataFrame:
    """records -> rec, group_key, split, group_size: tied records never cross splits."""
    spark = recs.sparkSession
    ship_package(spark)
    props = np.array(proportions, float) / sum(proportions)
    k = len(props)
    one = recs.groupBy("rec").agg(F.min("label").alias("label"))
    groups = tied_groups(recs)
    members_ = cut(one.join(groups, "rec", "left").select("rec", "label", F.coalesce("root", "rec").alias("group_key")))
    bin_ = F.pmod(F.xxhash64("label"), F.lit(LABEL_BINS)).cast("int")
    by_bin = [F.count_if(bin_ == i).alias(f"l{i}") for i in range(LABEL_BINS)]
    cols = ["size", *(f"l{i}" for i in range(LABEL_BINS))]
    comps = members_.groupBy("group_key").agg(F.count("*").alias("size"), *by_bin)
    comps = cut(comps.withColumn("h", F.xxhash64("group_key")).withColumn("cls", F.floor(F.log2(F.col("size").cast("double")) / 4).cast("int")))
    # one row a size class (each sixteen times the one before), of which there are at most some fifteen
    classes = comps.groupBy("cls").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in cols)).orderBy(F.desc("cls")).collect()
    if not classes:
        return members_.select("rec", "group_key", F.lit(None).cast("string").alias("split"), F.lit(0).cast("long").alias("group_size"))
    whole = {c: float(sum(r[c] for r in classes)) for c in cols}
    left, left_l = props * whole["size"], props[:, None] * np.array([whole[c] for c in cols[1:]])[None, :]
    shape, chosen = "group_key string, size long, splits array<int>, " + ", ".join(f"{c} long" for c in cols[1:]), None
    for r in classes:  # large components first; every class starts from hashed assignment and takes what the larger ones left
        parts = max(1, -(-int(r.n) // PART_COMPONENTS))
        own, own_l = float(r["size"]), np.array([r[c] for c in cols[1:]], float)
        room, room_l = np.maximum(left, 0), np.maximum(left_l, 0)
        share, share_l = room / max(1e-9, room.sum()), room_l / np.maximum(1e-9, room_l.sum(0))

        mine = comps.where(F.col("cls") == r.cls).withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
        tried = cut(mine.groupBy("part").applyInPandas(_search(share, share_l, chains, seed, sweeps), shape))
        # sums of chains x splits
        sums = tried.select(F.posexplode("splits").alias("chain", "s"), *cols).groupBy("chain", "s").agg(*(F.sum(c).alias(c) for c in cols)).collect()
        have, have_l = np.zeros((chains, k)), np.zeros((chains, k, LABEL_BINS))
        for x in sums:
            have[x.chain, x.s], have_l[x.chain, x.s] = x["size"], [x[c] for c in cols[1:]]
        best = int(np.argmin(_cost(have, have_l, share * own, share_l * own_l[None, :])))
        left, left_l = left - have[best], left_l - have_l[best]
        part = tried.select("group_key", F.get("splits", F.lit(best)).alias("split_no"), F.col("size").alias("group_size"))
        chosen = part if chosen is None else chosen.unionByName(part)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("split_no") + 1)
    large = members.large_keys(chosen, ["group_key"], "group_size")
    return members.join_divided(chosen, members_, ["group_key"], large, "rec").select("rec", "group_key", name.alias("split"), "group_size")


def split_report(assigned: DataFrame) -> DataFrame:
    """split, records, share of all records, groups: what the search reached."""
    g = assigned.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("group_key").alias("groups"))
    total = assigned.agg(F.count("*").alias("_n"))
    return g.join(F.broadcast(total)).select("split", "records", (F.col("records") / F.col("_n")).alias("share"), "groups")  # one row
