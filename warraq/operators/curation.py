"""Curation: pools and duplicates, overlap and hold-out filters, canonical policy, span search.

Match keys are shuffled, not texts collected; a side is broadcast by Spark only
where its measured size allows. Duplicate groups are resolved by partial
minima, so a text that a third of all rows share is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

PRE_VOWELIZED, PARTIAL, FEW_WORDS = 0.50, 0.05, 3
EXCLUDING = ("no_arabic", "no_tashkeel", "pre_vowelized", "duplicate")
ALL_FLAGS = ("digits", "duplicate", "latin", "no_arabic", "no_tashkeel", "partially_vowelized", "pre_vowelized", "short", "word_count_mismatch")


def pool_flags(sentence: str, tashkeel: str) -> Column:
    """Sorted flags of a candidate row; null texts count as empty."""
    s, t = F.coalesce(F.col(sentence), F.lit("")), F.coalesce(F.col(tashkeel), F.lit(""))
    rate, blank = X.diacritization_rate(s), X.squeeze(t) == ""
    n = F.size(X.arabic_tokens(s))
    return X.flag_set(
        ("no_arabic", rate.isNull()), ("no_tashkeel", blank), ("pre_vowelized", rate >= PRE_VOWELIZED), ("partially_vowelized", (rate >= PARTIAL) & (rate < PRE_VOWELIZED)),
        ("word_count_mismatch", ~blank & (n != F.size(X.arabic_tokens(t)))), ("short", n < FEW_WORDS), ("latin", X.has_latin(s)), ("digits", X.has_digits(s)),
    )


def excluded(flags: str | Column) -> Column:
    return F.arrays_overlap(X._c(flags), F.array(*map(F.lit, EXCLUDING)))


def build_pool(rows: DataFrame) -> DataFrame:
    """rows(id, sentence, tashkeel_sentence) -> id, sentence, tashkeel_sentence, rate, flags, skel, eligible.

    Of the rows with one skeleton, the first by (excluded, id) is kept; the others get
    the flag duplicate. Nothing is deleted.
    """
    x = rows.select("id", "sentence", "tashkeel_sentence").withColumn("rate", X.diacritization_rate(F.coalesce("sentence", F.lit("")))).withColumn("flags", pool_flags("sentence", "tashkeel_sentence"))
    x = x.withColumn("skel", X.skeleton(F.coalesce("sentence", F.lit(""))))
    first = x.groupBy("skel").agg(F.min(F.struct(excluded("flags").alias("e"), F.col("id").alias("i"))).alias("k")).select("skel", F.col("k.i").alias("keep"))
    x = x.join(first, "skel").withColumn("flags", F.when(F.col("id") == F.col("keep"), F.col("flags")).otherwise(F.sort_array(F.array_append("flags", F.lit("duplicate")))))
    return x.select("id", "sentence", "tashkeel_sentence", "rate", "flags", "skel", (~excluded("flags")).alias("eligible"))


def flag_counts(pool: DataFrame, flags: str = "flags", names: tuple[str, ...] = ALL_FLAGS) -> DataFrame:
    """How many rows carry each flag, zero included; a row may carry several."""
    known = pool.sparkSession.createDataFrame([(n,) for n in names], "flag string")
    n = pool.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("rows"))
    return known.join(n, "flag", "left").select("flag", F.coalesce("rows", F.lit(0)).alias("rows"))


def duplicate_groups(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with the first id and the count (no list of a hot group is built)."""
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.min("id").alias("first_id")).where("rows > 1")


def skeleton_overlap(rows: DataFrame, against: DataFrame, text: str = "sentence", other: str = "sentence") -> DataFrame:
    """Rows whose skeleton occurs in the other table: id, skel."""
    keys = against.select(X.skeleton(other).alias("skel")).where("skel != ''").distinct()
    return rows.select("id", X.skeleton(text).alias("skel")).join(keys, "skel", "left_semi").select("id", "skel")


def contamination(sets: DataFrame, train: DataFrame, tag: str = "eval_set") -> DataFrame:
    """sets(tag, sentence), train(id, sentence) -> per set: skeletons, hit skeletons, hit train rows, raw-string hits."""
    s = sets.select(tag, "sentence", X.skeleton("sentence").alias("skel")).where("skel != ''")
    t = train.select("id", "sentence", X.skeleton("sentence").alias("skel")).where("skel != ''")
    per = t.groupBy("skel").agg(F.count("*").alias("train_rows"))
    raw = t.select("sentence").distinct().withColumn("raw_hit", F.lit(True))
    x = s.select(tag, "skel").distinct().join(per, "skel", "left").groupBy(tag).agg(F.count("*").alias("skeletons"), F.count("train_rows").alias("hit_skeletons"), F.coalesce(F.sum("train_rows"), F.lit(0)).alias("hit_train_rows"))
    y = s.select(tag, "sentence").distinct().join(raw, "sentence").groupBy(tag).agg(F.count("*").alias("raw_hits"))
    return x.join(y, tag, "left").select(tag, "skeletons", "hit_skeletons", "hit_train_rows", F.coalesce("raw_hits", F.lit(0)).alias("raw_hits"))


def union_of(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).union(b.select(column)).where(F.col(column).isNotNull()).distinct()


def holdout_keys(holdout: DataFrame, id_columns: list[str], refs: str = "holdout_phoneme_refs") -> tuple[DataFrame, DataFrame]:
    """(ids, phoneme keys), distinct; entries are read bare, padded or as clip paths."""
    ids = None
    for c in id_columns:
        e = holdout.select(F.explode(c).alias("x")).select(F.coalesce(X.utterance_id(X.squeeze("x")), X.squeeze("x")).alias("hold_id"))
        ids = e if ids is None else ids.union(e)
    keys = holdout.select(F.explode(refs).alias("x")).select(X.squeeze("x").alias("hold_ref"))
    return ids.where("hold_id is not null").distinct(), keys.where("hold_ref is not null").distinct()


def holdout_filter(rows: DataFrame, ids: DataFrame, refs: DataFrame, id_: str = "id", sentence: str = "phoneme_ref") -> DataFrame:
    """Adds verdict: 'id' before 'phoneme' before 'keep'; a row that matches both counts once, as id."""
    a = ids.select(F.col("hold_id").alias(id_), F.lit(True).alias("_by_id"))
    x = rows.withColumn("_ref", X.squeeze(sentence)).join(a, id_, "left")
    x = x.join(refs.select(F.col("hold_ref").alias("_ref"), F.lit(True).alias("_by_ref")), "_ref", "left")
    return x.withColumn("verdict", F.when(F.col("_by_id"), "id").when(F.col("_by_ref"), "phoneme").otherwise("keep")).drop("_ref", "_by_id", "_by_ref")


def held_fractions(filtered: DataFrame, by: str) -> DataFrame:
    """holdout_filter's rows -> by, rows, by_id, by_phoneme, held_share."""
    g = filtered.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(F.col("verdict") == "id").alias("by_id"), F.count_if(F.col("verdict") == "phoneme").alias("by_phoneme"))
    return g.withColumn("held_share", (F.col("by_id") + F.col("by_phoneme")) / F.col("rows"))


def fair_rows(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose text the references have phonemes for; null texts are left out."""
    return rows.withColumn("_flags", X.clean(text)["flags"]).where(X.fair("_flags")).drop("_flags")


def join_on_prompt(clips: DataFrame, canonicals: DataFrame, id_: str = "id", prompt: str = "prompt") -> DataFrame:
    """Clips with the canonical of their prompt, which is read from the clip's id; others are dropped."""
    return clips.withColumn(prompt, X.prompt_index(id_)).join(canonicals, prompt)


def scorable(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds skipped: the first of the columns whose text is null or blank; null where the row can be scored."""
    blank = [F.when(F.coalesce(X.squeeze(c), F.lit("")) == "", F.lit(c)) for c in columns]
    return rows.withColumn("skipped", F.coalesce(*blank))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Guard: an error, before anything is written, if there is no row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def canonical_policy(rows: DataFrame, files: DataFrame, path: str = "path", sentence: str = "sentence", canonical: str | None = None) -> DataFrame:
    """Adds canonical and provenance, first rule that fits: blank sentence, given column, numeric id, file, missing.

    files(path, content): canonical texts by path. Rows with empty_transcript or
    missing_canonical are for rejection; no canonical is ever empty.
    """
    text = X.squeeze(F.coalesce(F.col(sentence), F.lit("")))
    given = X.squeeze(F.coalesce(F.col(canonical), F.lit(""))) if canonical else F.lit("")
    place = F.when(X.utterance_id(path).isNotNull(), X.canonical_path(path))
    x = rows.withColumn("_file", place).join(files.select(F.col("path").alias("_file"), X.squeeze("content").alias("_content")), "_file", "left")
    kind = F.when(text == "", "empty_transcript").when(given != "", "passed_through").when(X.is_numeric_id(path), "from_sentence").when(F.col("_content") != "", "from_file").otherwise("missing_canonical")
    x = x.withColumn("provenance", kind)
    value = F.when(F.col("provenance") == "passed_through", given).when(F.col("provenance") == "from_sentence", text).when(F.col("provenance") == "from_file", F.col("_content"))
    return x.withColumn("canonical", value).drop("_file", "_content")


def key_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """shared, only_left, only_right, as counts of different keys."""
    x = a.select(key).distinct().withColumn("_l", F.lit(1)).join(b.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    return x.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("shared"), F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))


def clean_keys(all_: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Keys of all_ that are not bad; an error if a bad key is unknown."""
    stray = bad.select(key).distinct().join(all_.select(key).distinct(), key, "left_anti")
    if not stray.isEmpty():
        raise ValueError(f"contaminated {key} values that the whole set does not hold")
    return all_.select(key).distinct().join(bad.select(key).distinct(), key, "left_anti")


#: Words of a piece by which phrases are met in the corpus.
PIECE_WORDS = 8


def _offsets() -> Column:
    """Where the pieces of the words _q begin: they cover them whole."""
    return F.when(F.size("_q") <= PIECE_WORDS, F.array(F.lit(0))).otherwise(F.expr(f"array_distinct(concat(sequence(0, greatest(size(_q) - {PIECE_WORDS}, 0), {PIECE_WORDS}), array(size(_q) - {PIECE_WORDS})))"))


def _chapters(corpus: DataFrame, part: list[str], order: list[str], text: str) -> DataFrame:
    """part..., _w: the words of each part in order."""
    lines = corpus.where(F.col(text).isNotNull()).select(*part, F.struct(*order).alias("_o"), X.words(X.skeleton(text)).alias("_w")).distinct()
    return lines.groupBy(*part).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_w"))), lambda r: r["_w"])).alias("_w"))


def span_matches(corpus: DataFrame, queries: DataFrame, part: list[str], order: list[str], text: str, query_id: str, query: str) -> DataFrame:
    """Places where the query's n skeleton words follow one another in a part of the corpus.

    part names a bounded unit such as a chapter of an edition: its words are put in
    one row, and a span does not cross its end. Phrases of any length are cut into
    pieces of at most PIECE_WORDS words that cover them whole; pieces are joined to
    the corpus by equality, and a phrase lies where all its pieces do. Result:
    query_id, part..., position (0-based word of the part), n_words.
    """
    q = queries.select(query_id, X.words(X.skeleton(query)).alias("_q")).where("size(_q) > 0").select(query_id, F.sha2(F.array_join("_q", " "), 256).alias("_k"), "_q").distinct()
    phrases = q.select("_k", "_q", F.size("_q").alias("n_words"), _offsets().alias("_at")).dropDuplicates(["_k"])
    pieces = phrases.select("_k", "_q", "n_words", F.size("_at").alias("_pieces"), F.explode("_at").alias("_off")).select("_k", "n_words", "_pieces", "_off", F.least("n_words", F.lit(PIECE_WORDS)).alias("_n"), F.expr(f"array_join(slice(_q, _off + 1, {PIECE_WORDS}), ' ')").alias("gram"))
    lengths = sorted(r[0] for r in pieces.select("_n").distinct().collect())  # at most PIECE_WORDS
    whole = _chapters(corpus, part, order, text)
    grams = whole.select(*part, "_w", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("_n")).where("size(_w) >= _n")
    grams = grams.select(*part, "_n", F.posexplode(F.expr("transform(sequence(0, size(_w) - _n), i -> array_join(slice(_w, i + 1, _n), ' '))")).alias("_p", "gram"))
    met = grams.join(pieces, ["_n", "gram"]).select("_k", *part, (F.col("_p") - F.col("_off")).alias("position"), "n_words", "_pieces")
    several = met.where("_pieces > 1").groupBy("_k", *part, "position", "n_words", "_pieces").agg(F.count("*").alias("_met")).where("_met = _pieces")
    found = met.where("_pieces = 1").drop("_pieces").unionByName(several.drop("_pieces", "_met"))
    return found.join(q.select(query_id, "_k"), "_k").select(query_id, *part, "position", "n_words")


def span_counts(corpus: DataFrame, queries: DataFrame, part: list[str], order: list[str], text: str, query_id: str, query: str) -> DataFrame:
    """query_id, candidates: how many rows span_matches has for each query; queries without any are left out.

    Places are counted by phrase before the queries join: of short phrases by the
    corpus' own run counts, of longer ones by the places where their pieces meet. No
    row is made of a query and a place. Runs and phrases are joined by digests, and
    both sides are sorted: neither is sent to the driver, whatever its size.
    """
    key = ["_k1", "_k2"]
    q = queries.select(query_id, X.words(X.skeleton(query)).alias("_q")).where("size(_q) > 0").select(query_id, "_q", *X.digest(F.array_join("_q", " "), "_k"))
    phrases = q.select(*key, "_q", F.size("_q").alias("_n")).dropDuplicates(key)
    short, long = phrases.where(f"_n <= {PIECE_WORDS}"), phrases.where(f"_n > {PIECE_WORDS}")
    lengths = sorted(r[0] for r in short.select("_n").distinct().collect())  # at most PIECE_WORDS
    whole = _chapters(corpus, part, order, text)
    runs = lambda t: t.where("size(_w) >= _n").select(*part, F.posexplode(F.expr("transform(sequence(0, size(_w) - _n), i -> array_join(slice(_w, i + 1, _n), ' '))")).alias("_p", "_g"))
    grams = runs(whole.select(*part, "_w", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("_n")))
    counts = grams.select(*X.digest("_g", "_k")).groupBy(*key).agg(F.count("*").alias("_places"))
    counts = counts.join(short.select(*key).hint("merge"), key)
    pieces = long.select(*key, F.size(_offsets()).alias("_pieces"), "_q", F.explode(_offsets()).alias("_off")).select(*key, "_pieces", "_off", *X.digest(F.expr(f"array_join(slice(_q, _off + 1, {PIECE_WORDS}), ' ')"), "_g"))
    eights = runs(whole.withColumn("_n", F.lit(PIECE_WORDS))).select(*part, "_p", *X.digest("_g", "_g"))
    met = eights.join(pieces.hint("merge"), ["_g1", "_g2"]).groupBy(*key, *part, (F.col("_p") - F.col("_off")).alias("position"), "_pieces").agg(F.count("*").alias("_met"))
    counts = counts.unionByName(met.where("_met = _pieces").groupBy(*key).agg(F.count("*").alias("_places")))
    ids = q.select(query_id, *key).distinct()
    return ids.join(counts.hint("merge"), key).groupBy(query_id).agg(F.sum("_places").alias("candidates"))


def recovery_choice(matches: DataFrame, query_id: str, part: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """The primary place of each query: the first in order, unless overridden; with the number of candidates.

    overrides(query_id, chosen) wins where it is given.
    """
    place = F.struct(*part, "position")
    x = matches.groupBy(query_id).agg(F.count("*").alias("candidates"), F.to_json(F.min(place)).alias("primary"))
    if overrides is None:
        return x
    return x.join(overrides, query_id, "left").select(query_id, "candidates", F.coalesce("chosen", "primary").alias("primary"))
