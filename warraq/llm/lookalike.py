"""One consistent form for texts that look the same (DuckDB inside Arrow partitions).

Each Arrow batch is handed to an embedded DuckDB, which maps compatibility forms,
invisible characters and look-alike letters with translate, composes with
nfc_normalize, sorts the marks of one letter and collapses blanks. Null stays
null; an empty text, or one of blanks and invisible characters only, becomes the
empty string. Texts of any length are processed whole.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship_package
from . import letters, members


# The Persian yeh has no dots at a word's end, where it looks like
# the dotless Arabic one, and two dots elsewhere.
YEH, DOTLESS_YEH, DOTTED_YEH = "\u06cc", "\u0649", "\u064a"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars) -> str:
    """A regular-expression class of the characters, as ranges of code points."""
    cps, parts, i = sorted(map(ord, chars)), [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        parts.append(f"\\x{{{cps[i]:x}}}" + (f"-\\x{{{cps[j]:x}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(parts) + "]"


def _doubled(t: dict) -> list[str]:
    """Composed letters that hold two marks of one class themselves."""
    cls = {m: k for k, ms in t["marks"].items() for m in ms}
    return [a for a, v in t["composed"].items() if len({cls.get(m) for m in v[1:]}) < len(v) - 1]


def _unsettled(t: dict) -> str:
    """A pattern for clusters whose marks composition leaves in the order given: two of one combining class, or any of class 0."""
    parts = []
    for cls, marks in sorted(t["marks"].items()):
        own = _class(marks)
        if cls == 0:
            parts += [f"{own}\\p{{M}}", f"\\p{{M}}{own}"]
            continue
        if len(marks) > 1:
            parts.append(f"{own}{{2}}")
        holders = [a for a, v in t["composed"].items() if any(m in marks for m in v[1:])]
        if holders:
            parts.append(f"{_class(holders)}\\p{{M}}*{own}")
    return "|".join([*parts, _class(_doubled(t))])


def _taken_apart(composed: dict[str, str]) -> str:
    """SQL: a cluster g whose letter carries marks, as its bare letter with all of its marks sorted."""
    first = "g[1]"
    part = lambda i: f"translate({first}, {_sql_text(''.join(composed))}, {_sql_text(''.join(v[i] for v in composed.values()))})"
    deep = {a: v for a, v in composed.items() if len(v) > 2}
    marks = f"{part(1)} || regexp_replace(g, '(?s)^.', '')"
    for i in range(2, max(map(len, composed.values()))):
        own = {a: v for a, v in deep.items() if len(v) > i}
        marks += f" || CASE WHEN regexp_matches({first}, {_sql_text(_class(own))}) THEN translate({first}, {_sql_text(''.join(own))}, {_sql_text(''.join(v[i] for v in own.values()))}) ELSE '' END"
    return f"{part(0)} || array_to_string(list_sort(regexp_extract_all({marks}, '\\p{{M}}')), '')"


def canonical_sql(source: str = "batch") -> str:
    """The embedded SQL: rid, text -> rid, canon. The table `ligature`(ch, letters) must exist."""
    t = letters.tables()
    blanks = [c for c in t["blanks"] if c != " "]
    one_to_one = {**t["shapes"], **{c: " " for c in blanks}}
    look = {a: b for a, b in t["look_alike"].items() if a != YEH}  # its look depends on its place: see below
    one_to_one |= look
    for a, b in t["shapes"].items():  # a shape of a look-alike goes straight to its base letter
        one_to_one[a] = look.get(b, b)
    froms = "".join(one_to_one) + "".join(t["invisible"])
    tos = "".join(one_to_one.values())
    odd = _class(list(one_to_one) + t["invisible"])
    lig = _class(t["ligatures"])
    arabic = {a: b for a, b in t["composed"].items() if "\u0600" <= a <= "\u06ff"}
    other = {a: b for a, b in t["composed"].items() if a not in arabic}
    other_pre, unsettled = _class(other), _unsettled(t)
    in_order = "g[1] || array_to_string(list_sort(regexp_extract_all(g, '\\p{M}')), '')"
    return f"""
WITH a AS (
  SELECT rid, CASE WHEN regexp_matches(text, {_sql_text(odd)}) THEN translate(text, {_sql_text(froms)}, {_sql_text(tos)}) ELSE text END AS s FROM {source}
), split AS (
  SELECT rid, unnest(l) AS ch, generate_subscripts(l, 1) AS i
  FROM (SELECT rid, regexp_extract_all(s, '(?s).') AS l FROM a WHERE regexp_matches(s, {_sql_text(lig)}))
), joined AS (
  SELECT rid, string_agg(coalesce(m.letters, split.ch), '' ORDER BY i) AS s FROM split LEFT JOIN ligature m ON m.ch = split.ch GROUP BY rid
), b AS (
  SELECT a.rid, nfc_normalize(replace(regexp_replace(coalesce(joined.s, a.s), '{YEH}(\\p{{M}}*)($|[^\\p{{L}}\\p{{M}}])', '{DOTLESS_YEH}\\1\\2', 'g'), '{YEH}', '{DOTTED_YEH}')) AS s
  FROM a LEFT JOIN joined USING (rid)
), c AS (
  SELECT rid, CASE WHEN regexp_matches(s, {_sql_text(unsettled)}) THEN
    nfc_normalize(array_to_string(list_transform(regexp_extract_all(' ' || s, '(?s)\\P{{M}}\\p{{M}}*'), lambda g: CASE
      WHEN length(g) < 2 AND NOT regexp_matches(g, {_sql_text(_class(_doubled(t)))}) THEN g
      WHEN g >= '{chr(0x600)}' AND g < '{chr(0x700)}' THEN CASE WHEN g[1] IN ({', '.join(map(_sql_text, arabic))}) THEN {_taken_apart(arabic)} WHEN length(g) = 2 THEN g ELSE {in_order} END
      WHEN regexp_matches(g, '^{other_pre}') THEN {_taken_apart(other)}
      WHEN length(g) = 2 THEN g ELSE {in_order} END), ''))
    ELSE s END AS s FROM b
)
SELECT rid, trim(regexp_replace(s, ' +', ' ', 'g'), ' ') AS canon FROM c ORDER BY rid"""


class Canonicaliser:
    """A DuckDB connection with the prepared tables; one per Python worker task."""

    def __init__(self):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        lig = letters.tables()["ligatures"]
        look = letters.tables()["look_alike"]
        out = ["".join(look.get(c, c) for c in v) for v in lig.values()]
        self.con.register("lig_arrow", pa.table({"ch": list(lig), "letters": out}))
        self.con.execute("CREATE TABLE ligature AS SELECT * FROM lig_arrow")
        self.sql = canonical_sql()

    def __call__(self, texts: pa.Array) -> pa.Array:
        self.con.register("batch", pa.table({"rid": pa.array(range(len(texts)), pa.int64()), "text": texts}))
        got = self.con.sql(self.sql).to_arrow_table().column("canon")
        self.con.unregister("batch")
        return pa.chunked_array(got.chunks, type=got.type).combine_chunks().cast(pa.string())


#: Bytes of text that DuckDB is given at a time (one longer text goes alone).
SLICE_BYTES = 8 << 20


def by_size(batch: pa.RecordBatch, text: str):
    """A batch as tables of at most SLICE_BYTES of text each."""
    t = pa.Table.from_batches([batch])
    sizes = pc.fill_null(pc.binary_length(t.column(text)), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if total + n > SLICE_BYTES and i > lo:
            yield t.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield t.slice(lo)


def with_canonical(df: DataFrame, text: str, out: str = "canon") -> DataFrame:
    """Adds the consistent form of column `text`; a column of the name `out` is replaced."""
    ship_package(df.sparkSession)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        make = Canonicaliser()
        for b in batches:
            for t in by_size(b, text):
                col = t.column(text).combine_chunks().cast(pa.string())
                yield from t.append_column(out, make(col)).to_batches()

    return df.mapInArrow(run, schema)


def look_alike_classes(texts: DataFrame) -> DataFrame:
    """texts(field_name, rec_key, text) -> field_name, rec_key, text, canon, differs, n_rows.

    One row for each different (field, key, text); canon is the class, n_rows its
    rows, differs whether it holds two different strings. Null texts or keys belong to no class.
    """
    rows = texts.select("field_name", "rec_key", "text").where("text is not null and rec_key is not null").distinct()
    done = cut(with_canonical(rows, "text"))
    sizes = done.groupBy("field_name", "canon").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.count(F.lit(1)).alias("n_rows"))
    return done.join(sizes, ["field_name", "canon"]).select("field_name", "rec_key", "text", "canon", (F.col("lo") != F.col("hi")).alias("differs"), "n_rows")


def look_alike_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (field_name, key_a < key_b) of records whose texts differ as strings but look the same.

    The different texts of a class are paired first; only then does each pair of
    texts get the records of its two sides. Exact copies are never paired with one
    another, so no row is made that is not a result.
    """
    made = with_canonical(texts.select("field_name", "rec_key", "text").where("text is not null and rec_key is not null"), "text")
    rows = cut(made.select("field_name", "rec_key", *members.digest("canon", "l"), *members.digest("text", "t")).distinct())
    kinds = rows.groupBy("field_name", "l1", "l2", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: kinds.select("field_name", "l1", "l2", F.col("t1").alias(f"{x}1"), F.col("t2").alias(f"{x}2"), F.col("n").alias(f"n_{x}"))
    pairs = side("a").join(side("b"), ["field_name", "l1", "l2"]).where("(a1, a2) < (b1, b2)").drop("l1", "l2")
    of = lambda x, name: rows.select("field_name", F.col("t1").alias(f"{x}1"), F.col("t2").alias(f"{x}2"), F.col("rec_key").alias(name))
    found = members.expand(pairs, of("a", "one"), ["field_name", "a1", "a2"], "n_a", "one")
    found = members.expand(found, of("b", "two"), ["field_name", "b1", "b2"], "n_b", "two")
    return found.where("one != two").select("field_name", F.least("one", "two").alias("key_a"), F.greatest("one", "two").alias("key_b")).distinct()


def field_texts(candidates: DataFrame, verses: DataFrame) -> DataFrame:
    """The texts of problem 3 in one long table."""
    c = candidates.select(F.explode(F.array(F.struct(F.lit("sentence").alias("field_name"), F.col("id").alias("rec_key"), F.col("sentence").alias("text")), F.struct(F.lit("tashkeel_sentence").alias("field_name"), F.col("id").alias("rec_key"), F.col("tashkeel_sentence").alias("text")))).alias("x")).select("x.*")
    v = verses.select(F.lit("verse_text").alias("field_name"), F.col("verse_id").cast("string").alias("rec_key"), "text")
    return c.unionByName(v)
