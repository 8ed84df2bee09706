"""DuckDB SQL for the training-data queries that SQL can express, by plain joins over whole tables."""

from __future__ import annotations

from ..functions.phonemes import INVENTORY as SYMBOLS
from . import letters
from .overlap import WHITE

_TRIMMED = "lower(regexp_replace({}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'))"
INVENTORY = " ".join(SYMBOLS)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _seq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WHITE}', ' ', 'g'), ' ')"


def _coded(x: str) -> str:
    """A sequence as one single-byte character a symbol (for symbols of the inventory)."""
    return f"array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda t: t <> ''), lambda t: chr((33 + list_position(string_split('{INVENTORY}', ' '), t))::INT)), '')"


def _folded(x: str) -> str:
    """Words of an Arabic text as a list: letters only, forms and look-alikes folded, marks and stretching dropped."""
    t = letters.tables()
    one = {**t["look_alike"], **{a: t["look_alike"].get(b, b) for a, b in t["shapes"].items()}}
    s = f"translate({x}, {_quoted(''.join(one) + ''.join(t['invisible']) + letters.TATWEEL)}, {_quoted(''.join(one.values()))})"
    for a, b in t["ligatures"].items():
        if 0xFEF5 <= ord(a) <= 0xFEFC:
            s = f"replace({s}, {_quoted(a)}, {_quoted(b)})"
    s = f"regexp_replace(lower(nfc_normalize({s})), '\\p{{M}}', '', 'g')"
    return f"regexp_extract_all({s}, '[\\p{{L}}\\p{{N}}]+')"


_REFS = f"""
SELECT block || ':r:' || p AS k, block AS b, {_seq('x')} AS s FROM (SELECT block, unnest(holdout_phoneme_refs) AS x, unnest(range(len(holdout_phoneme_refs))) AS p FROM holdout WHERE holdout_phoneme_refs IS NOT NULL) WHERE x IS NOT NULL"""
_NAMED = f"regexp_replace(regexp_replace(regexp_replace(x, '^{WHITE}|{WHITE}$', '', 'g'), '^(.*/)?audio_(.+)\\.wav$', '\\2'), '^$', '')"

P1_FOUND = f"""
WITH e AS (SELECT k, s FROM ({_REFS}) UNION SELECT id, {_seq('phoneme_ref')} FROM msa_pilot_sample WHERE phoneme_ref IS NOT NULL AND id IS NOT NULL),
t AS (SELECT id AS k, {_seq('phoneme_ref')} AS s FROM train_rows WHERE split = 'train' AND id IS NOT NULL UNION SELECT 'iqra_tts_' || row_no, {_seq('x')} FROM (SELECT row_no, unnest([phoneme_ref, phoneme_mis]) AS x FROM tts_rows) WHERE row_no IS NOT NULL),
ec AS (SELECT s, {_coded('s')} AS c, length({_coded('s')}) AS n FROM (SELECT DISTINCT s FROM e)), tc AS (SELECT s, {_coded('s')} AS c, length({_coded('s')}) AS n FROM (SELECT DISTINCT s FROM t WHERE s IS NOT NULL)),
near AS (SELECT ec.s AS es, tc.s AS ts FROM ec JOIN tc ON 10 * abs(ec.n - tc.n) <= greatest(ec.n, tc.n) AND 10 * levenshtein(ec.c, tc.c) <= greatest(ec.n, tc.n)),
i AS (SELECT block || ':t:' || p AS k, x FROM (SELECT block, unnest(holdout_train_ids) AS x, unnest(range(len(holdout_train_ids))) AS p FROM holdout WHERE holdout_train_ids IS NOT NULL) UNION ALL
  SELECT block || ':d:' || p, x FROM (SELECT block, unnest(holdout_dev_ids) AS x, unnest(range(len(holdout_dev_ids))) AS p FROM holdout WHERE holdout_dev_ids IS NOT NULL))
SELECT e.k AS eval_key, t.k AS train_key FROM e JOIN near ON near.es = e.s JOIN t ON t.s = near.ts
UNION SELECT i.k, t.k FROM i JOIN t ON t.k = {_NAMED}"""

P1_REPORT = f"""
WITH p AS ({P1_FOUND}), s AS (SELECT id AS k, min(source) AS source FROM train_rows WHERE split = 'train' AND id IS NOT NULL GROUP BY id UNION ALL SELECT DISTINCT 'iqra_tts_' || row_no, 'iqra_tts' FROM tts_rows WHERE row_no IS NOT NULL),
h AS (SELECT k, min(eval_set) AS eval_set FROM (SELECT block || ':' || tag || ':' || unnest(range(n)) AS k, eval_set FROM (SELECT block, eval_set, 't' AS tag, len(holdout_train_ids) AS n FROM holdout UNION ALL SELECT block, eval_set, 'd', len(holdout_dev_ids) FROM holdout UNION ALL SELECT block, eval_set, 'r', len(holdout_phoneme_refs) FROM holdout) WHERE n > 0) GROUP BY k)
SELECT coalesce(h.eval_set, 'pilot') AS eval_set, s.source, count(DISTINCT p.eval_key) AS eval_records, count(DISTINCT p.train_key) AS train_records, count(*) AS pairs FROM p JOIN s ON s.k = p.train_key LEFT JOIN h ON h.k = p.eval_key GROUP BY 1, 2"""

P1_CLASSES = f"""
WITH e AS (SELECT k, s FROM ({_REFS}) UNION SELECT id, {_seq('phoneme_ref')} FROM msa_pilot_sample WHERE phoneme_ref IS NOT NULL AND id IS NOT NULL),
t AS (SELECT id AS k, {_seq('phoneme_ref')} AS s FROM train_rows WHERE split = 'train' AND id IS NOT NULL AND phoneme_ref IS NOT NULL UNION SELECT 'iqra_tts_' || row_no, {_seq('x')} FROM (SELECT row_no, unnest([phoneme_ref, phoneme_mis]) AS x FROM tts_rows) WHERE row_no IS NOT NULL AND x IS NOT NULL),
ec AS (SELECT s, {_coded('s')} AS c, length({_coded('s')}) AS n, count(DISTINCT k) AS eval_records FROM e GROUP BY s), tc AS (SELECT s, {_coded('s')} AS c, length({_coded('s')}) AS n, count(DISTINCT k) AS train_records FROM t GROUP BY s)
SELECT sha256(ec.s) AS ref, sha256(tc.s) AS text, levenshtein(ec.c, tc.c) AS distance, eval_records, train_records FROM ec JOIN tc ON 10 * abs(ec.n - tc.n) <= greatest(ec.n, tc.n) AND 10 * levenshtein(ec.c, tc.c) <= greatest(ec.n, tc.n)"""

P2_FOUND = f"""
WITH RECURSIVE r AS (SELECT k, NULL::VARCHAR AS c, NULL::VARCHAR AS w, s FROM ({_REFS}) UNION SELECT id, CASE WHEN regexp_replace(client_id, '[\\s\\x{{a0}}]', '', 'g') <> '' THEN client_id END, nullif(array_to_string({_folded('sentence')}, ' '), ''), {_seq('phoneme_ref')} FROM msa_pilot_sample WHERE id IS NOT NULL),
a AS (SELECT k, 'c' || c AS v FROM r WHERE c IS NOT NULL UNION SELECT k, 'w' || w FROM r WHERE w IS NOT NULL UNION SELECT k, 's' || s FROM r WHERE s IS NOT NULL),
e AS MATERIALIZED (SELECT DISTINCT x.k AS p, y.k AS q FROM a x JOIN a y USING (v)),
z AS (SELECT p, q FROM e UNION SELECT z.p, e.q FROM z JOIN e ON e.p = z.q)
SELECT p AS rec_key, min(q) AS group_key FROM z GROUP BY p HAVING count(DISTINCT q) > 1"""

P4_FOUND = f"""
WITH rows AS (SELECT DISTINCT id, {_TRIMMED.format("stratum")} AS s, disagreement AS x FROM msa_pilot_sample WHERE id IS NOT NULL AND disagreement IS NOT NULL AND NOT isnan(disagreement)),
n AS (SELECT t.category, count(DISTINCT rows.id) AS supply FROM sample_targets t LEFT JOIN rows ON rows.s = t.stratum AND rows.x >= t.band_low AND rows.x < t.band_high GROUP BY t.category)
SELECT t.category FROM sample_targets t JOIN n USING (category) WHERE n.supply < greatest(t.target_share * t.sample_rows, t.min_rows)"""

P5_FOUND = f"""
WITH items AS (SELECT batch_id, tool, unnest(texts) AS text, unnest(range(len(texts))) AS p FROM chunked_batches WHERE texts IS NOT NULL)
SELECT DISTINCT l.tool, items.batch_id || ':' || p AS item_key FROM items JOIN tool_limits l ON l.tool = {_TRIMMED.format("items.tool")} WHERE length(text) > l.max_input_chars
UNION
SELECT DISTINCT l.tool, 'v' || verse_id FROM verses JOIN tool_limits l ON length(text) > l.max_input_chars"""

P6_FOUND = f"""
WITH b AS (SELECT item_id, {_folded('text')} AS w FROM benchmark_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_folded('text')} AS w FROM documents WHERE text IS NOT NULL),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 10], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - 9)) AS i FROM b WHERE len(w) > 9)),
dg AS (SELECT doc_id, array_to_string(w[i + 1 : i + 10], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 9)) AS i FROM d WHERE len(w) > 9))
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)"""


_CLOSE = "length(a) >= 4 AND length(b) >= 4 AND a <> b AND a[1] = b[1] AND abs(length(a) - length(b)) <= 1 AND len(list_filter(range(length(a) + 1), lambda i: a[:i] = b[:i] AND (a[i + 2:] = b[i + 2:] OR a[i + 1:] = b[i + 2:] OR a[i + 2:] = b[i + 1:]))) > 0"
#: Smith-Waterman cell by cell over whole documents, for all pairs that share five words in a row.
P6_SCORES = f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT DISTINCT item_id, {_folded('text')} AS w FROM benchmark_items WHERE text IS NOT NULL), d AS MATERIALIZED (SELECT doc_id, {_folded('text')} AS w FROM documents WHERE text IS NOT NULL),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - 4)) AS i FROM b WHERE len(w) > 4)),
dg AS (SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) > 4)),
p AS MATERIALIZED (SELECT row_number() OVER () AS pid, doc_id, item_id, b.w AS x, d.w AS y FROM (SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)) JOIN b USING (item_id) JOIN d USING (doc_id)),
u AS (SELECT DISTINCT a.w AS a, c.w AS b FROM (SELECT pid, unnest(x) AS w FROM p) a JOIN (SELECT DISTINCT pid, unnest(y) AS w FROM p) c ON a.pid = c.pid AND a.w[1] = c.w[1]),
n AS MATERIALIZED (SELECT a, b FROM u WHERE {_CLOSE}),
cells AS (
  SELECT pid, 0 AS i, j, 0 AS v, 0 AS r FROM (SELECT pid, unnest(range(len(y) + 1)) AS j FROM p)
  UNION ALL
  SELECT pid, i, j, max(s + j) OVER (PARTITION BY pid ORDER BY j ROWS UNBOUNDED PRECEDING) - j, r
  FROM (SELECT c.pid, c.i + 1 AS i, c.j, coalesce(greatest(0, c.v - 1, lag(c.v) OVER w + CASE WHEN p.x[c.i + 1] = p.y[c.j] THEN 2 WHEN n.a IS NOT NULL THEN 1 ELSE -1 END), 0) AS s, CASE WHEN p.x[c.i + 1] = p.y[c.j] THEN lag(c.r) OVER w + 1 ELSE 0 END AS r
    FROM cells c JOIN p USING (pid) LEFT JOIN n ON n.a = p.x[c.i + 1] AND n.b = p.y[c.j] WHERE c.i < len(p.x) WINDOW w AS (PARTITION BY c.pid ORDER BY c.j))
)
SELECT doc_id, item_id, max(v)::BIGINT AS score, max(r)::BIGINT AS run_words FROM cells JOIN p USING (pid) GROUP BY doc_id, item_id HAVING max(v) >= 12 OR max(r) >= 10"""

P5_ROUND_TRIP = f"""
WITH items AS (SELECT batch_id, tool, unnest(texts) AS text, unnest(range(len(texts))) AS p FROM chunked_batches WHERE texts IS NOT NULL)
SELECT DISTINCT l.tool, items.batch_id || ':' || p AS item_key, md5(text) AS digest, true AS within FROM items LEFT JOIN tool_limits l ON l.tool = {_TRIMMED.format("items.tool")} WHERE text IS NOT NULL AND batch_id IS NOT NULL
UNION
SELECT DISTINCT l.tool, 'v' || verse_id, md5(text), true FROM verses JOIN tool_limits l ON l.max_input_chars IS NOT NULL WHERE text IS NOT NULL AND verse_id IS NOT NULL"""


def _apart() -> str:
    """VALUES of characters and what they are compared as: fully taken apart, folded to one shape and alphabet, invisible ones empty."""
    import unicodedata

    t, rows = letters.tables(), {}
    fold = lambda c: t["look_alike"].get(c, c)
    for ch in letters.searched():
        if ch == "\u06cc":
            continue  # its look depends on its place
        to = " " if ch in BLANKS else "" if letters.is_invisible(ch) and not letters.is_blank(ch) else t["shapes"].get(ch) or t["ligatures"].get(ch) or ch
        to = unicodedata.normalize("NFD", "".join(map(fold, to)))
        if to != ch:
            rows[ord(ch)] = to
    return "VALUES " + ", ".join(f"({cp}, {_quoted(to)})" for cp, to in rows.items())


BLANKS = frozenset(letters.tables()["blanks"])


def p3_found() -> str:
    """Texts letter by letter: characters replaced from one table, marks of a letter sorted, blanks counted once."""
    return f"""
WITH m(cp, f) AS ({_apart()}), x AS (SELECT row_number() OVER () AS rid, * FROM (
  SELECT DISTINCT 'sentence' AS field_name, id AS k, sentence AS t FROM candidates WHERE id IS NOT NULL AND sentence IS NOT NULL UNION SELECT 'tashkeel_sentence', id, tashkeel_sentence FROM candidates WHERE id IS NOT NULL AND tashkeel_sentence IS NOT NULL
  UNION SELECT 'verse_text', verse_id::VARCHAR, text FROM verses WHERE verse_id IS NOT NULL AND text IS NOT NULL)),
c AS (SELECT rid, unnest(l) AS ch, generate_subscripts(l, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '(?s).') AS l FROM x)),
a AS (SELECT rid, string_agg(coalesce(m.f, ch), '' ORDER BY i) AS s FROM c LEFT JOIN m ON m.cp = unicode(ch) GROUP BY rid),
b AS (SELECT rid, replace(regexp_replace(s, '\u06cc(\\p{{M}}*)($|[^\\p{{L}}\\p{{M}}])', '\u0649\\1\\2', 'g'), '\u06cc', '\u064a') AS s FROM a),
g AS (SELECT rid, list_transform(regexp_extract_all(' ' || s, '(?s)\\P{{M}}\\p{{M}}*'), lambda u: u[1] || array_to_string(list_sort(regexp_extract_all(u, '\\p{{M}}')), '')) AS l FROM b),
f AS (SELECT field_name, k, t, trim(regexp_replace(array_to_string(l, ''), ' +', ' ', 'g'), ' ') AS look FROM x LEFT JOIN g USING (rid)),
d AS (SELECT field_name, k, t, coalesce(look, '') AS look FROM f)
SELECT DISTINCT p.field_name, least(p.k, q.k) AS key_a, greatest(p.k, q.k) AS key_b FROM d p JOIN d q ON p.field_name = q.field_name AND p.look = q.look WHERE p.t <> q.t AND p.k <> q.k"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_report": P1_REPORT, "p1_classes": P1_CLASSES, "p3_found": p3_found(), "p5_round_trip": P5_ROUND_TRIP, "p6_scores": P6_SCORES, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p6_found": P6_FOUND}
