"""DuckDB SQL that gives the same rows as the queries it is named after."""

from __future__ import annotations

from ..functions.phonemes import INVENTORY
from . import alignment_sql as L

MARKS = r"[\x{064B}-\x{0655}\x{0670}\x{06D6}-\x{06ED}]"
LET = r"[\x{0621}-\x{063A}\x{0641}-\x{064A}\x{0671}\x{0675}]"
SCORED = r"[\x{064B}-\x{0652}\x{0670}]"
SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'), ' ')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '[\x{{064B}}-\x{{0655}}\x{{0670}}\x{{06D6}}-\x{{06ED}}\x{{0640}}]', '', 'g')"


def skeleton(x: str) -> str:
    return squeeze(rf"regexp_replace({strip(f'nfc_normalize({x})')}, '\p{{P}}', '', 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def arabic_tokens(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: regexp_matches(w, '{LET}'))"


def arabic_words(x: str) -> str:
    return f"list_filter({words(rf'''regexp_replace(nfc_normalize({x}), '\p{{P}}', ' ', 'g')''')}, lambda w: regexp_matches(w, '{LET}'))"


def count(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, '{p}'))"


def rate(x: str) -> str:
    return f"(CASE WHEN {count(x, LET)} > 0 THEN {count(x, LET + MARKS)} / {count(x, LET)}::DOUBLE END)"


NAMED = f"CASE WHEN regexp_matches({squeeze('x')}, 'audio_(.+)\\.wav$') THEN regexp_extract({squeeze('x')}, 'audio_(.+)\\.wav$', 1) ELSE {squeeze('x')} END"
DIGIT = r"[\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
POOL = rf"""
x AS (SELECT id, coalesce(sentence, '') AS s, coalesce(tashkeel_sentence, '') AS t FROM candidates),
f AS (SELECT id, s, {rate('s')} AS r, len({arabic_tokens('s')}) AS n, {squeeze('t')} = '' AS blank, len({arabic_tokens('t')}) AS m, {skeleton('s')} AS skel FROM x),
g AS (SELECT id, skel, list_filter([CASE WHEN r IS NULL THEN 'no_arabic' END, CASE WHEN blank THEN 'no_tashkeel' END, CASE WHEN r >= 0.5 THEN 'pre_vowelized' END, CASE WHEN r >= 0.05 AND r < 0.5 THEN 'partially_vowelized' END,
  CASE WHEN NOT blank AND n <> m THEN 'word_count_mismatch' END, CASE WHEN n < 3 THEN 'short' END, CASE WHEN regexp_matches(s, '\p{{Latin}}') THEN 'latin' END, CASE WHEN regexp_matches(s, '{DIGIT}') THEN 'digits' END], lambda v: v IS NOT NULL) AS flags FROM f),
h AS (SELECT *, list_has_any(flags, ['no_arabic', 'no_tashkeel', 'pre_vowelized', 'duplicate']) AS ex FROM g),
k AS (SELECT skel, min({{'e': ex, 'i': id}}) AS k FROM h GROUP BY skel),
pool AS (SELECT h.id, h.skel, list_sort(CASE WHEN h.id = k.k.i THEN flags ELSE list_append(flags, 'duplicate') END) AS flags FROM h JOIN k USING (skel))"""
FLAGS = "'digits'), ('duplicate'), ('latin'), ('no_arabic'), ('no_tashkeel'), ('partially_vowelized'), ('pre_vowelized'), ('short'), ('word_count_mismatch'"
VOC = f"string_split('{' '.join(INVENTORY)}', ' ')"


def hash_key(x: str, seed: int) -> str:
    return f"(((coalesce(try_cast(substr(regexp_replace({x}, '[^0-9]', '', 'g'), 1, 15) AS BIGINT), 0) % 1000003) + {seed}) * 48271) % 2147483647"


def order_stats(table: str, value: str, by: str) -> str:
    return f"""
WITH s AS (SELECT {by}, list_sort(list({value})) AS l FROM {table} WHERE {value} IS NOT NULL GROUP BY {by}), n AS (SELECT *, len(l) AS n FROM s)
SELECT {by}, n, l[1] AS least, l[n // 20 + 1] AS p05, l[n // 2 + 1] AS median, l[9 * n // 10 + 1] AS p90, l[n - (n + 19) // 20 + 1] AS p95, l[n] AS most FROM n"""


def codes(x: str) -> str:
    return f"array_to_string(list_transform({words(x)}, lambda t: chr((33 + list_position({VOC}, t))::INT)), '')"


def letter_groups(w: str) -> str:
    """Letters of a word with their scored marks, as strings."""
    clean = rf"regexp_replace(regexp_replace({w}, '[\x{{0653}}-\x{{0655}}\x{{06D6}}-\x{{06ED}}\x{{0640}}]', '', 'g'), '^{SCORED}+', '')"
    return f"regexp_extract_all({clean}, '[^\\x{{064B}}-\\x{{0652}}\\x{{0670}}]{SCORED}*')"


def mark_set(g: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({g}, '{SCORED}')))"


def der(ref: str, hyp: str, by: str, table: str) -> str:
    """Positions and errors of the four variants, letter by letter."""
    return f"""
WITH t AS (SELECT {by}, row_number() OVER () AS id, {arabic_words(f"coalesce({ref}, '')")} AS r, {arabic_words(f"coalesce({hyp}, '')")} AS h FROM {table} WHERE {ref} IS NOT NULL AND {hyp} IS NOT NULL),
s AS (SELECT *, list_transform(r, lambda w: {strip('w')}) = list_transform(h, lambda w: {strip('w')}) AS same FROM t),
w AS (SELECT {by}, id, unnest(range(len(r))) AS wi, unnest(r) AS rw, unnest(h) AS hw FROM s WHERE same),
l AS (SELECT {by}, id, wi, len({letter_groups('rw')}) AS n, unnest(range(len({letter_groups('rw')}))) AS li, unnest({letter_groups('rw')}) AS rg, unnest({letter_groups('hw')}) AS hg FROM w),
m AS (SELECT {by}, id, wi, li = n - 1 AS final, len({mark_set('rg')}) > 0 AS marked, {mark_set('rg')} <> {mark_set('hg')} AS differs FROM l),
v AS (SELECT * FROM (VALUES ('ce_all', true, false), ('noce_all', false, false), ('ce_markedonly', true, true), ('noce_markedonly', false, true)) v(variant, ce, mo)),
x AS (SELECT {by}, variant, id, wi, count(*) AS p, count(*) FILTER (differs) AS e FROM m, v WHERE (ce OR NOT final) AND (marked OR NOT mo) GROUP BY ALL),
g AS (SELECT {by}, variant, sum(p)::BIGINT AS positions, sum(e)::BIGINT AS errors, count(*) AS words, count(*) FILTER (e > 0) AS word_errors FROM x GROUP BY ALL),
b AS (SELECT {by}, variant, count(*) AS rows, count(*) FILTER (NOT same) AS skeleton_mismatch FROM s, v GROUP BY ALL)
SELECT b.{by}, b.variant, rows, coalesce(positions, 0) AS positions, coalesce(errors, 0) AS errors, coalesce(words, 0) AS words, coalesce(word_errors, 0) AS word_errors, skeleton_mismatch, coalesce(errors / nullif(positions, 0)::DOUBLE, 0) AS der, coalesce(word_errors / nullif(words, 0)::DOUBLE, 0) AS wer
FROM b LEFT JOIN g ON g.{by} = b.{by} AND g.variant = b.variant"""


PHRASES = """SELECT concat_ws('-', edition, surah, ayah) AS query_id, text AS phrase FROM verses WHERE text IS NOT NULL AND surah IS NOT NULL AND ayah IS NOT NULL
UNION ALL SELECT 'candidate-' || id, sentence FROM candidates WHERE id IS NOT NULL AND sentence IS NOT NULL"""
LATE = "l_quantity > 25"
WILSON_P = "(k / n::DOUBLE)"
Z = "1.959963984540054"

SQL: dict[str, str] = {
    "rates_by_cluster": f"""
WITH c AS (SELECT l_suppkey, count(*) FILTER (NOT ({LATE}) AND l_returnflag <> 'R') AS ta, count(*) FILTER ({LATE} AND l_returnflag <> 'R') AS fr, count(*) FILTER (NOT ({LATE}) AND l_returnflag = 'R') AS fa, count(*) FILTER ({LATE} AND l_returnflag = 'R') AS tr,
  count(*) FILTER ({LATE} AND l_returnflag = 'R' AND l_discount > 0.05) AS cd, count(*) FILTER ({LATE} AND l_returnflag = 'R' AND l_discount <= 0.05) AS ed FROM lineitem GROUP BY l_suppkey),
r AS (SELECT *, tr / nullif(tr + fr, 0)::DOUBLE AS p, tr / nullif(tr + fa, 0)::DOUBLE AS q FROM c)
SELECT l_suppkey, ta, fr, fa, tr, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / nullif(p + q, 0), 6) AS f1, round(1 - q, 6) AS far, round(fr / nullif(fr + ta, 0)::DOUBLE, 6) AS frr, round(ed / nullif(ed + cd, 0)::DOUBLE, 6) AS der, round((ta + tr) / nullif(ta + tr + fr + fa, 0)::DOUBLE, 6) AS accuracy FROM r""",
    "token_edit_distance": f"SELECT DISTINCT row_no, levenshtein({codes('phoneme_ref')}, {codes('phoneme_mis')}) AS distance FROM tts_rows WHERE phoneme_ref IS NOT NULL AND phoneme_mis IS NOT NULL",
    "vocabulary_codec": f"""
WITH x AS (SELECT DISTINCT row_no, phoneme_ref FROM tts_rows WHERE phoneme_ref IS NOT NULL), e AS (SELECT list_append(list_transform({words('phoneme_ref')}, lambda t: coalesce(list_position({VOC}, t) + 2, 2)), 1) AS e, len(list_filter({words('phoneme_ref')}, lambda t: NOT list_contains({VOC}, t))) = 0 AS back FROM x)
SELECT number::INT AS number, count(*) AS uses, count(*) FILTER (back) AS in_round_trip FROM (SELECT unnest(e) AS number, back FROM e) GROUP BY 1""",
    "phoneme_classes": f"SELECT CASE WHEN t IN ('a','i','u','A','I','U') THEN 'short' WHEN t IN ('aa','ii','uu','AA','II','UU') THEN 'long' ELSE 'consonant' END AS class, count(*) AS n FROM (SELECT unnest({words('phoneme_ref')}) AS t FROM train_rows WHERE phoneme_ref IS NOT NULL) GROUP BY 1",
    "first_differences": f"""
WITH x AS (SELECT DISTINCT row_no, {words('phoneme_ref')} AS a, {words('phoneme_mis')} AS b FROM tts_rows WHERE phoneme_ref IS NOT NULL AND phoneme_mis IS NOT NULL)
SELECT row_no, list_min(list_filter(range(greatest(len(a), len(b))), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1])) AS "at" FROM x WHERE a <> b""",
    "three_way_join": """
WITH x AS (SELECT DISTINCT row_no, speaker, phoneme_ref, coalesce(phoneme_mis, phoneme_ref) AS said FROM tts_rows WHERE phoneme_ref IS NOT NULL), y AS (SELECT *, CASE WHEN row_no % 2 = 0 THEN said ELSE phoneme_ref END AS heard FROM x)
SELECT row_no AS id, heard = phoneme_ref AS copies_canonical, heard = said AS hears_said FROM y""",
    "label_differences": f"""
WITH x AS (SELECT DISTINCT row_no, coalesce(label, '?') AS label, phoneme_ref AS a, coalesce(phoneme_mis, phoneme_ref) AS b FROM tts_rows WHERE phoneme_ref IS NOT NULL)
SELECT label, count(*) AS rows, count(*) FILTER ({words('a')} <> {words('b')}) AS different, sum(levenshtein({codes('a')}, {codes('b')}))::BIGINT AS distance FROM x GROUP BY label""",
    "review_order": """
WITH x AS (SELECT id, max(coalesce(len(flags), -1)) AS n, max(round(rate, 6)) AS rate FROM candidates WHERE id IS NOT NULL GROUP BY id)
SELECT id, CASE WHEN n > 1 THEN 0 WHEN n = 1 THEN 1 ELSE 2 END AS tier, rate FROM x ORDER BY tier, coalesce(rate, 0) DESC, id""",
    "diacritic_errors": der("tashkeel_sentence", "sentence", "source", "train_rows"),
    "marked_positions": f"""
WITH t AS (SELECT source, {arabic_words("coalesce(tashkeel_sentence, '')")} AS w FROM train_rows), w AS (SELECT source, unnest(w) AS w FROM t), l AS (SELECT source, len({letter_groups('w')}) AS n, unnest(range(len({letter_groups('w')}))) AS i, unnest({letter_groups('w')}) AS g FROM w),
s AS (SELECT DISTINCT source FROM w)
SELECT s.source, count(*) FILTER (len({mark_set('g')}) > 0 AND i = n - 1) AS final, count(*) FILTER (len({mark_set('g')}) > 0 AND i < n - 1) AS other FROM s LEFT JOIN l ON l.source IS NOT DISTINCT FROM s.source GROUP BY s.source""",
    "liaison_sites": f"""
WITH t AS (SELECT split, sentence, tashkeel_sentence, {arabic_words('tashkeel_sentence')} AS r, {arabic_words('sentence')} AS f FROM train_rows WHERE sentence IS NOT NULL AND tashkeel_sentence IS NOT NULL),
u AS (SELECT *, list_filter(range(len(r)), lambda i: i < len(r) - 1 AND starts_with({strip('r[i + 2]')}, 'ال') AND list_contains({mark_set(letter_groups('r[i + 1]') + '[-1]')}, chr(1618))) AS sites FROM t)
SELECT split, coalesce(sum(len(sites)), 0)::BIGINT AS sites, coalesce(sum(CASE WHEN len(r) = len(f) THEN len(list_filter(sites, lambda i: list_has_any({mark_set(letter_groups('f[i + 1]') + '[-1]')}, [chr(1614), chr(1615), chr(1616)]))) END), 0)::BIGINT AS breaks, count(*) FILTER ({skeleton('sentence')} <> {skeleton('tashkeel_sentence')} OR len(f) <> len(r)) AS blocking FROM u GROUP BY split""",
    "draft_quality": f"""
WITH x AS (SELECT coalesce(sentence, '') AS s, coalesce(tashkeel_sentence, '') AS d FROM candidates)
SELECT count(*) AS rows, count(*) FILTER ({skeleton('s')} <> {skeleton('d')}) AS skeleton_differs, count(*) FILTER (len({arabic_words('s')}) <> len({arabic_words('d')})) AS words_differ,
  count(*) FILTER (regexp_replace(s, '[\\p{{L}}\\p{{N}}]|{MARKS}|{SP}', '', 'g') <> regexp_replace(d, '[\\p{{L}}\\p{{N}}]|{MARKS}|{SP}', '', 'g')) AS punctuation_differs,
  sum(list_sum(list_transform(string_split_regex(regexp_replace(d, '[^\\x{{064B}}-\\x{{0650}}\\x{{0652}}]', ' ', 'g'), ' +'), lambda g: greatest(length(g) - 1, 0))))::BIGINT AS stacked FROM x""",
    "collapse_report": f"""
WITH x AS (SELECT DISTINCT row_no, label, phoneme_ref AS c, coalesce(phoneme_mis, phoneme_ref) AS t FROM tts_rows WHERE phoneme_ref IS NOT NULL), y AS (SELECT (row_no % 2)::INT AS arm, {codes('c')} AS c, {codes('t')} AS t, CASE WHEN row_no % 3 = 0 THEN {codes('t')} ELSE {codes('c')} END AS p FROM x)
SELECT arm, count(*) AS utterances, count(*) FILTER (p = c) / count(*)::DOUBLE AS copy_rate, count(*) FILTER (c <> t) AS informative_utterances, count(*) FILTER (c <> t AND levenshtein(p, c) < levenshtein(p, t)) / count(*) FILTER (c <> t)::DOUBLE AS canonical_preference FROM y GROUP BY arm""",
    "annotation_problems": """
WITH b AS (SELECT id, (regexp_replace(id, '[^0-9]', '', 'g')::BIGINT % 100000) AS rank FROM candidates WHERE id IS NOT NULL GROUP BY id), c AS (SELECT id, rank, rank % 5 = 0 AS x FROM b),
a AS (SELECT id, rank, annotator, CASE WHEN NOT x OR (annotator = 'a1') = (rank < 25) THEN 'anchored' ELSE 'blank' END AS condition FROM c, (VALUES ('a1'), ('a2')) v(annotator) WHERE x OR (rank % 2 = 0) = (annotator = 'a1')),
r AS (SELECT *, CASE WHEN rank % 7 = 0 THEN 'other' ELSE condition END AS cond, condition = 'anchored' OR rank % 11 = 0 AS suggested FROM a),
u AS (SELECT *, 1 AS n FROM r UNION ALL SELECT *, 2 FROM r WHERE rank % 13 = 0)
SELECT annotator, CASE WHEN cond = 'other' THEN 'wrong_condition' WHEN n = 2 THEN 'duplicate' WHEN cond = 'blank' AND suggested THEN 'unblinded' ELSE 'ok' END AS problem, count(*) AS rows FROM u GROUP BY 1, 2
UNION ALL SELECT annotator, 'unknown', count(*) FROM u WHERE rank % 17 = 0 AND n = 1 GROUP BY 1""",
    "mark_rates": f"SELECT DISTINCT id, sentence, round({rate('sentence')}, 9) AS rate, len({arabic_tokens('sentence')}) AS words FROM train_rows WHERE sentence IS NOT NULL",
    "candidate_pool": f"WITH {POOL} SELECT id, skel, NOT list_has_any(flags, ['no_arabic', 'no_tashkeel', 'pre_vowelized', 'duplicate']) AS eligible, array_to_string(flags, ',') AS flags FROM pool",
    "pool_flag_counts": f"WITH {POOL}, n AS (SELECT unnest(flags) AS flag FROM pool) SELECT v.flag, (SELECT count(*) FROM n WHERE n.flag = v.flag) AS rows FROM (VALUES ({FLAGS})) v(flag)",
    "duplicate_texts": f"SELECT {skeleton('sentence')} AS skel, count(*) AS rows, min(id) AS first_id FROM train_rows WHERE sentence IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "stacked_marks": r"""
WITH x AS (SELECT regexp_replace(tashkeel_sentence, '[^\x{064B}-\x{0650}\x{0652}]', ' ', 'g') AS m FROM train_rows WHERE tashkeel_sentence IS NOT NULL)
SELECT list_sum(list_transform(string_split_regex(m, ' +'), lambda g: greatest(length(g) - 1, 0)))::BIGINT AS pairs, count(*) AS rows FROM x GROUP BY 1""",
    "dagger_survival": "SELECT contains(tashkeel_sentence, chr(1648)) AS in_source, contains(sentence, chr(1648)) AS in_output, count(*) AS rows FROM train_rows WHERE sentence IS NOT NULL AND tashkeel_sentence IS NOT NULL GROUP BY 1, 2",
    "skeleton_overlap": f"SELECT DISTINCT id, {skeleton('sentence')} AS skel FROM train_rows WHERE sentence IS NOT NULL AND {skeleton('sentence')} <> '' AND {skeleton('sentence')} IN (SELECT {skeleton('sentence')} FROM msa_pilot_sample WHERE sentence IS NOT NULL)",
    "contamination": f"""
WITH s AS (SELECT lower(trim(stratum, ' ')) AS eval_set, sentence, {skeleton('sentence')} AS skel FROM msa_pilot_sample WHERE sentence IS NOT NULL AND stratum IS NOT NULL),
t AS (SELECT sentence, {skeleton('sentence')} AS skel FROM train_rows WHERE sentence IS NOT NULL),
p AS (SELECT skel, count(*) AS n FROM t WHERE skel <> '' GROUP BY skel)
SELECT eval_set, count(*) AS skeletons, count(p.n) AS hit_skeletons, coalesce(sum(p.n), 0)::BIGINT AS hit_train_rows,
  (SELECT count(DISTINCT s.sentence) FROM s WHERE s.eval_set = u.eval_set AND s.skel <> '' AND s.sentence IN (SELECT sentence FROM t)) AS raw_hits
FROM (SELECT DISTINCT eval_set, skel FROM s WHERE skel <> '') u LEFT JOIN p USING (skel) GROUP BY eval_set""",
    "holdout_filter": f"""
WITH i AS (SELECT DISTINCT {NAMED} AS id FROM (SELECT unnest(holdout_train_ids) AS x FROM holdout UNION ALL SELECT unnest(holdout_dev_ids) FROM holdout) WHERE x IS NOT NULL),
r AS (SELECT DISTINCT {squeeze('x')} AS ref FROM (SELECT unnest(holdout_phoneme_refs) AS x FROM holdout) WHERE x IS NOT NULL)
SELECT split, CASE WHEN id IN (SELECT id FROM i) THEN 'id' WHEN coalesce({squeeze('phoneme_ref')} IN (SELECT ref FROM r), false) THEN 'phoneme' ELSE 'keep' END AS verdict, count(*) AS rows FROM train_rows GROUP BY 1, 2""",
    "holdout_union": f"""
SELECT (SELECT count(DISTINCT {NAMED}) FROM (SELECT unnest(holdout_train_ids) AS x FROM holdout UNION ALL SELECT unnest(holdout_dev_ids) FROM holdout) WHERE x IS NOT NULL) AS ids,
  (SELECT count(DISTINCT {squeeze('x')}) FROM (SELECT unnest(holdout_phoneme_refs) AS x FROM holdout) WHERE x IS NOT NULL) AS phoneme_keys""",
    "canonical_policy": f"""
WITH m AS (SELECT id AS key, true AS numeric, {squeeze("coalesce(phoneme_ref, '')")} AS s FROM train_rows WHERE id IS NOT NULL UNION ALL SELECT speaker || '_' || row_no, false, {squeeze("coalesce(sentence_ref, '')")} FROM tts_rows),
f AS (SELECT DISTINCT speaker || '_' || row_no AS key, phoneme_ref FROM tts_rows WHERE phoneme_ref IS NOT NULL),
j AS (SELECT s, numeric, {squeeze('f.phoneme_ref')} AS c FROM m LEFT JOIN f USING (key)),
k AS (SELECT *, CASE WHEN s = '' THEN 'empty_transcript' WHEN numeric THEN 'from_sentence' WHEN c <> '' THEN 'from_file' ELSE 'missing_canonical' END AS provenance FROM j)
SELECT provenance, count(*) AS rows, coalesce(sum(CASE provenance WHEN 'from_sentence' THEN length(s) WHEN 'from_file' THEN length(c) END), 0)::BIGINT AS characters FROM k GROUP BY 1""",
    "key_overlap": """
WITH a AS (SELECT DISTINCT id FROM train_rows WHERE split = 'train'), b AS (SELECT DISTINCT id FROM train_rows WHERE split = 'dev')
SELECT (SELECT count(*) FROM a JOIN b USING (id)) AS shared, (SELECT count(*) FROM a ANTI JOIN b USING (id)) AS only_left, (SELECT count(*) FROM b ANTI JOIN a USING (id)) AS only_right""",
    "clean_blocks": f"""
SELECT DISTINCT block FROM holdout WHERE block NOT IN (SELECT block FROM (SELECT block, unnest(holdout_phoneme_refs) AS x FROM holdout) WHERE {squeeze('x')} IN (SELECT {squeeze('phoneme_ref')} FROM train_rows WHERE phoneme_ref IS NOT NULL))""",
    "span_search": f"""
WITH v AS (SELECT DISTINCT edition, surah, ayah, verse_id, {words(skeleton('text'))} AS w FROM verses WHERE text IS NOT NULL AND surah IS NOT NULL AND ayah IS NOT NULL),
q AS (SELECT DISTINCT query_id, {words(skeleton('phrase'))} AS g FROM ({PHRASES})),
c AS (SELECT edition, surah, flatten(list(w ORDER BY ayah, verse_id, w)) AS w FROM v GROUP BY edition, surah),
p AS (SELECT edition, surah, w, w[position + 1] AS first, position FROM (SELECT edition, surah, w, unnest(range(len(w))) AS position FROM c))
SELECT q.query_id, p.edition, p.surah, p.position, len(q.g) AS n_words FROM q JOIN p ON p.first = q.g[1] WHERE p.position + len(q.g) <= len(p.w) AND q.g = p.w[p.position + 1 : p.position + len(q.g)]""",
    "span_recovery": "",
    "character_audit": rf"""
WITH x AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '[ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي\x{{064B}}-\x{{0652}}\x{{0670}}]|{SP}', '', 'g'), '(?s).')) AS ch FROM documents WHERE text IS NOT NULL)
SELECT ch, CASE WHEN regexp_matches(ch, '\p{{P}}') THEN 'punctuation' WHEN regexp_matches(ch, '\p{{Nd}}') THEN 'digit' WHEN regexp_matches(ch, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS class, count(*) AS n FROM x GROUP BY 1, 2""",
    "token_histogram": f"""
WITH v AS (SELECT DISTINCT unnest({words('text')}) AS token FROM benchmark_items WHERE text IS NOT NULL), t AS (SELECT unnest({words('text')}) AS token FROM documents WHERE text IS NOT NULL)
SELECT token, count(*) AS n, token IN (SELECT token FROM v) AS known FROM t GROUP BY token""",
    "unused_tokens": f"SELECT token FROM (SELECT unnest({VOC}) AS token) WHERE token NOT IN (SELECT unnest({words('phoneme_ref')}) FROM train_rows WHERE phoneme_ref IS NOT NULL)",
    "distinct_units": f"SELECT DISTINCT unnest({words('phoneme_ref')}) AS unit FROM train_rows WHERE phoneme_ref IS NOT NULL",
    "order_summary": order_stats("documents", "n_chars", "source"),
    "price_order_summary": order_stats("orders", "o_totalprice", "o_orderstatus"),
    "length_buckets": "SELECT (CASE WHEN n >= 3200 THEN 7 WHEN n >= 1600 THEN 6 WHEN n >= 800 THEN 5 WHEN n >= 400 THEN 4 WHEN n >= 200 THEN 3 WHEN n >= 100 THEN 2 WHEN n >= 50 THEN 1 ELSE 0 END)::INT AS bucket, count(*) AS n FROM (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "cross_table": "SELECT a, b, count(*) AS n, grouping(a)::INT AS total_a, grouping(b)::INT AS total_b FROM (SELECT coalesce(split, '?') AS a, coalesce(source, '?') AS b FROM train_rows) GROUP BY CUBE (a, b)",
    "final_marks": rf"""
WITH x AS (SELECT list_filter({words(r"regexp_replace(tashkeel_sentence, '[\p{P}]', ' ', 'g')")}, lambda w: regexp_matches(w, '[\x{{064B}}-\x{{0655}}\x{{0670}}\x{{06D6}}-\x{{06ED}}\p{{L}}]')) AS w, {words('phoneme_ref')} AS t FROM train_rows WHERE tashkeel_sentence IS NOT NULL AND phoneme_ref IS NOT NULL),
y AS (SELECT list_max(list_filter(range(1, length(w[-1]) + 1), lambda i: unicode(w[-1][i]) IN (1611, 1612, 1613, 1614, 1615, 1616, 1618, 1648))) AS place, w[-1] AS w, t[-1] AS p FROM x WHERE len(w) > 0 AND len(t) > 0)
SELECT CASE unicode(w[place]) WHEN 1611 THEN 'tanwin fath' WHEN 1612 THEN 'tanwin damm' WHEN 1613 THEN 'tanwin kasr' WHEN 1614 THEN 'fatha' WHEN 1615 THEN 'damma' WHEN 1616 THEN 'kasra' WHEN 1618 THEN 'sukun' WHEN 1648 THEN 'superscript alef' ELSE '(bare)' END AS mark,
  CASE WHEN p IN ('a','i','u','A','I','U') THEN 'short' WHEN p IN ('aa','ii','uu','AA','II','UU') THEN 'long' ELSE 'consonant' END AS class, count(*) AS n FROM y GROUP BY 1, 2""",
    "identity_rates": f"""
WITH x AS (SELECT sentence AS a, tashkeel_sentence AS b FROM train_rows WHERE sentence IS NOT NULL AND tashkeel_sentence IS NOT NULL)
SELECT count(*) AS rows, round(avg((a = b)::INT), 9) AS equal, round(avg(({skeleton('a')} = {skeleton('b')})::INT), 9) AS same_skeleton, round(avg(({squeeze(r"regexp_replace(a, '\p{P}', '', 'g')")} = {squeeze(r"regexp_replace(b, '\p{P}', '', 'g')")})::INT), 9) AS same_without_punctuation FROM x""",
    "content_loss": f"""
WITH x AS (SELECT len({arabic_tokens('sentence')}) AS n, len({arabic_tokens('tashkeel_sentence')}) AS m FROM candidates WHERE sentence IS NOT NULL AND tashkeel_sentence IS NOT NULL)
SELECT count(*) AS rows, count(*) FILTER (m / n::DOUBLE < 0.7) AS truncated, count(*) FILTER (m <> n) AS changed FROM x WHERE n > 0""",
    "conflicting_duplicates": """
WITH x AS (SELECT nfc_normalize(sentence) AS t, phoneme_ref AS v, id AS o FROM train_rows WHERE sentence IS NOT NULL), y AS (SELECT *, first_value(v) OVER (PARTITION BY t ORDER BY o, v NULLS FIRST) AS f FROM x)
SELECT count(DISTINCT t) AS texts, count(*) AS rows, count(*) FILTER (v IS DISTINCT FROM f) AS conflicting FROM y""",
    "prompts_first": "SELECT sentence_ref, count(*) AS clips, min(row_no) AS row_no, arg_min(speaker, row_no) AS speaker FROM tts_rows WHERE sentence_ref IS NOT NULL GROUP BY 1",
    "top_sources": "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 5",
    "stratified_pick": f"""
WITH x AS (SELECT id, max(CASE WHEN NOT isnan(disagreement) THEN disagreement END) AS s FROM msa_pilot_sample WHERE id IS NOT NULL GROUP BY id), t AS (SELECT id FROM x WHERE s IS NOT NULL ORDER BY s DESC, id LIMIT 80),
h AS (SELECT id FROM t ORDER BY {hash_key('id', 11)}, id LIMIT 20)
SELECT id, 'high' AS stratum_pick FROM h UNION ALL SELECT * FROM (SELECT id, 'uniform' FROM x WHERE id NOT IN (SELECT id FROM h) ORDER BY {hash_key('id', 12)}, id LIMIT 20)""",
    "hash_sample": f"SELECT id FROM (SELECT DISTINCT id FROM train_rows) ORDER BY {hash_key('id', 20261014)}, id LIMIT 100",
    "length_batches": f"""
WITH x AS (SELECT DISTINCT row_no, speaker, len({words('phoneme_ref')}) AS n FROM tts_rows WHERE phoneme_ref IS NOT NULL)
SELECT row_no, speaker, n, (row_number() OVER (PARTITION BY speaker ORDER BY n DESC, row_no) - 1) // 16 AS batch FROM x""",
    "bootstrap_portable": """
WITH c AS (SELECT speaker, count(*) FILTER (phoneme_mis IS NOT NULL) AS k, count(*) AS n FROM tts_rows WHERE speaker IS NOT NULL GROUP BY speaker), m AS (SELECT row_number() OVER (ORDER BY speaker) - 1 AS i, k, n FROM c), s AS (SELECT count(*) AS c FROM m),
d AS (SELECT r AS replicate, (((r * 7919 + p * 104729 + 12345) * 48271) % 2147483647) % s.c AS i FROM s, range(200) a(r), range(s.c) b(p))
SELECT replicate, round(sum(k) / sum(n), 9) AS rate FROM d JOIN m USING (i) GROUP BY replicate""",
    "wilson_intervals": f"""
WITH c AS (SELECT speaker, count(*) FILTER (phoneme_mis IS NOT NULL) AS k, count(*) AS n FROM tts_rows WHERE speaker IS NOT NULL GROUP BY speaker),
w AS (SELECT *, 1 + {Z} * {Z} / n AS d, {WILSON_P} + {Z} * {Z} / (2 * n) AS c0, {Z} * sqrt({WILSON_P} * (1 - {WILSON_P}) / n + {Z} * {Z} / (4 * n * n)) AS h FROM c)
SELECT speaker, k, n, round(greatest((c0 - h) / d, 0) * 100, 6) AS low, round(least((c0 + h) / d, 1) * 100, 6) AS high FROM w""",
    "power_grid": """
WITH s AS (SELECT s_nationkey, stddev_samp(s_acctbal) / sqrt(count(*)) AS se FROM supplier GROUP BY 1 HAVING count(*) > 1)
SELECT s_nationkey, k, rho, round(2.8015852 * se * sqrt(1 + k - 2 * rho * sqrt(k)), 4) AS mde FROM s, (VALUES (1.0::DOUBLE), (1.5), (2.0)) a(k), (VALUES (0.0::DOUBLE), (0.5)) b(rho)""",
    "annotation_queue": """
WITH b AS (SELECT id, (regexp_replace(id, '[^0-9]', '', 'g')::BIGINT % 100000) AS rank FROM candidates WHERE id IS NOT NULL GROUP BY id), c AS (SELECT id, rank, rank % 5 = 0 AS crossover FROM b),
a AS (SELECT * FROM c, (VALUES ('a1'), ('a2')) v(annotator) WHERE crossover OR (rank % 2 = 0) = (annotator = 'a1'))
SELECT id, annotator, rank, crossover, CASE WHEN NOT crossover OR (annotator = 'a1') = (rank < 25) THEN 'anchored' ELSE 'blank' END AS condition, row_number() OVER (PARTITION BY annotator ORDER BY NOT crossover, rank, id) - 1 AS queue_place FROM a""",
    "latest_decisions": "WITH x AS (SELECT DISTINCT id, ingested_at FROM train_rows WHERE id IS NOT NULL AND ingested_at IS NOT NULL), y AS (SELECT *, max(ingested_at) OVER (PARTITION BY id) AS m FROM x) SELECT ingested_at < m AS superseded, count(*) AS rows FROM y GROUP BY 1",
    "marker_sessions": """
WITH x AS (SELECT user_id, event_id, sum((event_type = (SELECT min(event_type) FROM events))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM events)
SELECT user_id, run, count(*) AS n, min(event_id) AS first_event FROM x GROUP BY 1, 2""",
    "chunked_tool": f"SELECT DISTINCT verse_id, {strip('CASE WHEN length(text) <= 320 THEN text ELSE ' + squeeze('text') + ' END')} AS output FROM verses WHERE text IS NOT NULL",
    "tumbling_windows": "SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_windows": "SELECT ((epoch_us(ts) // 3600000000 - s) * 3600)::BIGINT AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(s) GROUP BY 1, 2",
    "user_sessions": """
WITH x AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT AS b FROM events), y AS (SELECT *, sum(coalesce(b, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x)
SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM y GROUP BY user_id, s""",
    "scan_training": f"SELECT DISTINCT id, coalesce(len({words('phoneme_ref')}), -1) AS tokens FROM train_rows WHERE split = 'train'",
    "scan_synthetic": f"SELECT DISTINCT 'iqra_tts_' || row_no AS id, speaker, coalesce(len({words('phoneme_ref')}), -1) AS tokens FROM tts_rows",
}

SQL["span_recovery"] = f"""
WITH m AS ({SQL['span_search']}), k AS (SELECT query_id, count(*) AS n FROM m GROUP BY query_id), q AS (SELECT DISTINCT query_id FROM ({PHRASES}))
SELECT count(*) AS queries, count(n) AS located, count(*) FILTER (n = 1) AS unique_place, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n IS NULL) AS missing FROM q LEFT JOIN k USING (query_id)"""

# ---- the alignment chain ------------------------------------------------------
READINGS = f"""
SELECT row_no, speaker, c, a, CASE WHEN row_no % 2 = 0 THEN a ELSE c END AS p, phoneme_ref, said
FROM (SELECT row_no, speaker, phoneme_ref, said, {words('phoneme_ref')} AS c, {words('said')} AS a FROM (SELECT DISTINCT row_no, speaker, phoneme_ref, coalesce(phoneme_mis, phoneme_ref) AS said FROM tts_rows WHERE phoneme_ref IS NOT NULL))"""
BY_SPEAKER = f"WITH RECURSIVE {L.counted(f'SELECT speaker, c, a, p, count(*) AS n FROM ({READINGS}) GROUP BY ALL')}"
SQL["detection_rates"] = f"{BY_SPEAKER} {L.rates(L.summed('speaker'))}"
SQL["official_rates"] = f"{BY_SPEAKER} {L.shares(L.rates(L.summed('speaker'), '0'))}"
PROBED = f"SELECT lower(trim(stratum, ' ')) AS stratum, {words('phoneme_ref')} AS c, {words('phoneme_ref')} AS a, {words('prediction')} AS p, count(*) AS n FROM msa_pilot_sample WHERE id IS NOT NULL AND phoneme_ref IS NOT NULL AND prediction IS NOT NULL GROUP BY ALL"
SQL["base_rate_probe"] = f"WITH RECURSIVE {L.counted(PROBED)} SELECT *, CASE WHEN fr + ta <> 0 THEN fr::DOUBLE / (fr + ta) ELSE 'nan'::DOUBLE END AS frr FROM ({L.summed('stratum')})"
CUT = lambda x: f"CASE WHEN list_contains(['a','i','u','A','I','U'], c[-1]) AND len({x}) > 1 THEN {x}[:len({x}) - 1] ELSE {x} END"
SQL["final_token_ablation"] = f"""WITH RECURSIVE x AS ({READINGS}), {L.counted(f"SELECT arm, c, a, p, count(*) AS n FROM (SELECT 'whole' AS arm, c, a, p FROM x UNION ALL SELECT 'without_final', {CUT('c')}, {CUT('a')}, {CUT('p')} FROM x) GROUP BY ALL")} {L.rates(L.summed('arm'))}"""
SQL["metric_deltas"] = f"""WITH RECURSIVE x AS ({READINGS}), {L.counted("SELECT speaker, d, c, a, p, count(*) AS n FROM (SELECT speaker, 'ours' AS d, c, a, p FROM x UNION ALL SELECT speaker, 'theirs', c, a, CASE WHEN row_no % 3 = 0 THEN a ELSE c END FROM x) GROUP BY ALL")},
r AS ({L.rates(L.summed('speaker, d'))}), u AS (UNPIVOT (SELECT speaker, d, precision, recall, f1, frr, accuracy FROM r) ON precision, recall, f1, frr, accuracy INTO NAME metric VALUE v)
SELECT a.speaker, a.metric, a.v AS ours, b.v AS theirs, a.v - b.v AS delta, (isnan(a.v) AND isnan(b.v)) OR (NOT isnan(a.v - b.v) AND abs(a.v - b.v) <= 0.01) AS agrees FROM u a JOIN u b ON a.speaker = b.speaker AND a.metric = b.metric AND a.d = 'ours' AND b.d = 'theirs'"""
SQL["alignment_operations"] = f"""SELECT unnest(['C', 'S', 'D', 'I']) AS op, unnest([c, s, d, i]) AS n FROM ({L.operations(f'SELECT c AS x, a AS y, count(*) AS n FROM ({READINGS}) GROUP BY ALL')})"""
SQL["correct_rates"] = f"""SELECT speaker, tokens, s AS substitutions, d AS deletions, i AS insertions, round((tokens - s - d) / tokens::DOUBLE, 4) AS correct_rate, round((tokens - s - d - i) / tokens::DOUBLE, 4) AS accuracy
FROM ({L.operations(f'SELECT speaker, c AS x, a AS y, count(*) AS n FROM ({READINGS}) WHERE len(c) > 0 GROUP BY ALL', 'speaker')})"""
SQL["corruption_attribution"] = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT * FROM ({READINGS}) WHERE phoneme_ref <> said), {L.counted("SELECT phoneme_ref, said, arm, c, a, p, count(*) AS n FROM (SELECT phoneme_ref, said, 'gold' AS arm, c, c AS a, p FROM x UNION ALL SELECT phoneme_ref, said, 'auto', a, c, p FROM x UNION ALL SELECT phoneme_ref, said, 'sites', c, a, p FROM x) GROUP BY ALL")},
w AS (SELECT phoneme_ref, said, sum((fr + fa) * n) FILTER (arm = 'gold') AS g, sum((fr + fa) * n) FILTER (arm = 'auto') AS o FROM counted GROUP BY ALL),
y AS (SELECT phoneme_ref, said, c, a, count(*) AS clips, min(row_no) AS prompt FROM x GROUP BY ALL),
m AS (SELECT pid, x, y, len(x) + len(y) - count(am.xi) - count(*) FILTER (x[am.xi] = y[am.yi]) AS sites FROM ap LEFT JOIN am USING (pid) GROUP BY pid, x, y)
SELECT prompt, sites * clips AS sites, abs(o - g)::BIGINT AS damage, abs(o - g) > sites * clips AS over_bound, sites = 0 AND o <> g AS artifact FROM y JOIN w USING (phoneme_ref, said) JOIN m ON m.x = y.c AND m.y = y.a"""
SQL["collapse_verdict"] = f"""WITH r AS ({SQL['collapse_report']}), x AS (SELECT least(a.informative_utterances, b.informative_utterances) AS informative, a.canonical_preference - b.canonical_preference AS delta FROM r a, r b WHERE a.arm = 0 AND b.arm = 1)
SELECT 'dev' AS split, informative, delta, informative >= 20 AS powered, informative >= 20 AND NOT isnan(delta) AND delta > 0.15 AS fires FROM x"""

# ---- intervals ------------------------------------------------------------------
TAIL = lambda k, p: f"coalesce(list_sum(list_transform(range(0, ({k}) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - ({p}))))), 0)"
SQL["exact_intervals"] = f"""
WITH RECURSIVE c AS (SELECT speaker, count(*) FILTER (phoneme_mis IS NOT NULL) AS k, count(*) AS n FROM tts_rows WHERE speaker IS NOT NULL GROUP BY speaker),
b AS (SELECT speaker, k, n, 0 AS step, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS h0, 1.0::DOUBLE AS h1 FROM c UNION ALL
  SELECT speaker, k, n, step + 1, CASE WHEN low THEN lm ELSE l0 END, CASE WHEN low THEN l1 ELSE lm END, CASE WHEN high THEN hm ELSE h0 END, CASE WHEN high THEN h1 ELSE hm END
  FROM (SELECT *, 1 - {TAIL('k - 1', 'lm')} < 0.025 AS low, {TAIL('k', 'hm')} > 0.025 AS high FROM (SELECT *, (l0 + l1) / 2 AS lm, (h0 + h1) / 2 AS hm FROM b WHERE step < 45)))
SELECT speaker, k, n, k / n::DOUBLE AS rate, round(CASE WHEN k = 0 THEN 0 ELSE l0 END, 7) AS low, round(CASE WHEN k = n THEN 1 ELSE h0 END, 7) AS high FROM b WHERE step = 45"""
SQL["power_recommendation"] = f"""SELECT n_regionkey, worst_mde, CASE WHEN worst_mde < 10000 THEN 'keep' ELSE 'cut' END AS decision, round(CASE WHEN worst_mde <> 0 THEN 10000 / worst_mde END, 6) AS margin
FROM (SELECT n_regionkey, max(mde) AS worst_mde FROM ({SQL['power_grid']}) g JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey)"""

# ---- text contracts ----------------------------------------------------------------
def published(x: str) -> str:
    """Letters and blanks of a text with their marks, as strings."""
    clean = squeeze(rf"regexp_replace(regexp_replace({x}, '[\x{{0670}}\x{{0640}}]', '', 'g'), '[^{LET[1:-1]}{MARKS[1:-1]}]', ' ', 'g')")
    return f"regexp_extract_all({clean}, '[^{MARKS[1:-1]}]{MARKS}*')"


def _sorted_unit(g: str) -> str:
    return f"{g}[1] || array_to_string(list_sort(string_split({g}[2:], '')), '')"


def _coded_by(x: str, dictionary: str) -> str:
    return f"array_to_string(list_transform({x}, lambda t: chr((33 + list_position({dictionary}, t))::INT)), '')"


_ARM = lambda u: f"CASE WHEN ce THEN list_transform({u}, lambda g: {_sorted_unit('g')}) ELSE list_transform({u}, lambda g, i: CASE WHEN {u}[i + 1][1] = ' ' THEN g[1] ELSE {_sorted_unit('g')} END) END"
_LABELS = lambda u: f"list_concat(['<BOS>'], list_transform({u}, lambda g: g[2:]), ['<EOS>'])"
SQL["diacritic_errors_published"] = f"""
WITH t AS (SELECT source, n, {published('tashkeel_sentence')} AS r, {published('sentence')} AS h FROM (SELECT source, tashkeel_sentence, sentence, count(*) AS n FROM train_rows WHERE sentence IS NOT NULL AND tashkeel_sentence IS NOT NULL GROUP BY ALL)),
v AS (SELECT source, n, ce, {_ARM('r')} AS r, {_ARM('h')} AS h FROM t, (VALUES (true), (false)) v(ce)),
w AS (SELECT source, ce, n, {_LABELS('r')} AS rl, {_LABELS('h')} AS hl, string_split(array_to_string(r, ''), ' ') AS rw, string_split(array_to_string(h, ''), ' ') AS hw FROM v),
x AS (SELECT *, list_distinct(list_concat(rl, hl)) AS dl, list_distinct(list_concat(rw, hw)) AS dw FROM w),
s AS (SELECT source, ce AS case_endings, sum(n * levenshtein({_coded_by('rl', 'dl')}, {_coded_by('hl', 'dl')}))::BIGINT AS label_distance, sum(n * len(rl))::BIGINT AS labels, sum(n * levenshtein({_coded_by('rw', 'dw')}, {_coded_by('hw', 'dw')}))::BIGINT AS word_distance, sum(n * len(rw))::BIGINT AS words FROM x GROUP BY ALL)
SELECT *, label_distance::DOUBLE / labels AS der, word_distance::DOUBLE / words AS wer FROM s"""


def _compatibility_forms() -> str:
    """VALUES of characters and their compatibility composition, by rule from the Unicode database."""
    import unicodedata

    rows = []
    for lo, hi in ((0xA0, 0x250), (0x2000, 0x2100), (0x2100, 0x2190), (0x2460, 0x2500), (0x3000, 0x3001), (0xFB00, 0xFE00), (0xFE20, 0xFF00), (0xFF00, 0xFFF0)):
        for cp in range(lo, hi):
            to = unicodedata.normalize("NFKC", chr(cp))
            if to != chr(cp):
                rows.append(f"({cp}, '{to.replace(chr(39), chr(39) * 2)}')")
    return "VALUES " + ", ".join(rows)


SQL["cleaning_contract"] = rf"""
WITH x AS (SELECT row_number() OVER () AS id, sentence AS s FROM candidates WHERE sentence IS NOT NULL), m(cp, f) AS ({_compatibility_forms()}),
c AS (SELECT id, unnest(l) AS ch, generate_subscripts(l, 1) AS i FROM (SELECT id, regexp_extract_all(s, '(?s).') AS l FROM x)),
k AS (SELECT id, nfc_normalize(string_agg(coalesce(m.f, ch), '' ORDER BY i)) AS t FROM c LEFT JOIN m ON m.cp = unicode(ch) GROUP BY id),
d AS (SELECT id, unnest(regexp_extract_all(t, '(?s).')) AS ch FROM k),
e AS (SELECT id, CASE WHEN regexp_matches(ch, '[ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي\x{{064B}}-\x{{0652}}\x{{0670}}]|{SP}') THEN NULL WHEN ch IN ('ی', 'ک', 'ھ') THEN 'script_variant' WHEN ch = chr(1600) OR regexp_matches(ch, '\p{{Mn}}') THEN 'non_phonemic_mark'
  WHEN ch IN ('چ', 'ڨ') THEN 'no_msa_equivalent' WHEN regexp_matches(ch, '\p{{P}}') THEN 'punctuation' ELSE 'unsupported_character' END AS flag FROM d),
g AS (SELECT id, flag FROM e WHERE flag IS NOT NULL UNION SELECT id, 'latin' FROM x WHERE regexp_matches(s, '[A-Za-z\x{{00C0}}-\x{{024F}}]') UNION SELECT id, 'digits' FROM x WHERE regexp_matches(s, '{DIGIT}')
  UNION SELECT id, 'presentation_form' FROM x WHERE regexp_matches(s, '[\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]')),
u AS (SELECT id FROM g WHERE flag IN ('latin', 'digits', 'no_msa_equivalent'))
SELECT flag, x.id NOT IN (SELECT id FROM u) AS fair, count(*) AS rows FROM x LEFT JOIN g USING (id) GROUP BY 1, 2"""
BETWEEN = rf"{MARKS[1:-1]}\x{{0640}}\p{{P}}{SP[1:-1]}"
SQL["restored_punctuation"] = rf"""
WITH x AS (SELECT DISTINCT id, nfc_normalize(sentence) AS s, nfc_normalize(tashkeel_sentence) AS d, tashkeel_sentence AS draft FROM msa_pilot_sample WHERE sentence IS NOT NULL AND tashkeel_sentence IS NOT NULL),
u AS (SELECT *, regexp_extract_all(s, '[^{BETWEEN}][{BETWEEN}]*') AS su, regexp_extract_all(d, '[^{BETWEEN}][{BETWEEN}]*') AS du FROM x),
o AS (SELECT *, list_transform(list_zip(du, su), lambda z: regexp_replace(z[1], '[\x{{0640}}\p{{P}}{SP[1:-1]}]', '', 'g') || regexp_replace(z[2][2:], '{MARKS}', '', 'g')) AS l FROM u)
SELECT DISTINCT id, CASE WHEN {skeleton('s')} = {skeleton('d')} AND len(su) = len(du) THEN regexp_replace(regexp_extract(d, '^[{BETWEEN}]*'), '[\x{{0640}}\p{{P}}{SP[1:-1]}]', '', 'g') || regexp_replace(regexp_extract(s, '^[{BETWEEN}]*'), '{MARKS}', '', 'g') || array_to_string(l, '') ELSE draft END AS restored FROM o"""
PAIRED = f"""
t AS (SELECT split, row_number() OVER () AS id, {arabic_words('tashkeel_sentence')} AS r, {arabic_words('sentence')} AS h FROM train_rows WHERE sentence IS NOT NULL AND tashkeel_sentence IS NOT NULL),
w AS (SELECT split, unnest(r) AS rw, unnest(h) AS hw, unnest(range(len(r))) = len(r) - 1 AS last FROM t WHERE len(r) = len(h)),
q AS (SELECT split, last, {letter_groups('rw')} AS gl, {letter_groups('hw')} AS hl FROM w),
l AS (SELECT split, last, unnest(range(len(gl))) = len(gl) - 1 AS final, unnest(list_transform(gl, lambda g: {mark_set('g')})) AS gm, unnest(list_transform(range(len(gl)), lambda i: coalesce({mark_set('hl[i + 1]')}, []))) AS hm FROM q)"""
SQL["mark_errors"] = f"""
WITH {PAIRED}, m AS (SELECT *, unnest(list_distinct(list_concat(gm, hm))) AS mark FROM l),
b AS (SELECT split, CASE WHEN unicode(mark) IN (1611, 1612, 1613) OR (last AND final) THEN 'free' WHEN unicode(mark) = 1617 THEN 'A' WHEN final THEN 'B' ELSE 'A' END AS bucket, list_contains(gm, mark) AS g, list_contains(hm, mark) AS h,
  CASE WHEN unicode(mark) = 1617 THEN list_contains(hm, chr(1617)) ELSE len(list_filter(hm, lambda v: v <> chr(1617))) > 0 END AS other FROM m),
s AS (SELECT split, bucket, count(*) AS scored, count(*) FILTER (g AND NOT h AND other) AS substitutions, count(*) FILTER (g AND NOT h AND NOT other) AS omissions, count(*) FILTER (h AND NOT g) AS spurious FROM b GROUP BY ALL),
e AS (SELECT *, substitutions + omissions + spurious AS errors FROM s), p AS (SELECT *, errors / scored::DOUBLE AS p, scored::DOUBLE AS n FROM e),
z AS (SELECT *, 1 + {Z} * {Z} / n AS d, p + {Z} * {Z} / (2 * n) AS c0, {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n)) AS h FROM p)
SELECT split, bucket, scored, substitutions, omissions, spurious, errors, round(greatest((c0 - h) / d, 0) * 100, 6) AS low, round(least((c0 + h) / d, 1) * 100, 6) AS high FROM z"""
SQL["mark_confusions"] = f"""
WITH {PAIRED}, n AS (SELECT split, array_to_string(gm, '') AS gold, array_to_string(hm, '') AS written, count(*) AS n FROM l WHERE gm <> hm GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, gold, written) AS place FROM n)
SELECT split, gold, written, n, place FROM o WHERE place <= 8"""
SQL["file_report"] = f"""
WITH b AS (SELECT id, (regexp_replace(id, '[^0-9]', '', 'g')::BIGINT % 100000) AS n, min(sentence) AS s FROM candidates WHERE id IS NOT NULL GROUP BY id),
a AS (SELECT id, n, s, n % 5 = 0 AS x, annotator, CASE WHEN n % 5 <> 0 OR (annotator = 'a1') = (n < 25) THEN 'anchored' ELSE 'blank' END AS cond FROM b, (VALUES ('a1'), ('a2')) v(annotator) WHERE n % 5 = 0 OR (n % 2 = 0) = (annotator = 'a1')),
r AS (SELECT *, CASE WHEN n % 9 = 0 THEN 'other' ELSE cond END AS c, CASE WHEN cond = 'anchored' OR n % 11 = 0 THEN s END AS suggested, CASE WHEN n % 6 = 0 THEN concat_ws(' ', s, 'زائد') ELSE s END AS final FROM a),
u AS (SELECT *, 0 AS k FROM r UNION ALL SELECT * REPLACE ('ثان' AS final), 1 FROM r WHERE n % 13 = 0 UNION ALL SELECT *, 2 FROM r WHERE n % 17 = 0),
v AS (SELECT *, k < 2 AND c <> 'other' AS valid, n % 7 <> 0 AS usable, k < 2 AND c <> 'other' AND n % 7 <> 0 AS live FROM u)
SELECT annotator, count(*) AS rows, count(*) FILTER (live) AS done, count(*) FILTER (valid AND NOT usable) AS unusable, count(*) FILTER (k = 1) AS duplicates, count(*) FILTER (k = 2) AS unknown, count(*) FILTER (k < 2 AND c = 'other') AS wrong_condition, count(*) FILTER (live AND c = 'blank' AND suggested <> '') AS breaches,
  count(*) FILTER (live AND x) AS crossover_done, count(*) FILTER (valid AND NOT usable AND x) AS crossover_unusable, count(*) FILTER (live AND ({skeleton("coalesce(s, '')")} <> {skeleton("coalesce(final, '')")} OR len({arabic_words("coalesce(s, '')")}) <> len({arabic_words("coalesce(final, '')")}))) AS blocking,
  (2 * count(*) FILTER (live))::BIGINT AS flagged, count(*) FILTER (live AND n % 2 = 0) AS ambiguous, quantile_cont(CASE WHEN live THEN (n % 50 + 10)::DOUBLE END, 0.5) AS median_seconds,
  count(*) FILTER (valid AND x) >= 50 AND count(*) FILTER (live AND x) < 45 AS extend FROM v GROUP BY annotator"""

# ---- sources, sinks, records ------------------------------------------------------------
CLIPS = f"""SELECT DISTINCT 'train/wav/audio_' || coalesce(speaker, '') || '_' || row_no || '.wav' AS path, {squeeze("coalesce(sentence_ref, '')")} AS sentence, {squeeze("coalesce(phoneme_ref, '')")} AS canonical, coalesce(speaker, '') AS speaker, {squeeze("coalesce(phoneme_mis, '')")} AS other FROM tts_rows"""
BLOCK = """b AS (SELECT id, (regexp_replace(id, '[^0-9]', '', 'g')::BIGINT % 100000) AS n, min(sentence) AS s FROM candidates WHERE id IS NOT NULL GROUP BY id),
q AS (SELECT id, n, s, annotator, CASE WHEN n % 5 <> 0 OR (annotator = 'a1') = (n < 25) THEN 'anchored' ELSE 'blank' END AS condition FROM b, (VALUES ('a1'), ('a2')) v(annotator) WHERE n % 5 = 0 OR (n % 2 = 0) = (annotator = 'a1'))"""
SQL["manifest_round_trip"] = f"SELECT DISTINCT path, sentence, canonical FROM ({CLIPS})"
SQL["ark_round_trip"] = f"SELECT row_no::VARCHAR AS id, array_to_string(p, ' ') AS hyp, array_to_string(a, ' ') AS ref, array_to_string(c, ' ') AS canon FROM ({READINGS})"
SQL["cache_round_trip"] = "SELECT DISTINCT id, sentence, tashkeel_sentence, phoneme_ref, phoneme_aug FROM train_rows"
SQL["speaker_splits"] = f"WITH x AS ({CLIPS}) SELECT CASE WHEN speaker = (SELECT min(speaker) FROM x WHERE speaker <> '') THEN 'dev' ELSE 'train' END AS split, count(*) AS rows, count(DISTINCT speaker) AS speakers FROM x GROUP BY 1"
SQL["variant_manifests"] = f"""WITH x AS ({CLIPS}), c AS (SELECT sentence, min(canonical) AS gold, min(CASE WHEN other <> '' THEN other ELSE canonical END) AS auto FROM x GROUP BY sentence), y AS (SELECT gold, auto FROM x JOIN c USING (sentence))
SELECT 'gold' AS variant, count(*) AS rows, sum(length(gold))::BIGINT AS characters FROM y UNION ALL SELECT 'auto', count(*), sum(length(auto))::BIGINT FROM y"""
SQL["word_segments"] = f"""WITH x AS (SELECT id AS file, min(sentence) AS s FROM train_rows WHERE id IS NOT NULL AND sentence IS NOT NULL GROUP BY id),
w AS (SELECT file, unnest({words('s')}) AS w, unnest(range(len({words('s')}))) AS i FROM x), b AS (SELECT file, i, nfc_normalize(w) AS w, starts_with(w, '#') AS b, sum(starts_with(w, '#')::INT) OVER (PARTITION BY file ORDER BY i)::BIGINT AS segment FROM w)
SELECT file, string_agg(w, ' ' ORDER BY i) AS text, segment FROM b WHERE NOT b AND regexp_matches(w, '[\\x{{0621}}-\\x{{064A}}]') GROUP BY file, segment"""
SQL["submitted_answers"] = "WITH x AS (SELECT id, min(tashkeel_sentence) AS b FROM msa_pilot_sample WHERE id IS NOT NULL GROUP BY id), y AS (SELECT id, CASE WHEN b IS NULL THEN 'again' ELSE nfc_normalize(trim(b, ' ')) END AS a FROM x) SELECT id AS file, 1::BIGINT AS item, a AS answer FROM y WHERE a <> ''"
SQL["gold_texts"] = """WITH t AS (SELECT id, max(CASE WHEN split = 'dev' THEN tashkeel_sentence END) AS adj, min(sentence) AS lo, max(sentence) AS hi FROM train_rows WHERE id IS NOT NULL GROUP BY id), w AS (SELECT id FROM t UNION SELECT id FROM msa_pilot_sample WHERE id IS NOT NULL)
SELECT coalesce(adj IS NULL AND lo <> hi, false) AS conflict, adj IS NULL AND lo IS NULL AS missing, count(*) AS ids, sum(length(coalesce(adj, lo, '')))::BIGINT AS characters FROM w LEFT JOIN t USING (id) GROUP BY 1, 2"""
SQL["built_records"] = f"WITH {BLOCK} SELECT id, annotator, condition, condition <> 'blank' AND s IS NOT NULL AS has_suggestion, array_to_string(list_sort(list_distinct([n % 4, n % 3])), ',') AS flagged, CASE WHEN n % 7 = 0 THEN 'unusable' ELSE 'done' END AS status FROM q"
SQL["tag_groups"] = """WITH x AS (SELECT id, min(flags) AS f FROM candidates WHERE id IS NOT NULL AND len(flags) > 0 GROUP BY id),
y AS (SELECT id, array_to_string(list_sort(f), ',') AS tags, unnest([0, 1]) AS w FROM x UNION ALL SELECT id, f[1], 2 FROM x)
SELECT id, tags, string_agg(w::VARCHAR, ',' ORDER BY w) AS words FROM y GROUP BY id, tags"""
SQL["paired_lines"] = f"SELECT row_no, phoneme_ref = CASE WHEN row_no % 2 = 0 THEN said ELSE phoneme_ref END AS equal FROM ({READINGS})"
SQL["held_fractions"] = f"""WITH v AS ({SQL['holdout_filter']}) SELECT split, sum(rows)::BIGINT AS rows, coalesce(sum(rows) FILTER (verdict = 'id'), 0)::BIGINT AS by_id, coalesce(sum(rows) FILTER (verdict = 'phoneme'), 0)::BIGINT AS by_phoneme,
  round(coalesce(sum(rows) FILTER (verdict <> 'keep'), 0) / sum(rows)::DOUBLE, 9) AS held_share FROM v GROUP BY split"""
SQL["skipped_rows"] = f"""SELECT label, CASE WHEN {squeeze("coalesce(sentence_ref, '')")} = '' THEN 'sentence' WHEN {squeeze("coalesce(phoneme_ref, '')")} = '' THEN 'phoneme_ref' END AS skipped, count(DISTINCT row_no) AS ids FROM tts_rows GROUP BY 1, 2"""
SQL["base_rates"] = """WITH x AS (SELECT id, min(lower(trim(stratum, ' '))) AS stratum, max(CASE WHEN NOT isnan(disagreement) THEN disagreement END) AS u FROM msa_pilot_sample WHERE id IS NOT NULL GROUP BY id),
y AS (SELECT stratum, CASE WHEN u > 0.5 THEN 4 WHEN u > 0.25 THEN 1 ELSE 0 END AS strict, CASE WHEN u > 0.5 THEN 3 ELSE 0 END AS lenient FROM x WHERE u IS NOT NULL)
SELECT stratum, count(*) AS utterances, count(*) FILTER (strict > 0) AS strict_utterances, count(*) FILTER (lenient > 0) AS lenient_utterances, 8 * count(*) AS words, sum(strict)::BIGINT AS strict_words, sum(lenient)::BIGINT AS lenient_words, round(sum(strict) / (8.0 * count(*)), 9) AS strict_rate, round(sum(lenient) / (8.0 * count(*)), 9) AS lenient_rate FROM y GROUP BY stratum"""
SQL["halved_batches"] = f"""WITH b AS ({SQL['length_batches']}), g AS (SELECT *, max(n) OVER w AS most, count(*) OVER w AS c, row_number() OVER (PARTITION BY speaker, batch ORDER BY n DESC, row_no) AS i FROM b WINDOW w AS (PARTITION BY speaker, batch))
SELECT row_no, speaker, n, batch FROM g WHERE i <= CASE WHEN most > 60 AND c > 1 THEN c // 2 ELSE c END"""
