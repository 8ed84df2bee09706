"""DuckDB SQL of the alignment chain: score matrix and trace back as recursive queries, cell by cell.

Written from the definition of the alignment, without the engine's code: a row of
the matrix is one step of a recursion, its left neighbours a running maximum.
"""

from __future__ import annotations

COUNTS = ("ta", "fr", "fa", "tr", "cd", "ed")


def aligned(pairs: str) -> str:
    """CTEs for pairs(x, y: lists): ap(pid, x, y) and am(pid, xi, yi), the places (from 1) that stand opposite one another."""
    return f"""
ap AS MATERIALIZED (SELECT row_number() OVER () AS pid, x, y FROM (SELECT DISTINCT x, y FROM ({pairs}))),
cells AS (
  SELECT pid, 0 AS i, j, -j AS v, 0 AS w FROM (SELECT pid, unnest(range(len(x) + 1)) AS j FROM ap WHERE x <> y)
  UNION ALL
  SELECT pid, i, j, v, CASE WHEN j = 0 THEN 0 WHEN v = d THEN 1 WHEN v = lag(v) OVER (PARTITION BY pid ORDER BY j) - 1 THEN 2 ELSE 3 END
  FROM (SELECT pid, i, j, d, max(b + j) OVER (PARTITION BY pid ORDER BY j ROWS UNBOUNDED PRECEDING) - j AS v
    FROM (SELECT pid, i, j, d, CASE WHEN j = 0 THEN -i ELSE greatest(d, v - 1) END AS b
      FROM (SELECT c.pid, c.i + 1 AS i, c.j, c.v, lag(c.v) OVER (PARTITION BY c.pid ORDER BY c.j) + CASE WHEN ap.x[c.j] = ap.y[c.i + 1] THEN 1 ELSE -1 END AS d
        FROM cells c JOIN ap USING (pid) WHERE c.i < len(ap.y))))
),
ways AS MATERIALIZED (SELECT pid, i, list(w ORDER BY j) AS w FROM cells WHERE i > 0 GROUP BY pid, i),
trace AS (
  SELECT pid, len(y) AS i, len(x) AS j, 0 AS w, 0 AS mi, 0 AS mj FROM ap WHERE x <> y
  UNION ALL
  SELECT t.pid, CASE WHEN ways.w[t.j + 1] = 2 THEN t.i ELSE t.i - 1 END, CASE WHEN ways.w[t.j + 1] = 3 THEN t.j ELSE t.j - 1 END, ways.w[t.j + 1], t.i, t.j
  FROM trace t JOIN ways ON ways.pid = t.pid AND ways.i = t.i WHERE t.i > 0 AND t.j > 0
),
am AS MATERIALIZED (SELECT pid, mj AS xi, mi AS yi FROM trace WHERE w = 1 UNION ALL SELECT pid, k, k FROM (SELECT pid, unnest(range(1, len(x) + 1)) AS k FROM ap WHERE x = y))"""


def counted(triples: str) -> str:
    """CTEs for triples(c, a, p: lists and further columns): counted = tr with tid and the six counts of each triple."""
    return f"""
tr AS MATERIALIZED (SELECT row_number() OVER () AS tid, * FROM ({triples})),
{aligned("SELECT c AS x, a AS y FROM tr UNION SELECT a, p FROM tr UNION SELECT c, p FROM tr")},
ids AS (SELECT tr.tid, tr.c, tr.a, tr.p, q1.pid AS ca, q2.pid AS ap, q3.pid AS cp FROM tr JOIN ap q1 ON q1.x = tr.c AND q1.y = tr.a JOIN ap q2 ON q2.x = tr.a AND q2.y = tr.p JOIN ap q3 ON q3.x = tr.c AND q3.y = tr.p),
said AS (SELECT tid, c, a, p, ca, ap, unnest(range(1, len(a) + 1)) AS k FROM ids),
s AS (SELECT tid, a[k] AS a, c[m1.xi] AS want, p[m2.yi] AS got FROM said LEFT JOIN am m1 ON m1.pid = ca AND m1.yi = k LEFT JOIN am m2 ON m2.pid = ap AND m2.xi = k),
canon AS (SELECT tid, c, p, ca, cp, unnest(range(1, len(c) + 1)) AS k FROM ids),
g AS (SELECT tid, c[k] AS c, p[m3.yi] AS third FROM canon LEFT JOIN am m3 ON m3.pid = cp AND m3.xi = k ANTI JOIN am m1 ON m1.pid = ca AND m1.xi = k),
one AS (
  SELECT tid, CASE WHEN want = a THEN CASE WHEN got = a THEN 'ta' ELSE 'fr' END WHEN got = a THEN 'cd'
    WHEN want IS NULL THEN CASE WHEN got IS NULL THEN 'fa' ELSE 'ed' END WHEN got = want THEN 'fa' ELSE 'ed' END AS k FROM s
  UNION ALL SELECT tid, CASE WHEN third IS NULL THEN 'cd' WHEN third = c THEN 'fa' ELSE 'ed' END FROM g
),
per AS (SELECT tid, count(*) FILTER (k = 'ta') AS ta, count(*) FILTER (k = 'fr') AS fr, count(*) FILTER (k = 'fa') AS fa, count(*) FILTER (k IN ('cd', 'ed')) AS tr, count(*) FILTER (k = 'cd') AS cd, count(*) FILTER (k = 'ed') AS ed FROM one GROUP BY tid),
counted AS (SELECT tr.*, {", ".join(f"coalesce(per.{k}, 0) AS {k}" for k in COUNTS)} FROM tr LEFT JOIN per USING (tid))"""


def summed(by: str) -> str:
    """A query over counted(by, n, counts): pooled counts by group."""
    return f"SELECT {by}, sum(n)::BIGINT AS utterances, {', '.join(f'sum({k} * n)::BIGINT AS {k}' for k in COUNTS)} FROM counted GROUP BY {by}"


def rates(counts: str, empty: str = "'nan'::DOUBLE") -> str:
    """A query over counts: all its columns and the seven rates."""
    def ratio(n: str, d: str) -> str:
        return f"(CASE WHEN ({d}) <> 0 THEN ({n})::DOUBLE / ({d})::DOUBLE ELSE {empty} END)"

    return f"""SELECT *, {ratio('2 * precision * recall', 'precision + recall')} AS f1, 1 - recall AS far, {ratio('fr', 'fr + ta')} AS frr, {ratio('ed', 'ed + cd')} AS der, {ratio('ta + tr', 'ta + tr + fr + fa')} AS accuracy
FROM (SELECT *, {ratio('tr', 'tr + fr')} AS precision, {ratio('tr', 'tr + fa')} AS recall FROM ({counts}))"""


def shares(rated: str) -> str:
    """A query over rates with zero for empty: the shares of the second convention."""
    ratio = lambda n, d: f"(CASE WHEN ({d}) <> 0 THEN ({n})::DOUBLE / ({d})::DOUBLE ELSE 0 END)"
    parts = [f"{ratio(k, f'{k} + {o}')} AS {k}_share" for k, o in (("ta", "fr"), ("fr", "ta"), ("fa", "tr"), ("tr", "fa"), ("cd", "ed"), ("ed", "cd"))]
    return f"SELECT *, {', '.join(parts)}, 1 - accuracy AS per FROM ({rated})"


def operations(pairs: str, by: str = "") -> str:
    """A WITH query over pairs(x, y, n, by...): reference tokens and columns C, S, D, I by group."""
    key = f"{by}, " if by else ""
    return f"""WITH RECURSIVE src AS MATERIALIZED ({pairs}), {aligned("SELECT x, y FROM src")},
k AS (SELECT ap.pid, count(am.xi) AS m, count(*) FILTER (ap.x[am.xi] = ap.y[am.yi]) AS c FROM ap LEFT JOIN am USING (pid) GROUP BY ap.pid),
o AS (SELECT src.*, len(src.x) AS n_x, k.c, k.m - k.c AS s, len(src.x) - k.m AS d, len(src.y) - k.m AS i FROM src JOIN ap ON ap.x = src.x AND ap.y = src.y JOIN k USING (pid))
SELECT {key}sum(n_x * n)::BIGINT AS tokens, sum(c * n)::BIGINT AS c, sum(s * n)::BIGINT AS s, sum(d * n)::BIGINT AS d, sum(i * n)::BIGINT AS i FROM o {f'GROUP BY {by}' if by else ''}"""
