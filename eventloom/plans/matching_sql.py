"""SQL of entity resolution, written from the definitions: ratios of whole joined strings by the full
table of common subsequences, clusters by a recursive walk, merges by ordered picks.

Each part continues a list of common table expressions that starts with records
``n(idx, key, place, start, "end")``.
"""

from __future__ import annotations

_LETTERS = "list_transform(range(1, length({0}) + 1), lambda i: [unicode(substr({0}, i::INTEGER, 1))::BIGINT])"

#: (u, v, common): the longest common subsequence, row by row; numbers are wrapped in lists, as a reduction keeps one type.
_LCS = f"""list_reduce({_LETTERS.format('u')},
      lambda above, c: list_reduce(list_transform(range(1, length(v) + 1), lambda j: [j]),
        lambda done, j: list_append(done, CASE WHEN unicode(substr(v, j[1]::INTEGER, 1)) = c[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], done[-1]) END), [0::BIGINT]),
      list_transform(range(0, length(v) + 1), lambda z: 0::BIGINT))[-1]"""

#: p: pairs that share a block and lie within a day; m(l_idx, r_idx, title_score, venue_score, score).
SCORES = f"""k AS (SELECT idx, key, place, start, "end", unnest(CASE WHEN "end" - start <= 3 THEN list_transform(range(0, ("end" - start) + 1), lambda i: (start + i::INTEGER)::VARCHAR)
    ELSE list_distinct([start::VARCHAR, "end"::VARCHAR, 'long ' || strftime(start, '%Y-%m')]) END) AS b FROM n),
  p AS (SELECT DISTINCT x.idx AS l_idx, y.idx AS r_idx, x.key AS lk, y.key AS rk, x.place AS lp, y.place AS rp
    FROM k x JOIN k y ON x.b = y.b AND x.idx < y.idx AND x.start - 1 <= y."end" AND y.start - 1 <= x."end"),
  w AS (SELECT DISTINCT lk AS a, rk AS b FROM p UNION SELECT DISTINCT lp, rp FROM p),
  t AS (SELECT a, b, list_sort(string_split(a, ' ')) AS sa, list_sort(string_split(b, ' ')) AS sb,
    list_sort(list_intersect(list_distinct(string_split(a, ' ')), string_split(b, ' '))) AS s,
    list_sort(list_filter(list_distinct(string_split(a, ' ')), lambda x: NOT list_contains(string_split(b, ' '), x))) AS dx,
    list_sort(list_filter(list_distinct(string_split(b, ' ')), lambda x: NOT list_contains(string_split(a, ' '), x))) AS dy FROM w),
  g AS (SELECT a, b, len(s) > 0 AS any_common, len(s) > 0 AND (len(dx) = 0 OR len(dy) = 0) AS inside, array_to_string(sa, ' ') AS sa, array_to_string(sb, ' ') AS sb,
    array_to_string(s, ' ') AS s, array_to_string(s || dx, ' ') AS sx, array_to_string(s || dy, ' ') AS sy FROM t),
  q AS (SELECT u, v, CASE WHEN length(u) + length(v) = 0 THEN 1.0::DOUBLE WHEN length(u) = 0 OR length(v) = 0 THEN 0.0 ELSE 2.0::DOUBLE * {_LCS} / (length(u) + length(v)) END AS r
    FROM (SELECT sa AS u, sb AS v FROM g UNION SELECT sx, sy FROM g UNION SELECT s, sx FROM g UNION SELECT s, sy FROM g) z),
  f AS (SELECT g.a, g.b, q1.r AS by_sort, CASE WHEN inside THEN 1.0 ELSE greatest(q2.r, CASE WHEN any_common THEN q3.r ELSE 0 END, CASE WHEN any_common THEN q4.r ELSE 0 END) END AS by_set
    FROM g JOIN q q1 ON q1.u = sa AND q1.v = sb JOIN q q2 ON q2.u = sx AND q2.v = sy JOIN q q3 ON q3.u = s AND q3.v = sx JOIN q q4 ON q4.u = s AND q4.v = sy),
  h AS (SELECT l_idx, r_idx, CASE WHEN lk = '' OR rk = '' THEN 0.0 WHEN lk = rk THEN 1.0 ELSE (ft.by_set + ft.by_sort) / 2 END AS ts,
      CASE WHEN lp = '' OR rp = '' THEN NULL WHEN lp = rp THEN 1.0 ELSE fv.by_set END AS vs,
      least(len(list_distinct(string_split(lk, ' '))), len(list_distinct(string_split(rk, ' ')))) <= 1
        AND list_sort(list_distinct(string_split(lk, ' '))) <> list_sort(list_distinct(string_split(rk, ' '))) AS single
    FROM p JOIN f ft ON ft.a = lk AND ft.b = rk JOIN f fv ON fv.a = lp AND fv.b = rp),
  m AS (SELECT l_idx, r_idx, ts AS title_score, vs AS venue_score, CASE WHEN single OR ts < 0.55 THEN 0.0 WHEN vs < 0.4 THEN 0.75 * (0.72 * ts + 0.28 * vs)
      WHEN ts >= 0.97 THEN 1.0 WHEN vs IS NULL THEN 0.97 * ts ELSE 0.72 * ts + 0.28 * vs END AS score FROM h)"""

#: c(idx, root): the least record that each record reaches over scores of 0.82 and more.
CLUSTERS = SCORES + """,
  d AS (SELECT l_idx AS a, r_idx AS b FROM m WHERE score >= 0.82 UNION ALL SELECT r_idx, l_idx FROM m WHERE score >= 0.82),
  walk(idx, other) AS (SELECT idx, idx FROM n UNION SELECT w.idx, d.b FROM walk w JOIN d ON d.a = w.other),
  c AS (SELECT idx, min(other) AS root FROM walk GROUP BY 1)"""

#: o: records ``r`` (with priority, title, image, is_free, low, raw and what is merged) in the order of their cluster.
MERGE = CLUSTERS + """,
  ranked AS (SELECT r.*, c.root, row_number() OVER (PARTITION BY c.root ORDER BY priority DESC, tidy DESC, (coalesce(venue, '') <> '') DESC,
      (CASE WHEN length(listed) BETWEEN 12 AND 60 THEN 2 WHEN length(listed) <= 90 THEN 1 ELSE 0 END) DESC, r.idx) AS best FROM r JOIN c ON c.idx = r.idx),
  o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY (best = 1) DESC, priority DESC, idx) AS ord, row_number() OVER (PARTITION BY root ORDER BY (best = 1) DESC, idx) AS fold FROM ranked),
  by_source AS (SELECT root, source, min(ord) AS first, arg_min(url, ord) AS url, arg_max(listed, ord) AS listed FROM o GROUP BY ALL)"""
