"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"

_FEATURES = rf"""
base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
rep AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY doc_id),
feat AS (
  SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM feat)
"""

QUALITY_RULES = rf"""
WITH {_FEATURES},
ratios AS (
  SELECT doc_id, lang, source, base_failed, unnest([
    {{'k': 'symbols', 'v': 1000 * n_symbols // greatest(word_chars, 1), 'events': n_symbols}},
    {{'k': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1), 'events': n_dup_lines}},
    {{'k': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1), 'events': n_repeat_words // 6}},
    {{'k': 'letters', 'v': 100 * word_chars // greatest(n_words, 1), 'events': NULL}}]) AS r
  FROM judged),
vals AS (
  SELECT doc_id, lang, source, base_failed, r.k AS k, r.v AS v, r.events AS events,
         CASE WHEN r.k IN ('symbols', 'letters') THEN 900 ELSE 990 END AS top,
         (r.v // (1::BIGINT << greatest(length(bin(r.v)) - 6, 0)::BIGINT))
           * (1::BIGINT << greatest(length(bin(r.v)) - 6, 0)::BIGINT) AS bucket
  FROM ratios),
own_rank AS (
  SELECT lang, source, k, bucket, top,
         row_number() OVER (PARTITION BY lang, source, k ORDER BY bucket) AS rn,
         count(*) OVER (PARTITION BY lang, source, k) AS size
  FROM vals WHERE NOT base_failed),
own AS (
  SELECT lang, source, k, min(CASE WHEN 4 * rn >= size THEN bucket END) AS q1,
         min(CASE WHEN 2 * rn >= size THEN bucket END) AS q2,
         min(CASE WHEN 4 * rn >= 3 * size THEN bucket END) AS q3,
         min(CASE WHEN 1000 * rn >= top * size THEN bucket END) AS tail,
         min(CASE WHEN 1000 * rn >= (1000 - top) * size THEN bucket END) AS low_tail, max(size) AS size
  FROM own_rank GROUP BY lang, source, k),
lang_rank AS (
  SELECT lang, k, bucket, top, row_number() OVER (PARTITION BY lang, k ORDER BY bucket) AS rn,
         count(*) OVER (PARTITION BY lang, k) AS size
  FROM vals WHERE NOT base_failed),
whole AS (
  SELECT lang, k, min(CASE WHEN 4 * rn >= size THEN bucket END) AS q1,
         min(CASE WHEN 2 * rn >= size THEN bucket END) AS q2,
         min(CASE WHEN 4 * rn >= 3 * size THEN bucket END) AS q3,
         min(CASE WHEN 1000 * rn >= top * size THEN bucket END) AS tail,
         min(CASE WHEN 1000 * rn >= (1000 - top) * size THEN bucket END) AS low_tail
  FROM lang_rank GROUP BY lang, k),
quart AS (
  SELECT o.lang, o.source, o.k,
         CASE WHEN o.size >= 100 THEN o.q1 ELSE w.q1 END AS q1,
         CASE WHEN o.size >= 100 THEN o.q2 ELSE w.q2 END AS q2,
         CASE WHEN o.size >= 100 THEN o.q3 ELSE w.q3 END AS q3,
         CASE WHEN o.size >= 100 THEN least(o.tail, greatest(o.q3, w.tail)) ELSE w.tail END AS tail,
         CASE WHEN o.size >= 100 THEN greatest(o.low_tail, least(o.q1, w.low_tail)) ELSE w.low_tail END AS low_tail,
         CASE o.k WHEN 'letters' THEN 32 ELSE 10 END AS least_spread
  FROM own o JOIN whole w ON o.lang IS NOT DISTINCT FROM w.lang AND o.k = w.k),
bounds AS (
  SELECT lang, source, k,
         CASE WHEN q3 > q1 THEN q1 - 3 * greatest(q3 - q1, least_spread)
              ELSE low_tail - 3 * greatest(q2 - low_tail, least_spread) END AS lo,
         CASE WHEN q3 > q1 THEN q3 + 3 * greatest(q3 - q1, least_spread)
              ELSE tail + 3 * greatest(tail - q2, least_spread) END AS hi
  FROM quart),
bad AS (
  SELECT v.doc_id, bool_or((v.v > b.hi AND coalesce(v.events > 3, TRUE))
                          OR (v.k = 'letters' AND v.v < b.lo)) AS out
  FROM vals v JOIN bounds b ON v.lang IS NOT DISTINCT FROM b.lang
       AND v.source IS NOT DISTINCT FROM b.source AND v.k = b.k
  GROUP BY v.doc_id)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT coalesce(bad.out, FALSE)) AS kept
FROM judged j LEFT JOIN bad ON j.doc_id = bad.doc_id
"""

LINE_DEDUP = r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT rid) >= 5)
SELECT y.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE f.k IS NOT NULL AND y.doc_id IS DISTINCT FROM f.last_doc)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (WHERE f.k IS NULL OR y.doc_id IS NOT DISTINCT FROM f.last_doc), '')) AS kept_sha256
FROM keyed y LEFT JOIN frequent f ON y.k = f.k
GROUP BY y.rid, y.doc_id
"""
