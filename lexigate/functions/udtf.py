"""The match table for SQL: ``keyword_matches`` as a view over the texts.

``register_keyword_matches`` binds a text table and a pattern table to a name; SQL
then reads (id, pattern_id, idx, end_idx) like any table, joins it, filters it or
stops at the first match with an aggregate. The rows come from the native matcher,
with case and position rules applied.

``register_match_function`` makes a SQL table function of a pattern table instead, to be
called with LATERAL on any text of any table. Its body is the native key join, which
Spark decorrelates: each different text is matched once and joined back to its rows by
the text itself, so every match is shuffled with its whole text. ``match_by_function``
calls the function on short stretches of the texts instead, so that a match takes only its
stretch along, however long the text is. The view leaves texts in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register_keyword_matches(docs: DataFrame, patterns: DataFrame, name: str = "keyword_matches",
                             id_col: str = "doc_id", text: str = "text") -> str:
    from lexigate.operators.matching import keyword_occurrences
    found = keyword_occurrences(docs, patterns, id_col, text)
    found.select(id_col, "pattern_id", "idx", "end_idx").createOrReplaceTempView(name)
    return name


STRETCH_BYTES = 64  # text bytes that are shuffled with each match
_LETTERS = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def register_match_function(patterns: DataFrame, name: str) -> str:
    """A temporary function ``name(text STRING, at INT DEFAULT NULL)``: TABLE (pattern_id,
    idx, end_idx). With ``at`` the text is a stretch of bytes from that place of a text, and
    places and position rules count from that text's start.

    The patterns are written and named by a view ``{name}_patterns``. Case and position
    rules hold; null and empty texts give no rows. Pieces of a text bound the positions in
    one array, as in the matcher."""
    from lexigate.functions import ascii_fold
    from lexigate.operators.matching import KEY_BYTES, PIECE_BYTES, _pattern_side, _uses
    from lexigate.session import materialize
    spark = patterns.sparkSession
    side = _pattern_side(patterns).select(
        "*", F.encode("pattern", "UTF-8").alias("pb"), F.encode(ascii_fold("pattern"), "UTF-8").alias("pf"))
    side = materialize(side.withColumn("key", F.xxhash64(F.substring("pf", 1, KEY_BYTES))), "function_patterns")
    side.createOrReplaceTempView(f"{name}_patterns")
    _, lengths, longest = _uses(side)
    step = max(PIECE_BYTES, 8 * longest)
    kind = side.schema["pattern_id"].dataType.simpleString()
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING, at INT DEFAULT NULL)
RETURNS TABLE (pattern_id {kind}, idx INT, end_idx INT)
RETURN SELECT p.pattern_id, CAST(a.start + a.place AS INT), CAST(a.start + a.place + p.n AS INT)
FROM (SELECT start + base AS start, b, fb, place, xxhash64(substring(fb, place + 1, size)) AS key
      FROM (SELECT start, base, b, fb, place, explode(array({", ".join(str(int(n)) for n in lengths)})) AS size
            FROM (SELECT start, base, b, fb, explode(sequence(0, least(octet_length(fb), {step}) - 1)) AS place
                  FROM (SELECT start, base, b, encode(translate(decode(b, 'ISO-8859-1'), {_LETTERS}), 'ISO-8859-1') AS fb
                        FROM (SELECT start, base, substring(d, start + 1, {step + longest - 1}) AS b
                              FROM (SELECT d, base, explode(sequence(0, octet_length(d) - 1, {step})) AS start
                                    FROM (SELECT IF(at IS NULL, encode(t, 'UTF-8'), CAST(t AS BINARY)) AS d,
                                                 coalesce(at, 0) AS base) WHERE octet_length(d) > 0)))))
      WHERE place + size <= octet_length(fb)) a
JOIN {name}_patterns p ON a.key = p.key
WHERE substring(a.fb, a.place + 1, p.n) = p.pf
  AND (p.nocase OR substring(a.b, a.place + 1, p.n) = p.pb)
  AND p.offset >= 0 AND p.depth >= 0 AND (p.offset = 0 OR p.offset <= a.start + a.place)
  AND (p.depth = 0 OR p.offset + p.depth >= a.start + a.place + p.n)""")
    return name


def match_by_function(texts: DataFrame, name: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The matches of ``name`` (of ``register_match_function``) in the texts: (id, pattern_id,
    idx, end_idx), by calls on stretches of ``STRETCH_BYTES`` and what the longest pattern
    reaches beyond them; a match is taken from the stretch in which it begins."""
    spark = texts.sparkSession
    longest = spark.table(f"{name}_patterns").agg(F.max("n")).first()[0] or 1
    step = max(STRETCH_BYTES, 8 * longest)
    cut = texts.select(id_col, F.encode(text, "UTF-8").alias("__d")).filter(F.octet_length("__d") > 0).select(
        id_col, "__d", F.explode(F.expr(f"sequence(0, octet_length(__d) - 1, {step})")).alias("__at")).select(
        id_col, "__at", F.expr(f"CAST(substring(__d, __at + 1, {step + longest - 1}) AS STRING)").alias("__part"))
    return spark.sql(f"SELECT c.`{id_col}`, m.* FROM {{c}} c, LATERAL {name}(c.__part, c.__at) m "
                     f"WHERE m.idx < c.__at + {step}", c=cut)
