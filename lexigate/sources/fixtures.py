"""Small fixed tables: keyword dictionaries, patterns and policies.

Each table exists twice: as a Spark DataFrame (a local relation, broadcast
side of the match joins) and as a SQL ``VALUES`` list for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written: results and goldens depend on them)
# ---------------------------------------------------------------------------

# Category dictionary in the `urlkeyword` shape: id, groupid, grouptype, keywordlist.
WORD_DICTIONARY_ROWS = [
    (1, 55, 2, "hers,his,she,he"),
    (2, 10, 1, "eaux,the,license"),
    (3, 13, 1, "he,example.com,the"),
]

# The sample dictionary of the original service, same shape.
SAMPLE_URLKEYWORD_ROWS = [
    (1, 55, 2, "王菲,狗仔,艳照"),
    (2, 10, 1, "百度,好友,浏览器"),
    (3, 13, 1, "王菲,好友,人人"),
]

# Policies (`keyword_group`): id, name, percent, comment.
POLICY_ROWS = [
    (1, "test", 70, "for test"),
    (2, "legal", 0, "any hit"),
    (3, "fr", 200, "suffixes"),
]

# Policy keywords (`keyword`): id, group_name, keyword.
POLICY_KEYWORD_ROWS = [
    (1, "test", "hers"),
    (2, "test", "his"),
    (3, "test", "she"),
    (4, "test", "he"),
    (5, "legal", "license"),
    (6, "legal", "copyright"),
    (7, "fr", "eaux"),
    (8, "fr", "aux"),
    (9, "fr", "eau"),
]

# Patterns with case and position settings:
# pattern_id, pattern, nocase, offset, depth, policy.
PATTERN_ROWS = [
    (1, "hers", False, 0, 0, "test"),
    (2, "his", False, 0, 0, "test"),
    (3, "she", False, 0, 0, "test"),
    (4, "he", False, 0, 0, "test"),
    (5, "The", True, 0, 0, "caps"),
    (6, "THE", False, 0, 0, "caps"),
    (7, "eaux", True, 0, 0, "fr"),
    (8, "license", True, 0, 400, "legal"),
    (9, "example.com", False, 0, 0, "web"),
    (10, "he", False, 100, 0, "test"),
    (11, "she", False, -1, 0, "test"),
    (12, "Is", False, 0, 2, "caps"),
]

# ---------------------------------------------------------------------------

URLKEYWORD_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("groupid", T.StringType(), True),
    T.StructField("grouptype", T.StringType(), True),
    T.StructField("keywordlist", T.StringType(), True),
])

POLICY_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("percent", T.IntegerType(), False),
    T.StructField("comment", T.StringType(), True),
])

POLICY_KEYWORD_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("group_name", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
])

PATTERN_SCHEMA = T.StructType([
    T.StructField("pattern_id", T.IntegerType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("nocase", T.BooleanType(), False),
    T.StructField("offset", T.IntegerType(), False),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("policy", T.StringType(), False),
])


def _as_text_dictionary(rows):
    # Dictionary cells arrive as text, like the SQL store returns them.
    return [(i, str(g), str(t), k) for i, g, t, k in rows]


def word_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_as_text_dictionary(WORD_DICTIONARY_ROWS), URLKEYWORD_SCHEMA)


def sample_urlkeyword(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_as_text_dictionary(SAMPLE_URLKEYWORD_ROWS), URLKEYWORD_SCHEMA)


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY_ROWS, POLICY_SCHEMA)


def policy_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY_KEYWORD_ROWS, POLICY_KEYWORD_SCHEMA)


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERN_ROWS, PATTERN_SCHEMA)


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows, columns, types=None) -> str:
    """``SELECT`` over a ``VALUES`` list with named (and optionally cast) columns."""
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(
        f"CAST(c{i} AS {types[i]}) AS {c}" if types else f"c{i} AS {c}"
        for i, c in enumerate(columns))
    names = ", ".join(f"c{i}" for i in range(len(columns)))
    return f"SELECT {cols} FROM (VALUES {body}) AS v({names})"


WORD_DICTIONARY_SQL = values_sql(
    _as_text_dictionary(WORD_DICTIONARY_ROWS), ["id", "groupid", "grouptype", "keywordlist"],
    ["BIGINT", "VARCHAR", "VARCHAR", "VARCHAR"])
POLICY_SQL = values_sql(POLICY_ROWS, ["id", "name", "percent", "comment"],
                        ["INTEGER", "VARCHAR", "INTEGER", "VARCHAR"])
POLICY_KEYWORD_SQL = values_sql(POLICY_KEYWORD_ROWS, ["id", "group_name", "keyword"],
                                ["INTEGER", "VARCHAR", "VARCHAR"])
PATTERN_SQL = values_sql(PATTERN_ROWS, ["pattern_id", "pattern", "nocase", "offset", "depth",
                                        "policy"],
                         ["INTEGER", "VARCHAR", "BOOLEAN", "INTEGER", "INTEGER", "VARCHAR"])
