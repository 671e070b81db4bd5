"""Searches that stop at a text's first match: any, none and the first event.

Rounds over growing stretches of the texts. Round ``r`` looks for the matches that end
in its stretch of bytes, in the texts that no earlier round has settled and that reach
so far; a text is settled by its first match. Each stretch is ``GROWTH`` times longer
than all before it, so there are about log(length) rounds, a text without a match is
read to its end, and one with an early match costs its first stretch only.

Stretches cut by where a match *ends*, as the first event is the one that ends first
(then the shorter, then the smaller id); each reaches back by the longest pattern less
one byte. Texts stay where they are: what goes to the tasks is a bitmap of the ids still
open (at most 16 MiB). An id that only collides with an open one is read again, which
never changes a result. Each round is written, and the rounds run when called, since
the next one depends on them.

Defined cases: null and empty texts have no match; a repeated id is one id, with the first
event over its texts; a null id is never settled (it is read to its end), is not among the
documents with a match and is among those without, as in the other searches; no patterns,
no match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.functions import position_rule
from lexigate.operators.bitmap import hash_bitmap, in_bitmap
from lexigate.operators.matching import byte_occurrences
from lexigate.operators.sequence import ORDER
from lexigate.session import materialize

STRETCH = 2048  # bytes of the first round
GROWTH = 4


def _stretch(docs: DataFrame, id_col: str, text: str, low: int, high: int, longest: int) -> DataFrame:
    """(id, ``__data``) of the bytes in which matches that end in (low, high] lie."""
    start = max(0, low - longest + 1)
    long_enough = docs.filter(F.octet_length(text) > low)
    return long_enough.select(id_col, F.expr(
        f"substring(encode(`{text}`, 'UTF-8'), {start + 1}, {high - start})").alias("__data"))


def first_events(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text: str = "text",
                 stretch: int = STRETCH, growth: int = GROWTH) -> DataFrame:
    """(id, pattern_id, idx, end_idx): the first event of every text that has one."""
    longest = patterns.agg(F.max(F.octet_length("pattern"))).first()[0] or 1
    sizes = materialize(docs.select(id_col, F.octet_length(text).alias("size")).filter("size > 0"), "sizes")
    most = sizes.agg(F.max("size")).first()[0] or 0
    low, high, rounds, opened = 0, stretch, [], None
    while low < most or not rounds:
        rows = _stretch(docs, id_col, text, low, high, longest)
        if opened is not None:
            rows = in_bitmap(rows.withColumn("__id", F.xxhash64(id_col)), "__id", *opened).drop("__id")
        start = max(0, low - longest + 1)
        found = (byte_occurrences(rows, patterns, "__data")
                 .withColumn("idx", F.col("idx") + start).withColumn("end_idx", F.col("end_idx") + start)
                 .filter(F.col("end_idx") > low).filter(position_rule()))
        rounds.append(materialize(found.groupBy(id_col).agg(F.min(F.struct(*ORDER, "idx")).alias("m")), "round"))
        still = sizes.filter(F.col("size") > high)
        for done in rounds:
            still = still.join(done.select(id_col), id_col, "left_anti")
        still = materialize(still.select(F.xxhash64(id_col).alias("__id")), "open")
        if still.isEmpty():
            break
        opened = hash_bitmap(still, "__id")
        low, high = high, high * growth
    events = rounds[0]
    for more in rounds[1:]:
        events = events.unionByName(more)
    first = events.groupBy(id_col).agg(F.min("m").alias("m"))
    return first.select(id_col, F.col("m.pattern_id").alias("pattern_id"), F.col("m.idx").alias("idx"),
                        F.col("m.end_idx").alias("end_idx"))


def any_match_docs(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with a match, each read only as far as its first one."""
    return docs.join(first_events(docs, patterns, id_col, text).select(id_col), id_col, "left_semi")


def no_match_docs(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without a match (a null id is never matched to one, so it stays)."""
    return docs.join(first_events(docs, patterns, id_col, text).select(id_col), id_col, "left_anti")
