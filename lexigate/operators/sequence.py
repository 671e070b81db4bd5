"""Order-dependent views of the match events of one text.

Events are ordered by end position, then length, then pattern id. All windows
here are partitioned by the text: one text is one bounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("end_idx", "n", "pattern_id")


def match_order(occ: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Position of each event in the text's match order (1-based)."""
    w = Window.partitionBy(id_col).orderBy(*ORDER)
    return occ.withColumn("seq", F.row_number().over(w))


def first_match(occ: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The event a stopping callback sees: the first in match order (an aggregate,
    combined map-side, no window)."""
    first = occ.groupBy(id_col).agg(F.min(F.struct(*ORDER, "idx")).alias("m"))
    return first.select(id_col, F.col("m.pattern_id").alias("pattern_id"),
                        F.col("m.idx").alias("idx"), F.col("m.end_idx").alias("end_idx"))


def policy_trigger(occ: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per (text, policy): the first event whose running percent passes the threshold.

    Running percent after m events is ``m * 100 div content_num``; the trigger is
    the smallest such m, so it is the m-th event: no running frame is needed,
    only the event's rank within (text, policy).
    """
    w = Window.partitionBy(id_col, "policy").orderBy(*ORDER)
    ranked = occ.withColumn("m", F.row_number().over(w))
    return (ranked.filter(F.expr("(m * 100) div content_num > percent")
                          & (F.col("m") == F.expr(
                              "((percent + 1) * content_num + 99) div 100")))
            .select(id_col, "policy", "pattern_id", "idx", "end_idx",
                    F.col("m").cast("bigint").alias("events"),
                    F.expr("(m * 100) div content_num").cast("bigint").alias("running_percent")))


def hits_before_repeat(occ: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Distinct keywords seen before the first repeated keyword in match order
    (the search of a buffer stops when a keyword is seen again)."""
    w = Window.partitionBy(id_col, "pattern_id").orderBy(*ORDER)
    nth = occ.withColumn("nth", F.row_number().over(w))
    stop = (nth.filter(F.col("nth") == 2).groupBy(id_col)
            .agg(F.min(F.struct(*ORDER)).alias("stop")))
    firsts = nth.filter(F.col("nth") == 1).join(stop, id_col, "left")
    before = firsts.filter(F.col("stop").isNull()
                           | (F.struct(*ORDER) < F.col("stop")))
    return before.select(id_col, "pattern_id", "idx")


def collapse_repeat_hits(occ: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Report a match position only when its set of ending patterns differs from
    the previous reported one (consecutive repeats collapse)."""
    at_end = occ.groupBy(id_col, "end_idx").agg(
        F.array_sort(F.collect_list("pattern_id")).alias("hit_set"))
    w = Window.partitionBy(id_col).orderBy("end_idx")
    return (at_end.withColumn("prev", F.lag("hit_set").over(w))
            .filter(F.col("prev").isNull() | (F.col("prev") != F.col("hit_set")))
            .select(id_col, "end_idx", "hit_set"))
