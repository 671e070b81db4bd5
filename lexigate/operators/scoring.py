"""Scores and decisions: categories per document/URL, policies per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 70  # percent; the sample policy's value


def doc_keyword_set(hits: DataFrame, id_col: str = "doc_id",
                    key: str = "pattern_id") -> DataFrame:
    """Sorted set of distinct keywords hit per document (bounded by the dictionary)."""
    return hits.groupBy(id_col).agg(F.sort_array(F.collect_set(key)).alias("keywords"))


def hit_sets(occurrences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The distinct patterns that hit each document: one shuffle by document, sets
    combined map-side. The steps from here to a verdict stay on that partitioning."""
    return occurrences.groupBy(id_col).agg(F.collect_set("pattern_id").alias("patterns"))


def hit_categories(hits: DataFrame, index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each distinct hit keyword fans out to every entry of its category list
    (a word listed twice in one category contributes twice)."""
    side = index.select(F.col("iid").alias("pattern_id"), "cat_index")
    return hits.select(id_col, "pattern_id").join(side, "pattern_id")


def category_hits(hit_cats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document and category: number of distinct hit keywords."""
    return hit_cats.groupBy(id_col, "cat_index").agg(F.count(F.lit(1)).alias("hits"))


def url_verdict(cat_hits: DataFrame, totals: DataFrame, subjects: DataFrame,
                id_col: str = "doc_id", threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """One category code per subject (its other columns kept), 0 when none qualifies.

    ``pct = hits * 100 div total_words``; a category qualifies when
    ``pct > threshold``; the highest pct wins, ties go to the smallest code.
    """
    side = totals.select("cat_index", "category", "total_words")
    scored = (cat_hits.join(side, "cat_index")
              .withColumn("pct", F.expr("(hits * 100) div total_words"))
              .filter(F.col("pct") > threshold))
    # Highest pct, then smallest 16-bit code, packed in one long so the
    # aggregate stays a (map-side combined) hash aggregate.
    packed = F.col("pct").cast("long") * 65536 + (65535 - F.col("category"))
    best = (scored.groupBy(id_col).agg(F.max(packed).alias("best"))
            .select(id_col, (65535 - F.col("best") % 65536).cast("int").alias("type")))
    keep = [c for c in subjects.columns if c != "type"]
    return (subjects.select(*keep).join(best, id_col, "left")
            .select(*keep, F.coalesce("type", F.lit(0)).cast("int").alias("type")))


def valid_verdicts(verdicts: DataFrame) -> DataFrame:
    """Only records with a verdict are sent on."""
    return verdicts.filter(F.col("type") != 0)


# -- policies -----------------------------------------------------------------

def policy_hits(occurrences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document and policy: hit events (every occurrence) and group size.

    ``occurrences`` carries ``policy``, ``percent`` and ``content_num``.
    """
    return occurrences.groupBy(id_col, "policy", "percent", "content_num").agg(
        F.count(F.lit(1)).alias("hit_times"))


def policy_percent(hits: DataFrame) -> DataFrame:
    """``hit_times * 100 div content_num`` (integer, may exceed 100)."""
    return hits.withColumn("hit_percent",
                           F.expr("(hit_times * 100) div content_num").cast("bigint"))


def policy_decision(percents: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A document matches when any policy's percent is strictly above its threshold."""
    per_doc = percents.groupBy(id_col).agg(
        F.bool_or(F.col("hit_percent") > F.col("percent")).alias("matched"))
    return (docs.select(id_col).join(per_doc, id_col, "left")
            .select(id_col, F.coalesce("matched", F.lit(False)).alias("matched")))
