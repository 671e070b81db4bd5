"""Strategy parity and chunk parity on the driver's data."""

from pyspark.sql import functions as F

from lexigate.operators import chunks as C
from lexigate.operators import matching as M
from lexigate.sources import derived, fixtures

from conftest import SF_SMALL


def test_strategies_agree(spark):
    docs = derived.docs(spark, SF_SMALL)
    pats = fixtures.patterns(spark)
    res = {s: sorted(map(tuple, M.keyword_hits(docs, pats, strategy=s).collect()))
           for s in M.STRATEGIES}
    assert res["contains"] == res["regex"] == res["keys"]
    assert len(res["contains"]) > 0


def test_counts_equal_occurrences(spark):
    docs = derived.docs(spark, SF_SMALL)
    pats = fixtures.patterns(spark)
    occ = (M.keyword_occurrences(docs, pats).groupBy("doc_id", "pattern_id")
           .agg(F.count(F.lit(1)).alias("occurrences")))
    cnt = M.occurrence_counts(docs, pats)
    assert sorted(map(tuple, occ.collect())) == sorted(map(tuple, cnt.collect()))


def test_chunks_equal_whole_text(spark):
    docs = derived.docs(spark, SF_SMALL)
    pats = fixtures.patterns(spark).filter("offset = 0 AND depth = 0")
    whole = M.raw_occurrences(docs, pats).select(
        "doc_id", "pattern_id", ((F.col("end_idx") - 1) / 1024).cast("int").alias("seq"),
        (F.col("idx") - ((F.col("end_idx") - 1) / 1024).cast("int") * 1024).alias("idx"))
    for size in (1024, 7):
        ch = C.content_chunks(docs, size=size)
        got = C.chunk_stitch(ch, pats, min_chunk_bytes=size).select(
            "resource_id", "pattern_id", "seq", "idx")
        if size == 1024:
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
        else:  # small chunks: hits span several earlier chunks; count must match
            assert got.count() == whole.count()
