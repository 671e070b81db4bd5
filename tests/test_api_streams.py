"""Object interface, and stream state carried over several micro-batches."""

from pyspark.sql import functions as F

from lexigate.api import KeywordMatcher
from lexigate.streaming import operators as SO
from lexigate.streaming import runner
from lexigate.sources import tables

from conftest import SF_SMALL


def test_matcher_interface(spark):
    words = spark.createDataFrame([(1, "hers"), (2, "his"), (3, "she"), (4, "he")],
                                  "id int, word string")
    docs = spark.createDataFrame([(0, "she says ushers"), (1, "nothing")],
                                 "doc_id long, text string")
    m = KeywordMatcher(spark).add_patterns(words, "id", "word")
    assert m.count() == 4
    assert sorted(map(tuple, m.hits(docs).collect())) == [(0, 1), (0, 3), (0, 4)]
    assert [r.doc_id for r in m.any(docs).collect()] == [0]
    assert [r.doc_id for r in m.none(docs).collect()] == [1]
    first = m.first(docs).collect()
    # "she"@0 and "he"@1 both end at byte 3; ties go to the shorter pattern
    assert [(r.pattern_id, r.idx) for r in first] == [(4, 1)]


def test_watermark_dedup_keeps_one_per_key(spark):
    ev = tables.events(spark, SF_SMALL)
    staged = runner.stage(spark, [ev], "events_dedup")
    stream = runner.read_stream(spark, staged)
    kept = SO.inflight_dedup_watermark(stream, ["user_id", "event_type"], "ts", "3650 days")
    got = spark.read.parquet(runner.run_to_parquet(kept, "dedup_watermark", staged))
    assert got.count() == ev.select("user_id", "event_type").distinct().count()
    assert got.select("user_id", "event_type").distinct().count() == got.count()
