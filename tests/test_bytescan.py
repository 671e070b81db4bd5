"""Windows of bytes found by numpy: the hits are those of the key join, in far fewer rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexigate.operators import bytescan as B
from lexigate.operators import matching as M
from lexigate.streaming import operators as SO

PATTERNS = "pattern_id long, pattern string, nocase boolean"


def words(spark, rng):
    rows = ["a", "E", "he", "héh", "\x00a", "a\x00", "abcdefgh", "abcdefghi", "ABCDEFGHI", "éééééé", "x" * 256, "tail", "edge"]
    rows += ["".join(rng.choice("abE é") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    return spark.createDataFrame([(i, w, i % 3 == 0) for i, w in enumerate(rows + rows[:20])], PATTERNS)


def texts(rng):
    some = ["", None, "abcdefghi ABCDEFGHI abcdEFGHI", "a\x00a", "x" * 300, "éééééééé hÉh"]
    some += ["".join(rng.choice("abeE é") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    at = B.SCAN_BYTES - 2  # over the end of a piece
    some.append("." * at + "edge" + "." * (B.SCAN_BYTES - 4) + "tailabcdefghi")
    return some


def test_grouped_hits_are_those_of_the_keys(spark):
    rng = random.Random(41)
    ids = [1, 1, None, None, 2]  # ids repeat or are null
    docs = spark.createDataFrame([(ids[i] if i < len(ids) else i, t) for i, t in enumerate(texts(rng))],
                                 "doc_id long, text string").repartition(3)
    docs = docs.unionByName(docs.filter("doc_id = 2 OR doc_id IS NULL"))
    pats = words(spark, rng)
    want = sorted(map(str, M.keyword_hits(docs, pats).collect()))
    got = sorted(map(str, M.keyword_hits(docs, pats, strategy="anchor").collect()))
    assert got == want and len(got) > 500
    named = docs.select(F.col("doc_id").cast("string").alias("name"), "text")
    assert M.keyword_hits(named, pats, "name", strategy="anchor").count() == len(want)
    assert M.keyword_hits(docs, pats.limit(0), strategy="anchor").count() == 0
    assert M.keyword_hits(docs.limit(0), pats, strategy="anchor").count() == 0


def test_a_window_is_shuffled_once_a_group(spark, monkeypatch):
    """Texts with the same words: rows for the words of a group, not for each text's."""
    made = []
    real = M.grouped_windows
    monkeypatch.setattr(M, "grouped_windows", lambda *a: made.append(real(*a)) or made[-1])
    pats = spark.createDataFrame([(i, f"word{i}", False) for i in range(50)], PATTERNS)
    docs = spark.createDataFrame([(d, " ".join(f"word{i}" for i in range(50))) for d in range(800)],
                                 "doc_id long, text string")
    assert M.keyword_hits(docs, pats, strategy="anchor").count() == 800 * 50
    groups = made[0].select("__group").distinct().count()
    assert made[0].count() <= 60 * groups < 800 * 50 / 20


def test_frames_name_first_places_only(spark):
    """A word said often in a frame is one row, and the first place of each pattern in each
    frame is that of all hits, with position rules and patterns over ``ANCHOR_BYTES`` too."""
    rng = random.Random(43)
    rows = [(1, "frame", 0, 0, b"he " * 300, 5), (1, "frame", 1, 2, b"e he he HE", 5), (2, "end", 4, 0, None, 5),
            (3, "frame", 0, 0, b"", 5), (3, "frame", 1, 3, b"abcdefghi abcdefghi", 5), (4, "frame", 0, 0, b"q" * 700, 5)]
    for i in range(20):
        data = "".join(rng.choice("abeE é") for _ in range(rng.randint(1, 200))).encode()
        rows.append((10 + i, "frame", 0, rng.randint(0, len(data) // 2), data, 5))
    frames = spark.createDataFrame([(r, k, q, s, d and bytearray(d), b) for r, k, q, s, d, b in rows],
                                   "resource_id long, kind string, seq int, shift int, data binary, began_ms long")
    pats = words(spark, rng).select("*", F.lit(0).alias("offset"), F.lit(0).alias("depth")).unionByName(
        spark.createDataFrame([(500, "he", False, 3, 6), (501, "q" * 300, True, 0, 0)], PATTERNS + ", offset int, depth int"))
    heads, _ = M.alike_patterns(pats)
    every, first = SO.frame_hits(frames, heads), SO.first_frame_hits(frames, heads)

    def least(hits):
        return sorted(map(str, hits.groupBy("resource_id", "seq", "began_ms", "pattern_id").agg(F.min("idx")).collect()))
    assert least(first) == least(every) and len(least(first)) > 100
    he = heads.filter("pattern = 'he' AND offset = 0 AND NOT nocase")
    said = frames.filter("resource_id = 1 AND seq = 0")
    assert SO.frame_hits(said, he).count() == 300 and SO.first_frame_hits(said, he).count() == 1
    assert SO.first_frame_hits(frames, heads.limit(0)).count() == 0


def test_places_in_order():
    rng = np.random.default_rng(7)
    seq, idx = rng.integers(0, 1 << 31, 1000), rng.integers(-(1 << 31), 1 << 31, 1000)
    place = SO._place(seq, idx)
    assert [p.tolist() for p in SO._seq_idx(place)] == [seq.tolist(), idx.tolist()] and place.min() > SO.SEEN
    assert (np.argsort(place, kind="stable") == np.lexsort((idx, seq))).all()
    hits = np.column_stack([rng.integers(0, 5, 1000), rng.integers(0, 9, 1000), place])
    kept = SO._first_of_each(hits)
    assert {tuple(k[:2]): k[2] for k in kept.tolist()} == {
        pair: min(h[2] for h in hits.tolist() if tuple(h[:2]) == pair) for pair in {tuple(h[:2]) for h in hits.tolist()}}
