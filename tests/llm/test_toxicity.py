"""Toxicity: segments against all intervals, held-out accuracy, defined cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexigate.llm import toxicity
from lexigate.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def by_all_intervals(scores):
    """All maximal-scoring segments: the best interval, then the same on both sides."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or (total, i - j) > (best[2], best[0] - best[1] + 1)):
                best = (i, j + 1, total)
    if best is None:
        return []
    s, e, _ = best
    right = [(a + e, b + e, x) for a, b, x in by_all_intervals(scores[e:])]
    return by_all_intervals(scores[:s]) + [best] + right


def test_segments_against_all_intervals():
    rng = random.Random(2)
    for _ in range(800):
        drift = rng.choice([3, 17, 64]) / 64  # sums of such numbers are exact
        weights = [rng.choice([0, 0, 0, 1, 2, 4, -1, -2]) * rng.randint(1, 50) / 16 for _ in range(rng.randint(0, 25))]
        got = toxicity.segments(weights, drift)
        want = by_all_intervals([w - drift for w in weights])
        assert [round(x[2], 9) for x in got] == [round(x[2], 9) for x in want]
        assert all(round(sum(weights[s:e]) - drift * (e - s), 9) == round(x, 9) for s, e, x in got)


def test_isotonic_pools_falling_neighbours():
    at, p = toxicity.isotonic([(0.0, 10, 1), (1.0, 10, 0), (2.0, 10, 5), (3.0, 4, 4)])
    assert at == [0.0, 1.0, 2.0, 3.0] and p == [0.05, 0.05, 0.5, 1.0]


def test_held_out_accuracy(spark):
    found = QUERIES["op13_toxicity"][0](spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    clean, toxic = ([r for r in held if r["toxic"] == t] for t in (0, 1))
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.fixture(scope="module")
def model():
    return toxicity.Model({"scum": 6.0, "vil*": 3.0, "fine": -1.0}, 0.02, {}, 0.0, [-25.0, 0.0, 5.0], [0.0, 0.2, 1.0])


def test_stems_spans_and_discount(model):
    weights = toxicity.Weights(model.of_feature)
    assert [weights[t] for t in ("scum", "vilest", "vi", "fine", "other")] == [6.0, 3.0, 0.0, -1.0, 0.0]
    assert toxicity.discounted(["scum", "a", "scum", "fine", "fine"], weights) == [6.0, 0.0, 3.0, -1.0, -1.0]


def test_odd_documents(spark, odd_docs, no_docs, model):
    scored = toxicity.score(odd_docs, model).collect()
    assert len(scored) == odd_docs.count()
    floor = {r["score"] for r in scored if not (r["doc_id"] or 9) > 3}
    assert floor == {0.0}  # null, empty, blank
    assert toxicity.score(no_docs, model).collect() == []
    text = "İ word " + "calm " * 50 + "SCUM vilest Scum " + "calm " * 50 + "scum " * 2
    row = toxicity.score(spark.createDataFrame([(1, text)], "score_of long, text string"), model).first()
    assert [text[p["start"]:p["end"]].lower().split()[0] for p in row["passages"]] == ["scum"]
    assert row["value"] > 0 and row["n_above"] >= 1
    long_text = spark.createDataFrame([("calm " * 2_000_000 + "scum vile villain vilest",)], "text string")
    found = toxicity.score(long_text, model).first()  # read to its end
    assert found["passages"] == [] and -5 < found["value"] < 5  # chance grows with the length


def test_training_cases(spark, no_docs):
    labels = "doc_id long, toxic int"
    assert toxicity.train(no_docs, spark.createDataFrame([], labels)) == toxicity.Model()
    assert toxicity.score(no_docs, toxicity.Model()).collect() == []
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (None, "same text"), (3, None), (1, "same text"),
                                  (4, "other"), (6, "one more")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1), (4, None), (5, 1), (6, 0)], labels)
    learned = toxicity.learnable(docs, marks).collect()
    assert sorted((r["text"], r["toxic"]) for r in learned) == [("one more", False), ("same text", True)]
    one_class = toxicity.train(docs, marks.filter("toxic = 1"))
    assert toxicity.score(docs, one_class).agg(F.max("score")).first()[0] == 0.0
