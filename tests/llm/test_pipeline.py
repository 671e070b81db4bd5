"""The pipeline against its operators' brute-force versions, and its registration."""

import re

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from lexigate.llm.queries import QUERIES
from .test_simhash import plain_fingerprint, roots

SF_SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF_SMALL).cache())
        assert seen[-1].columns == columns
    rows = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen]
    verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op1_quality_rules"][0](spark, SF_SMALL).collect()}
    assert set(rows[1]) == {d for d, kept in verdict.items() if kept}
    assert set(rows[2]) == set(rows[1])
    ids = sorted(rows[2])
    fps = [plain_fingerprint(rows[2][d]) for d in ids]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert set(rows[3]) == {ids[r] for r in roots(len(ids), near)}
    items = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    plain = [" ".join(re.findall(r"\w+", t.lower())) for t in items]
    for d, t in rows[3].items():
        words = f" {' '.join(re.findall(r'\w+', t.lower()))} "
        if any(f" {p} " in words for p in plain):
            assert d not in rows[4]
    for a, b in zip(rows[2:], rows[3:]):
        assert all(a[d] == t for d, t in b.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF_SMALL).collect()
    assert {r["doc_id"] for r in packed} == set(rows[4])
    assert np.sum([r["start"] == 0 for r in packed]) == len(rows[4])


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1


def test_stages_take_odd_rows_and_none(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, SF_SMALL).count() > 0
        assert stage(spark, no_docs, SF_SMALL).count() == 0
