"""Verdicts over a dictionary that grows: a task's texts are bounded, whatever the table's size."""

from pyspark.sql import functions as F

from lexigate import session
from lexigate.plans import catalog as K

WORDS = "ab,cd,ef,gh"


def tables_of(spark):
    rows = [(i + 1, str(i), "1", ",".join(WORDS.split(",")[i % 2:][:1 + i % 3])) for i in range(9)]
    return K.dictionary_tables(spark.createDataFrame(rows, "id long, groupid string, grouptype string, keywordlist string"))


def texts_of(spark, n):
    words = F.array(*[F.lit(w) for w in WORDS.split(",")])
    text = F.concat_ws(" ", *[F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3)) > 0,
                                     words[F.pmod(F.col("id") + k, F.lit(4)).cast("int")]) for k in range(4)])
    # some ids are null, some stand for two rows
    doc_id = F.when(F.col("id") % 13 != 0, F.col("id") - F.when(F.col("id") % 7 == 0, 1).otherwise(0))
    return spark.range(n).select(doc_id.alias("doc_id"), text.alias("text"))


def test_dealt_verdicts_equal_the_others(spark, monkeypatch):
    monkeypatch.setattr(session, "DEAL_BYTES", 128)
    tables, texts = tables_of(spark), texts_of(spark, 200)
    usual, dealt = (K.verdicts_with(tables, texts, dealt=d).collect() for d in (False, True))
    assert sorted(map(str, dealt)) == sorted(map(str, usual))
    assert sum(r["type"] != 0 for r in dealt) > 20


def test_tasks_grow_with_the_texts_and_all_steps_stay_there(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "DEAL_BYTES", 64)
    few, many = (texts_of(spark, n) for n in (500, 5000))
    parts = [session.dealt_by_bytes(t, "doc_id", "text").rdd.getNumPartitions() for t in (few, many)]
    assert parts[0] > cores and 9 < parts[1] / parts[0] < 11
    assert session.dealt_by_bytes(few.limit(0), "doc_id", "text").rdd.getNumPartitions() == cores
    plan = K.verdicts_with(tables_of(spark), many, dealt=True)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # texts by their ids, and ids to their verdicts; no step between is dealt anew
    assert sum("doc_id" in line for line in dealt) == 2
    assert all("doc_id" in line or "iid" in line for line in dealt), dealt
