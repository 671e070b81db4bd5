"""State partitions of streams follow what has arrived, not the session's shuffle partitions."""

import os

import pytest
from pyspark.sql import functions as F

from lexigate.streaming import operators as SO
from lexigate.streaming import runner

KEY = "spark.sql.shuffle.partitions"


def run_chunks(spark):
    rows = spark.range(40).select(F.col("id").alias("resource_id"), F.lit(0).alias("seq"),
                                  F.lit(b"abc").alias("data"), F.timestamp_seconds("id").alias("ts"))
    more = rows.withColumn("seq", F.lit(1))
    staged = runner.stage(spark, [rows, more], "partitions")
    frames = SO.framed_chunks(runner.read_stream(spark, staged), 3, 3600, "1 day")
    chk = runner.run_to_state(frames, "partitions", staged)
    state = chk.removeprefix("file:") + "/state/0"
    return sum(p.isdigit() for p in os.listdir(state))


@pytest.mark.parametrize("piece", [4 << 20, 1, 1 << 9])
def test_a_small_stream_has_a_state_partition_per_core(spark, monkeypatch, piece):
    usual, cores = spark.conf.get(KEY), spark.sparkContext.defaultParallelism
    spark.conf.set(KEY, str(cores + 3))
    monkeypatch.setattr(runner, "STATE_BYTES", piece)
    try:
        # many bytes for one partition: a core each; few: the session's number, no more
        assert run_chunks(spark) == (cores if piece > 1 << 9 else cores + 3)
        assert spark.conf.get(KEY) == str(cores + 3)
    finally:
        spark.conf.set(KEY, usual)
