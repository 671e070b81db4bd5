"""Stream inputs staged as file sources, and queries run to completion.

All folders live under the session's shared checkpoint folder, so a restarted
or re-attempted query finds its offsets and state again. An input arrives in waves:
each wave keeps the partitions it was computed in (one file each), and the query runs
over what is there (``availableNow``) before the next wave is added, always with the
same checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from lexigate.session import new_folder

# Every state partition costs a task and a commit in each micro-batch, also in those without
# rows, and their number is fixed when a query first starts: one for so many bytes of what
# has arrived by then, one for each core at least, the session's shuffle partitions at most.
STATE_BYTES = 4 << 20


def _folder(spark: SparkSession, kind: str, name: str) -> str:
    return new_folder(spark, f"streams/{kind}", name)


class Staged:
    """A file-source folder and the waves that have not arrived yet."""

    def __init__(self, path: str, waves: list[DataFrame]):
        self.path, self.waves = path, list(waves)
        self.schema = waves[0].schema
        self.arrive()

    def arrive(self) -> bool:
        """Write the next wave; False when there is none."""
        if not self.waves:
            return False
        self.waves.pop(0).write.mode("append").parquet(self.path)
        return True


def stage(spark: SparkSession, waves: list[DataFrame], name: str) -> Staged:
    """The waves of a stream input, oldest first; the first is there at once."""
    return Staged(_folder(spark, "in", name), waves)


def read_stream(spark: SparkSession, staged: Staged) -> DataFrame:
    return spark.readStream.schema(staged.schema).parquet(staged.path)


def state_partitions(spark: SparkSession, staged: tuple[Staged, ...]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    arrived = 0
    for s in staged:
        place = jvm.org.apache.hadoop.fs.Path(s.path)
        arrived += place.getFileSystem(conf).getContentSummary(place).getLength()
    wanted = max(spark.sparkContext.defaultParallelism, math.ceil(arrived / STATE_BYTES))
    return min(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _started(spark: SparkSession, query: DataStreamWriter, staged: tuple[Staged, ...]) -> StreamingQuery:
    """The query, started with ``state_partitions`` (one that goes on keeps its own); it
    takes a copy of the session's settings then, so they are put back at once."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions(spark, staged)))
    try:
        return query.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def _run(start: Callable, staged: tuple[Staged, ...]) -> None:
    while True:
        start().awaitTermination()
        if not any([s.arrive() for s in staged]):
            return


def run_to_parquet(stream: DataFrame, name: str, *staged: Staged, mode: str = "append") -> str:
    """Run a stream over all waves of its inputs into a parquet sink; return its path."""
    spark = stream.sparkSession
    out, chk = _folder(spark, "out", name), _folder(spark, "chk", name)
    _run(lambda: _started(spark, stream.writeStream.format("parquet").option("path", out)
                          .option("checkpointLocation", chk).outputMode(mode).trigger(availableNow=True), staged),
         staged)
    return out


def run_to_state(stream: DataFrame, name: str, *staged: Staged) -> str:
    """Run a stream over all waves for its state: the checkpoint folder, which other
    queries read between waves too. Its rows are written and left alone."""
    chk, target = _folder(stream.sparkSession, "chk", name), _folder(stream.sparkSession, "out", name)
    _run(lambda: _started(stream.sparkSession, stream.writeStream.format("parquet").option("path", target)
                          .option("checkpointLocation", chk).trigger(availableNow=True), staged), staged)
    return chk


def run_foreach_batch(stream: DataFrame, name: str, fn: Callable[[DataFrame, int], None],
                      *staged: Staged) -> None:
    chk = _folder(stream.sparkSession, "chk", name)
    _run(lambda: _started(stream.sparkSession, stream.writeStream.foreachBatch(fn)
                          .option("checkpointLocation", chk).trigger(availableNow=True), staged), staged)


def run_hops(first: DataFrame, then: Callable[[DataFrame], DataFrame], name: str, *staged: Staged,
             fn: Callable[[DataFrame, int], None] | None = None) -> tuple[str, str | None]:
    """Two queries in a row: the first writes a table, the second reads it as a stream.
    After each wave both run over what is there, each with its own checkpoint. ``then``
    builds the second query anew each time, so static tables it reads are those of now.
    Returns both output folders (the second is None with ``fn``, which takes its batches)."""
    spark = first.sparkSession
    between, chk = _folder(spark, "out", f"{name}-frames"), _folder(spark, "chk", f"{name}-frames")
    out, then_chk = (None if fn else _folder(spark, "out", name)), _folder(spark, "chk", name)
    while True:
        _started(spark, first.writeStream.format("parquet").option("path", between)
                 .option("checkpointLocation", chk).trigger(availableNow=True), staged).awaitTermination()
        second = then(spark.readStream.schema(first.schema).parquet(between)).writeStream
        second = second.foreachBatch(fn) if fn else second.format("parquet").option("path", out)
        _started(spark, second.option("checkpointLocation", then_chk).outputMode("append")
                 .trigger(availableNow=True), staged).awaitTermination()
        if not any([s.arrive() for s in staged]):
            return between, out


def output_folder(spark: SparkSession, name: str) -> str:
    return _folder(spark, "out", name)
