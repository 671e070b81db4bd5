"""Session helpers: building a local session, checkpoint folder, stored tables."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEAL_BYTES = 4 << 20  # text bytes of one task where what it makes of them is many times that


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lexigate") -> SparkSession:
    """A local session configured like the tests and the benchmark.

    On a cluster the session comes from the platform; this is only used for
    local runs, which is also the only place we set a checkpoint folder.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the setting names a shared folder and is used as is; it must be
    set, since a machine-local folder would not survive an executor loss. Only a
    local-mode session (tests, benchmark) without the setting gets a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster is a cluster
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    base = os.environ.get("TMPDIR", "/tmp")
    path = tempfile.mkdtemp(prefix="lexigate-ckpt-", dir=base)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def local_copy(df: DataFrame) -> DataFrame:
    """The rows of a fixed, hand-written list as a local relation (Spark knows its size
    and broadcasts it). Not for tables that grow with the data."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


_FOLDERS: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, kind: str, name: str) -> str:
    """A new folder below the shared checkpoint folder, noted for ``release``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def holds(spark: SparkSession, path: str) -> bool:
    """Whether a folder of this session has not been released."""
    return path in _FOLDERS.get(spark.sparkContext.applicationId, [])


def release(spark: SparkSession) -> int:
    """Delete every folder made so far in this session: written tables, stream inputs,
    sinks and checkpoints. To be called when their results have been consumed, since
    a DataFrame over a written table reads it when it runs. Returns how many went."""
    paths = _FOLDERS.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` once as a table in the shared checkpoint
    folder and scan it (one job; a reliable RDD checkpoint would compute it twice)."""
    path = new_folder(df.sparkSession, "tables", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan over the cores when it has fewer splits than there are cores (a
    small table in one row group reads as one task). Large inputs have many splits
    and are left alone, so a big table is never shuffled for this; the rows and the
    method that follows are the same either way.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def dealt_by_bytes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt by ``key`` to as many partitions as ``DEAL_BYTES`` of text each ask (one a
    core at least; a number given is not coalesced). Reads one sum of the texts."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / DEAL_BYTES)), key)
