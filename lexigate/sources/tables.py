"""Readers for the input tables (one parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one table; naming the columns lets the scan read only those."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", *(columns or ("page_id", "url", "html")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as a TIMESTAMP instant (stored as TIMESTAMP_NTZ, read as
    UTC wall-clock time whatever the session time zone)."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    utc = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("ts")).cast("timestamp")
    return (read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
            .withColumn("ts", utc))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark", "item_id", "text")
