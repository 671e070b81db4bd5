"""Finished records grouped into bounded batches, and batches split back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.operators.ordinal import group_ordinal

BATCH_RECORDS = 5  # fixed value: records per result message

RECORD_FIELDS = ["method", "dst", "type", "host", "path"]


def verdict_batches(records: DataFrame, key: str = "host", order: str = "req_id",
                    size: int = BATCH_RECORDS) -> DataFrame:
    """Batches of at most ``size`` records, numbered within ``key``.

    Records are numbered inside their key with the range-partitioned ordinal,
    so a key holding a large share of the records is split over many tasks;
    each batch holds at most ``size`` records, so no group is unbounded.
    """
    numbered = group_ordinal(records, [key], [order], "k")
    return (numbered.withColumn("batch", F.expr(f"(k - 1) div {size}"))
            .groupBy(key, "batch")
            .agg(F.array_sort(F.collect_list(F.struct(order, *RECORD_FIELDS))).alias("items"))
            .select(key, F.col("batch").cast("bigint").alias("batch"),
                    F.size("items").alias("n_items"), "items"))


def verdict_batch_rows(batches: DataFrame, order: str = "req_id") -> DataFrame:
    """Every record of every batch again (``inline`` of the item array)."""
    return batches.select("batch", F.inline("items")).select(order, *RECORD_FIELDS)
