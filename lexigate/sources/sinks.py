"""Sinks for verdicts (batch and stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def verdict_sink(verdicts: DataFrame, path: str, mode: str = "append",
                 partition_by: list[str] | None = None) -> None:
    """Write finished verdict records (only those with a verdict) as parquet."""
    out = verdicts.filter("type <> 0")
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
