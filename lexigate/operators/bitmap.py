"""A bitmap of 64-bit hashes: a broadcast of fixed size that tells most rows without a
partner from the others before a shuffle. A false hit costs a shuffled row, never a result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigate.session import materialize

MAX_BITS = 27  # log2 of the bits: 16 MiB


def _place(hashed: Column, bits: int) -> Column:
    return F.pmod(hashed, F.lit(1 << bits)) + 1


def hash_bitmap(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(bitmap rows, log2 of its bits) of a column of hashes: 16 bits for each, up to
    ``MAX_BITS``. One row per 4 KiB."""
    bits = min(MAX_BITS, max(15, (16 * keys.count()).bit_length()))
    place = _place(F.col(column), bits)
    made = (keys.groupBy(F.bitmap_bucket_number(place).alias("__bm_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bm_bits")))
    # 1,024 numbers of 32 bits each: a test is one look-up and a shift
    words = F.expr("transform(sequence(0, 1023), w -> cast(conv(hex(substring(__bm_bits, 4 * w + 1, 4)), 16, 10) AS BIGINT))")
    return materialize(made.select("__bm_bucket", words.alias("__bm_words")), "bitmap"), bits


def hash_bits(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """(bytes of the bitmap, log2 of its bits) for a test inside tasks: 256 bits for each key,
    up to ``MAX_BITS``. Bit ``h mod 2**bits`` is bit ``% 8`` of byte ``// 8``."""
    bits = min(MAX_BITS, max(15, (256 * keys.count()).bit_length()))
    place = _place(F.col(column), bits)
    made = (keys.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")))
    table = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for row in made.collect():  # 4 KiB each
        table[(row["bucket"] - 1) << 12:row["bucket"] << 12] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


def in_bitmap(rows: DataFrame, column: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """The rows whose hash is (or collides with one) in the bitmap."""
    place = _place(F.col(column), bits)
    placed = rows.withColumn("__bm_own", F.bitmap_bucket_number(place)).withColumn(
        "__bm_at", F.bitmap_bit_position(place).cast("int"))
    # bytes are in order within a number, so its highest byte has the lowest places
    hit = F.expr("shiftright(get(__bm_words, cast(__bm_at div 32 AS INT)), (__bm_at % 32) ^ 24) & 1 = 1")
    return placed.join(F.broadcast(bitmap), F.col("__bm_own") == F.col("__bm_bucket")).filter(hit).select(*rows.columns)
