"""Texts as ordered byte chunks, and matching that continues across chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigate.functions import position_rule
from lexigate.operators.matching import byte_occurrences
from lexigate.session import materialize

CHUNK_BYTES = 1024


def content_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   size: int = CHUNK_BYTES) -> DataFrame:
    """``(resource_id, seq, data BINARY)``: the UTF-8 bytes cut every ``size``
    bytes (a cut may split a character); empty texts give no chunk."""
    b = docs.select(F.col(id_col).alias("resource_id"), F.encode(text, "UTF-8").alias("b"))
    return (b.filter(F.octet_length("b") > 0)
            .select("resource_id", F.posexplode(F.expr(
                f"transform(sequence(0, (octet_length(b) - 1) div {size}), "
                f"i -> substring(b, i * {size} + 1, {size}))")).alias("seq", "data"))
            .select("resource_id", F.col("seq").cast("int").alias("seq"), "data"))


def chunk_stitch(chunks: DataFrame, patterns: DataFrame, boundary: str = "stitch",
                 min_chunk_bytes: int = 1) -> DataFrame:
    """Hits over a resource's chunks as if the search state were carried.

    Hits inside a chunk are found where the chunk is. For those that began earlier, only
    the edges of chunks travel: their first and last ``max_len - 1`` bytes, joined on
    (resource, seq + 1), so a resource with a third of all chunks is dealt to all tasks.
    Where chunks may be shorter than that (``min_chunk_bytes``; 1 = any chunking), the
    last bytes first reach over 2, 4, 8, ... chunks, each step a join of the edges with
    themselves. A chunk that is not there ends the reach, as it does in a stream.

    ``idx`` is relative to the chunk in which the hit ends (negative when the hit began
    earlier), and position rules count from there. ``boundary='strict'`` drops
    case-sensitive hits that began in an earlier chunk.
    """
    longest = patterns.agg(F.max(F.octet_length("pattern"))).first()[0] or 1
    tail = max(longest - 1, 0)
    inside = byte_occurrences(chunks.select("resource_id", "seq", "data"), patterns, "data")
    found = inside
    if tail:
        found = inside.unionByName(_crossing(chunks, patterns, tail, min_chunk_bytes))
    hits = found.filter(position_rule())
    if boundary == "strict":
        hits = hits.filter((F.col("idx") >= 0) | F.col("nocase"))
    return hits.select("resource_id", "seq", "pattern_id", "idx", "end_idx")


def _last_bytes(data: Column, n: int) -> Column:
    return F.when(F.octet_length(data) > n, F.substring(data, -n, n)).otherwise(data)


def _crossing(chunks: DataFrame, patterns: DataFrame, tail: int, min_chunk_bytes: int) -> DataFrame:
    """Hits that began in an earlier chunk than the one they end in."""
    key = ["resource_id", "seq"]
    edges = materialize(chunks.select(*key, F.substring("data", 1, tail).alias("head"),
                                      _last_bytes(F.col("data"), tail).alias("last")), "chunk-edges")
    # ``full``: the bytes are those of ``step`` chunks, none of them missing.
    reach = edges.select(*key, "last", F.lit(True).alias("full"))
    step, needed = 1, -(-tail // max(1, min_chunk_bytes))
    while step < needed:
        earlier = reach.select("resource_id", (F.col("seq") + step).alias("seq"), F.col("last").alias("more"),
                               F.col("full").alias("more_full"))
        joined = reach.join(earlier, key, "left")
        longer = _last_bytes(F.concat(F.coalesce("more", F.lit(b"")), F.col("last")), tail)
        reach = joined.select(*key, F.when(F.col("full"), longer).otherwise(F.col("last")).alias("last"),
                              (F.col("full") & F.coalesce("more_full", F.lit(False))).alias("full"))
        step *= 2
    before = reach.select("resource_id", (F.col("seq") + 1).alias("seq"), F.col("last").alias("carried"))
    buffers = edges.join(before, key).select(*key, F.octet_length("carried").alias("shift"),
                                             F.concat("carried", "head").alias("buffer"))
    found = byte_occurrences(buffers, patterns, "buffer").filter(
        (F.col("idx") < F.col("shift")) & (F.col("end_idx") > F.col("shift")))
    return found.withColumn("idx", F.col("idx") - F.col("shift")).withColumn(
        "end_idx", F.col("end_idx") - F.col("shift")).drop("shift")
