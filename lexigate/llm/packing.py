"""Best-fit packing of token sequences: bounded-space online best-fit.

Documents become token ids followed by the end id. Only longer ones are cut, from
the end, into full pieces; the first piece takes the remainder. Pieces are dealt to
tasks by a hash and arrive in hash order, in blocks of ``BINS`` sorted longest
first. Each task keeps at most ``BINS`` open bins in a bitset keyed by free space:
the lowest set bit at or above a piece's length is its best fit; when there are too
many open bins, the fullest closes. Memory is bounded by the number of bins, and a
repeated task gives the same rows (its input is sorted).

Defined cases: null text is empty (one piece, the end id alone); repeated rows are
packed as often as they occur; a null doc_id is carried; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigate.llm.common import stored
from lexigate.llm.tokens import Vocabulary, default_vocabulary, slices

CAPACITY = 1024
END_ID = 2
BINS = 4096
PIECES_PER_TASK = 200_000


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids as little-endian unsigned 32-bit."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Vocabulary(path)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for a, b in slices(texts):
                keys = batch.column("doc_id").slice(a, b - a)
                ids, counts = encoder.encode(texts.slice(a, b - a), end_id)
                rows, piece, start, length = [], [], [], []
                for row, n in enumerate(counts.tolist()):
                    at = 0
                    for k, size in enumerate(cut_lengths(n, capacity)):
                        rows.append(row), piece.append(k), start.append(at), length.append(size)
                        at += size
                ends = np.cumsum(np.array(length, dtype=np.int64)) * 4
                raw = pa.Array.from_buffers(pa.binary(), len(length), [
                    None, pa.py_buffer(np.append(0, ends).astype(np.int32)),
                    pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), raw],
                    names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


class OpenBins:
    """Open bins by free space; ``place`` gives (bin, offset) of the next piece."""

    def __init__(self, capacity: int, bins: int):
        self.capacity, self.limit = capacity, bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, space: int) -> int:
        found = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            space, found = self.capacity, self.made
            self.made += 1
        if left := space - length:
            self.free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return found, self.capacity - space


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, bins: int = BINS) -> list[tuple[int, int]]:
    """(bin, offset) of each length in arrival order."""
    packer = OpenBins(capacity, bins)
    return [packer.place(n) for n in lengths]


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, bins: int = BINS,
                     pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``pieces`` (doc_id, piece, length, more) with ``sequence_id`` and ``offset``."""
    tasks = max(1, math.ceil(pieces.count() / pieces_per_task))
    order, names = F.xxhash64("doc_id", "piece"), pieces.columns
    dealt = (pieces.withColumn("__order", order).repartition(tasks, "__order")
             .withColumn("__task", F.spark_partition_id().cast("long"))
             .sortWithinPartitions("__order", *names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = OpenBins(capacity, bins)
        for batch in batches:
            for a in range(0, batch.num_rows, bins):
                block = batch.slice(a, bins)
                lengths = block.column("length").to_numpy()
                order = np.argsort(-lengths, kind="stable")
                placed = np.array([packer.place(n) for n in lengths[order].tolist()], dtype=np.int64)
                block = block.take(pa.array(order))
                task = block.column("__task").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [block.column(c) for c in names]
                    + [pa.array((task << 36) + placed[:, 0]), pa.array(placed[:, 1])],
                    names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, bins: int = BINS) -> DataFrame:
    """Pieces with their ids and places: (doc_id, piece, start, length, ids, sequence_id, offset)."""
    pieces = stored(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return assign_sequences(pieces, capacity, bins)


def pack_digest(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                end_id: int = END_ID, bins: int = BINS) -> DataFrame:
    """As ``pack`` with the CRC-32 of each piece's ids in their place, so that the ids
    themselves are neither written nor shuffled."""
    pieces = token_pieces(docs, vocabulary, capacity, end_id).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return assign_sequences(stored(pieces, "pieces"), capacity, bins)
