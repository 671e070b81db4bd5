"""Places of texts whose bytes may be a pattern's, found by numpy inside tasks.

Every byte position has one window for each pattern length in use; its hash over the
ASCII-folded bytes is looked up in a bitmap of the patterns' hashes (at most
``bitmap.MAX_BITS``). Windows beyond ``HEAD`` bytes are hashed only where their first
``HEAD`` bytes are in the bitmap too. What is sent on for joining is the window's own
bytes once a text: a false hit of the bitmap costs a row, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigate.functions import ascii_fold
from lexigate.operators.bitmap import hash_bits

HEAD = 8  # bytes in one number
SCAN_BYTES = 1 << 19  # text bytes looked at together
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x51_7CC1B7 + 0x2545F491)) * _M1
    x ^= x >> np.uint64(31)
    x *= _M2
    return x ^ (x >> np.uint64(29))


def _folded(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 97) & (b <= 122), b - np.uint8(32), b)  # as ``ascii_fold``


def _numbers(rows: np.ndarray) -> np.ndarray:
    """Equal long rows of bytes as rows of 64-bit numbers, the last one filled with zeros."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // HEAD) * HEAD), dtype=np.uint8)
    wide[:, :rows.shape[1]] = rows
    return wide.view("<u8")


def _hashed(numbers: np.ndarray, n: int) -> np.ndarray:
    h = _mixed(numbers[:, 0], n)
    for k in range(1, numbers.shape[1]):
        h = _mixed(h ^ numbers[:, k], k)
    return h


def _with(rows: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*rows.schema.fields, *[T.StructField(name, kind) for name, kind in more.items()]])


def pattern_keys(side: DataFrame, column: str) -> DataFrame:
    """``side`` with ``__pkey``, the hash of a BINARY column's (folded) bytes, none empty,
    and ``__phead``, that of the first ``HEAD`` bytes of a longer one (else null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column).to_pylist()
            sizes = np.array([len(v) for v in values], dtype=np.int64)
            keys, heads = (np.zeros(len(values), dtype=np.uint64) for _ in range(2))
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                numbers = _numbers(np.frombuffer(b"".join(values[i] for i in own), np.uint8).reshape(-1, n))
                keys[own], heads[own] = _hashed(numbers, n), _hashed(numbers[:, :1], 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys.view(np.int64)), pa.array(heads.view(np.int64), mask=sizes <= HEAD)],
                names=[*batch.schema.names, "__pkey", "__phead"])
    return side.mapInArrow(run, _with(side, __pkey=T.LongType(), __phead=T.LongType()))


class Scan:
    """The windows that ``keyed`` patterns (``n``, ``__pkey``, ``__phead``) may match."""

    def __init__(self, keyed: DataFrame):
        found = keyed.agg(F.sort_array(F.collect_set("n"))).first()[0]
        self.lengths = [int(n) for n in found] or [1]
        self.table, self.bits = hash_bits(keyed.select(F.explode(F.array("__pkey", "__phead")).alias("__k")).filter(
            "__k IS NOT NULL"), "__k")

    def held(self, h: np.ndarray) -> np.ndarray:
        place = h & np.uint64((1 << self.bits) - 1)
        return self.table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1

    def windows(self, pieces: list[tuple[np.ndarray, int, int, int]]) -> Iterator[tuple]:
        """Of ``pieces`` (bytes, own, text, after: windows begin in the first ``own`` bytes and
        end behind byte ``after``; those of a text in order) and for each length: (hash, bytes,
        text, piece, place in it, new) of the first place of every different window of a text,
        equal windows together, ``new`` at the first of them."""
        b = np.concatenate([p[0] for p in pieces])
        sizes = np.array([len(p[0]) for p in pieces])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        at = np.arange(len(b))
        left = np.repeat(ends, sizes) - at
        left[at >= np.repeat(begins + np.array([p[1] for p in pieces]), sizes)] = 0
        least = np.repeat(begins + np.array([p[3] for p in pieces]), sizes) - at  # a window ends behind it
        text = np.array([p[2] for p in pieces])
        b = np.append(b, np.zeros(max(self.lengths) + HEAD, dtype=np.uint8))
        fb, size = _folded(b), int(ends[-1])
        number, ready, heads = np.zeros(size, dtype=np.uint64), 0, None
        for n in self.lengths:
            while ready < min(n, HEAD):
                number |= fb[ready:ready + size].astype(np.uint64) << np.uint64(8 * ready)
                ready += 1
            if n <= HEAD:
                h = _mixed(number, n)
                spot = np.flatnonzero(self.held(h) & (left >= n) & (least < n))
                h = h[spot]
            else:
                if heads is None:
                    heads = np.flatnonzero(self.held(_mixed(number, 0)) & (left > HEAD))
                spot = heads[(left[heads] >= n) & (least[heads] < n)]
                h = _hashed(_numbers(sliding_window_view(fb, n)[spot]), n)
                keep = self.held(h)
                spot, h = spot[keep], h[keep]
            if not len(spot):
                continue
            cut = sliding_window_view(b, n)[spot]
            numbers = _numbers(cut)
            order = np.lexsort(numbers.T)  # stable: equal windows stay in the order of texts
            numbers, piece = numbers[order], np.searchsorted(ends, spot[order], side="right")
            new = np.append(True, (numbers[1:] != numbers[:-1]).any(axis=1))
            first = new | np.append(True, text[piece][1:] != text[piece][:-1])
            order, piece = order[first], piece[first]
            yield h[order], cut[order], text[piece], piece, spot[order] - begins[piece], new[first]


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _pieces(data: pa.Array, longest: int, after: list[int] | None = None,
            groups: list[int] | None = None) -> Iterator[list[tuple]]:
    """The texts of a batch as pieces of at most ``SCAN_BYTES``, as many together (of one group)."""
    held, size, group = [], 0, None
    for i, value in enumerate(data):
        raw = value.as_py()
        if not raw:
            continue
        if held and (size >= SCAN_BYTES or (groups and groups[i] != group)):
            yield held
            held, size = [], 0
        group = groups[i] if groups else None
        whole = np.frombuffer(raw, np.uint8)
        for start in range(0, len(whole), SCAN_BYTES):
            if start and size >= SCAN_BYTES:
                yield held
                held, size = [], 0
            own = min(SCAN_BYTES, len(whole) - start)
            held.append((whole[start:start + own + longest - 1], own, i, (after[i] if after else 0) - start, start))
            size += own
    if held:
        yield held


def grouped_windows(rows: DataFrame, group: str, id_col: str, data: str, keyed: DataFrame) -> DataFrame:
    """(``group``, ``__key``, ``__w``, ``__ids``): the windows of the texts (BINARY ``data``) of a
    group with the ids of the texts that have them; rows of a group should follow each other.
    A group may have several rows of one window."""
    scan = Scan(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups = batch.column(id_col), batch.column(group).to_pylist()
            for held in _pieces(batch.column(data), max(scan.lengths), groups=groups):
                for h, cut, text, _, _, new in scan.windows([p[:4] for p in held]):
                    at = np.flatnonzero(new)
                    offsets = pa.array(np.append(at, len(text)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), groups[held[0][2]], np.int64)), pa.array(h[at].view(np.int64)),
                         _binary(cut[at]), pa.ListArray.from_arrays(offsets, ids.take(pa.array(text)))],
                        names=[group, "__key", "__w", "__ids"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(group, id_col, data).mapInArrow(run, f"`{group}` long, __key long, __w binary, __ids array<{kind}>")


def first_windows(rows: DataFrame, data: str, after: str, keyed: DataFrame) -> DataFrame:
    """The columns of ``rows`` but ``data`` with ``__key``, ``__w`` and ``idx``: the different
    windows of each row's BINARY ``data`` that end behind byte ``after``, at their first
    places (a text beyond ``SCAN_BYTES`` may name a later place too)."""
    scan = Scan(keyed)
    others = [c for c in rows.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in _pieces(batch.column(data), max(scan.lengths), after=batch.column(after).to_pylist()):
                start = np.array([p[4] for p in held])
                found = [(text, h, place + start[piece], cut) for h, cut, text, piece, place, _ in scan.windows(
                    [p[:4] for p in held])]
                if not found:
                    continue
                text, h, idx = (np.concatenate([f[k] for f in found]) for k in range(3))
                order = np.argsort(text, kind="stable")  # a text's windows together
                own = pa.array(text[order])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(own) for c in others], pa.array(h[order].view(np.int64)),
                     pa.concat_arrays([_binary(f[3]) for f in found]).take(pa.array(order)),
                     pa.array(idx[order].astype(np.int64))], names=[*others, "__key", "__w", "idx"])

    return rows.mapInArrow(run, _with(rows.select(*others), __key=T.LongType(), __w=T.BinaryType(), idx=T.LongType()))


def same_bytes(window: str = "__w") -> Column:
    """Whether a window is the pattern (``__p``, or ``__pf`` of a folded one), under the case rule."""
    folded = F.encode(ascii_fold(F.decode(F.col(window), "ISO-8859-1")), "ISO-8859-1")
    return F.when(F.col("nocase"), folded == F.col("__pf")).otherwise(F.col(window) == F.col("__p"))
