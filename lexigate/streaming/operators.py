"""Streaming operators.

Native where Spark has the operator (stateless filters, watermark de-dup,
session windows, stream-stream outer join, micro-batches); keyed Python state
(``applyInPandasWithState``) only for what must be read in order: the bytes carried
from chunk to chunk, and in-flight holds with explicit release. Matching itself is the
native key join, in a second query over the frames that the first one writes (Spark
allows no second stateful operator behind keyed Python state).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from lexigate.functions import position_rule
from lexigate.operators import requests as R
from lexigate.operators.matching import byte_occurrences, first_occurrences, short_free


def stream_requests(payloads: DataFrame) -> DataFrame:
    """Captured payloads to URL requests, continuously (stateless)."""
    return R.request_length_guard(R.http_request_extract(R.http_get_filter(payloads)))


def inflight_dedup_watermark(stream: DataFrame, key: Sequence[str], ts: str,
                             hold: str) -> DataFrame:
    """Suppress repeats of a key for ``hold`` after its first sighting (native)."""
    return stream.withWatermark(ts, hold).dropDuplicatesWithinWatermark(list(key))


# Keyed Python state pays some milliseconds for every key of every micro-batch, so a key is
# a bucket of resources (or of request keys), and memory is that of one bucket. Not to be
# changed for a checkpoint.
BUCKETS = 512


def _bucket(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).alias("bucket")


# Rows wait in state as JSON; this keeps their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _in_time_order(stream: DataFrame, key: Sequence[str], ts: str, hold_seconds: int, watermark: str,
                   cols: Sequence[str], rank: Column, tie: str | None, decide) -> DataFrame:
    """The rows of each key that ``decide`` admits, read in time order whatever the
    micro-batches they came in.

    A row waits in state until the watermark has passed it: no earlier row can come any
    more. Rows are then read by (time, ``rank``, ``tie``, row). ``decide(since, t, rank)``
    gives (since, admitted), where ``since`` is the time in microseconds at which the key
    went in flight, or None; it lapses after ``hold_seconds``. Keys are kept in ``BUCKETS``
    states by hash; state is bounded by the rows within the watermark's delay and the keys
    in flight. Rows without a time are not read, nor those at 1970-01-01 or before, where
    Spark's first watermark stands.
    """
    key = list(key)
    hold_us = hold_seconds * 1_000_000
    names = [f"__k{i}" for i in range(len(key))]
    key_type = T.StructType([T.StructField(n, stream.schema[c].dataType) for c, n in zip(key, names)])
    schema = T.StructType([f for f in stream.schema.fields if f.name in set(cols)])
    keys = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in zip(key, names)]), _JSON)
    rows = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark).select(
        _bucket(*key), keys.alias("__key"), F.col(ts).alias("__ts"),
        F.unix_micros(ts).alias("__us"), rank.cast("int").alias("__rank"),
        (F.coalesce(F.col(tie).cast("long"), F.lit(0)) if tie else F.lit(0)).cast("long").alias("__tie"),
        F.to_json(F.struct(*schema.names), _JSON).alias("__row"))
    # One entry per key of the bucket in ``key`` and ``since``, per waiting row in the last five;
    # ``typed`` stays empty and tells ``inflight_keys`` the types.
    state_schema = T.StructType([T.StructField("typed", T.ArrayType(key_type)),
                                 T.StructField("key", T.ArrayType(T.StringType())),
                                 T.StructField("since", T.ArrayType(T.LongType())),
                                 T.StructField("us", T.ArrayType(T.LongType())),
                                 T.StructField("rank", T.ArrayType(T.LongType())),
                                 T.StructField("tie", T.ArrayType(T.LongType())),
                                 T.StructField("row", T.ArrayType(T.StringType())),
                                 T.StructField("row_key", T.ArrayType(T.StringType()))])

    def step(k, batches, state):
        since: dict[str, int | None] = {}
        waiting = []
        if state.exists:
            _, known, at, *held = state.get
            since, waiting = dict(zip(known, at)), list(zip(*held))
        for pdf in batches:
            waiting.extend(zip(*(pdf[c].tolist() for c in ("__us", "__rank", "__tie", "__row", "__key"))))
        waiting.sort()
        now = state.getCurrentWatermarkMs()
        admitted, read = [], 0
        for us, rank_, _, row, own in waiting:
            if us > now * 1000:
                break
            read += 1
            since[own], admit = decide(since.get(own), us, rank_)
            if admit:
                admitted.append(row)
        waiting = waiting[read:]
        since = {own: at for own, at in since.items() if at is not None and at + hold_us > now * 1000}
        if since or waiting:
            state.update(([], list(since), list(since.values()), *([int(w[i]) for w in waiting] for i in range(3)),
                          *([w[i] for w in waiting] for i in (3, 4))))
            wake = min([*(at + hold_us for at in since.values()), *(w[0] for w in waiting[:1])])
            state.setTimeoutTimestamp(max(wake // 1000, now + 1))
        elif state.exists:
            state.remove()
        if admitted:
            yield pd.DataFrame({"row": admitted})

    kept = (rows.groupBy("bucket").applyInPandasWithState(
        step, T.StructType([T.StructField("row", T.StringType())]), state_schema, "append",
        GroupStateTimeout.EventTimeTimeout))
    return kept.select(F.from_json("row", schema, _JSON).alias("r")).select("r.*")


def inflight_hold(stream: DataFrame, key: Sequence[str], ts: str, hold_seconds: int,
                  watermark: str, tie: str | None = None) -> DataFrame:
    """Admit a request unless its key is in flight; a key is in flight for
    ``hold_seconds`` after its admission (then completed and released).

    Requests are read in time order (``tie`` breaks ties), each once the watermark has
    passed it, so the result does not depend on micro-batches.
    """
    hold_us = hold_seconds * 1_000_000

    def decide(since, t, rank):
        admit = since is None or t >= since + hold_us
        return (t if admit else since), admit

    return _in_time_order(stream, key, ts, hold_seconds, watermark, stream.columns, F.lit(0), tie, decide)


def inflight_until_done(stream: DataFrame, key: Sequence[str], ts: str, max_hold_seconds: int,
                        watermark: str, kind: str = "kind", tie: str | None = "req_id") -> DataFrame:
    """Requests and completions of URL keys in one stream (``kind`` is
    ``'request'`` or ``'done'``). A request is admitted when its key is not in
    flight; it puts the key in flight until a completion of that key arrives,
    or until ``max_hold_seconds`` pass (the fetch gave up). A completion releases
    only a fetch that began before it. At equal times a completion is applied first.
    Emits the admitted requests. Rows are read in time order, as in ``inflight_hold``.
    """
    hold_us = max_hold_seconds * 1_000_000

    def decide(since, t, rank):
        if rank == 0:  # a completion
            return (None if since is not None and t > since else since), False
        admit = since is None or t >= since + hold_us
        return (t if admit else since), admit

    rank = F.when(F.col(kind) == "done", 0).otherwise(1)
    return _in_time_order(stream, key, ts, max_hold_seconds, watermark,
                          [c for c in stream.columns if c != kind], rank, tie, decide)


# -- matching over chunks ---------------------------------------------------------

FRAME_SCHEMA = T.StructType([
    T.StructField("resource_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("shift", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("began_ms", T.LongType()),
])
FINISHED_SCHEMA = T.StructType([T.StructField("resource_id", T.LongType()),
                                T.StructField("part", T.IntegerType()),
                                T.StructField("began_ms", T.LongType()),
                                T.StructField("patterns", T.ArrayType(T.LongType()))])
CHUNK_HIT_SCHEMA = T.StructType([
    T.StructField("resource_id", T.LongType()),
    T.StructField("pattern_id", T.LongType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("idx", T.IntegerType()),
])
PARTS = 4  # a resource's hits are dealt over this many states


def inflight_keys(spark: SparkSession, checkpoint: str, key: Sequence[str], hold_seconds: int,
                  batch_id: int | None = None) -> DataFrame:
    """The keys in flight in a stream of ``inflight_hold`` or ``inflight_until_done``, from
    the state in its checkpoint (of the last finished micro-batch, or ``batch_id``): the
    ``key`` columns, ``since`` and ``until`` (when the hold lapses: state keeps a lapsed key
    until the watermark has passed that). The stream may go on meanwhile. Keys with only
    rows that wait for the watermark are not in flight yet."""
    read = spark.read.format("statestore")
    if batch_id is not None:
        read = read.option("batchId", batch_id)
    state = read.load(checkpoint).select("value.groupState.*")
    types = state.schema["typed"].dataType.elementType
    state = (state.select(F.inline(F.arrays_zip("key", "since")))
             .select(F.from_json("key", types, _JSON).alias("key"), F.timestamp_micros("since").alias("since")))
    return state.select(*[F.col(f"key.__k{i}").alias(k) for i, k in enumerate(key)], "since",
                        (F.col("since") + F.make_dt_interval(secs=F.lit(hold_seconds))).alias("until"))


def framed_chunks(chunks: DataFrame, max_pattern_bytes: int, idle_seconds: int, watermark: str,
                  horizon_seconds: int = 7 * 86400) -> DataFrame:
    """Each resource's chunks in order, framed with the bytes before them, for native
    matching (``frame_hits``). No pattern is held in state.

    State per resource: the last ``max_pattern_bytes - 1`` bytes, the next sequence
    number, and chunks that came early; they are numbered from 0. Resources are kept in
    ``BUCKETS`` states by hash. When the resource has
    been idle for ``idle_seconds`` (the watermark has passed its last chunk by that much),
    chunks still held go out across the gap, without the bytes before it, and it ends. A
    mark stays in state for ``horizon_seconds`` more, so a chunk that comes after the end
    is not read as a new resource. Rows (``FRAME_SCHEMA``), told apart by ``kind``:

    * ``frame`` - ``data`` is ``shift`` bytes carried over and the chunk ``seq``;
    * ``late``  - a chunk that came after the end (the side output of dropped chunks);
    * ``end``   - the resource ended; ``seq`` is the next number. Once per resource.

    ``began_ms`` is the time of the first chunk read. A repeated number is read once; a
    null ``data`` is an empty chunk; rows without resource, number or time are not read,
    nor are those behind the watermark (Spark drops them before the state).
    """
    tail_len = max(max_pattern_bytes - 1, 0)
    idle_ms, horizon_ms = idle_seconds * 1000, horizon_seconds * 1000
    # One entry per resource of the bucket in the first six, per held chunk in the last three.
    state_schema = T.StructType([T.StructField("resource_id", T.ArrayType(T.LongType())),
                                 T.StructField("tail", T.ArrayType(T.BinaryType())),
                                 T.StructField("next_seq", T.ArrayType(T.IntegerType())),
                                 T.StructField("began_ms", T.ArrayType(T.LongType())),
                                 T.StructField("last_ms", T.ArrayType(T.LongType())),
                                 T.StructField("ended", T.ArrayType(T.BooleanType())),
                                 T.StructField("held_of", T.ArrayType(T.LongType())),
                                 T.StructField("held_seq", T.ArrayType(T.IntegerType())),
                                 T.StructField("held_data", T.ArrayType(T.BinaryType()))])

    def step(k, batches, state):
        known: dict[int, list] = {}  # resource: tail, next number, began, last, ended, held chunks
        if state.exists:
            *each, held_of, held_seq, held_data = state.get
            known = {r: [bytes(tail), *more, {}] for r, tail, *more in zip(*each)}
            for r, seq, data in zip(held_of, held_seq, held_data):
                known[r][5][seq] = bytes(data)
        now = state.getCurrentWatermarkMs()
        touched = set()

        def take(r, rows, across_gaps):
            tail, next_seq, began, _, _, held = known[r]
            while held and (across_gaps or next_seq in held):
                seq = next_seq if next_seq in held else min(held)
                if seq != next_seq:  # a chunk never came: nothing carries over the gap
                    tail = b""
                data = held.pop(seq)
                rows.append((r, "frame", seq, len(tail), tail + data, began))
                tail = (tail + data)[-tail_len:] if tail_len else b""
                next_seq = seq + 1
            known[r][:2] = tail, next_seq

        rows = []
        for r, own in known.items():
            if not own[4] and own[3] + idle_ms <= now:
                take(r, rows, True)
                rows.append((r, "end", own[1], 0, None, own[2]))
                own[0], own[4] = b"", True
                touched.add(r)
        if rows:
            yield pd.DataFrame(rows, columns=FRAME_SCHEMA.names)
        for pdf in batches:
            rows, came = [], set()
            for r, seq, ms, data in zip(*(pdf[c].tolist() for c in ("resource_id", "seq", "ms", "data"))):
                own = known.get(r)
                if own is None:
                    own = known[r] = [b"", 0, ms, 0, False, {}]
                touched.add(r)
                if own[4]:
                    rows.append((r, "late", seq, 0, bytes(data), own[2]))
                    continue
                own[3] = max(own[3], ms)
                if seq >= own[1]:
                    own[5].setdefault(seq, bytes(data))
                    came.add(r)
            for r in came:
                take(r, rows, False)
            if rows:
                yield pd.DataFrame(rows, columns=FRAME_SCHEMA.names)
        # A mark goes when its horizon has passed, in a micro-batch without a chunk of it.
        known = {r: own for r, own in known.items()
                 if not own[4] or r in touched or own[3] + idle_ms + horizon_ms >= now}
        if not known:
            if state.exists:
                state.remove()
            return
        held = [(r, seq, own[5][seq]) for r, own in known.items() for seq in sorted(own[5])]
        state.update((list(known), *([own[i] for own in known.values()] for i in range(5)),
                      *([h[i] for h in held] for i in range(3))))
        wake = min(own[3] + idle_ms + (horizon_ms if own[4] else 0) for own in known.values())
        state.setTimeoutTimestamp(max(wake, now + 1))

    read = chunks.filter(F.col("resource_id").isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull())
    return (read.withWatermark("ts", watermark)
            .select(_bucket("resource_id"), "resource_id", F.col("seq").cast("int").alias("seq"), "ts",
                    F.unix_millis("ts").alias("ms"), F.coalesce(F.col("data"), F.lit(b"")).alias("data"))
            .groupBy("bucket")
            .applyInPandasWithState(step, FRAME_SCHEMA, state_schema, "append", GroupStateTimeout.EventTimeTimeout))


def frame_hits(frames: DataFrame, patterns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every hit in the frames, by the key join of batch matching (stream-static here):
    (resource_id, seq, began_ms, pattern_id, idx, keep...). ``idx`` is relative to the
    chunk in which the hit ends, negative when it began earlier; position rules count from
    the chunk. Frames are dealt by (resource, number), so a hot resource's bytes spread."""
    dealt = (frames.filter(F.col("kind") == "frame").select("resource_id", "seq", "began_ms", "shift", "data")
             .repartition("resource_id", "seq"))
    found = byte_occurrences(dealt, patterns, "data", list(keep)).filter(F.col("end_idx") > F.col("shift"))
    return (found.withColumn("idx", F.col("idx") - F.col("shift"))
            .withColumn("end_idx", F.col("end_idx") - F.col("shift")).filter(position_rule())
            .select("resource_id", "seq", "began_ms", "pattern_id", F.col("idx").cast("int").alias("idx"), *keep))


def first_frame_hits(frames: DataFrame, patterns: DataFrame) -> DataFrame:
    """``frame_hits`` for ``resource_hits``, which keeps a pattern's first hit: of a pattern
    without a position rule, all but its first places in a frame are left out where they are
    found. ``patterns`` with all columns of the rules."""
    dealt = (frames.filter(F.col("kind") == "frame").select("resource_id", "seq", "began_ms", "shift", "data")
             .repartition("resource_id", "seq"))
    ruled = patterns.filter(~short_free())
    if patterns.filter(short_free()).isEmpty():
        return frame_hits(frames, ruled)
    found = first_occurrences(dealt, patterns.filter(short_free()), "data", "shift").select(
        "resource_id", "seq", "began_ms", "pattern_id", (F.col("idx") - F.col("shift")).cast("int").alias("idx"))
    return found if ruled.isEmpty() else found.unionByName(frame_hits(frames, ruled))


def resource_hits(hits: DataFrame, frames: DataFrame, finished: bool = False) -> DataFrame:
    """Each pattern once per resource, at its first hit: ``CHUNK_HIT_SCHEMA``.

    With ``finished`` nothing comes out before a resource's ``end`` row; then its patterns
    do, in ``PARTS`` rows (resource_id, part, began_ms, patterns), empty ones included, for a verdict.
    State is the reported pattern ids of resources that have not ended: a resource's are dealt
    over ``PARTS`` places, these over ``BUCKETS`` states. Hits reach them packed: a row per
    frame and part. Frames written by one micro-batch must be read together (no
    ``maxFilesPerTrigger`` that splits them).
    """
    packed = "resource_id long, part int, seq int, began_ms long, ids binary, places binary"
    rows = hits.select("resource_id", "seq", F.col("pattern_id").cast("long").alias("pattern_id"), "idx").mapInArrow(
        _packed_hits, packed)
    ends = frames.filter(F.col("kind") == "end").select(
        "resource_id", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"),
        F.lit(None).cast("int").alias("seq"), "began_ms", F.lit(b"").alias("ids"), F.lit(b"").alias("places"))

    def step(k, batches, state):
        seen = _read_pairs(state.get[0]) if state.exists else np.zeros((0, 2), np.int64)
        new, more, ended = np.zeros((0, 3), np.int64), [], {}
        for pdf in batches:
            is_end = pdf["seq"].isna()
            ended.update(zip(zip(pdf["resource_id"][is_end].tolist(), pdf["part"][is_end].tolist()),
                             pdf["began_ms"][is_end].tolist()))
            hit = pdf[~is_end].sort_values(["resource_id", "seq"], kind="stable")  # nearly sorted is sorted sooner
            ids = [np.frombuffer(b, np.int64) for b in hit["ids"]]
            if not ids:
                continue
            sizes = [len(i) for i in ids]
            more.append(np.column_stack([
                np.repeat(hit["resource_id"].to_numpy(np.int64), sizes), np.concatenate(ids),
                _place(np.repeat(hit["seq"].to_numpy(np.int64), sizes),
                       np.concatenate([np.frombuffer(b, np.int32) for b in hit["places"]]).astype(np.int64))]))
            if sum(map(len, more)) > len(new):  # so a hit is merged a few times, not once a batch
                new, more = _first_of_each(np.concatenate([new, *more])), []
        # What was seen comes first of its pair, so only the others are news.
        both = _first_of_each(np.concatenate([np.column_stack([seen, np.full(len(seen), SEEN)]), new, *more]))
        news, pairs = both[both[:, 2] != SEEN], both[:, :2]
        over = np.zeros(len(pairs), bool)
        if ended:
            own = pd.MultiIndex.from_arrays([pairs[:, 0], np.mod(pairs[:, 1], PARTS)])
            over = own.isin(list(ended))
        if not finished and len(news):
            yield pd.DataFrame(np.column_stack([news[:, :2], *_seq_idx(news[:, 2])]), columns=CHUNK_HIT_SCHEMA.names)
        elif finished and ended:
            found = {key: [] for key in ended}
            for r, pid in pairs[over].tolist():
                found[r, pid % PARTS].append(pid)
            yield pd.DataFrame([(*key, ended[key], ids) for key, ids in found.items()], columns=FINISHED_SCHEMA.names)
        if not over.all():
            state.update((_written_pairs(pairs[~over]),))
        elif state.exists:
            state.remove()

    return (rows.unionByName(ends).select(_bucket("resource_id", "part"), "*").groupBy("bucket").applyInPandasWithState(
        step, FINISHED_SCHEMA if finished else CHUNK_HIT_SCHEMA,
        T.StructType([T.StructField("seen", T.BinaryType())]), "append", GroupStateTimeout.NoTimeout))


SEEN = np.iinfo(np.int64).min  # the place of a pair that was reported before


def _place(seq: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """(seq, idx), of 32 bits each, as one number in their order."""
    return (seq << 32) + idx + (1 << 31)


def _seq_idx(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 32, (place & 0xFFFFFFFF) - (1 << 31)


def _first_of_each(hits: np.ndarray) -> np.ndarray:
    """The row with the least place of each (resource, pattern); sorted by these."""
    hits = hits[np.lexsort(hits.T[::-1])]
    return hits[np.append(True, (hits[1:, :2] != hits[:-1, :2]).any(axis=1))[:len(hits)]]


def _written_pairs(pairs: np.ndarray) -> bytes:
    """Sorted (resource, pattern) pairs as zipped differences."""
    return zlib.compress(np.diff(pairs, axis=0, prepend=np.zeros((1, 2), np.int64)).T.tobytes(), 1)


def _read_pairs(written: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(written), np.int64).reshape(2, -1).T, axis=0)


def _packed_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits to one row per frame and part of the pattern ids: the ids and places, each
    pattern at its first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        resource, seq, pid, idx = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        # a frame is one of (resource, seq); the first place of a pattern in it is kept
        order = np.lexsort((idx, pid, np.mod(pid, PARTS), seq, resource))
        at = np.column_stack([resource, seq, np.mod(pid, PARTS), pid, idx])[order]
        at = at[np.append(True, (at[1:, :4] != at[:-1, :4]).any(axis=1))]
        start = np.flatnonzero(np.append(True, (at[1:, :3] != at[:-1, :3]).any(axis=1)))
        cuts = list(zip(start.tolist(), [*start[1:].tolist(), len(at)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[start, 0]), pa.array(at[start, 2].astype(np.int32)), pa.array(at[start, 1].astype(np.int32)),
             pa.nulls(len(start), pa.int64()),
             pa.array([at[a:b, 3].tobytes() for a, b in cuts], pa.binary()),
             pa.array([at[a:b, 4].astype(np.int32).tobytes() for a, b in cuts], pa.binary())],
            names=["resource_id", "part", "seq", "began_ms", "ids", "places"])


def drop_late(stream: DataFrame, ts: str, watermark: str, row_key: Sequence[str]) -> DataFrame:
    """Drop rows that arrive behind the watermark (their resource is finished).

    Watermark de-duplication on a unique row key discards exactly the rows older
    than the watermark; its state is bounded by the watermark delay.
    """
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(row_key))


def idle_sessions(stream: DataFrame, key: str, ts: str, gap: str, watermark: str,
                  value: str, row_key: Sequence[str] | None = None) -> DataFrame:
    """A key's activity is finished after ``gap`` without data (native session
    window). With ``row_key``, rows behind the watermark are never read."""
    if row_key:
        stream = drop_late(stream, ts, watermark, row_key)
    else:
        stream = stream.withWatermark(ts, watermark)
    return (stream
            .groupBy(F.session_window(ts, gap).alias("s"), key)
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.array_sort(F.collect_set(value)).alias("values"))
            .select(key, F.col("s.start").alias("session_start"),
                    F.col("s.end").alias("session_end"), "n_events", "values"))


def request_content_join(requests: DataFrame, content: DataFrame, wait_seconds: int,
                         watermark: str) -> DataFrame:
    """Each request with the content that arrives within ``wait_seconds``;
    none in time -> the request is finished empty (left outer stream join)."""
    r = requests.withWatermark("ts", watermark).alias("r")
    c = (content.withWatermark("c_ts", watermark)
         .withColumnRenamed("host", "c_host").withColumnRenamed("path", "c_path").alias("c"))
    cond = ((F.col("host") == F.col("c_host")) & (F.col("path") == F.col("c_path"))
            & (F.col("c_ts") >= F.col("ts"))
            & (F.col("c_ts") <= F.col("ts") + F.expr(f"INTERVAL {int(wait_seconds)} SECONDS")))
    return r.join(c, cond, "leftOuter")
