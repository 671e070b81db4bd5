"""Keyed stream state: order, ends, late chunks and releases do not depend on micro-batches."""

import random

import duckdb
from pyspark.sql import functions as F

from lexigate import session
from lexigate.operators import chunks as C
from lexigate.plans import streams as ST
from lexigate.sources import fixtures, tables
from lexigate.streaming import operators as SO
from lexigate.streaming import runner

from conftest import SF_SMALL

CHUNK = "resource_id long, seq int, data binary, ts timestamp"


def pats_of(spark, *words):
    return spark.createDataFrame([(i + 1, w, False, 0, 0, "x") for i, w in enumerate(words)], fixtures.PATTERN_SCHEMA)


def wave(spark, *rows):
    """Rows (resource, number, bytes, second)."""
    raw = spark.createDataFrame([(r, s, None if d is None else bytearray(d), t) for r, s, d, t in rows],
                                "resource_id long, seq int, data binary, t long")
    return raw.select("resource_id", "seq", "data", F.timestamp_seconds("t").alias("ts"))


def run(spark, waves, pats, finished=False, idle=3600, delay="1 hour", horizon=7 * 86400):
    staged = runner.stage(spark, waves, "state_chunks")
    longest = pats.agg(F.max(F.octet_length("pattern"))).first()[0]
    frames = SO.framed_chunks(runner.read_stream(spark, staged), longest, idle, delay, horizon)
    between, found = runner.run_hops(
        frames, lambda f: SO.resource_hits(SO.frame_hits(f, pats), f, finished), "state_chunks", staged)
    return spark.read.parquet(between).collect(), spark.read.parquet(found).collect()


def test_chunks_out_of_order_equal_the_batch(spark):
    pats = spark.createDataFrame([(1, "hers", False, 0, 0, "x"), (2, "he", False, 3, 0, "x"),
                                  (3, "yy", False, 0, 0, "x")], fixtures.PATTERN_SCHEMA)
    first, second = (1, 0, b"xxhe", 1), (1, 1, b"rs yy", 2)
    for waves in ([[first], [second]], [[second], [first]], [[second, first]]):
        _, got = run(spark, [wave(spark, *w) for w in waves], pats)
        assert sorted((r.pattern_id, r.seq, r.idx) for r in got) == [(1, 1, -2), (3, 1, 3)]


def test_shuffled_chunks_equal_the_batch_stitch(spark):
    rng = random.Random(3)
    rows = [(r, s, bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 4))), 1000 + 10 * r + s)
            for r in range(30) for s in range(rng.randint(1, 9))]
    pats = pats_of(spark, "abcab", "ab", "c", "bbbbbbb", "aca", "ca")
    mixed = rows[:]
    rng.shuffle(mixed)
    waves = [mixed[i::4] for i in range(4)] + [[mixed[0], mixed[1]]]  # two chunks come again
    _, got = run(spark, [wave(spark, *w) for w in waves], pats)
    want = {}
    for h in C.chunk_stitch(wave(spark, *rows), pats).collect():
        at = (h.resource_id, h.pattern_id)
        want[at] = min(want.get(at, (h.seq, h.idx)), (h.seq, h.idx))
    assert {(r.resource_id, r.pattern_id): (r.seq, r.idx) for r in got} == want
    assert len(got) == len(want)


def test_a_chunk_after_the_end_is_dropped_and_not_a_new_resource(spark):
    day = 86400
    waves = [[(1, 0, b"..a", 10), (1, 2, b"c", 11)], [(9, 0, None, 2 * day)], [(1, 1, b"b", 2 * day + 5)],
             [(9, 1, b"", 4 * day)], [(1, 3, b"c", 4 * day)], [(9, 2, b"", 8 * day)]]
    frames, got = run(spark, [wave(spark, *w) for w in waves], pats_of(spark, "a", "ab", "c", "b"), finished=True)
    mine = [f for f in frames if f.resource_id == 1]
    assert sorted(f.seq for f in mine if f.kind == "late") == [1, 3]
    assert [f.seq for f in mine if f.kind == "end"] == [3]
    # the gap was given up at the end: chunk 2 was read, without the bytes before it
    assert sorted(f.seq for f in mine if f.kind == "frame") == [0, 2]
    done = [r for r in got if r.resource_id == 1]
    assert len(done) == SO.PARTS and sorted(p for r in done for p in r.patterns) == [1, 3]


def test_after_the_horizon_a_number_may_be_used_again(spark):
    day = 86400
    waves = [[(1, 0, b"a", 10)], [(9, 0, b"", 2 * day)], [(9, 1, b"", 20 * day)], [(1, 0, b"a", 20 * day + 1)]]
    frames, _ = run(spark, [wave(spark, *w) for w in waves], pats_of(spark, "a"), horizon=3 * day)
    assert [f.kind for f in frames if f.resource_id == 1].count("frame") == 2


def test_frames_hold_no_pattern_and_matching_is_native(spark):
    staged = runner.stage(spark, [wave(spark, (1, 0, b"ab", 1))], "plan_chunks")
    frames = spark.read.schema(SO.FRAME_SCHEMA).parquet(staged.path)
    plan = SO.frame_hits(frames, pats_of(spark, "ab"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan


def hold_in_waves(spark, waves, tie="event_id"):
    staged = runner.stage(spark, waves, "hold_waves")
    admitted = SO.inflight_hold(runner.read_stream(spark, staged), ["user_id", "event_type"], "ts",
                                ST.HOLD_SECONDS, watermark="4000 days", tie=tie)
    return spark.read.parquet(runner.run_to_parquet(admitted, "hold_waves", staged))


def test_inflight_hold_over_shuffled_micro_batches(spark):
    ev = tables.events(spark, SF_SMALL)
    marker = ev.orderBy("event_id").limit(1).select(*[
        (F.col("ts") + F.expr("INTERVAL 9000 DAYS")).alias("ts") if c == "ts"
        else F.lit(-1).cast("long").alias(c) if c == "user_id" else F.col(c) for c in ev.columns])
    waves = [ev.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i) for i in range(4)] + [marker]
    got = hold_in_waves(spark, waves)
    assert got.schema == ev.schema
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_SMALL}/events.parquet'")
    want = sorted((r[0], r[1]) for r in con.execute(ST.INFLIGHT_SQL).fetchall())
    assert sorted(map(tuple, got.select("event_id", F.unix_micros("ts")).collect())) == want


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "req_id long, host string, t long, kind string").select(
        "req_id", "host", F.timestamp_seconds("t").alias("ts"), "kind")


def admitted_of(spark, waves, hold):
    end = requests(spark, (-1, "end", 10 ** 6, "done"))
    staged = runner.stage(spark, [requests(spark, *w) for w in waves] + [end], "done_waves")
    kept = SO.inflight_until_done(runner.read_stream(spark, staged), ["host"], "ts", hold, watermark="1 day")
    return sorted(r.req_id for r in spark.read.parquet(
        runner.run_to_parquet(kept, "done_waves", staged)).collect())


def test_late_completion_does_not_release_a_newer_request(spark):
    assert admitted_of(spark, [[(1, "h", 100, "request")],
                               [(2, "h", 90, "done"), (3, "h", 102, "request")]], 3600) == [1]


def test_an_earlier_request_in_a_later_micro_batch(spark):
    a, b = (1, "h", 100, "request"), (2, "h", 50, "request")
    for waves in ([[a, b]], [[a], [b]], [[b], [a]]):
        assert admitted_of(spark, waves, 60) == [2]


def test_requests_and_completions_in_any_order(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["h", "g", None]), 1000 + rng.randint(0, 400), rng.choice(["request", "request", "done"]))
            for i in range(120)]
    since, want = {}, []
    for i, host, t, kind in sorted(rows, key=lambda r: (r[2], r[3] != "done", r[0])):
        at = since.get(host)
        if kind == "done":
            if at is not None and t > at:
                since.pop(host)
        elif at is None or t >= at + 30:
            want.append(i)
            since[host] = t
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        assert admitted_of(spark, [rows[i::3] for i in range(3)], 30) == sorted(want)


def test_state_is_kept_by_buckets_of_resources(spark):
    """Keyed Python state pays for each key of each micro-batch: many resources, few keys."""
    many = spark.range(6000).select(F.col("id").alias("resource_id"), F.lit(0).alias("seq"), F.lit(b"ab").alias("data"),
                                    F.timestamp_seconds(F.lit(10)).alias("ts"))
    staged = runner.stage(spark, [many, wave(spark, (-1, 0, b"", 10 ** 6))], "bucket_chunks")
    pats = pats_of(spark, "ab", "b", "b")
    frames = SO.framed_chunks(runner.read_stream(spark, staged), 2, 3600, "1 hour")
    between, found = runner.run_hops(frames, lambda f: SO.resource_hits(SO.frame_hits(f, pats), f, True), "bucket", staged)
    chk = next(p for p in reversed(session._FOLDERS[spark.sparkContext.applicationId]) if "/chk/bucket-frames" in p)
    assert spark.read.format("statestore").load(chk).count() <= SO.BUCKETS
    got = spark.read.parquet(found).groupBy("resource_id").agg(F.count("*").alias("n"), F.sum(F.size("patterns")).alias("p"))
    assert got.filter("resource_id >= 0 AND n = 4 AND p = 3").count() == 6000
    assert spark.read.parquet(between).filter("kind = 'end' AND resource_id >= 0").count() == 6000


def test_request_keys_are_kept_by_buckets(spark):
    """Many keys, few states; null and large keys stay apart, and the listing has their types."""
    rows = spark.range(3000).select(
        F.col("id").alias("req_id"), F.when(F.col("id") != 7, (1 << 60) + F.col("id")).alias("dst"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("h"), "id")).alias("host"), F.timestamp_seconds(F.lit(100)).alias("ts"),
        F.lit("request").alias("kind"))
    done = rows.filter("req_id % 10 = 0").withColumn("ts", F.timestamp_seconds(F.lit(200))).withColumn("kind", F.lit("done"))
    end = rows.filter("req_id = 0").withColumn("host", F.lit("end")).withColumn("kind", F.lit("done")).withColumn(
        "ts", F.timestamp_seconds(F.lit(10 ** 6)))
    staged = runner.stage(spark, [rows, done, end], "bucket_keys")
    kept = SO.inflight_until_done(runner.read_stream(spark, staged), ["host", "dst"], "ts", 10 ** 7, "1 day")
    chk = runner.run_to_state(kept, "bucket_keys", staged)
    assert spark.read.format("statestore").load(chk).count() <= SO.BUCKETS
    listed = SO.inflight_keys(spark, chk, ["host", "dst"], 10 ** 7)
    assert listed.schema["dst"].dataType.simpleString() == "bigint"
    want = rows.filter("req_id % 10 <> 0").select("host", "dst").collect()
    key = lambda r: (r.host or "", r.dst or 0)
    assert sorted(listed.select("host", "dst").collect(), key=key) == sorted(want, key=key)
