"""Registered streaming queries.

Each stages its input (derived from the given tables) as a file stream,
runs the streaming plan with ``availableNow`` and returns the sink's rows.
Where the result is deterministic the SQL oracle restates it in batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigate.operators import batches as B
from lexigate.operators import chunks as C
from lexigate.operators import matching as M
from lexigate.operators import requests as R
from lexigate.operators import scoring as S
from lexigate.plans import catalog as K
from lexigate.plans import oracle as O
from lexigate.plans.catalog import out, query
from lexigate.session import materialize
from lexigate.sources import derived, fixtures, tables
from lexigate.streaming import operators as SO
from lexigate.streaming import runner

# Fixed values of the stream stand-ins.
EPOCH = "2024-01-01 00:00:00"
EPOCH_SECONDS = 1704067200   # the same instant, UTC
HOLD_SECONDS = 3600          # in-flight time of a request key
SESSION_GAP = "30 minutes"   # idle time that finishes a key's activity
WAIT_SECONDS = 5             # how long a request waits for its content
BEGIN_SECONDS = 1800         # chunk streams begin within this time
IDLE_SECONDS = 3600          # a resource without chunks for this long has ended
LATE_SHIFT_DAYS = 7          # late copies arrive this much behind
MAX_WORD_BYTES = 64          # words of dictionaries yet to come are no longer
RECORDS_PER_SECOND = 40      # request id units per second of verdict records
# The dictionary as replaced while running (second version).
WORD_DICTIONARY_V2_ROWS = [
    (1, 55, 2, "hers,his,she"),
    (2, 10, 1, "eaux,the,license"),
    (3, 13, 1, "he,example.com,the,and"),
]


def _epoch_plus(seconds_col) -> F.Column:
    return F.timestamp_seconds(F.lit(EPOCH_SECONDS) + seconds_col)


def _read_back(spark, path):
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------

@query("stream_requests", K.QUERIES["request_length_guard"][1])
def q_stream_requests(spark, sf):
    payloads = derived.http_payloads(spark, sf)
    staged = runner.stage(spark, [payloads], "payloads")
    stream = runner.read_stream(spark, staged)
    res = runner.run_to_parquet(SO.stream_requests(stream), "stream_requests", staged)
    return out(_read_back(spark, res))


def _events(spark, sf):
    return tables.events(spark, sf)


INFLIGHT_SQL = f"""
WITH RECURSIVE ev AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
  FROM events),
chain AS (
  SELECT user_id, event_type, event_id, ts, rn FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_type, e.event_id, e.ts, e.rn
  FROM chain c JOIN ev e ON e.user_id = c.user_id AND e.event_type = c.event_type
   AND e.rn = (SELECT min(x.rn) FROM ev x WHERE x.user_id = c.user_id
               AND x.event_type = c.event_type AND x.ts >= c.ts + INTERVAL {HOLD_SECONDS} SECOND))
SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type FROM chain"""


@query("stream_inflight_dedup", INFLIGHT_SQL)
def q_stream_inflight_dedup(spark, sf):
    staged = runner.stage(spark, _with_end_marker(_events(spark, sf)), "events")
    stream = runner.read_stream(spark, staged)
    admitted = SO.inflight_hold(stream, ["user_id", "event_type"], "ts", HOLD_SECONDS,
                                watermark=f"{HOLD_SECONDS} seconds", tie="event_id")
    res = runner.run_to_parquet(admitted, "stream_inflight_dedup", staged)
    r = _read_back(spark, res)
    return out(r.select("event_id", F.unix_micros("ts").alias("ts_us"), "user_id",
                        "event_type"))


def _chunk_rows(spark, sf):
    """Chunks of every text; all resources begin within half an hour, at any table size."""
    ch = C.content_chunks(derived.docs(spark, sf))
    return ch.withColumn("ts", _epoch_plus(F.pmod(F.col("resource_id"), F.lit(BEGIN_SECONDS)))
                         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("seq") / 1000))


def _chunk_marker(rows: DataFrame) -> DataFrame:
    """One chunk of another resource 30 days later, behind which every resource is idle."""
    return rows.agg(F.max("ts").alias("m")).select(
        F.lit(-1).cast("long").alias("resource_id"), F.lit(0).alias("seq"), F.lit(b"").alias("data"),
        (F.col("m") + F.expr("INTERVAL 30 DAYS")).alias("ts"))


def _longest(patterns: DataFrame) -> int:
    return patterns.agg(F.max(F.octet_length("pattern"))).first()[0] or 1


CHUNK_HIT_BODY = (
    f"SELECT doc_id AS resource_id, pattern_id, (end_idx - 1) // {O.CHUNK} AS seq, "
    f"idx - ((end_idx - 1) // {O.CHUNK}) * {O.CHUNK} AS idx FROM (SELECT *, row_number() OVER "
    "(PARTITION BY doc_id, pattern_id ORDER BY end_idx) AS rn FROM tocc) WHERE rn = 1")
CHUNK_MATCH_SQL = O.with_(K.TEST_OCC, CHUNK_HIT_BODY)


def _first_hits(spark, sf, patterns, name):
    rows = _chunk_rows(spark, sf)
    # two arrival waves (first two chunks of every text, then the rest), so the
    # state carried between micro-batches is exercised
    staged = runner.stage(spark, [rows.filter("seq < 2"), rows.filter("seq >= 2")], "chunks")
    frames = SO.framed_chunks(runner.read_stream(spark, staged), _longest(patterns), IDLE_SECONDS, "1 day")
    # equal patterns are matched and kept in state once; they take their own ids behind it
    heads, members = (materialize(t, "stream-patterns") for t in M.alike_patterns(patterns))
    _, found = runner.run_hops(frames, lambda f: SO.resource_hits(SO.first_frame_hits(f, heads), f), name, staged)
    return (_read_back(spark, found).withColumnRenamed("pattern_id", "__head").join(members, "__head")
            .select("resource_id", "pattern_id", "seq", "idx"))


@query("stream_chunk_match", CHUNK_MATCH_SQL)
def q_stream_chunk_match(spark, sf):
    return out(_first_hits(spark, sf, K.test_policy_patterns(spark), "stream_chunk_match"))


@query("stream_chunk_match_words", O.with_(K.BENCH_WORD_HITS, "SELECT doc_id AS resource_id, pattern_id FROM bh"))
def q_stream_chunk_match_words(spark, sf):
    """The benchmark's words, a dictionary that grows with the data, over the chunk stream."""
    pats = materialize(K.bench_word_patterns(spark, sf), "stream-words")
    return out(_first_hits(spark, sf, pats, "stream_chunk_match_words").select("resource_id", "pattern_id"))


def _score_ended(target: str, tables):
    """A micro-batch of ended resources to verdicts; ``tables()`` gives (index, totals)."""
    def score(df: DataFrame, batch_id: int) -> None:
        df = df.persist()  # read twice below; the state advances once
        idx, totals = tables()
        hits = df.select("resource_id", F.explode("patterns").alias("pattern_id"))
        found = S.category_hits(S.hit_categories(hits, idx, "resource_id"), "resource_id")
        subjects = df.filter("part = 0").select("resource_id", "began_ms")
        (S.url_verdict(found, totals, subjects.select("resource_id"), "resource_id").join(subjects, "resource_id")
         .write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}"))
        df.unpersist()
    return score


@query("stream_verdicts", O.with_(O.verdict_ctes("docs", "doc_id", "text"),
                                  "SELECT doc_id AS resource_id, type FROM verdicts", "docs"))
def q_stream_verdicts(spark, sf):
    """Chunks to hits to a verdict when a resource has gone idle: frames, then matches."""
    rows = _chunk_rows(spark, sf)
    staged = runner.stage(spark, [rows.filter("seq < 2"), rows.filter("seq >= 2"), _chunk_marker(rows)],
                          "verdict_chunks")
    _, _, idx, totals, pats = K.word_dictionary(spark)
    frames = SO.framed_chunks(runner.read_stream(spark, staged), _longest(pats), IDLE_SECONDS, "1 day")
    target = runner.output_folder(spark, "stream_verdicts")
    runner.run_hops(frames, lambda f: SO.resource_hits(SO.frame_hits(f, pats), f, finished=True),
                    "stream_verdicts", staged, fn=_score_ended(target, lambda: (idx, totals)))
    return out(spark.read.parquet(target).select("resource_id", "type"))


LATE_CHUNKS_SQL = O.with_(
    K.TEST_OCC + [("ch", K.CHUNKS_SQL)],
    f"SELECT resource_id, seq, pattern_id, idx, FALSE AS late FROM ({CHUNK_HIT_BODY}) WHERE seq < 2 "
    "UNION ALL SELECT resource_id, seq, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), TRUE FROM ch WHERE seq >= 2")


@query("stream_late_chunks", LATE_CHUNKS_SQL)
def q_stream_late_chunks(spark, sf):
    """The third and later chunks come a month later, when their resource has ended: they
    are dropped to the side output, and hits are those of the first two."""
    rows = _chunk_rows(spark, sf)
    late = rows.filter("seq >= 2").withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    staged = runner.stage(spark, [rows.filter("seq < 2"), _chunk_marker(rows), late], "late_chunks")
    pats = K.test_policy_patterns(spark)
    frames = SO.framed_chunks(runner.read_stream(spark, staged), _longest(pats), IDLE_SECONDS, "1 day",
                              horizon_seconds=60 * 86400)
    between, found = runner.run_hops(frames, lambda f: SO.resource_hits(SO.frame_hits(f, pats), f),
                                     "stream_late_chunks", staged)
    dropped = _read_back(spark, between).filter("kind = 'late'").select(
        "resource_id", "seq", F.lit(None).cast("long").alias("pattern_id"),
        F.lit(None).cast("int").alias("idx"), F.lit(True).alias("late"))
    return out(_read_back(spark, found).select("resource_id", "seq", "pattern_id", "idx", F.lit(False).alias("late"))
               .unionByName(dropped))


def _with_end_marker(ev: DataFrame) -> list[DataFrame]:
    """The input and an end-of-input marker one day after its last event, so the
    watermark passes every real session."""
    marker = ev.agg(F.max("ts").alias("m")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("m") + F.expr("INTERVAL 1 DAY")).alias("ts"),
        F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"))
    return [ev, marker]


SESSIONS_SQL = f"""
WITH e AS (SELECT user_id, event_type, CAST(ts AS TIMESTAMP) AS ts FROM events),
g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
        OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL {SESSION_GAP}
        THEN 1 ELSE 0 END AS new_s FROM e),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start_us,
       epoch_us(max(ts) + INTERVAL {SESSION_GAP}) AS session_end_us,
       CAST(count(*) AS BIGINT) AS n_events, list_sort(list(DISTINCT event_type)) AS values
FROM s GROUP BY user_id, sid"""


def _sessions_out(df: DataFrame) -> DataFrame:
    return out(df.select("user_id", F.unix_micros("session_start").alias("session_start_us"),
                         F.unix_micros("session_end").alias("session_end_us"),
                         "n_events", "values"))


@query("stream_idle_finalize", SESSIONS_SQL)
def q_stream_idle_finalize(spark, sf):
    ev = _events(spark, sf)
    staged = runner.stage(spark, _with_end_marker(ev), "events")
    stream = runner.read_stream(spark, staged)
    sess = SO.idle_sessions(stream, "user_id", "ts", SESSION_GAP, "1 hour", "event_type")
    return _sessions_out(_read_back(spark, runner.run_to_parquet(sess, "stream_idle_finalize", staged)))


@query("stream_late_events", SESSIONS_SQL)
def q_stream_late_events(spark, sf):
    ev = _events(spark, sf)
    late = ev.withColumn("ts", F.col("ts") - F.expr(f"INTERVAL {LATE_SHIFT_DAYS} DAYS"))
    parts = _with_end_marker(ev)
    staged = runner.stage(spark, [parts[0], late, parts[1]], "events_late")
    stream = runner.read_stream(spark, staged)
    sess = SO.idle_sessions(stream, "user_id", "ts", SESSION_GAP, "1 hour", "event_type",
                            row_key=["event_id"])
    return _sessions_out(_read_back(spark, runner.run_to_parquet(sess, "stream_late_events", staged)))


# -- requests and their content ------------------------------------------------

def _timed_requests(spark, sf):
    r = derived.url_requests(spark, sf)
    return r.withColumn("ts", _epoch_plus(F.col("req_id")))


def _timed_content(spark, sf):
    return (derived.page_content(spark, sf)
            .select("host", "path", F.octet_length("html").cast("bigint").alias("content_bytes"),
                    _epoch_plus(F.col("page_id") * 4 + F.col("page_id") % 9).alias("c_ts")))


REQUEST_CONTENT_SQL = O.with_(
    [("rq", "SELECT *, to_timestamp(epoch('" + EPOCH + "'::TIMESTAMP) + req_id) AS ts "
            "FROM url_requests"),
     ("ct", "SELECT host, path, CAST(strlen(html) AS BIGINT) AS content_bytes, "
            "to_timestamp(epoch('" + EPOCH + "'::TIMESTAMP) + page_id * 4 + page_id % 9) "
            "AS c_ts FROM page_content")],
    "SELECT r.req_id, r.host, r.path, c.content_bytes, epoch_us(r.ts) AS ts_us, "
    "epoch_us(c.c_ts) AS c_ts_us FROM rq r LEFT JOIN ct c ON r.host = c.host AND "
    f"r.path = c.path AND c.c_ts >= r.ts AND c.c_ts <= r.ts + INTERVAL {WAIT_SECONDS} SECOND")


@query("stream_request_content", REQUEST_CONTENT_SQL)
def q_stream_request_content(spark, sf):
    req = _timed_requests(spark, sf)
    con = _timed_content(spark, sf)
    end_r = req.agg(F.max("ts").alias("m")).select(
        F.lit(-1).cast("long").alias("req_id"), F.lit(1).cast("tinyint").alias("method"),
        F.lit(0).cast("long").alias("dst"), F.lit("end").alias("host"), F.lit("/").alias("path"),
        (F.col("m") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    end_c = con.agg(F.max("c_ts").alias("m")).select(
        F.lit("end").alias("host"), F.lit("/").alias("path"), F.lit(0).cast("bigint")
        .alias("content_bytes"), (F.col("m") + F.expr("INTERVAL 2 DAYS")).alias("c_ts"))
    requests = runner.stage(spark, [req, end_r], "requests")
    content = runner.stage(spark, [con, end_c], "content")
    rs = runner.read_stream(spark, requests)
    cs = runner.read_stream(spark, content)
    joined = SO.request_content_join(rs, cs, WAIT_SECONDS, "1 hour")
    res = _read_back(spark, runner.run_to_parquet(joined, "stream_request_content", requests, content))
    return out(res.filter("req_id <> -1").select(
        "req_id", "host", "path", "content_bytes", F.unix_micros("ts").alias("ts_us"),
        F.unix_micros("c_ts").alias("c_ts_us")))


# -- verdict batches per second -------------------------------------------------

VERDICT_BATCH_SQL = O.with_(
    K.REQ_VERDICT_CTES + [
        ("tv", f"SELECT *, req_id // {RECORDS_PER_SECOND} AS sec FROM rverdict WHERE type <> 0"),
        ("nv", "SELECT *, row_number() OVER (PARTITION BY sec ORDER BY req_id) AS k FROM tv")],
    f"SELECT epoch_us(to_timestamp(epoch('{EPOCH}'::TIMESTAMP) + sec)) AS window_start_us, "
    "CAST((k - 1) // 5 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n_items, "
    "list(req_id ORDER BY req_id) AS req_ids FROM nv GROUP BY sec, (k - 1) // 5")


@query("stream_verdict_batches", VERDICT_BATCH_SQL)
def q_stream_verdict_batches(spark, sf):
    recs = S.valid_verdicts(K.request_verdicts(spark, sf)).withColumn(
        "ts", _epoch_plus(F.floor(F.col("req_id") / RECORDS_PER_SECOND)))
    staged = runner.stage(spark, [recs], "verdict_records")
    stream = runner.read_stream(spark, staged)
    target = runner.output_folder(spark, "stream_verdict_batches")

    def flush(df: DataFrame, batch_id: int) -> None:
        # one-second tumbling windows, at most 5 records per message
        keyed = df.withColumn("window_start", F.window("ts", "1 second").start)
        b = B.verdict_batches(keyed, key="window_start")
        (b.select(F.unix_micros("window_start").alias("window_start_us"), "batch", "n_items",
                  F.transform("items", lambda x: x["req_id"]).alias("req_ids"))
         .write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}"))

    runner.run_foreach_batch(stream, "stream_verdict_batches", flush, staged)
    return out(spark.read.parquet(target).drop("batch_id"))


# -- dictionary replaced while running ------------------------------------------

RELOAD_SQL = O.with_(
    [("d1", fixtures.WORD_DICTIONARY_SQL),
     ("d2", fixtures.values_sql([(i, str(g), str(t), k) for i, g, t, k in WORD_DICTIONARY_V2_ROWS],
                                ["id", "groupid", "grouptype", "keywordlist"],
                                ["BIGINT", "VARCHAR", "VARCHAR", "VARCHAR"])),
     ("w1docs", "SELECT doc_id, text FROM documents WHERE lang = 'en'"),
     ("w2docs", "SELECT doc_id, text FROM documents WHERE lang IS DISTINCT FROM 'en'")]
    + O.verdict_ctes("w1docs", "doc_id", "text", source="d1", w="a", v="x")
    + O.verdict_ctes("w2docs", "doc_id", "text", source="d2", w="b", v="y"),
    "SELECT doc_id, type, CAST(1 AS BIGINT) AS version FROM xerdicts UNION ALL "
    "SELECT doc_id, type, CAST(2 AS BIGINT) AS version FROM yerdicts")


@query("stream_dictionary_reload", RELOAD_SQL)
def q_stream_dictionary_reload(spark, sf):
    docs = tables.documents(spark, sf, "doc_id", "text", "lang")
    schema = T.StructType([T.StructField("version", T.LongType()),
                           T.StructField("effective_batch", T.LongType())]
                          + list(fixtures.URLKEYWORD_SCHEMA.fields))
    v1 = [(1, 0, i, str(g), str(t), k) for i, g, t, k in fixtures.WORD_DICTIONARY_ROWS]
    v2 = [(2, 1, i, str(g), str(t), k) for i, g, t, k in WORD_DICTIONARY_V2_ROWS]
    # versions are files in a folder that the running query reads at every batch
    folder = runner.output_folder(spark, "dictionary_versions")
    spark.createDataFrame(v1 + v2, schema).write.parquet(folder)
    # documents arrive in two waves; the dictionary is replaced between them
    staged = runner.stage(spark, [docs.filter("lang = 'en'"),
                                  docs.filter("NOT (lang <=> 'en')")], "docs")
    stream = runner.read_stream(spark, staged)
    target = runner.output_folder(spark, "stream_dictionary_reload")

    def score(df: DataFrame, batch_id: int) -> None:
        # exactly one dictionary version per micro-batch: the newest in effect
        live = (df.sparkSession.read.schema(schema).parquet(folder)
                .filter(F.col("effective_batch") <= batch_id))
        v = live.agg(F.max("version")).first()[0]
        dictionary = live.filter(F.col("version") == v).drop("version", "effective_batch")
        (K.verdicts_with(K.dictionary_tables(dictionary), df.select("doc_id", "text"))
         .withColumn("version", F.lit(v).cast("bigint"))
         .write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}"))

    runner.run_foreach_batch(stream, "stream_dictionary_reload", score, staged)
    return out(spark.read.parquet(target).drop("batch_id"))


PINNED_SQL = O.with_(
    [("d1", fixtures.WORD_DICTIONARY_SQL),
     ("d2", fixtures.values_sql([(i, str(g), str(t), k) for i, g, t, k in WORD_DICTIONARY_V2_ROWS],
                                ["id", "groupid", "grouptype", "keywordlist"],
                                ["BIGINT", "VARCHAR", "VARCHAR", "VARCHAR"])),
     ("olddocs", "SELECT doc_id, text FROM docs WHERE doc_id % 2 = 0"),
     ("newdocs", "SELECT doc_id, text FROM docs WHERE doc_id % 2 <> 0")]
    + O.verdict_ctes("olddocs", "doc_id", "text", source="d1", w="a", v="x")
    + O.verdict_ctes("newdocs", "doc_id", "text", source="d2", w="b", v="y"),
    "SELECT doc_id AS resource_id, type, CAST(1 AS BIGINT) AS version FROM xerdicts UNION ALL "
    "SELECT doc_id AS resource_id, type, CAST(2 AS BIGINT) AS version FROM yerdicts", "docs")
VERSION_SCHEMA = T.StructType([T.StructField("version", T.LongType()), T.StructField("from_ms", T.LongType())]
                              + list(fixtures.URLKEYWORD_SCHEMA.fields))
VERSION_IDS = 1 << 32  # ids of a version's words and categories lie this far apart


def versioned_tables(stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(versions, index, totals, patterns) of a table of dictionary versions. A version
    holds from ``from_ms`` until the next one's; few versions are kept at a time."""
    rows = sorted(map(tuple, stored.select("version", "from_ms").distinct().collect()), key=lambda r: r[1])
    spans = [(v, start, rows[i + 1][1] if i + 1 < len(rows) else None) for i, (v, start) in enumerate(rows)]
    built = []
    for v, start, until in spans:
        _, _, idx, totals, pats = K.dictionary_tables(stored.filter(F.col("version") == v).drop("version", "from_ms"))
        built.append((idx.withColumn("iid", F.col("iid") + v * VERSION_IDS)
                      .withColumn("cat_index", F.col("cat_index") + v * VERSION_IDS),
                      totals.withColumn("cat_index", F.col("cat_index") + v * VERSION_IDS),
                      pats.withColumn("pattern_id", F.col("pattern_id") + v * VERSION_IDS)
                      .withColumn("from_ms", F.lit(start).cast("long"))
                      .withColumn("until_ms", F.lit(until).cast("long"))))
    merged = [built[0][i] for i in range(3)]
    for more in built[1:]:
        merged = [a.unionByName(b) for a, b in zip(merged, more)]
    versions = stored.sparkSession.createDataFrame(spans, "version long, from_ms long, until_ms long")
    return versions, *(materialize(t, "dictionary-version") for t in merged)


def _in_force() -> F.Column:
    """A resource keeps the version that held when it began."""
    return (F.col("began_ms") >= F.col("from_ms")) & (F.col("until_ms").isNull()
                                                      | (F.col("began_ms") < F.col("until_ms")))


@query("stream_dictionary_pinned", PINNED_SQL)
def q_stream_dictionary_pinned(spark, sf):
    """The dictionary is replaced while resources are open. Those with an even number began
    before and are scored by the old version to their end, the others by the new one."""
    swap = EPOCH_SECONDS + 2 * BEGIN_SECONDS
    rows = _chunk_rows(spark, sf)
    old = F.col("resource_id") % 2 == 0
    after = rows.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {2 * BEGIN_SECONDS} SECONDS"))
    staged = runner.stage(spark, [rows.filter(old & F.expr("seq < 2")), after.filter(~(old & F.expr("seq < 2"))),
                                  _chunk_marker(after)], "pinned_chunks")
    versions = [spark.createDataFrame([(v, at * 1000, i, str(g), str(t), k) for i, g, t, k in entries], VERSION_SCHEMA)
                for v, at, entries in ((1, 0, fixtures.WORD_DICTIONARY_ROWS), (2, swap, WORD_DICTIONARY_V2_ROWS))]
    stored = runner.stage(spark, versions, "dictionary_versions")  # the second arrives with the second wave
    live: dict = {}

    def match(frames: DataFrame) -> DataFrame:
        _, live["idx"], live["totals"], pats = versioned_tables(spark.read.schema(VERSION_SCHEMA).parquet(stored.path))
        hits = SO.frame_hits(frames, pats, ["from_ms", "until_ms"]).filter(_in_force())
        return SO.resource_hits(hits, frames, finished=True)

    frames = SO.framed_chunks(runner.read_stream(spark, staged), MAX_WORD_BYTES, IDLE_SECONDS, "1 day")
    target = runner.output_folder(spark, "stream_dictionary_pinned")
    runner.run_hops(frames, match, "stream_dictionary_pinned", staged, stored,
                    fn=_score_ended(target, lambda: (live["idx"], live["totals"])))
    spans = versioned_tables(spark.read.schema(VERSION_SCHEMA).parquet(stored.path))[0]
    return out(spark.read.parquet(target).join(F.broadcast(spans), _in_force())
               .select("resource_id", "type", "version"))


# -- in flight until completed ---------------------------------------------------

FETCH_GIVE_UP = 5      # a fetch still open after this long is given up
PATH_CHARS_PER_SECOND = 10  # stand-in fetch time: one second per 10 path characters

INFLIGHT_DONE_SQL = O.with_(
    [("rq", "SELECT req_id, host, path, method, dst, "
            f"to_timestamp(epoch('{EPOCH}'::TIMESTAMP) + req_id) AS ts, "
            "row_number() OVER (PARTITION BY host, path, method, dst ORDER BY req_id) AS rn "
            "FROM url_requests"),
     ("dn", "SELECT host, path, method, dst, "
            f"to_timestamp(epoch('{EPOCH}'::TIMESTAMP) + req_id + "
            f"length(path) // {PATH_CHARS_PER_SECOND}) AS ts FROM url_requests_first")],
    "SELECT req_id, host, path, CAST(method AS BIGINT) AS method, dst, epoch_us(ts) AS ts_us "
    "FROM chain", "url_requests", "url_requests_first")
# recursive part: the next admitted request of a key after an admitted one
INFLIGHT_DONE_SQL = INFLIGHT_DONE_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "\nSELECT req_id, host, path, CAST(method",
    ",\nchain AS (SELECT req_id, host, path, method, dst, ts, rn FROM rq WHERE rn = 1 "
    "UNION ALL SELECT r.req_id, r.host, r.path, r.method, r.dst, r.ts, r.rn FROM chain c "
    "JOIN rq r ON r.host = c.host AND r.path = c.path AND r.method = c.method AND r.dst = c.dst "
    "AND r.rn = (SELECT min(x.rn) FROM rq x WHERE x.host = c.host AND x.path = c.path "
    "AND x.method = c.method AND x.dst = c.dst AND x.rn > c.rn AND "
    f"(x.ts >= c.ts + INTERVAL {FETCH_GIVE_UP} SECOND OR EXISTS (SELECT 1 FROM dn d "
    "WHERE d.host = c.host AND d.path = c.path AND d.method = c.method AND d.dst = c.dst "
    "AND d.ts > c.ts AND d.ts <= x.ts))))\nSELECT req_id, host, path, CAST(method", 1)


@query("stream_inflight_completion", INFLIGHT_DONE_SQL)
def q_stream_inflight_completion(spark, sf):
    """Keys stay in flight until their fetch completes (or is given up)."""
    first = derived.url_requests_first(spark, sf)
    reqs = (derived.url_requests(spark, sf).withColumn("ts", _epoch_plus(F.col("req_id")))
            .withColumn("kind", F.lit("request")))
    # every first-wave fetch completes; its duration grows with the path length
    fetch = F.floor(F.char_length("path") / PATH_CHARS_PER_SECOND)
    done = (first.withColumn("ts", _epoch_plus(F.col("req_id") + fetch))
            .withColumn("kind", F.lit("done")))
    rows = reqs.unionByName(done)
    marker = rows.agg(F.max("ts").alias("m")).select(
        F.lit(-1).cast("long").alias("req_id"), F.lit(1).cast("tinyint").alias("method"),
        F.lit(0).cast("long").alias("dst"), F.lit("end").alias("host"), F.lit("/").alias("path"),
        (F.col("m") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("done").alias("kind"))
    staged = runner.stage(spark, [rows, marker.select(*rows.columns)], "requests_done")
    stream = runner.read_stream(spark, staged)
    admitted = SO.inflight_until_done(stream, ["host", "path", "method", "dst"], "ts",
                                      FETCH_GIVE_UP, watermark="1 hour")
    res = _read_back(spark, runner.run_to_parquet(admitted, "stream_inflight_completion", staged))
    return out(res.select("req_id", "host", "path", "method", "dst",
                          F.unix_micros("ts").alias("ts_us")))


# -- listing of what is in flight, from a stream's state --------------------------

LISTING_GIVE_UP = 90 * 86400  # no fetch is given up while the stream is looked at

INFLIGHT_STATE_SQL = O.with_(
    [("done", "SELECT DISTINCT r.host, r.path, r.method, r.dst, "
              f"r.req_id + length(r.path) // {PATH_CHARS_PER_SECOND} AS done_at FROM url_requests_first r "
              "JOIN page_content c ON r.host = c.host AND r.path = c.path"),
     ("last_done", "SELECT host, path, method, dst, max(done_at) AS done_at FROM done GROUP BY ALL"),
     ("open", "SELECT DISTINCT r.host, r.path, r.method, r.dst FROM url_requests r LEFT JOIN last_done d ON "
              "d.host = r.host AND d.path = r.path AND d.method = r.method AND d.dst = r.dst "
              "WHERE d.done_at IS NULL OR r.req_id >= d.done_at")],
    "SELECT host || path AS url, CAST(method AS BIGINT) AS method, dst FROM open",
    "url_requests", "url_requests_first", "page_content")


@query("stream_inflight_listing", INFLIGHT_STATE_SQL)
def q_stream_inflight_listing(spark, sf):
    """URLs in flight, read from the state of a stream of requests and completions: only
    URLs with a page complete."""
    key = ["host", "path", "method", "dst"]
    reqs = (derived.url_requests(spark, sf).withColumn("ts", _epoch_plus(F.col("req_id")))
            .withColumn("kind", F.lit("request")))
    fetch = F.floor(F.char_length("path") / PATH_CHARS_PER_SECOND)
    found = derived.page_content(spark, sf).select("host", "path")
    done = (derived.url_requests_first(spark, sf).join(found, ["host", "path"], "left_semi")
            .withColumn("ts", _epoch_plus(F.col("req_id") + fetch)).withColumn("kind", F.lit("done")))
    rows = reqs.unionByName(done)
    marker = rows.agg(F.max("ts").alias("m")).select(
        F.lit(-1).cast("long").alias("req_id"), F.lit(1).cast("tinyint").alias("method"),
        F.lit(0).cast("long").alias("dst"), F.lit("end").alias("host"), F.lit("/").alias("path"),
        (F.col("m") + F.expr("INTERVAL 20 DAYS")).alias("ts"), F.lit("done").alias("kind"))
    staged = runner.stage(spark, [rows.filter("req_id % 2 = 1"), rows.filter("req_id % 2 = 0"),
                                  marker.select(*rows.columns)], "requests_listing")
    admitted = SO.inflight_until_done(runner.read_stream(spark, staged), key, "ts", LISTING_GIVE_UP, watermark="10 days")
    chk = runner.run_to_state(admitted, "stream_inflight_listing", staged)
    listed = SO.inflight_keys(spark, chk, key, LISTING_GIVE_UP)
    return out(R.inflight_listing(listed, "method", "dst"))
