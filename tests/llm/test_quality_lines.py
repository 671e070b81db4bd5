"""Quality rules and line de-duplication against plain Python."""

import collections
import glob
import hashlib

import duckdb
import re

from pyspark.sql import functions as F

from lexigate.llm import lines, quality
from lexigate.llm.queries import QUERIES
from lexigate.llm.sql import LINE_DEDUP
from lexigate.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    t = text or ""
    w = re.findall(WORD, t)
    ls = [x for x in t.split("\n") if re.search(WORD, x)]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered))


def test_counts_match_plain_python(odd_docs):
    got = quality.judge(odd_docs, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        n = plain_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])


def test_overlapping_repeats_and_duplicate_lines(spark):
    texts = ["a a a a", "a b c x a b c", "a b a b a b", "x\nx\n\n \nx", "one two"]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs, F.col("doc_id")).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == plain_counts(t)[3:], t


def test_thresholds_adapt_to_the_source(spark):
    """A ratio that is usual in one source is an outlier in another."""
    def text(i, symbol):
        return " ".join(f"w{i}x{k}" + (symbol if k % 2 else "") for k in range(80))
    rows = [(i, text(i, ""), "en", "plain") for i in range(120)] + [(1000 + i, text(i, "#"), "en", "code") for i in range(120)]
    rows += [(5000, text(7777, "#"), "en", "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, F.col("doc_id")).collect()}
    assert not kept[5000]
    assert all(v for k, v in kept.items() if k != 5000)


def test_limits_of_repeated_lines_come_from_the_sketch(spark):
    """Verse repeats lines in every text, reports do not: no constant keeps the verse and
    rejects the report that reads like verse. One short line again is never judged."""
    def text(i, lines, again):
        own = [" ".join(f"d{i:04}l{k:02}w{j:02}" for j in range(12)) for k in range(lines)]
        return "\n".join(own + own[:again])
    rows = [(i, text(i, 16, 4), "en", "verse") for i in range(120)]
    rows += [(1000 + i, text(1000 + i, 20, 0), "en", "report") for i in range(900)]
    rows += [(5000, text(5000, 16, 4), "en", "report"), (5001, text(5001, 5, 0) + "\nsee page two\nsee page two", "en", "report")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, F.col("doc_id")).collect()}
    assert {k for k, v in kept.items() if not v} == {5000}


def test_a_source_of_much_junk_does_not_set_its_own_limit(spark):
    def text(i, symbol):
        return " ".join(f"w{i}x{k}" + (symbol if k % 2 else "") for k in range(80))
    rows = [(i, text(i, "#" if i % 7 == 0 else ""), "en", "dump") for i in range(140)]
    rows += [(1000 + i, text(1000 + i, ""), "en", "plain") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, F.col("doc_id")).collect()}
    assert {k for k, v in kept.items() if not v} == set(range(0, 140, 7))


def test_merged_sketches_equal_one_sketch(odd_docs):
    counted = quality.features(odd_docs, F.col("text"), F.col("doc_id"), F.col("lang").alias("__lang"),
                               F.col("source").alias("__source"))
    parts = quality.sketches(counted.filter("doc_id % 2 = 0")).unionByName(
        quality.sketches(counted.filter("doc_id % 2 = 1 or doc_id is null")))
    by = ("__lang", "__source")
    whole = {tuple(r) for r in quality.merged(quality.sketches(counted), *by).collect()}
    assert {tuple(r) for r in quality.merged(parts, *by).collect()} == whole


def test_filter_keeps_columns_and_rows(odd_docs, no_docs):
    out = quality.filter_documents(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(5) == 2 and 1 not in ids and 2 not in ids
    assert quality.filter_documents(no_docs).count() == 0


def plain_lines(rows, least=40, docs=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        def drops(x):
            k = key(x)
            ids = [i for i in held[k] if i is not None]
            return len(k) >= least and len(held[k]) >= docs and d != (max(ids) if ids else None)
        kept = [x for x in ls if not drops(x)]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(docs, **options):
    out = lines.dedup_lines(docs.select("doc_id", "text"), **options)
    kept = F.coalesce("kept_text", "text", F.lit(""))
    return sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2(
        kept.cast("binary"), 256)).collect()), key=str)


def test_lines_match_plain_python(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert digest(odd_docs) == plain_lines(rows)


def test_batches_and_levels_do_not_change_the_result(odd_docs):
    base = digest(odd_docs, batches=1, fanout=9)
    assert digest(odd_docs, batches=5, fanout=2) == base
    assert digest(odd_docs, batches=3, fanout=3) == base


def test_fresh_keys_are_unique_over_runs(odd_docs, spark):
    keys = lines.line_keys(odd_docs, min_chars=1, batches=3)
    runs = lines.LineRuns(spark, fanout=10)
    for b in range(3):
        runs.add(keys.filter(F.col("batch") == b))
    every = runs.runs()[0]
    for r in runs.runs()[1:]:
        every = every.unionByName(r)
    assert every.filter("fresh").groupBy("h1", "h2").count().filter("count > 1").count() == 0
    assert every.filter("fresh").count() == keys.select("h1", "h2").distinct().count()


def test_stage_keeps_columns_nulls_and_repeats(odd_docs, no_docs):
    out = lines.filter_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[1]["text"] is None and by_id[1]["n_chars"] is None
    assert "very line" in by_id[16]["text"].lower() and "very line" not in by_id[11]["text"].lower()
    assert by_id[11]["n_chars"] == len(by_id[11]["text"])
    assert lines.filter_lines(no_docs).count() == 0


def test_repeated_and_null_ids_against_the_sql(spark, tmp_path):
    line = "A line of more than forty code points, found in many rows"
    rows = [(1, line)] * 5 + [(None, line + " b")] * 5 + [(i, f"{line} c\nown {i}") for i in (2, 2, 3, 4, 4)] + [(7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op6_line_dedup"][0](spark, str(tmp_path)).select("doc_id", "kept_sha256", "n_dropped", "n_lines")
    want = con.execute(f"SELECT doc_id, kept_sha256, n_dropped, n_lines FROM ({LINE_DEDUP})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) == 3


def test_runs_are_deleted(odd_docs, spark):
    tables = {t.name for t in spark.catalog.listTables()}
    before = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/tables/line-run-*"))
    lines.dropped_lines(odd_docs.select("doc_id", "text")).count()
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/tables/line-run-*")) == before


def test_bitmap_misses_no_text(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    drops = rows.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("d_doc"), F.xxhash64("text").alias("d_hash"),
                                                 F.array(F.lit(0)).alias("drops"))
    told = lines.marked(rows, drops)
    assert told.filter("doc_id % 7 = 0 AND NOT __marked").count() == 0
    assert told.filter("__marked").count() < 1000 and told.count() == 4000
