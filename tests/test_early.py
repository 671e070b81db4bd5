"""Searches that stop at the first match, the match function in SQL, and in-flight state."""

import random

from pyspark.sql import functions as F

from lexigate.api import KeywordMatcher
from lexigate.functions.udtf import match_by_function, register_match_function
from lexigate.operators import early, matching
from lexigate.operators.sequence import first_match
from lexigate.sources import fixtures
from lexigate.streaming import operators as SO
from lexigate.streaming import runner

DOCS = "doc_id long, text string"


def pats_of(spark, *rows):
    """Rows (pattern, nocase, offset, depth)."""
    return spark.createDataFrame([(i + 1, *r, "x") for i, r in enumerate(rows)], fixtures.PATTERN_SCHEMA)


def test_first_event_equals_the_whole_search(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("abxé") for _ in range(rng.choice([0, 3, 16, 17, 40, 300])))) for i in range(150)]
    rows += [(3, "ba" * 40), (200, None), (None, "xxab"), (201, "x" * 500 + "abab")]
    docs = spark.createDataFrame(rows, DOCS)
    pats = pats_of(spark, ("aab", False, 0, 0), ("BBA", True, 0, 0), ("abababxxab", False, 0, 0),
                   ("xa", False, 9, 30), ("éé", False, 0, 40), ("xab", False, 0, 0))
    whole = first_match(matching.keyword_occurrences(docs, pats))
    want = sorted(map(tuple, whole.filter("doc_id is not null").collect()))
    for stretch, growth in ((7, 2), (16, 4), (early.STRETCH, early.GROWTH)):
        got = early.first_events(docs, pats, stretch=stretch, growth=growth)
        assert sorted(map(tuple, got.filter("doc_id is not null").collect())) == want, (stretch, growth)
    assert len(want) > 50 and any(r[0] == 201 for r in want)
    m = KeywordMatcher(spark).add_patterns(pats, "pattern_id", "pattern", F.col("nocase"), F.col("offset"), F.col("depth"))
    for fast, plain in ((early.any_match_docs, m.any), (early.no_match_docs, m.none)):
        key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "")
        assert sorted(fast(docs, m.patterns).collect(), key=key) == sorted(plain(docs).collect(), key=key)


def test_settled_texts_are_not_read_on(spark, monkeypatch):
    """Later rounds hold only texts without an early match (and ids that collide with one)."""
    rows = [(i, "hit" + "x" * 4000) for i in range(40)] + [(100 + i, "x" * 4000) for i in range(3)]
    seen, plain = [], early.byte_occurrences

    def spied(rounds, *args):
        seen.append({r[0] for r in rounds.select("doc_id").collect()})
        return plain(rounds, *args)

    monkeypatch.setattr(early, "byte_occurrences", spied)
    docs = spark.createDataFrame(rows, DOCS)
    got = early.first_events(docs, pats_of(spark, ("hit", False, 0, 0)), stretch=64)
    assert {r["doc_id"] for r in got.collect()} == set(range(40))
    assert len(seen) == 4 and len(seen[0]) == 43
    assert all({100, 101, 102} <= s and len(s) < 10 for s in seen[1:])


def test_no_texts_and_no_patterns(spark):
    docs, pats = spark.createDataFrame([(1, "abc")], DOCS), pats_of(spark, ("b", False, 0, 0))
    assert early.first_events(docs.limit(0), pats).count() == 0
    assert early.first_events(docs, pats.limit(0)).count() == 0
    assert early.no_match_docs(docs, pats.limit(0)).count() == 1


def test_match_function_on_any_table(spark):
    pats = pats_of(spark, ("aba", False, 0, 0), ("É", False, 0, 0), ("NEEDLE IN HAY", True, 0, 0), ("a", False, 2, 4))
    long_text = "x" * ((1 << 16) - 5) + "needle in hay"
    texts = [(1, "ababa"), (2, "ABA É"), (3, None), (4, ""), (5, long_text), (6, "ababa")]
    docs = spark.createDataFrame(texts, DOCS)
    name = register_match_function(pats, "matches_of_test")
    got = spark.sql(f"SELECT d.doc_id, m.* FROM {{d}} d, LATERAL {name}(d.text) m", d=docs)
    want = matching.keyword_occurrences(docs, pats).select("doc_id", "pattern_id", "idx", "end_idx")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    other = spark.createDataFrame([("r", "an aba")], "row string, body string")
    assert {r[0] for r in spark.sql(f"SELECT m.pattern_id FROM {{o}}, LATERAL {name}(body) m", o=other).collect()} == {1, 4}


def test_inflight_keys_between_waves(spark):
    """The state after each micro-batch lists what is in flight there."""
    schema = "req_id long, url string, t long, kind string"
    waves = [[(1, "a", 100, "request"), (2, "b", 110, "request")], [(0, "end", 100_000, "done")],
             [(3, "a", 99_000, "done"), (4, "c", 99_500, "request")], [(0, "end", 200_000, "done")]]
    staged = runner.stage(spark, [spark.createDataFrame(w, schema).select(
        "req_id", "url", F.timestamp_seconds("t").alias("ts"), "kind") for w in waves], "inflight_keys")
    stream = SO.inflight_until_done(runner.read_stream(spark, staged), ["url"], "ts", 500_000, "1 hour")
    chk = runner.run_to_state(stream, "inflight_keys", staged)
    keys = SO.inflight_keys(spark, chk, ["url"], 500_000)
    assert {r["url"] for r in keys.collect()} == {"b", "c"}
    early_on = [{r["url"] for r in SO.inflight_keys(spark, chk, ["url"], 500_000, batch_id=b).collect()}
                for b in range(4)]
    assert {"a", "b"} in early_on
    first = keys.filter("url = 'b'").select(F.unix_seconds("since"), F.unix_seconds("until")).first()
    assert tuple(first) == (110, 500_110)


def test_match_function_takes_stretches_not_texts(spark):
    """A match carries a short stretch to the join, not its text; hits over cuts are found once."""
    pats = pats_of(spark, ("needle in hay", True, 0, 0), ("É", False, 0, 0), ("a", False, 100, 6), ("aa", False, 0, 0))
    texts = [(i, "x" * (n - 5) + "Needle in hay aaa É") for i, n in enumerate(range(60, 1200, 7))]
    texts += [(-1, "É" * 300), (-2, None), (-3, ""), (-4, "É" * 300), (None, "aa"), (None, "aa")]
    docs = spark.createDataFrame(texts, DOCS)
    got = match_by_function(docs, register_match_function(pats, "matches_of_stretches"))
    want = matching.keyword_occurrences(docs, pats).select("doc_id", "pattern_id", "idx", "end_idx")
    key = lambda r: (r[0] is None, *(v or 0 for v in r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join Inner" in line and "<=>" in line]
    assert joined and all("__part" in line for line in joined) and not any("text#" in line for line in joined)
