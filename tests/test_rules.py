"""Rules and sizes that once changed the method: positions, keys, big dictionaries, stream state."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexigate.operators import chunks as C
from lexigate.operators import dictionary as D
from lexigate.operators import matching as M
from lexigate.operators import requests as R
from lexigate.operators import scoring as S
from lexigate.plans import catalog
from lexigate.sources import derived, fixtures
from lexigate.streaming import operators as SO
from lexigate.streaming import runner

from conftest import SF_SMALL


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def pats_of(spark, rows):
    return spark.createDataFrame(rows, fixtures.PATTERN_SCHEMA)


def naive(patterns, texts):
    """(doc, pattern, byte start) of every occurrence under the case and position rules."""
    fold = bytes.maketrans(bytes(range(97, 123)), bytes(range(65, 91)))
    out = []
    for d, text in enumerate(texts):
        raw = text.encode()
        for pid, pat, nocase, offset, depth, *_ in patterns:
            t, p = (raw.translate(fold), pat.encode().translate(fold)) if nocase else (raw, pat.encode())
            for i in range(len(t) - len(p) + 1):
                if t[i:i + len(p)] == p and offset >= 0 and depth >= 0 and (not offset or offset <= i) and (
                        not depth or offset + depth >= i + len(p)):
                    out.append((d, pid, i))
    return sorted(out)


def test_random_patterns_and_rules(spark):
    rng = random.Random(1)
    alphabet = "abABé人"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    pats = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))), rng.random() < 0.5,
             rng.choice([0, 0, 3, 10, -1]), rng.choice([0, 0, 12, 40, -1]), "x") for i in range(80)]
    pats += [(200, "abABabABabABabAB"[:9] + "", True, 0, 0, "x"), (201, texts[3][:20] or "a", False, 0, 0, "x")]
    d, p = docs_of(spark, *texts), pats_of(spark, pats)
    want = naive(pats, texts)
    got = M.keyword_occurrences(d, p).select("doc_id", "pattern_id", "idx").collect()
    assert sorted(map(tuple, got)) == want
    hits = sorted({(a, b) for a, b, _ in want})
    for how in M.STRATEGIES:
        assert sorted(map(tuple, M.keyword_hits(d, p, strategy=how).collect())) == hits
    counts = {(r["doc_id"], r["pattern_id"]): r["occurrences"] for r in M.occurrence_counts(d, p).collect()}
    assert counts == {k: sum((a, b) == k for a, b, _ in want) for k in hits}
    for how in M.STRATEGIES:
        some = {r["doc_id"] for r in M.any_match_docs(d, p, strategy=how).collect()}
        none = {r["doc_id"] for r in M.no_match_docs(d, p, strategy=how).collect()}
        assert some == {a for a, _ in hits} and none == set(range(30)) - some


@pytest.mark.parametrize("how", M.STRATEGIES)
def test_no_size_changes_the_method(spark, how):
    long = "x" + "ab" * 2500  # 5,001 characters
    words = [f"w{i}" for i in range(70)] + [long, "人人", "百度"]
    pats = pats_of(spark, [(i, w, False, 0, 0, "x") for i, w in enumerate(words)])
    d = docs_of(spark, f"..{long}..", "w69 人人", "度百")
    assert sorted(map(tuple, M.keyword_hits(d, pats, strategy=how).collect())) == [
        (0, 70), (1, 6), (1, 69), (1, 71)]


def test_two_character_words_need_no_nested_loop(spark):
    words = [chr(0x4E00 + i) + chr(0x4E00 + (i * 7) % 900) for i in range(900)]
    pats = pats_of(spark, [(i, w, False, 0, 0, "x") for i, w in enumerate(words)])
    found = M.keyword_hits(docs_of(spark, "".join(words[:3]), "none"), pats)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "InPandas" not in plan
    assert {r["pattern_id"] for r in found.collect()} >= {0, 1, 2}


def test_blocks_of_patterns_give_the_same_rows(spark, monkeypatch):
    d, pats = derived.docs(spark, SF_SMALL), fixtures.patterns(spark)
    whole = sorted(map(tuple, M.keyword_occurrences(d, pats).collect()))
    monkeypatch.setattr(M, "BLOCK_BYTES", 200)
    monkeypatch.setattr(M, "REGEX_WORDS", 2)
    assert sorted(map(tuple, M.keyword_occurrences(d, pats).collect())) == whole
    assert sorted(map(tuple, M.keyword_hits(d, pats, strategy="regex").collect())) == sorted({r[:2] for r in whole})


def test_position_rule_in_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, bytearray(b"he..he")), (1, 1, bytearray(b"hehe"))],
                                   "resource_id long, seq int, data binary")
    pats = pats_of(spark, [(1, "he", False, 4, 0, "x"), (2, "he", False, -1, 0, "x"), (3, "he", False, 0, 2, "x")])
    got = sorted((r.seq, r.pattern_id, r.idx) for r in C.chunk_stitch(chunks, pats).collect())
    assert got == [(0, 1, 4), (0, 3, 0), (1, 3, 0)]


def test_staged_input_keeps_its_partitions(spark):
    staged = runner.stage(spark, [spark.range(1000).repartition(6)], "partitions")
    assert len(spark.read.parquet(staged.path).inputFiles()) == 6


def test_every_request_rule_is_triggered(spark):
    """Each variant of the payloads is there, so that leaving out one rule shows."""
    p = derived.http_payloads(spark, "/root/testdata/sf0.01")
    seen = {r["v"] for r in p.select(F.expr(f"(req_id div 4) % {derived.PAYLOAD_VARIANTS}").alias("v")).distinct().collect()}
    assert set(range(14)) <= seen
    for rule in ("dst_port <> 80", "rst = 1", "syn = 1", "fin = 1", "protocol <> 6", "total_len < 64",
                 "length(payload) > 2048", "octet_length(payload) > total_len - 40"):
        assert p.filter(rule).count() > 0, rule
    foreign = derived.foreign_requests(spark, SF_SMALL)
    for field in ("method", "dst", "host", "path"):
        assert foreign.filter(F.col(field).isNull()).count() > 0, field


def test_url_verdict_has_one_exchange_of_subjects(spark):
    df = entry.queries()["url_verdict"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 2 and "MapIn" not in plan and "NestedLoop" not in plan


def test_large_dictionary_verdict(spark):
    """A dictionary as large as the benchmark's words, through the same path."""
    words = spark.createDataFrame(
        [(1, "1", "1", ",".join(f"k{i}" for i in range(5000))), (2, "2", "1", "alpha,beta")],
        fixtures.URLKEYWORD_SCHEMA)
    from lexigate.plans import catalog as K
    d = docs_of(spark, "alpha beta", " ".join(f"k{i}" for i in range(4000)), "none", "alpha")
    got = {r["doc_id"]: r["type"] for r in K.verdicts_with(K.dictionary_tables(words), d).collect()}
    assert got == {0: 258, 1: 257, 2: 0, 3: 0}
    assert S.DEFAULT_THRESHOLD == 70 and D.SALT_ROWS > 0


def test_release_deletes_what_was_written(spark):
    import os

    from lexigate import session
    before = session._FOLDERS.pop(spark.sparkContext.applicationId, [])
    table = session.materialize(spark.range(5), "released")
    (path,) = session._FOLDERS[spark.sparkContext.applicationId]
    assert table.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    assert session.release(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
    session._FOLDERS[spark.sparkContext.applicationId] = before


def test_hits_on_every_edge_of_a_piece(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abAé") for _ in range(n)) for n in (0, 1, 7, 8, 9, 63, 64, 65, 400)]
    pats = pats_of(spark, [(i, w, c, o, d, "x") for i, (w, c, o, d) in enumerate(
        [("a", False, 0, 0), ("ab", True, 0, 0), ("é", False, 0, 0), ("ba" * 5, True, 0, 0), ("aba", False, 6, 0),
         ("AbaéaAbab", False, 0, 0), ("bab", True, 0, 70)])])
    want = naive([tuple(r) for r in pats.collect()], texts)
    for piece in (1, 8, 64, 1 << 16):
        monkeypatch.setattr(M, "PIECE_BYTES", piece)
        got = sorted(tuple(r)[:3] for r in M.keyword_occurrences(docs_of(spark, *texts), pats).collect())
        assert got == want


def test_anchor_shuffles_the_dictionary(spark, monkeypatch):
    d, pats = derived.docs(spark, SF_SMALL), fixtures.patterns(spark)
    want = sorted(map(tuple, M.keyword_hits(d, pats).collect()))
    found = M.keyword_hits(d, pats, strategy="anchor")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want
    assert plan.count("strategy=merge") == 1 and plan.count("strategy=broadcast") == 1  # the bitmap alone
    monkeypatch.setattr(M, "ANCHOR_BYTES", 2)  # longer ones go the other way
    assert sorted(map(tuple, M.keyword_hits(d, pats, strategy="anchor").collect())) == want
    none = M.keyword_hits(d, pats.limit(0), strategy="anchor")
    assert none.collect() == []


def test_window_that_ends_inside_a_character(spark):
    get = "GET /é HTTP/1.1\r\nHost: www.é.com\r\n\r\né"
    cut = len(get.encode()) + 40 - 1
    rows = [(i, 6, 80, 0, 0, 0, cut - k, 5, get) for i, k in enumerate((0, -1, 5, 6, 12))]
    p = spark.createDataFrame(rows, "req_id long, protocol int, dst_port int, syn int, fin int, rst int, "
                                    "total_len long, dst long, payload string")
    got = {r["req_id"]: (r["host"], r["path"]) for r in R.request_fields(p).collect()}
    assert got == {0: ("www.é.com", "/é"), 1: ("www.é.com", "/é"), 2: (None, "/é"), 3: (None, "/é"), 4: (None, "/é")}
    assert {r["req_id"] for r in SO.stream_requests(p).collect()} == {0, 1}


def test_chunk_edges_travel_alone(spark):
    rows = [(1, i, bytearray(c.encode())) for i, c in enumerate(["xs", "h", "e", "", "r", "s he"])]
    rows += [(2, 0, bytearray(b"..sh")), (2, 2, bytearray(b"he"))]  # chunk 1 never came
    chunks = spark.createDataFrame(rows, "resource_id long, seq int, data binary")
    pats = pats_of(spark, [(1, "hers", False, 0, 0, "x"), (2, "she", False, 0, 0, "x"), (3, "xshers he", True, 0, 0, "x")])
    found = C.chunk_stitch(chunks, pats)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.resource_id, r.seq, r.pattern_id, r.idx) for r in found.collect()) == [
        (1, 2, 2, -2), (1, 5, 1, -3), (1, 5, 3, -5)]


def test_anchor_shuffles_a_texts_equal_bytes_once(spark):
    """Shuffled candidates are distinct bytes of a text, not every position with the longest window."""
    d = spark.createDataFrame([(1, "ab " * 5000 + "longer word abc"), (2, "AB long words"), (None, "ab")], "doc_id long, text string")
    pats = spark.createDataFrame([(1, "ab", False, 0, 0, "x"), (2, "ab", False, 0, 0, "x"), (3, "longer word", False, 0, 0, "x"),
                                  (4, "long word", True, 0, 0, "x"), (5, "LONG WORDS", True, 0, 0, "x"),
                                  (6, "ab", True, 0, 0, "x")], fixtures.PATTERN_SCHEMA)
    side = M._byte_side(M._pattern_side(pats.filter("pattern_id <> 2")))
    rows = d.select("doc_id", F.encode("text", "UTF-8").alias("data"))
    assert M._shuffled_hits(rows, side, "data", once=True).count() == 8
    assert M._shuffled_hits(rows, side, "data").count() > 10_000
    got = sorted(map(tuple, M.keyword_hits(d, pats, strategy="anchor").collect()), key=str)
    assert got == sorted(map(tuple, M.keyword_hits(d, pats).collect()), key=str) and len(got) == 10


def test_lists_are_joined_to_their_ids_before_they_are_split(spark):
    rows = [(1, "a,b,,c"), (1, "d"), (2, ""), (None, "e"), (3, None)]
    lists = spark.createDataFrame(rows, "id long, keywordlist string").select(
        "id", F.lit("1").alias("groupid"), F.lit("1").alias("grouptype"), "keywordlist")
    cats = D.categories(lists)
    places = catalog.dictionary_places(cats)
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # the tokens stand above the join
    old = D.dictionary_tokens(cats).join(cats.select("cat_index", "id"), "cat_index").select("id", "pos", "word")
    assert sorted(map(tuple, places.collect())) == sorted(map(tuple, old.collect()))
