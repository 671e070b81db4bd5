"""Golden cases read off the original programs (see FIXTURES.md)."""

from pyspark.sql import functions as F

from lexigate.functions import atoi, position_rule, split_tokens
from lexigate.operators import chunks as C
from lexigate.operators import dictionary as D
from lexigate.operators import matching as M
from lexigate.operators import requests as R
from lexigate.operators import scoring as S
from lexigate.operators import sequence as Q
from lexigate.sources import fixtures


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _pats(spark, rows):
    return spark.createDataFrame(rows, fixtures.PATTERN_SCHEMA)


def test_sample_dictionary(spark):
    cats = D.categories(fixtures.sample_urlkeyword(spark))
    assert [(r.cat_index, r.category) for r in cats.orderBy("cat_index").collect()] == [
        (1, 567), (2, 266), (3, 269)]
    toks = D.dictionary_tokens(cats)
    idx = D.keyword_index(toks)
    lists = D.keyword_lists(idx).orderBy("iid").collect()
    assert [(r.iid, r.word, len(r.word.encode()), r.cat_index) for r in lists] == [
        (1, "王菲", 6, [1, 3]), (2, "狗仔", 6, [1]), (3, "艳照", 6, [1]), (4, "百度", 6, [2]),
        (5, "好友", 6, [2, 3]), (6, "浏览器", 9, [2]), (7, "人人", 6, [3])]
    totals = D.category_totals(cats, toks).orderBy("cat_index").collect()
    assert [r.total_words for r in totals] == [3, 3, 3]


def _policy_occ(spark, text):
    pats = D.policy_patterns(fixtures.policies(spark).filter("name = 'test'"),
                             fixtures.policy_keywords(spark))
    return M.keyword_occurrences(_docs(spark, text), pats,
                                 keep=["policy", "percent", "content_num"])


def test_policy_below_threshold(spark):
    occ = _policy_occ(spark, "he is good ,hello word")
    assert sorted((r.pattern_id, r.idx) for r in occ.collect()) == [(4, 0), (4, 12)]
    pct = S.policy_percent(S.policy_hits(occ)).collect()
    assert [(r.hit_times, r.hit_percent) for r in pct] == [(2, 50)]
    dec = S.policy_decision(S.policy_percent(S.policy_hits(occ)), _docs(spark, "x")).collect()
    assert [r.matched for r in dec] == [False]


def test_policy_above_threshold_and_trigger(spark):
    occ = _policy_occ(spark, "she says ushers")
    got = sorted((r.idx, r.pattern_id) for r in occ.collect())
    assert got == [(0, 3), (1, 4), (10, 3), (11, 1), (11, 4)]
    pct = S.policy_percent(S.policy_hits(occ)).collect()
    assert [r.hit_percent for r in pct] == [125]
    trig = Q.policy_trigger(occ).collect()
    # third event in match order, ending at byte 13, 75 percent
    assert [(r.events, r.end_idx, r.running_percent) for r in trig] == [(3, 13, 75)]


def test_strict_threshold(spark):
    occ = _policy_occ(spark, "he she his hers")  # 6 events of 4 words -> 150, over 70
    pct = S.policy_percent(S.policy_hits(occ))
    pol = pct.withColumn("percent", F.col("hit_percent"))  # threshold equal to percent
    assert [r.matched for r in S.policy_decision(pol, _docs(spark, "x")).collect()] == [False]


def test_category_score_sentence(spark):
    text = "你好,王菲,我是狗仔队教练,我手中有你的艳照"
    assert len(text.encode()) == 60
    cats = D.categories(fixtures.sample_urlkeyword(spark))
    toks = D.dictionary_tokens(cats)
    idx = D.keyword_index(toks)
    pats = D.service_patterns(idx)
    docs = _docs(spark, text, "lalalal")
    occ = M.keyword_occurrences(docs, pats).filter("doc_id = 0")
    assert sorted((r.pattern_id, r.idx) for r in occ.collect()) == [(1, 7), (2, 20), (3, 54)]
    hits = M.keyword_hits(docs, pats)
    ch = S.category_hits(S.hit_categories(hits, idx))
    assert sorted((r.cat_index, r.hits) for r in ch.collect()) == [(1, 3), (3, 1)]
    v = S.url_verdict(ch, D.category_totals(cats, toks), docs.select("doc_id"))
    assert sorted((r.doc_id, r.type) for r in v.collect()) == [(0, 567), (1, 0)]
    assert S.valid_verdicts(v).count() == 1


def test_overlap_case_and_fold(spark):
    def starts(word, nocase, text):
        rows = spark.createDataFrame([(1, bytearray(text.encode()))], "doc_id long, data binary")
        found = M.byte_occurrences(rows, _pats(spark, [(1, word, nocase, 0, 0, "x")]), "data")
        return sorted(r.idx for r in found.collect())

    assert starts("aa", False, "aaaa") == [0, 1, 2]
    assert starts("He", False, "he HE He") == [6]
    assert starts("He", True, "he HE He") == [0, 3, 6]
    assert starts("É", True, "é") == []


def test_case_rule_native(spark):
    pats = _pats(spark, [(1, "He", False, 0, 0, "x"), (2, "He", True, 0, 0, "x"),
                         (3, "É", True, 0, 0, "x")])
    docs = _docs(spark, "he HE", "He", "é")
    hits = sorted(tuple(r) for r in M.keyword_hits(docs, pats).collect())
    assert hits == [(0, 2), (1, 1), (1, 2)]


def test_position_rule(spark):
    cases = [(0, 0), (6, 0), (5, 0), (0, 6), (0, 7), (-1, 0)]
    df = spark.createDataFrame([(o, d) for o, d in cases], "offset int, depth int")
    got = [r.keep for r in df.select(
        position_rule(F.lit(5), F.lit(2), "offset", "depth").alias("keep")).collect()]
    assert got == [True, False, True, False, True, False]


def test_position_rule_in_hits(spark):
    pats = _pats(spark, [(1, "he", False, 5, 0, "x"), (2, "he", False, 0, 2, "x"),
                         (3, "he", False, -1, 0, "x")])
    docs = _docs(spark, "he..he", "xhe")
    hits = sorted(tuple(r) for r in M.keyword_hits(docs, pats).collect())
    assert hits == [(0, 2)]  # "he" at 4 is before offset 5; only doc 0 has it at 0


def test_tokens_and_atoi(spark):
    df = spark.createDataFrame([(",,a,,b,", "  12x"), ("a, b", "x")], "l string, n string")
    rows = df.select(split_tokens("l").alias("t"), atoi("n").alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [(["a", "b"], 12), (["a", " b"], 0)]


def test_chunk_stitch(spark):
    chunks = spark.createDataFrame(
        [(1, 1, bytearray(b"xxhe")), (1, 2, bytearray(b"rs sh")), (1, 3, bytearray(b"e"))],
        "resource_id long, seq int, data binary")
    pats = _pats(spark, [(1, "hers", False, 0, 0, "t"), (2, "his", False, 0, 0, "t"),
                         (3, "she", False, 0, 0, "t"), (4, "he", False, 0, 0, "t")])
    got = sorted((r.seq, r.pattern_id, r.idx) for r in C.chunk_stitch(chunks, pats).collect())
    assert got == [(1, 4, 2), (2, 1, -2), (3, 3, -2), (3, 4, -1)]
    strict = C.chunk_stitch(chunks, pats, boundary="strict").collect()
    assert [(r.seq, r.pattern_id, r.idx) for r in strict] == [(1, 4, 2)]


def test_request_parse_and_rejects(spark):
    good = "GET /1.html HTTP/1.1\r\nHost: www.baidu.com\r\n\r\n"
    rows = [
        (1, 6, 80, 0, 0, 0, 40 + len(good), 7, good),
        (2, 6, 80, 0, 0, 0, 40 + len(good), 7, good.replace("GET", "POST")),
        (3, 6, 80, 0, 0, 0, 40 + len(good), 7, good.replace("Host: ", "Hxst: ")),
        (4, 6, 80, 0, 0, 0, 40 + len(good), 7, good.replace("Host: ", "host: ")),
        (5, 6, 80, 1, 0, 0, 40 + len(good), 7, good),
        (6, 6, 8080, 0, 0, 0, 40 + len(good), 7, good),
        (7, 17, 80, 0, 0, 0, 40 + len(good), 7, good),
        (8, 6, 80, 0, 0, 0, 63, 7, good),
    ]
    df = spark.createDataFrame(rows, "req_id long, protocol int, dst_port int, syn int, "
                                     "fin int, rst int, total_len long, dst long, payload string")
    out = R.http_request_extract(R.http_get_filter(df)).collect()
    assert [(r.req_id, r.host, r.path, r.method) for r in out] == [
        (1, "www.baidu.com", "/1.html", 1)]


def test_request_dedup_and_inflight(spark):
    schema = "req_id long, method tinyint, dst long, host string, path string"
    a = spark.createDataFrame([(1, 0, 0, "www.baidu.com", "/1.html"),
                               (2, 0, 0, "www.baidu.com", "/1.html"),
                               (3, 0, 1, "www.baidu.com", "/1.html")], schema)
    d = R.request_dedup(a).collect()
    assert sorted((r.dst, r.req_id, r.copies) for r in d) == [(0, 1, 2), (1, 3, 1)]
    inflight = a.filter("req_id = 1")
    admitted = R.inflight_exclusion(a.filter("req_id = 2"), inflight).count()
    assert admitted == 0
    released = R.inflight_completion(inflight, inflight)
    assert R.inflight_exclusion(a.filter("req_id = 2"), released).count() == 1
