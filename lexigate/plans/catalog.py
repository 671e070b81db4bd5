"""Every registered query: a Spark plan over the given tables and its SQL oracle.

``QUERIES[name] = (build(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
Integer outputs are BIGINT on both sides so schemas compare equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigate.functions import code_groupid, code_grouptype
from lexigate.functions.udtf import match_by_function, register_keyword_matches, register_match_function
from lexigate.operators import batches as B
from lexigate.operators import chunks as C
from lexigate.operators import dictionary as D
from lexigate.operators import early as E
from lexigate.operators import matching as M
from lexigate.operators import requests as R
from lexigate.operators import scoring as S
from lexigate.operators import sequence as Q
from lexigate.operators.ordinal import global_ordinal
from lexigate.plans import oracle as O
from lexigate.session import dealt_by_bytes, local_copy, materialize, new_folder
from lexigate.sources import derived, fixtures, sinks
from lexigate.sources.tables import pages

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def out(df: DataFrame) -> DataFrame:
    """Integral columns (and integral arrays) as BIGINT."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _INTS):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, _INTS):
            cols.append(F.col(f.name).cast("array<bigint>").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# shared building blocks (Spark side)
# ---------------------------------------------------------------------------

_SMALL_CACHE: dict = {}


def word_dictionary(spark):
    """The fixed word dictionary: categories, tokens, index, totals, patterns.

    A fixed list of a few words, so its tables are evaluated once per session and
    kept as local relations instead of being derived again by every query.
    """
    key = (spark.sparkContext.applicationId, "word_dictionary")
    if key not in _SMALL_CACHE:
        _SMALL_CACHE[key] = tuple(map(local_copy, dictionary_tables(fixtures.word_dictionary(spark))))
    return _SMALL_CACHE[key]


def dictionary_tables(dictionary: DataFrame):
    """Categories, tokens, index, totals and patterns of a dictionary of any size."""
    cats = D.categories(dictionary)
    toks = D.dictionary_tokens(cats)
    idx = D.keyword_index(toks)
    return cats, toks, idx, D.category_totals(cats, toks), D.service_patterns(idx)


def verdicts_with(tables, texts: DataFrame, id_col: str = "doc_id", text: str = "text",
                  subjects: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Category verdict per subject with the given dictionary tables (any size).

    ``subjects`` (default: the ids of ``texts``) is every id that gets a verdict.
    ``dealt``, for dictionaries in which a text hits many words: texts are dealt by id, so
    many bytes to a task, and all steps to the verdict stay there, so that a task's
    (text, category) counts do not grow with the table. A null id has no hits either way.
    """
    _, _, idx, totals, pats = tables
    subjects = subjects if subjects is not None else texts.select(id_col)
    texts = texts.select(id_col, text)
    if dealt:
        # stored, so that Spark knows their sizes: small ones are broadcast
        idx, totals = materialize(idx, "keyword-index"), materialize(totals, "category-totals")
        texts = dealt_by_bytes(texts.filter(F.col(id_col).isNotNull()), id_col, text)
        found = M.keyword_occurrences(texts, D.service_patterns(idx), id_col=id_col, text=text)
        hits = found.select(id_col, "pattern_id").distinct()
    else:
        found = M.keyword_occurrences(texts, pats, id_col=id_col, text=text)
        hits = S.hit_sets(found, id_col).select(id_col, F.explode("patterns").alias("pattern_id"))
    ch = S.category_hits(S.hit_categories(hits, idx, id_col=id_col), id_col=id_col)
    return S.url_verdict(ch, totals, subjects, id_col=id_col)


def doc_dictionary(spark, sf):
    """The document-derived dictionary (grows with the data): categories, tokens."""
    cats = D.categories(derived.doc_dictionary(spark, sf))
    return cats, D.dictionary_tokens(cats)


def fixture_policy_patterns(spark):
    key = (spark.sparkContext.applicationId, "policy_patterns")
    if key not in _SMALL_CACHE:
        _SMALL_CACHE[key] = local_copy(D.policy_patterns(
            fixtures.policies(spark), fixtures.policy_keywords(spark)))
    return _SMALL_CACHE[key]


def test_policy_patterns(spark):
    return fixture_policy_patterns(spark).filter(F.col("policy") == "test")


def doc_verdicts(spark, sf):
    return verdicts_with(word_dictionary(spark), derived.docs(spark, sf),
                         subjects=derived.doc_ids(spark, sf))


def request_verdicts(spark, sf):
    """Captured payloads to one verdict per distinct URL request.

    GET filter -> host/path extraction -> length guard -> de-dup -> content
    (left outer) -> keyword hits -> category hits -> verdict.
    """
    gets = R.http_get_filter(derived.http_payloads(spark, sf))
    reqs = R.request_dedup(R.request_length_guard(R.http_request_extract(gets)))
    # Each body is scored where it is read; only its code is joined to the requests
    # on (host, path). A request without content keeps type 0.
    bodies = derived.page_content(spark, sf).select("page_id", "host", "path", F.col("html").alias("text"))
    codes = verdicts_with(word_dictionary(spark), bodies, id_col="page_id",
                          subjects=bodies.select("page_id", "host", "path"))
    return (reqs.select("req_id", "method", "dst", "host", "path")
            .join(codes.select("host", "path", "type"), ["host", "path"], "left")
            .select("req_id", "method", "dst", "host", "path",
                    F.coalesce("type", F.lit(0)).cast("int").alias("type")))


def occ_of(spark, sf, pats, keep=None):
    return M.keyword_occurrences(derived.docs(spark, sf), pats, keep=keep)


# ---------------------------------------------------------------------------
# shared building blocks (SQL side)
# ---------------------------------------------------------------------------

W = O.word_dictionary_ctes()
DD = O.doc_dictionary_ctes()
FPP = O.policy_pattern_ctes("policies", "policy_keywords", "fpp")
BPP = O.policy_pattern_ctes("bench_policies", "bench_policy_keywords", "bpp")
TEST_PP = [("tpp", "SELECT * FROM fpp WHERE policy = 'test'")]

GET_FILTER_SQL = ("SELECT * FROM http_payloads WHERE protocol = 6 AND dst_port = 80 AND syn = 0 "
                  "AND fin = 0 AND rst = 0 AND total_len - 40 >= 24 "
                  "AND starts_with(payload, 'GET') AND contains(payload, 'Host: ')")
FIELDS_SQL = (
    "SELECT req_id, CAST(1 AS TINYINT) AS method, dst, "
    "CASE WHEN h0 > 0 AND r2 > 0 THEN substr(w, h0 + 6, r2 - 1) END AS host, "
    "CASE WHEN r > 0 THEN substr(w, 5, r - 1) END AS path FROM ("
    "SELECT req_id, dst, w, r, h0, CASE WHEN h0 > 0 THEN instr(substr(w, h0 + 6), chr(13)) "
    "ELSE 0 END AS r2 FROM (SELECT req_id, dst, w, instr(substr(w, 5), ' ') AS r, "
    "instr(w, 'Host: ') AS h0 FROM (SELECT req_id, dst, "
    # A window that ends inside a character is read up to that character.
    "coalesce(" + ", ".join(f"try(decode(encode(payload)[1:CAST(total_len - {40 + k} AS INTEGER)]))" for k in range(4))
    + ") AS w FROM gets)))")
WELLFORMED = ("WHERE host IS NOT NULL AND path IS NOT NULL AND method IS NOT NULL "
              "AND dst IS NOT NULL AND host <> '' AND path <> ''")
REQ_CTES = [
    ("gets", GET_FILTER_SQL), ("fields", FIELDS_SQL),
    ("extracted", f"SELECT * FROM fields {WELLFORMED}"),
    ("guarded", "SELECT * FROM extracted WHERE strlen(host) <= 256 AND strlen(path) <= 2048"),
    ("rdedup", "SELECT host, path, method, dst, min(req_id) AS req_id, "
               "CAST(count(*) AS BIGINT) AS copies FROM guarded GROUP BY host, path, method, dst"),
    ("rcontent", "SELECT r.*, c.html FROM rdedup r LEFT JOIN page_content c "
                 "ON r.host = c.host AND r.path = c.path"),
    ("rbodies", "SELECT req_id, html AS text FROM rcontent WHERE html IS NOT NULL"),
]
REQ_VERDICT_CTES = W + REQ_CTES + O.verdict_ctes("rbodies", "req_id", "text")[len(W):] + [
    ("rverdict", "SELECT c.req_id, CAST(c.method AS BIGINT) AS method, c.dst, c.host, c.path, "
                 "CAST(COALESCE(b.type, 0) AS BIGINT) AS type FROM rcontent c "
                 "LEFT JOIN vbest b ON c.req_id = b.req_id"),
]


def _sql(ctes, body, *base):
    return O.with_(ctes, body, *base)


# ---------------------------------------------------------------------------
# 2.1 scans, sources, sinks
# ---------------------------------------------------------------------------

@query("dictionary_source",
       _sql([], "SELECT id, groupid, grouptype, keywordlist FROM doc_dictionary",
            "doc_dictionary"))
def q_dictionary_source(spark, sf):
    return out(D.dictionary_source(derived.doc_dictionary(spark, sf)))


@query("policy_source",
       _sql([], "SELECT name, CAST(percent AS BIGINT) AS percent FROM bench_policies",
            "bench_policies"))
def q_policy_source(spark, sf):
    return out(D.policy_source(D.require_rows(derived.bench_policies(spark, sf), "policies")))


@query("policy_keyword_source",
       _sql([], "SELECT group_name, keyword FROM bench_policy_keywords", "bench_policy_keywords"))
def q_policy_keyword_source(spark, sf):
    return D.policy_keyword_source(derived.bench_policy_keywords(spark, sf))


@query("payload_source",
       _sql([], "SELECT req_id, CAST(protocol AS BIGINT) AS protocol, "
                "CAST(dst_port AS BIGINT) AS dst_port, CAST(syn AS BIGINT) AS syn, "
                "CAST(fin AS BIGINT) AS fin, CAST(rst AS BIGINT) AS rst, total_len, dst, payload "
                "FROM http_payloads", "http_payloads"))
def q_payload_source(spark, sf):
    return out(derived.http_payloads(spark, sf))


@query("request_source",
       _sql([], "SELECT req_id, CAST(method AS BIGINT) AS method, dst, host, path, "
                "CAST(0 AS BIGINT) AS type FROM url_requests", "url_requests"))
def q_request_source(spark, sf):
    return out(R.request_source(derived.url_requests(spark, sf)))


CHUNKS_SQL = (
    f"SELECT doc_id AS resource_id, CAST(seq AS BIGINT) AS seq, "
    f"CAST(octet_length(b[seq * {O.CHUNK} + 1:(seq + 1) * {O.CHUNK}]) AS BIGINT) AS n_bytes, "
    f"md5(b[seq * {O.CHUNK} + 1:(seq + 1) * {O.CHUNK}]) AS digest FROM ("
    f"SELECT doc_id, b, unnest(range(0, (octet_length(b) + {O.CHUNK - 1}) // {O.CHUNK})) AS seq "
    "FROM (SELECT doc_id, encode(text) AS b FROM docs WHERE text IS NOT NULL))")


@query("content_chunks", _sql([], CHUNKS_SQL, "docs"))
def q_content_chunks(spark, sf):
    ch = C.content_chunks(derived.docs(spark, sf))
    return out(ch.select("resource_id", "seq", F.octet_length("data").alias("n_bytes"),
                         F.md5("data").alias("digest")))


@query("verdict_sink", _sql(O.verdict_ctes("docs", "doc_id", "text"),
                            "SELECT doc_id, type FROM verdicts WHERE type <> 0", "docs"))
def q_verdict_sink(spark, sf):
    folder = new_folder(spark, "verdict_sink", "verdicts")
    sinks.verdict_sink(doc_verdicts(spark, sf), folder, mode="overwrite")
    return out(spark.read.parquet(folder))


@query("verdict_batch_rows", _sql(REQ_VERDICT_CTES,
                                  "SELECT req_id, method, dst, type, host, path FROM rverdict "
                                  "WHERE type <> 0", "http_payloads", "page_content",
                                  "word_dictionary"))
def q_verdict_batch_rows(spark, sf):
    recs = S.valid_verdicts(request_verdicts(spark, sf))
    return out(B.verdict_batch_rows(B.verdict_batches(recs)))


@query("inflight_listing", _sql(
    [("inflight", "SELECT DISTINCT host, path, method, dst FROM url_requests_first"),
     ("done", "SELECT DISTINCT r.host, r.path, r.method, r.dst FROM url_requests_first r "
              "JOIN page_content c ON r.host = c.host AND r.path = c.path")],
    "SELECT host || path AS url FROM inflight i WHERE NOT EXISTS (SELECT 1 FROM done d WHERE "
    "d.host = i.host AND d.path = i.path AND d.method = i.method AND d.dst = i.dst)",
    "url_requests_first", "page_content"))
def q_inflight_listing(spark, sf):
    first = derived.url_requests_first(spark, sf)
    inflight = first.select(*R.REQUEST_KEY).distinct()
    done = first.join(derived.page_content(spark, sf).select("host", "path"), ["host", "path"])
    return R.inflight_listing(R.inflight_completion(inflight, done))


# ---------------------------------------------------------------------------
# 2.2 projections, filters, predicates
# ---------------------------------------------------------------------------

@query("http_get_filter", _sql(
    [("gets", GET_FILTER_SQL)],
    "SELECT req_id, CAST(protocol AS BIGINT) AS protocol, CAST(dst_port AS BIGINT) AS dst_port, "
    "CAST(syn AS BIGINT) AS syn, CAST(fin AS BIGINT) AS fin, CAST(rst AS BIGINT) AS rst, "
    "total_len, dst, payload FROM gets", "http_payloads"))
def q_http_get_filter(spark, sf):
    return out(R.http_get_filter(derived.http_payloads(spark, sf)))


@query("http_request_extract", _sql(
    REQ_CTES[:3], "SELECT req_id, CAST(method AS BIGINT) AS method, dst, host, path "
                  "FROM extracted", "http_payloads"))
def q_http_request_extract(spark, sf):
    return out(R.http_request_extract(R.http_get_filter(derived.http_payloads(spark, sf))))


@query("request_length_guard", _sql(
    REQ_CTES[:4], "SELECT req_id, CAST(method AS BIGINT) AS method, dst, host, path "
                  "FROM guarded", "http_payloads"))
def q_request_length_guard(spark, sf):
    gets = R.http_get_filter(derived.http_payloads(spark, sf))
    return out(R.request_length_guard(R.http_request_extract(gets)))


@query("wellformed_requests", _sql(
    REQ_CTES[:2] + [("every", "SELECT req_id, method, dst, host, path FROM fields UNION ALL "
                              "SELECT req_id, method, dst, host, path FROM foreign_requests")],
    f"SELECT req_id, CAST(method AS BIGINT) AS method, dst, host, path FROM every {WELLFORMED}",
    "http_payloads", "foreign_requests"))
def q_wellformed_requests(spark, sf):
    """Our own records and those of another producer, with missing and empty fields."""
    fields = R.request_fields(R.http_get_filter(derived.http_payloads(spark, sf)))
    foreign = derived.foreign_requests(spark, sf)
    return out(R.wellformed_requests(fields.unionByName(foreign)))


@query("dictionary_tokens", _sql(DD, "SELECT cat_index, category, pos, word FROM dtok",
                                 "doc_dictionary"))
def q_dictionary_tokens(spark, sf):
    return out(doc_dictionary(spark, sf)[1])


@query("category_code", _sql(
    DD, "SELECT cat_index, id, category, category >> 8 AS code_grouptype, "
        "category & 255 AS code_groupid FROM dcats", "doc_dictionary"))
def q_category_code(spark, sf):
    cats = doc_dictionary(spark, sf)[0]
    return out(cats.select("cat_index", "id", "category",
                           code_grouptype("category").alias("code_grouptype"),
                           code_groupid("category").alias("code_groupid")))


@query("pattern_table", _sql(
    DD + [("dpats", O.service_patterns("dids"))],
    "SELECT pattern_id, pattern, n, nocase, CAST(\"offset\" AS BIGINT) AS \"offset\", "
    "CAST(depth AS BIGINT) AS depth FROM dpats", "doc_dictionary"))
def q_pattern_table(spark, sf):
    ids = D.keyword_ids(doc_dictionary(spark, sf)[1])
    return out(D.service_patterns(ids).drop("payload"))


FREE = "SELECT * FROM patterns WHERE \"offset\" = 0 AND depth = 0"
RANGED = "SELECT * FROM patterns WHERE NOT (\"offset\" = 0 AND depth = 0)"


@query("match_case_rule", _sql([("free", FREE), ("h", O.hits("docs", "free"))],
                               "SELECT doc_id, pattern_id FROM h", "docs", "patterns"))
def q_match_case_rule(spark, sf):
    pats = fixtures.patterns(spark).filter((F.col("offset") == 0) & (F.col("depth") == 0))
    return out(M.keyword_hits(derived.docs(spark, sf), pats))


@query("match_position_rule", _sql(
    [("ranged", RANGED), ("o", O.occurrences("docs", "ranged"))],
    "SELECT doc_id, pattern_id, idx, end_idx FROM o", "docs", "patterns"))
def q_match_position_rule(spark, sf):
    pats = fixtures.patterns(spark).filter(~((F.col("offset") == 0) & (F.col("depth") == 0)))
    return out(occ_of(spark, sf, pats).select("doc_id", "pattern_id", "idx", "end_idx"))


@query("valid_verdicts", _sql(O.verdict_ctes("docs", "doc_id", "text"),
                              "SELECT doc_id, type FROM verdicts WHERE type <> 0", "docs"))
def q_valid_verdicts(spark, sf):
    return out(S.valid_verdicts(doc_verdicts(spark, sf)))


# ---------------------------------------------------------------------------
# 2.3 joins
# ---------------------------------------------------------------------------

@query("keyword_occurrences", _sql(
    [("o", O.occurrences("docs", "patterns"))],
    "SELECT doc_id, pattern_id, idx, end_idx FROM o", "docs", "patterns"))
def q_keyword_occurrences(spark, sf):
    return out(occ_of(spark, sf, fixtures.patterns(spark))
               .select("doc_id", "pattern_id", "idx", "end_idx"))


@query("keyword_hits", _sql(W + [("h", O.hits("docs", "wpats"))],
                            "SELECT doc_id, pattern_id FROM h", "docs", "word_dictionary"))
def q_keyword_hits(spark, sf):
    pats = word_dictionary(spark)[4]
    return out(M.keyword_hits(derived.docs(spark, sf), pats, strategy="contains"))


@query("any_match_docs", _sql(
    W, "SELECT doc_id FROM docs d WHERE EXISTS (SELECT 1 FROM wpats p "
       "WHERE contains(d.text, p.pattern))", "docs", "word_dictionary"))
def q_any_match_docs(spark, sf):
    return out(M.any_match_docs(derived.docs(spark, sf), word_dictionary(spark)[4])
               .select("doc_id"))


@query("no_match_docs", _sql(
    W, "SELECT doc_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM wpats p "
       "WHERE contains(d.text, p.pattern))", "docs", "word_dictionary"))
def q_no_match_docs(spark, sf):
    return out(M.no_match_docs(derived.docs(spark, sf), word_dictionary(spark)[4])
               .select("doc_id"))


@query("any_match_early", _sql(
    W, "SELECT doc_id FROM docs d WHERE EXISTS (SELECT 1 FROM wpats p "
       "WHERE contains(d.text, p.pattern))", "docs", "word_dictionary"))
def q_any_match_early(spark, sf):
    return out(E.any_match_docs(derived.docs(spark, sf), word_dictionary(spark)[4]).select("doc_id"))


@query("no_match_early", _sql(
    W, "SELECT doc_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM wpats p "
       "WHERE contains(d.text, p.pattern))", "docs", "word_dictionary"))
def q_no_match_early(spark, sf):
    return out(E.no_match_docs(derived.docs(spark, sf), word_dictionary(spark)[4]).select("doc_id"))


@query("policy_patterns", _sql(
    BPP, "SELECT pattern_id, pattern, n, nocase, CAST(\"offset\" AS BIGINT) AS \"offset\", "
         "CAST(depth AS BIGINT) AS depth, policy, percent, content_num FROM bpp",
    "bench_policies", "bench_policy_keywords"))
def q_policy_patterns(spark, sf):
    return out(D.policy_patterns(derived.bench_policies(spark, sf),
                                 derived.bench_policy_keywords(spark, sf)))


@query("request_content", _sql(
    REQ_CTES[:6], "SELECT req_id, CAST(method AS BIGINT) AS method, dst, host, path, "
                  "CAST(strlen(html) AS BIGINT) AS content_bytes FROM rcontent",
    "http_payloads", "page_content"))
def q_request_content(spark, sf):
    gets = R.http_get_filter(derived.http_payloads(spark, sf))
    reqs = R.request_dedup(R.request_length_guard(R.http_request_extract(gets)))
    joined = R.request_content(reqs, derived.page_content(spark, sf))
    return out(joined.select("req_id", "method", "dst", "host", "path",
                             F.octet_length("html").alias("content_bytes")))


@query("inflight_exclusion", _sql(
    [("inflight", "SELECT DISTINCT host, path, method, dst FROM url_requests_first")],
    "SELECT host, path, CAST(method AS BIGINT) AS method, dst, min(req_id) AS req_id, "
    "CAST(count(*) AS BIGINT) AS copies FROM url_requests_again a WHERE NOT EXISTS ("
    "SELECT 1 FROM inflight i WHERE i.host = a.host AND i.path = a.path "
    "AND i.method = a.method AND i.dst = a.dst) GROUP BY host, path, method, dst",
    "url_requests_first", "url_requests_again"))
def q_inflight_exclusion(spark, sf):
    return out(R.inflight_exclusion(derived.url_requests_again(spark, sf),
                                    derived.url_requests_first(spark, sf)))


@query("inflight_completion", _sql(
    [("inflight", "SELECT DISTINCT host, path, method, dst FROM url_requests_first"),
     ("done", "SELECT DISTINCT r.host, r.path, r.method, r.dst FROM url_requests_first r "
              "JOIN page_content c ON r.host = c.host AND r.path = c.path")],
    "SELECT host, path, CAST(method AS BIGINT) AS method, dst FROM inflight i WHERE NOT EXISTS ("
    "SELECT 1 FROM done d WHERE d.host = i.host AND d.path = i.path AND d.method = i.method "
    "AND d.dst = i.dst)", "url_requests_first", "page_content"))
def q_inflight_completion(spark, sf):
    first = derived.url_requests_first(spark, sf)
    inflight = first.select(*R.REQUEST_KEY).distinct()
    done = first.join(derived.page_content(spark, sf).select("host", "path"), ["host", "path"])
    return out(R.inflight_completion(inflight, done))


@query("hit_categories", _sql(
    W + [("h", O.hits("docs", "wpats"))],
    "SELECT h.doc_id, h.pattern_id, k.cat_index FROM h JOIN widx k ON h.pattern_id = k.iid",
    "docs", "word_dictionary"))
def q_hit_categories(spark, sf):
    _, _, idx, _, pats = word_dictionary(spark)
    hits = M.keyword_hits(derived.docs(spark, sf), pats)
    return out(S.hit_categories(hits, idx))


# ---------------------------------------------------------------------------
# 2.4 aggregations
# ---------------------------------------------------------------------------

@query("keyword_index", _sql(DD + [("didx", O.keyword_index("dtok", "dids"))],
                             "SELECT iid, word, cat_num, k, cat_index FROM didx",
                             "doc_dictionary"))
def q_keyword_index(spark, sf):
    return out(D.keyword_index(doc_dictionary(spark, sf)[1]))


@query("category_totals", _sql(DD + [("dtot", O.totals("dcats", "dtok"))],
                               "SELECT cat_index, category, total_words FROM dtot",
                               "doc_dictionary"))
def q_category_totals(spark, sf):
    cats, toks = doc_dictionary(spark, sf)
    return out(D.category_totals(cats, toks))


@query("pattern_count", _sql(BPP, "SELECT CAST(count(*) AS BIGINT) AS pattern_count FROM bpp",
                             "bench_policies", "bench_policy_keywords"))
def q_pattern_count(spark, sf):
    rows = D.policy_keyword_rows(derived.bench_policies(spark, sf),
                                 derived.bench_policy_keywords(spark, sf))
    return out(D.pattern_count(rows))


@query("doc_keyword_set", _sql(
    W + [("h", O.hits("docs", "wpats"))],
    "SELECT doc_id, list_sort(list(DISTINCT pattern_id)) AS keywords FROM h GROUP BY doc_id",
    "docs", "word_dictionary"))
def q_doc_keyword_set(spark, sf):
    hits = M.keyword_hits(derived.docs(spark, sf), word_dictionary(spark)[4])
    return out(S.doc_keyword_set(hits))


@query("category_hits", _sql(O.verdict_ctes("docs", "doc_id", "text"),
                             "SELECT doc_id, cat_index, hits FROM vch", "docs"))
def q_category_hits(spark, sf):
    _, _, idx, _, pats = word_dictionary(spark)
    hits = M.keyword_hits(derived.docs(spark, sf), pats)
    return out(S.category_hits(S.hit_categories(hits, idx)))


POLICY_OCC = FPP + [("pocc", O.occurrences("docs", "fpp", extra="policy, percent, content_num"))]
POLICY_HITS = POLICY_OCC + [(
    "phits", "SELECT doc_id, policy, percent, content_num, CAST(count(*) AS BIGINT) AS hit_times "
             "FROM pocc GROUP BY doc_id, policy, percent, content_num")]
POLICY_PCT = POLICY_HITS + [(
    "ppct", "SELECT *, (hit_times * 100) // content_num AS hit_percent FROM phits")]


def _policy_occ(spark, sf):
    return occ_of(spark, sf, fixture_policy_patterns(spark),
                  keep=["policy", "percent", "content_num"])


@query("policy_hits", _sql(POLICY_HITS, "SELECT * FROM phits", "docs", "policies",
                           "policy_keywords"))
def q_policy_hits(spark, sf):
    return out(S.policy_hits(_policy_occ(spark, sf)))


@query("policy_percent", _sql(POLICY_PCT, "SELECT * FROM ppct", "docs", "policies",
                              "policy_keywords"))
def q_policy_percent(spark, sf):
    return out(S.policy_percent(S.policy_hits(_policy_occ(spark, sf))))


@query("policy_decision", _sql(
    POLICY_PCT, "SELECT d.doc_id, COALESCE(m.matched, FALSE) AS matched FROM docs d LEFT JOIN "
                "(SELECT doc_id, bool_or(hit_percent > percent) AS matched FROM ppct "
                "GROUP BY doc_id) m ON d.doc_id = m.doc_id",
    "docs", "policies", "policy_keywords"))
def q_policy_decision(spark, sf):
    pct = S.policy_percent(S.policy_hits(_policy_occ(spark, sf)))
    return out(S.policy_decision(pct, derived.doc_ids(spark, sf)))


@query("url_verdict", _sql(O.verdict_ctes("docs", "doc_id", "text"),
                           "SELECT doc_id, type FROM verdicts", "docs"))
def q_url_verdict(spark, sf):
    return out(doc_verdicts(spark, sf))


@query("url_verdict_words", _sql(
    O.verdict_ctes("docs", "doc_id", "text", source="bench_dictionary", w="b", v="z"),
    "SELECT doc_id, type FROM zerdicts", "docs", "bench_dictionary"))
def q_url_verdict_words(spark, sf):
    """Verdicts over a dictionary that grows with the data: a category per benchmark
    item, its words as the keyword list; index, hits and scores stay distributed."""
    tables = dictionary_tables(derived.bench_dictionary(spark, sf))
    return out(verdicts_with(tables, derived.docs(spark, sf), subjects=derived.doc_ids(spark, sf), dealt=True))


@query("request_verdicts", _sql(REQ_VERDICT_CTES, "SELECT * FROM rverdict",
                                "http_payloads", "page_content", "word_dictionary"))
def q_request_verdicts(spark, sf):
    return out(request_verdicts(spark, sf))


@query("request_dedup", _sql(
    [], "SELECT host, path, CAST(method AS BIGINT) AS method, dst, min(req_id) AS req_id, "
        "CAST(count(*) AS BIGINT) AS copies FROM url_requests GROUP BY host, path, method, dst",
    "url_requests"))
def q_request_dedup(spark, sf):
    return out(R.request_dedup(derived.url_requests(spark, sf)))


@query("verdict_batches", _sql(
    REQ_VERDICT_CTES + [("vr", "SELECT *, row_number() OVER (PARTITION BY host ORDER BY req_id) "
                               "AS k FROM rverdict WHERE type <> 0")],
    "SELECT host, CAST((k - 1) // 5 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n_items, "
    "list(req_id ORDER BY req_id) AS req_ids FROM vr GROUP BY host, (k - 1) // 5",
    "http_payloads", "page_content", "word_dictionary"))
def q_verdict_batches(spark, sf):
    b = B.verdict_batches(S.valid_verdicts(request_verdicts(spark, sf)))
    return out(b.select("host", "batch", "n_items",
                        F.transform("items", lambda x: x["req_id"]).alias("req_ids")))


# ---------------------------------------------------------------------------
# 2.5 windows, 2.6 order
# ---------------------------------------------------------------------------

@query("keyword_ids", _sql(DD, "SELECT iid, word, cat_num FROM dids", "doc_dictionary"))
def q_keyword_ids(spark, sf):
    return out(D.keyword_ids(doc_dictionary(spark, sf)[1]))


@query("dictionary_order", _sql(
    DD, "SELECT c.id, t.pos, t.word, row_number() OVER (ORDER BY c.id, t.pos) AS token_no "
        "FROM dtok t JOIN dcats c ON t.cat_index = c.cat_index", "doc_dictionary"))
def q_dictionary_order(spark, sf):
    return out(global_ordinal(dictionary_places(doc_dictionary(spark, sf)[0]), ["id", "pos"], "token_no"))


def dictionary_places(cats):
    """(id, pos, word) of all tokens: whole lists are joined to their ids, then split."""
    named = cats.drop("id").join(cats.select("cat_index", "id"), "cat_index")
    return D.dictionary_tokens(named, ("id",)).select("id", "pos", "word")


TEST_OCC = FPP + TEST_PP + [("tocc", O.occurrences("docs", "tpp", extra="policy, percent, "
                                                                        "content_num"))]


def _test_occ(spark, sf):
    return occ_of(spark, sf, test_policy_patterns(spark),
                  keep=["policy", "percent", "content_num"])


@query("match_order", _sql(
    TEST_OCC, "SELECT doc_id, pattern_id, idx, end_idx, row_number() OVER (PARTITION BY doc_id "
              "ORDER BY end_idx, n, pattern_id) AS seq FROM tocc",
    "docs", "policies", "policy_keywords"))
def q_match_order(spark, sf):
    return out(Q.match_order(_test_occ(spark, sf))
               .select("doc_id", "pattern_id", "idx", "end_idx", "seq"))


@query("first_match", _sql(
    TEST_OCC, "SELECT doc_id, pattern_id, idx, end_idx FROM (SELECT *, row_number() OVER "
              "(PARTITION BY doc_id ORDER BY end_idx, n, pattern_id) AS rn FROM tocc) "
              "WHERE rn = 1", "docs", "policies", "policy_keywords"))
def q_first_match(spark, sf):
    return out(Q.first_match(_test_occ(spark, sf)))


@query("first_match_early", _sql(
    TEST_OCC, "SELECT doc_id, pattern_id, idx, end_idx FROM (SELECT *, row_number() OVER "
              "(PARTITION BY doc_id ORDER BY end_idx, n, pattern_id) AS rn FROM tocc) "
              "WHERE rn = 1", "docs", "policies", "policy_keywords"))
def q_first_match_early(spark, sf):
    return out(E.first_events(derived.docs(spark, sf), test_policy_patterns(spark)))


@query("policy_trigger", _sql(
    POLICY_OCC, "SELECT doc_id, policy, pattern_id, idx, end_idx, m AS events, "
                "(m * 100) // content_num AS running_percent FROM (SELECT *, count(*) OVER "
                "(PARTITION BY doc_id, policy ORDER BY end_idx, n, pattern_id ROWS BETWEEN "
                "UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM pocc) "
                "WHERE (m * 100) // content_num > percent QUALIFY row_number() OVER "
                "(PARTITION BY doc_id, policy ORDER BY m) = 1",
    "docs", "policies", "policy_keywords"))
def q_policy_trigger(spark, sf):
    return out(Q.policy_trigger(_policy_occ(spark, sf)))


WOCC = W + [("wocc", O.occurrences("docs", "wpats", extra="cat_num"))]


@query("hits_before_repeat", _sql(
    WOCC + [("nth", "SELECT *, row_number() OVER (PARTITION BY doc_id, pattern_id ORDER BY "
                    "end_idx, n, pattern_id) AS nth FROM wocc"),
            ("stop", "SELECT doc_id, min((end_idx, n, pattern_id)) AS s FROM nth WHERE nth = 2 "
                     "GROUP BY doc_id")],
    "SELECT f.doc_id, f.pattern_id, f.idx FROM nth f LEFT JOIN stop s ON f.doc_id = s.doc_id "
    "WHERE f.nth = 1 AND (s.s IS NULL OR (f.end_idx, f.n, f.pattern_id) < s.s)",
    "docs", "word_dictionary"))
def q_hits_before_repeat(spark, sf):
    return out(Q.hits_before_repeat(occ_of(spark, sf, word_dictionary(spark)[4])))


@query("collapse_repeat_hits", _sql(
    WOCC + [("ends", "SELECT doc_id, end_idx, list_sort(list(pattern_id)) AS hit_set FROM wocc "
                     "GROUP BY doc_id, end_idx")],
    "SELECT doc_id, end_idx, hit_set FROM (SELECT *, lag(hit_set) OVER (PARTITION BY doc_id "
    "ORDER BY end_idx) AS prev FROM ends) WHERE prev IS NULL OR prev <> hit_set",
    "docs", "word_dictionary"))
def q_collapse_repeat_hits(spark, sf):
    return out(Q.collapse_repeat_hits(occ_of(spark, sf, word_dictionary(spark)[4])))


STITCH_SQL = (f"SELECT doc_id AS resource_id, (end_idx - 1) // {O.CHUNK} AS seq, pattern_id, "
              f"idx - ((end_idx - 1) // {O.CHUNK}) * {O.CHUNK} AS idx, "
              f"end_idx - ((end_idx - 1) // {O.CHUNK}) * {O.CHUNK} AS end_idx FROM tocc")


@query("chunk_stitch", _sql(TEST_OCC, STITCH_SQL, "docs", "policies", "policy_keywords"))
def q_chunk_stitch(spark, sf):
    ch = C.content_chunks(derived.docs(spark, sf))
    return out(C.chunk_stitch(ch, test_policy_patterns(spark), min_chunk_bytes=C.CHUNK_BYTES))


@query("chunk_stitch_strict", _sql(TEST_OCC, f"SELECT * FROM ({STITCH_SQL}) WHERE idx >= 0",
                                   "docs", "policies", "policy_keywords"))
def q_chunk_stitch_strict(spark, sf):
    ch = C.content_chunks(derived.docs(spark, sf))
    return out(C.chunk_stitch(ch, test_policy_patterns(spark), boundary="strict",
                              min_chunk_bytes=C.CHUNK_BYTES))


# ---------------------------------------------------------------------------
# 2.7 set operations, 2.10 UDF/UDTF surface
# ---------------------------------------------------------------------------

@query("pattern_union", _sql(
    DD + BPP + [("dpats", O.service_patterns("dids"))],
    "SELECT pattern_id, pattern, n, 'dictionary' AS origin FROM dpats UNION ALL "
    "SELECT pattern_id, pattern, n, 'policy' AS origin FROM bpp",
    "doc_dictionary", "bench_policies", "bench_policy_keywords"))
def q_pattern_union(spark, sf):
    ids = D.keyword_ids(doc_dictionary(spark, sf)[1])
    a = D.service_patterns(ids).select("pattern_id", "pattern", "n",
                                       F.lit("dictionary").alias("origin"))
    b = D.policy_patterns(derived.bench_policies(spark, sf),
                          derived.bench_policy_keywords(spark, sf))
    b = b.select("pattern_id", "pattern", "n", F.lit("policy").alias("origin"))
    return out(D.pattern_union(a, b))


@query("match_udtf", _sql(TEST_OCC, "SELECT doc_id, pattern_id, idx, end_idx FROM tocc",
                          "docs", "policies", "policy_keywords"))
def q_match_udtf(spark, sf):
    name = register_keyword_matches(derived.docs(spark, sf), test_policy_patterns(spark),
                                    f"keyword_matches_{uuid.uuid4().hex[:8]}")
    return out(spark.sql(f"SELECT doc_id, pattern_id, idx, end_idx FROM {name}"))


MATCH_FUNCTION_SQL = _sql(
    TEST_OCC + [("pg", "SELECT page_id AS doc_id, html AS text FROM pages"),
                ("pocc_html", O.occurrences("pg", "tpp"))],
    "SELECT 'documents' AS origin, doc_id AS row_id, pattern_id, idx, end_idx FROM tocc UNION ALL "
    "SELECT 'pages', doc_id, pattern_id, idx, end_idx FROM pocc_html", "docs", "policies", "policy_keywords")


@query("match_function", MATCH_FUNCTION_SQL)
def q_match_function(spark, sf):
    """One table function called on two tables."""
    name = register_match_function(test_policy_patterns(spark), f"matches_{uuid.uuid4().hex[:8]}")
    tables = {"d": match_by_function(derived.docs(spark, sf), name),
              "p": match_by_function(pages(spark, sf, "page_id", "html"), name, "page_id", "html")}
    return out(spark.sql("SELECT 'documents' AS origin, doc_id AS row_id, pattern_id, idx, end_idx FROM {d} "
                         "UNION ALL SELECT 'pages', page_id, pattern_id, idx, end_idx FROM {p}", **tables))


@query("pattern_payload", _sql(
    WOCC, "SELECT doc_id, pattern_id, idx, pattern_id AS payload_iid, "
          "cat_num AS payload_cat_num FROM wocc", "docs", "word_dictionary"))
def q_pattern_payload(spark, sf):
    occ = occ_of(spark, sf, word_dictionary(spark)[4], keep=["payload"])
    return out(occ.select("doc_id", "pattern_id", "idx",
                          F.col("payload.iid").alias("payload_iid"),
                          F.col("payload.cat_num").alias("payload_cat_num")))


ALL_HITS = [("o", O.occurrences("docs", "patterns")),
            ("h", "SELECT DISTINCT doc_id, pattern_id FROM o")]


@query("match_strategy_contains", _sql(ALL_HITS, "SELECT doc_id, pattern_id FROM h",
                                       "docs", "patterns"))
def q_match_strategy_contains(spark, sf):
    return out(M.keyword_hits(derived.docs(spark, sf), fixtures.patterns(spark), strategy="contains"))


@query("match_strategy_regex", _sql(ALL_HITS, "SELECT doc_id, pattern_id FROM h",
                                    "docs", "patterns"))
def q_match_strategy_regex(spark, sf):
    return out(M.keyword_hits(derived.docs(spark, sf), fixtures.patterns(spark), strategy="regex"))


@query("match_strategy_anchor", _sql(ALL_HITS, "SELECT doc_id, pattern_id FROM h",
                                     "docs", "patterns"))
def q_match_strategy_anchor(spark, sf):
    return out(M.keyword_hits(derived.docs(spark, sf), fixtures.patterns(spark), strategy="anchor"))


@query("match_strategy_counts", _sql(
    [("o", O.occurrences("docs", "patterns"))],
    "SELECT doc_id, pattern_id, CAST(count(*) AS BIGINT) AS occurrences FROM o "
    "GROUP BY doc_id, pattern_id", "docs", "patterns"))
def q_match_strategy_counts(spark, sf):
    return out(M.occurrence_counts(derived.docs(spark, sf), fixtures.patterns(spark)))


BENCH_WORD_HITS = BPP + [("bh", O.hits("docs", "bpp"))]


def bench_word_patterns(spark, sf):
    return D.policy_patterns(derived.bench_policies(spark, sf),
                             derived.bench_policy_keywords(spark, sf))


@query("match_strategy_automaton", _sql(BENCH_WORD_HITS, "SELECT doc_id, pattern_id FROM bh",
                                        "docs", "bench_policies", "bench_policy_keywords"))
def q_match_strategy_automaton(spark, sf):
    """Hits of a large dictionary (every word of every benchmark item), by the default
    method; the query keeps the name of the method that it replaced."""
    return out(M.keyword_hits(derived.docs(spark, sf), bench_word_patterns(spark, sf)))


@query("match_strategy_anchor_words", _sql(BENCH_WORD_HITS, "SELECT doc_id, pattern_id FROM bh",
                                           "docs", "bench_policies", "bench_policy_keywords"))
def q_match_strategy_anchor_words(spark, sf):
    """The same large dictionary without a broadcast of it: bitmap, shuffle, salted join."""
    pats = bench_word_patterns(spark, sf)
    return out(M.keyword_hits(derived.docs(spark, sf), pats, strategy="anchor"))


@query("match_strategy_regex_words", _sql(BENCH_WORD_HITS, "SELECT doc_id, pattern_id FROM bh",
                                          "docs", "bench_policies", "bench_policy_keywords"))
def q_match_strategy_regex_words(spark, sf):
    """The same large dictionary through one native trie regex per text."""
    pats = bench_word_patterns(spark, sf)
    return out(M.keyword_hits(derived.docs(spark, sf), pats, strategy="regex"))
