"""HTTP request capture, URL request records, de-duplication and in-flight sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the request filter.
TCP = 6
HTTP_PORT = 80
HEADER_BYTES = 40          # fixed IPv4 + TCP header sizes used by the length test
MIN_PAYLOAD = 24           # a shorter payload cannot hold a request line and a host
HOST_LIMIT = 256
PATH_LIMIT = 2048
METHOD_GET = 1

REQUEST_KEY = ["host", "path", "method", "dst"]


def http_get_filter(payloads: DataFrame) -> DataFrame:
    """Keep captured packets that look like an HTTP GET to port 80.

    Cheap header tests come first in the conjunction; the string tests after.
    ``GET`` is compared on 3 bytes only, so ``GETX`` passes too.
    """
    return payloads.filter(
        (F.col("protocol") == TCP) & (F.col("dst_port") == HTTP_PORT)
        & (F.col("syn") == 0) & (F.col("fin") == 0) & (F.col("rst") == 0)
        & (F.col("total_len") - HEADER_BYTES >= MIN_PAYLOAD)
        & F.startswith(F.col("payload"), F.lit("GET"))
        & F.contains(F.col("payload"), F.lit("Host: ")))


def request_fields(gets: DataFrame) -> DataFrame:
    """Host and path cut out of each GET payload, as received (unchecked).

    Path: bytes after ``GET `` up to the first space, NULL when no space lies
    inside the payload; host: bytes after the first ``Host: `` up to ``\\r``,
    NULL when there is no ``\\r``. Only the first ``total_len - 40`` bytes count.
    """
    # As ISO-8859-1 every byte is one character, so a window that ends inside a character
    # can be searched; a field ends before an ASCII byte and is whole characters again.
    w = F.expr(f"decode(substring(encode(payload, 'UTF-8'), 1, CAST(total_len - {HEADER_BYTES} AS INT)), 'ISO-8859-1')")
    staged = gets.select(
        "req_id", "dst", w.alias("__w"),
        F.locate(" ", w, 5).alias("__sp"),
        (F.locate("Host: ", w) + 6).alias("__h"),
    ).withColumn("__cr", F.expr("locate('\\r', __w, __h)"))

    def field(cut: str) -> Column:
        return F.expr(f"decode(encode({cut}, 'ISO-8859-1'), 'UTF-8')")

    return staged.select(
        "req_id", F.lit(METHOD_GET).cast("tinyint").alias("method"), "dst",
        F.when((F.col("__h") > 6) & (F.col("__cr") > 0), field("substring(__w, __h, __cr - __h)")).alias("host"),
        F.when(F.col("__sp") > 0, field("substring(__w, 5, __sp - 5)")).alias("path"))


def wellformed_requests(requests: DataFrame) -> DataFrame:
    """Drop records with a missing or empty field."""
    return requests.filter(
        F.col("host").isNotNull() & F.col("path").isNotNull()
        & F.col("method").isNotNull() & F.col("dst").isNotNull()
        & (F.col("host") != "") & (F.col("path") != ""))


def http_request_extract(gets: DataFrame) -> DataFrame:
    """URL request rows from GET payloads; both host and path must be present."""
    return wellformed_requests(request_fields(gets))


def request_length_guard(requests: DataFrame) -> DataFrame:
    """Drop requests whose host or path is too long for the record (bytes)."""
    return requests.filter((F.octet_length("host") <= HOST_LIMIT)
                           & (F.octet_length("path") <= PATH_LIMIT))


def request_source(requests: DataFrame) -> DataFrame:
    """Incoming URL records: the four copied fields and an empty verdict."""
    cols = ["req_id"] if "req_id" in requests.columns else []
    return requests.select(*cols, "method", "dst", "host", "path",
                           F.lit(0).cast("int").alias("type"))


def request_dedup(requests: DataFrame) -> DataFrame:
    """One row per (host, path, method, dst): the first request id.

    An aggregate, so a hot URL is combined map-side before the shuffle.
    """
    return requests.groupBy(*REQUEST_KEY).agg(F.min("req_id").alias("req_id"),
                                              F.count(F.lit(1)).alias("copies"))


def request_content(requests: DataFrame, content: DataFrame) -> DataFrame:
    """Each request with its page body, NULL when there is none (left outer)."""
    return requests.join(content.select("host", "path", "html"), ["host", "path"], "left")


def inflight_exclusion(new: DataFrame, inflight: DataFrame) -> DataFrame:
    """New requests whose key is not in flight, one per key.

    De-duplicated before the anti join so a hot key reaches the join once.
    """
    fresh = request_dedup(new)
    return fresh.join(inflight.select(*REQUEST_KEY).distinct(), REQUEST_KEY, "left_anti")


def inflight_completion(inflight: DataFrame, done: DataFrame) -> DataFrame:
    """In-flight keys minus finished ones: a finished URL may be studied again."""
    return inflight.join(done.select(*REQUEST_KEY).distinct(), REQUEST_KEY, "left_anti")


def inflight_listing(inflight: DataFrame, *keep: str) -> DataFrame:
    """``host || path`` of every URL in flight (and the ``keep`` columns)."""
    return inflight.select(F.concat("host", "path").alias("url"), *keep)
