"""Line de-duplication with levelled sorted runs of line hashes.

Native DataFrame operations only. ``LineRuns`` keeps what is known of line keys as
sorted, bucketed tables (runs) on levels. A new batch is reduced to one row per
key and merge-anti-joined with the runs: keys that no run holds are its own run on
level 0, the others are written beside it as updates of their counts. Later batches
read the runs alone. ``FANOUT`` runs of one level are compacted with their updates into
one run of the next (counts add, the largest document id wins) and deleted. Buckets
are by key, so a run is never shuffled again: only the new batch moves.

Only texts that lose a line are joined to their lines: the others are told apart by a
bitmap of hashed texts (at most ``MAX_BITS``; a false hit costs a shuffled row) and
stay where they are read.

A line's key is the line stripped of white space and with A-Z lowered; runs hold a
128-bit hash of it. Keys of at least ``MIN_CHARS`` code points found in at least
``MIN_DOCS`` documents lose their lines except in the largest doc_id holding it.

Defined cases: null or empty text is one empty line and stays as it is; each row
is a document, so rows of one doc_id (or of none) count separately and, when they hold
the largest doc_id, all keep the line; a null doc_id is smaller than any other; texts
of any length are split whole; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigate.llm.common import (ascii_lower, delete_folder, let, packed, shared_path, stored, strip,
                                 unpacked)

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
KEY = ["h1", "h2"]
MAX_BITS = 27  # log2: a bitmap of 16 MiB


def _entries(text: Column, min_chars: int) -> Column:
    """Keys of the lines that are long enough, sorted: (h1, h2, pos, first), where
    ``first`` marks a key's first line in the text."""
    def key(line: Column, i: Column) -> Column:
        bare = ascii_lower(strip(line))
        return F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("line"), bare).alias("h2"),
                        i.alias("pos"))

    long_enough = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("l"), i.alias("i"))),
                           lambda x: F.char_length(strip(x["l"])) >= min_chars)
    keyed = F.sort_array(F.transform(long_enough, lambda x: key(x["l"], x["i"])))
    return let(keyed, lambda s: F.transform(s, lambda x, k: F.struct(
        x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"),
        (F.coalesce(F.get(s, k - 1)["h1"] != x["h1"], F.lit(True))
         | F.coalesce(F.get(s, k - 1)["h2"] != x["h2"], F.lit(True))).alias("first"))))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text_hash, batch, h1, h2, pos, first): one row per long line."""
    return docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
        F.inline(_entries(F.coalesce(F.col("text"), F.lit("")), min_chars)))


class LineRuns:
    """Runs by level; each run is a bucketed, sorted table in the shared folder,
    partitioned into ``fresh`` keys that no earlier run holds and updates of those that
    one does: ``n_docs`` and ``last_doc`` of what the table covers."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []  # (table, folder)

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_path(self.spark, f"line-run-l{level}")
        (rows.write.partitionBy("fresh").bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
         .option("path", path).saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n, _ in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``line_keys``: its keys join the runs in key order; the ones
        no run holds become the new run, the others updates."""
        own = lines.groupBy(*KEY).agg(
            F.sum(F.col("first").cast("long")).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            held = run.filter("fresh").select(*KEY, F.lit(True).alias(f"held_{i}"))
            own = own.join(held, KEY, "left")
            known = known | F.col(f"held_{i}").isNotNull()
        self._write(own.select(*KEY, "n_docs", "last_doc", (~known).alias("fresh")), 0)
        self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged = self.levels[level]
                self._write(self._summed([self.spark.table(n) for n, _ in merged]), level + 1)
                self.levels[level] = []
                self._delete(merged)
            level += 1

    def _delete(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            delete_folder(self.spark, path)

    def close(self) -> None:
        """Delete all runs."""
        for level in self.levels:
            self._delete(level)
        self.levels = []

    @staticmethod
    def _summed(tables: list[DataFrame]) -> DataFrame:
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"),
                                      F.max("fresh").alias("fresh"))

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Keys in at least ``min_docs`` documents with the document that keeps them."""
        return (self._summed(self.runs()).filter(F.col("n_docs") >= min_docs)
                .select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "last_doc"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                  batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(d_doc, d_hash, drops): positions of the lines each text loses; only texts
    that lose one. A line of very many documents is dealt to many tasks: the join
    with the frequent keys can be split, and only positions travel."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "line-keys")
    keys = line_keys(docs, min_chars, batches)
    keys.write.partitionBy("batch").parquet(path)  # a batch reads its own files
    lines = spark.read.schema(keys.schema).parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
    frequent = stored(runs.frequent(min_docs), "frequent-lines")
    runs.close()
    found = lines.join(frequent, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    drops = (found.filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
             .groupBy(F.col("doc_id").alias("d_doc"), F.col("text_hash").alias("d_hash"))
             .agg(F.collect_set("pos").alias("drops")))
    return stored(drops, "dropped-lines")


def _spot(doc_id: str, text_hash: Column | str, bits: int) -> Column:
    """Place (from 1) of a text in the bitmap."""
    return F.pmod(F.xxhash64(doc_id, text_hash), F.lit(1 << bits)) + 1


def marked(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """``rows`` with ``__marked``: false only where no row of ``drops`` is meant. The
    bitmap has 16 bits for each of them, up to its bound, and is broadcast."""
    bits = min(MAX_BITS, max(15, (16 * drops.count()).bit_length()))
    spot = _spot("d_doc", "d_hash", bits)
    bitmap = stored(drops.groupBy(F.bitmap_bucket_number(spot).alias("__bucket"))
                    .agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("__bits")), "line-bitmap")
    own = _spot("doc_id", F.xxhash64("text"), bits)
    placed = rows.select("*", F.bitmap_bucket_number(own).alias("__own"), F.bitmap_bit_position(own).alias("__at"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0
    return placed.join(F.broadcast(bitmap), F.col("__own") == F.col("__bucket"), "left").select(
        *rows.columns, F.coalesce(hit, F.lit(False)).alias("__marked"))


def _kept_text(text: Column, drops: Column) -> Column:
    return let(F.split(text, "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops), lambda i: F.get(lines, i)), "\n"))


def dedup_lines(rows: DataFrame, **options: int) -> DataFrame:
    """``rows`` (doc_id, text, more) with ``n_lines``, ``n_dropped`` and ``kept_text``
    (null where no line was dropped)."""
    drops = dropped_lines(rows.select("doc_id", "text"), **options)
    told = marked(rows, drops)
    # ``drops`` grows with the data: a merge join at every size, whatever its files weigh.
    joined = told.filter("__marked").join(
        drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d_doc")) & (F.xxhash64("text") == F.col("d_hash")), "left")
    whole = told.filter("NOT __marked").withColumn("drops", F.lit(None).cast("array<int>"))
    both = joined.select(*rows.columns, "drops").unionAll(whole.select(*rows.columns, "drops"))
    full = F.coalesce(F.col("text"), F.lit(""))
    return both.select(
        *rows.columns, F.size(F.split(full, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNotNull(), _kept_text(full, F.col("drops"))).alias("kept_text"))


def filter_lines(docs: DataFrame) -> DataFrame:
    """All documents, texts without their dropped lines (``n_chars`` follows)."""
    inner = docs.select(packed(docs), F.col("doc_id"), F.col("text"))
    out = dedup_lines(inner)
    changed = {"text": F.coalesce("kept_text", "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("kept_text").isNotNull(), F.char_length("kept_text")).otherwise(
            F.col("__row.n_chars")).cast(kind)
    return unpacked(out, docs, **changed)
