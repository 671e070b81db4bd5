"""Registered queries of the operators: name -> (callable, DuckDB SQL or None).

The queries are thin: each applies an operator to its whole table and derives the
digest columns. ``pipeline`` chains five operators (``corpus_pipeline.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigate.llm import (chat, decontam, extraction, langid, lines, packing, passages, quality,
                          repair, secret_scan, simhash, spelling, toxicity)
from lexigate.llm import sql as oracle
from lexigate.llm.common import documents
from lexigate.sources.tables import benchmark, pages, read_table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


@query("op1_quality_rules", oracle.QUALITY_RULES)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    return quality.judge(docs, F.col("doc_id")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query("op6_line_dedup", oracle.LINE_DEDUP)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    kept = F.coalesce("kept_text", "text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(documents(spark, sf_dir, "doc_id", "text"))


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_matches(documents(spark, sf_dir, "doc_id", "text"), benchmark(spark, sf_dir))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs)).withColumn(
        "base", F.filter("findings", lambda f: f["kind"] < 3))
    kinds = F.array(*[F.lit(k) for k in secret_scan.KINDS])

    def joined(findings: str):
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(
            ":", F.get(kinds, f["kind"]), f["start"].cast("string"), f["end"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda f: f["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"),
                        count(2).alias("n_hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                        joined("findings").alias("spans"))


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(pages(spark, sf_dir, "page_id", "url", "html"))


@query("op7_chat_formatting")
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    log = chat.event_log(rows.unionByName(probe))
    return chat.digests(chat.format_conversations(log))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", F.size("passages").cast("long").alias("n_passages"),
                        F.array_join(F.transform("passages", lambda p: F.concat_ws(
                            ":", p["start"].cast("string"), p["end"].cast("string"))), ",").alias("passages"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.noisy_words(documents(spark, sf_dir, "doc_id", "text")))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    table, repaired = repair.repair(repair.damaged(original))
    out = original.select("conv_id").distinct()
    for i, part in enumerate((table, repair.digests(repaired))):
        out = out.join(part.withColumnRenamed("conv_id", f"c{i}"), F.col("conv_id").eqNullSafe(F.col(f"c{i}")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
