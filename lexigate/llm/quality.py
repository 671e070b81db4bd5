"""Quality rules: thresholds per language and source from mergeable sketches.

Native DataFrame operations only. A document passes the fixed base rule first
(50 words, at most half of the words in repeated 3-word windows). Four ratios of
the passing documents then go into quantile sketches, one per (language, source):
counts of the value rounded down to six significant bits (relative error at most
1/32). Sketches merge by adding counts, so partial sketches are built before the
shuffle and a source with a third of all rows costs one row per bucket and task.
The sketches of a language's sources merge into the language's sketch, which
serves sources with fewer than ``MIN_SUPPORT`` documents (part of the method: a
quartile of fewer values says little). A join brings the limits back to the documents.

Limits come from the sketch alone. Where the quartiles differ they are fences,
``FENCE`` quartile ranges beyond the quartiles. Where they do not (a ratio that is 0 in
most documents) the spread is read at the tail: the ``TAIL`` quantile of the source, as
far as the tail of its language reaches too (but never inside the source's own
quartiles), so that a source full of junk does not set its own limit. ``ROUNDING``
is the least spread, what rounding of the quantiles alone can make, and a ratio made
by ``FEW`` events or fewer in a document is not judged (one repeated line in a text of
three is a third of it).

Defined cases: null text counts as empty (no words, base rule fails, not kept);
null language or source form groups of their own; repeated rows are judged one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigate.llm.common import let, packed, stored, strip, unpacked, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_SUPPORT = 100  # documents a source needs for cutoffs of its own
FENCE = 3  # quartile ranges beyond the quartile
SIGNIFICANT_BITS = 6
# Least spread per ratio: letters (hundredths of a character) are rounded by up to 16
# at either quartile; the others are per mille.
ROUNDING = {"symbols": 10, "dup_lines": 10, "repeats": 10, "letters": 32}
# Quantile (per mille) read where the quartiles are equal: ordinary prose has a line or
# phrase again now and then, runs of symbols are never ordinary. letters: either tail.
TAIL = {"symbols": 900, "dup_lines": 990, "repeats": 990, "letters": 900}
FEW = 3
WINDOW_PAIR = 6  # words of one window found twice: an event of ``repeats``
TWO_SIDED = ("letters",)


def _repeat_words(tokens: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Texts without a repeated window are
    settled by one hash set; the others sort (window, position) pairs, keep those
    equal to a neighbour and add up the words each one covers before the next.
    """
    def windows(h: Column) -> Column:
        n = F.size(h)
        return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                        lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        at = F.sort_array(F.transform(same, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0), lambda acc, x: acc + x))

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(g, lambda v, i: F.struct(v.alias("h"), i.alias("i")))), covered))))


def features(rows: DataFrame, text: Column, *carry: Column) -> DataFrame:
    """Counts per document: one pass over the text, no shuffle."""
    full = F.coalesce(text, F.lit(""))
    parts = rows.select(
        *carry, words(text).alias("__words"),
        F.filter(F.split(full, "\n"), lambda x: strip(x) != "").alias("__lines"),
        F.char_length(F.regexp_replace(full, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(full, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    kept = [c for c in parts.columns if c not in ("__words", "__lines")]
    counted = parts.select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__words")).cast("long").alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _ratios() -> dict[str, Column]:
    def per(top: str, bottom: str, scale: int) -> Column:
        return F.expr(f"{scale} * {top} div greatest({bottom}, 1)")
    return {"symbols": per("n_symbols", "word_chars", 1000),
            "dup_lines": per("n_dup_lines", "__n_lines", 1000),
            "repeats": per("n_repeat_words", "n_words", 1000),
            "letters": per("word_chars", "n_words", 100)}


def _events() -> dict[str, Column]:
    """How many events of a document make up a ratio, where it counts events."""
    return {"symbols": F.col("n_symbols"), "dup_lines": F.col("n_dup_lines"),
            "repeats": F.expr(f"n_repeat_words div {WINDOW_PAIR}")}


def _per_ratio(values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("ratio"))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n) over the documents that pass the base rule."""
    ratios = F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("value")) for k, v in _ratios().items()])
    low = f"greatest(length(bin(value)) - {SIGNIFICANT_BITS}, 0)"
    return (counted.filter(~F.col("base_failed"))
            .select("__lang", "__source", F.inline(ratios))
            .select("__lang", "__source", "ratio",
                    F.expr(f"shiftleft(shiftright(value, {low}), {low})").alias("bucket"))
            .groupBy("__lang", "__source", "ratio", "bucket").agg(F.count(F.lit(1)).alias("n")))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups: the sum of the finer ones."""
    return parts.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """Quartiles, ``TAIL`` quantile and size of each group's sketch."""
    group = Window.partitionBy(*by, "ratio")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.select(*by, "ratio", "bucket", F.sum("n").over(upto).alias("upto"),
                           F.sum("n").over(group).alias("size"))

    def at(per_mille: Column | int) -> Column:
        return F.min(F.when(1000 * F.col("upto") >= per_mille * F.col("size"), F.col("bucket")))

    return ranked.groupBy(*by, "ratio").agg(
        at(250).alias("q1"), at(500).alias("q2"), at(750).alias("q3"), at(_per_ratio(TAIL)).alias("tail"),
        at(1000 - _per_ratio(TAIL)).alias("low_tail"), F.max("size").alias("size"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with ``lo_``/``hi_`` bounds of every ratio."""
    names = ("q1", "q2", "q3", "tail", "low_tail")
    own = quantiles(sketch, "__lang", "__source")
    whole = (quantiles(merged(sketch, "__lang"), "__lang")
             .select(F.col("__lang").alias("l"), F.col("ratio").alias("r"),
                     *[F.col(n).alias(f"lang_{n}") for n in names]))
    both = own.join(whole, F.col("__lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("r")))
    alone = F.col("size") >= MIN_SUPPORT
    used = both.select("__lang", "__source", "ratio", "lang_tail", "lang_low_tail", _per_ratio(ROUNDING).alias("least"),
                       *[F.when(alone, F.col(n)).otherwise(F.col(f"lang_{n}")).alias(n) for n in names])
    least, apart = F.col("least"), F.col("q3") > F.col("q1")
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    tail = F.least("tail", F.greatest("q3", "lang_tail"))
    low = F.greatest("low_tail", F.least("q1", "lang_low_tail"))
    fenced = used.select(
        "__lang", "__source", "ratio",
        F.when(apart, F.col("q1") - reach).otherwise(low - FENCE * F.greatest(F.col("q2") - low, least)).alias("lo"),
        F.when(apart, F.col("q3") + reach).otherwise(tail + FENCE * F.greatest(tail - F.col("q2"), least)).alias("hi"))
    return fenced.groupBy(F.col("__lang").alias("t_lang"), F.col("__source").alias("t_source")).agg(
        *[F.max(F.when(F.col("ratio") == k, F.col(b))).alias(f"{b}_{k}")
          for k in ROUNDING for b in ("lo", "hi")])


def judge(docs: DataFrame, *carry: Column) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row, with the carried columns.

    The counts are stored once: the sketches and the filter both read them.
    """
    counted = stored(features(docs, F.col("text"), *carry, F.col("lang").alias("__lang"),
                              F.col("source").alias("__source")), "quality")
    # Written, so that its size is known when the join is planned: a small one is
    # broadcast and the documents stay where they are.
    bounds = stored(cutoffs(sketches(counted)), "cutoffs")
    joined = counted.join(bounds, F.col("__lang").eqNullSafe(F.col("t_lang"))
                          & F.col("__source").eqNullSafe(F.col("t_source")), "left")
    fine, events = F.lit(True), _events()
    for k, value in _ratios().items():
        few = events[k] <= FEW if k in events else F.lit(False)
        fine = fine & (few | (value <= F.col(f"hi_{k}")))
        if k in TWO_SIDED:
            fine = fine & (value >= F.col(f"lo_{k}"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(True)))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all columns unchanged."""
    inner = docs.select(packed(docs), F.col("text"), F.col("lang"), F.col("source"))
    return unpacked(judge(inner, F.col("__row")).filter("kept"), docs)
