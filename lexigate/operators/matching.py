"""Texts joined to patterns: occurrences with positions, hit pairs, any/none.

One algorithm serves every operator and every dictionary size. A pattern's key is
its first ``KEY_BYTES`` bytes (ASCII-folded; all of a shorter pattern), so a word of
one or two bytes and a two-character CJK word have keys like any other. Every byte
position of a text yields one key for each key length that the dictionary uses, and
an equi-join on the key's 64-bit hash (a long: the cheapest join key) finds the
candidates, checked against the bytes at the position under the case and position
rules. The dictionary goes to the tasks in
blocks of at most about ``BLOCK_BYTES`` (a proven bound for each broadcast), so a
text is never shuffled and no row is built for a position without a key.

Positions come in two levels: a text is cut into pieces of ``PIECE_BYTES`` and what the
longest pattern reaches beyond them, and only a piece's positions stand in one array. So
memory is bounded by the piece, whatever the length of the text.

Hit pairs may also be had by other methods, chosen by name only:

* ``anchor``   - for dictionaries beyond memory: the texts are read once and nothing of
  the dictionary is broadcast but a bitmap of key hashes (at most 16 MiB). Positions in
  the bitmap are shuffled with just the bytes that a pattern would cover and joined to the
  shuffled dictionary; keys are salted, as a usual word may be hot. Where no pattern has a
  position rule, hit pairs need the bytes once a group of texts: numpy finds them in the
  tasks (``operators/bytescan.py``), and they are shuffled with the ids of their texts.

* ``contains`` - a join on native ``contains``, one test per (text, pattern).
* ``regex``    - one trie-factored look-ahead regex per case class and block of
  words, evaluated natively; each text's longest matches are cut into prefixes and
  equi-joined to the patterns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigate.functions import ascii_fold, position_rule
from lexigate.functions.text import regex_quote
from lexigate.operators.bitmap import hash_bitmap, in_bitmap
from lexigate.operators.bytescan import first_windows, grouped_windows, pattern_keys, same_bytes
from lexigate.session import DEAL_BYTES, materialize

KEY_BYTES = 8
BLOCK_BYTES = 16 << 20   # pattern bytes in one broadcast block
ROW_BYTES = 64           # counted for each pattern besides its text
REGEX_WORDS = 20_000     # words in one trie regex
PIECE_BYTES = 1 << 16    # text positions in one array (times the key lengths)
ANCHOR_BYTES = 256       # longer patterns are not joined by shuffle
GROUP_BYTES = 1 << 20    # text bytes of a group whose equal bytes are shuffled once
SALTS = 8
STRATEGIES = ("keys", "anchor", "contains", "regex")


def _pattern_side(patterns: DataFrame, keep: list[str] = ()) -> DataFrame:
    cols = patterns.columns
    nocase = F.col("nocase") if "nocase" in cols else F.lit(False)
    offset = F.col("offset") if "offset" in cols else F.lit(0)
    depth = F.col("depth") if "depth" in cols else F.lit(0)
    rules = ("pattern_id", "pattern", "n", "nocase", "offset", "depth")
    return patterns.select("pattern_id", "pattern", F.octet_length("pattern").cast("int").alias("n"),
                           nocase.alias("nocase"), offset.cast("int").alias("offset"),
                           depth.cast("int").alias("depth"), *[c for c in keep if c not in rules]
                           ).filter(F.col("n") > 0)


def _uses(side: DataFrame) -> tuple[int, list[int], int]:
    """(size, key lengths, longest pattern) of a dictionary: one small aggregate (at
    most ``KEY_BYTES`` lengths come back)."""
    found = side.agg(F.sum(F.col("n") + ROW_BYTES).alias("size"), F.max("n").alias("longest"),
                     F.sort_array(F.collect_set(F.least("n", F.lit(KEY_BYTES)))).alias("lengths")).first()
    return found["size"] or 0, found["lengths"] or [KEY_BYTES], found["longest"] or 1


def _blocks(side: DataFrame, size: int) -> Iterator[DataFrame]:
    """The pattern side in blocks by hash."""
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        mine = side
        if blocks > 1:
            mine = side.filter(F.pmod(F.xxhash64("pattern_id", "pattern"), F.lit(blocks)) == b)
        yield mine


def _folded_bytes(data: str) -> Column:
    """ASCII-folded bytes; as ISO-8859-1 every byte is one character."""
    return F.encode(ascii_fold(F.decode(F.col(data), "ISO-8859-1")), "ISO-8859-1")


def _places(rows: DataFrame, data: str, lengths: list[int], longest: int) -> DataFrame:
    """Every position of a BINARY column with the key of every length in use: the other
    columns with ``__b`` and ``__fb`` (a piece and its folded copy), ``__at`` (position
    in the piece), ``idx`` (in the text) and ``__key``."""
    others = [c for c in rows.columns if c != data]
    step = max(PIECE_BYTES, 8 * longest)  # what pieces share stays small against them
    cut = rows.filter(F.octet_length(data) > 0).select(
        *others, F.col(data).alias("__d"),
        F.explode(F.expr(f"sequence(0, (octet_length(`{data}`) - 1) div {step})").cast("array<int>")).alias("__piece"))
    pieces = cut.select(*others, "__piece", F.expr(
        f"substring(__d, __piece * {step} + 1, {step + longest - 1})").alias("__b"))
    # The folded copy is made once per piece: the generator below needs it as a column.
    folded = pieces.withColumn("__fb", _folded_bytes("__b"))
    kinds = len(lengths)
    size = F.get(F.array(*[F.lit(int(n)) for n in lengths]), F.expr(f"cast(__i % {kinds} as int)"))
    return (folded.withColumn("__i", F.explode(F.expr(
                f"sequence(0, least(octet_length(__fb), {step}) * {kinds} - 1)")))
            .withColumn("__at", F.expr(f"cast(__i div {kinds} as int)")).withColumn("__size", size)
            .filter(F.col("__at") + F.col("__size") <= F.octet_length("__fb"))
            .withColumn("__key", F.expr("xxhash64(substring(__fb, __at + 1, __size))"))
            .withColumn("idx", F.expr(f"__piece * {step} + __at")))


def _byte_side(side: DataFrame) -> DataFrame:
    return side.select("*", F.encode("pattern", "UTF-8").alias("__p"),
                       F.encode(ascii_fold("pattern"), "UTF-8").alias("__pf")).withColumn(
                           "__pkey", F.xxhash64(F.substring("__pf", 1, KEY_BYTES)))


def byte_occurrences(rows: DataFrame, patterns: DataFrame, data: str, keep: list[str] = (),
                     shuffled: bool = False) -> DataFrame:
    """Every occurrence (overlaps included) in a BINARY column, under the case rule:
    the other columns of ``rows`` with pattern_id, idx, end_idx, n, nocase, offset,
    depth and the ``keep`` columns of the patterns. Byte offsets, ``end_idx`` exclusive.
    ``shuffled``: the ``anchor`` method."""
    side = _byte_side(_pattern_side(patterns, keep))
    others = [c for c in rows.columns if c != data]
    columns = [*others, "pattern_id", "idx", (F.col("idx") + F.col("n")).alias("end_idx"), "n",
               "nocase", "offset", "depth", *keep]
    if shuffled:
        long_side = side.filter(F.col("n") > ANCHOR_BYTES)
        short = _shuffled_hits(rows, side.filter(F.col("n") <= ANCHOR_BYTES), data).select(*columns)
        if long_side.isEmpty():
            return short
        side = long_side
    size, lengths, longest = _uses(side)
    places = _places(rows, data, lengths, longest)
    same = F.expr("substring(__fb, __at + 1, n)") == F.col("__pf")
    exact = F.col("nocase") | (F.expr("substring(__b, __at + 1, n)") == F.col("__p"))
    out = None
    for block in _blocks(side, size):
        part = places.join(F.broadcast(block), (F.col("__key") == F.col("__pkey")) & same & exact).select(*columns)
        out = part if out is None else out.unionByName(part)
    return out.unionByName(short) if shuffled else out


def _shuffled_hits(rows: DataFrame, side: DataFrame, data: str, once: bool = False) -> DataFrame:
    """Positions in the bitmap of the dictionary's keys, joined to it by shuffle.

    What is shuffled of a key shorter than ``KEY_BYTES`` is its bytes, else those that a
    pattern may cover. ``once``: each pattern once for the same bytes of a row (of one other
    column), without positions (``_window_hits``)."""
    if once:
        (id_col,) = [c for c in rows.columns if c != data]
        return _window_hits(rows, side, id_col, data)[0].withColumn(id_col, F.explode("__ids")).drop("__ids")
    _, lengths, longest = _uses(side)
    bitmap, bits = hash_bitmap(side.select("__pkey"), "__pkey")
    others = [c for c in rows.columns if c != data]
    covered = F.expr(f"substring(__b, __at + 1, IF(__size < {KEY_BYTES}, __size, {longest}))").alias("__w")
    places = in_bitmap(_places(rows, data, lengths, longest), "__key", bitmap, bits)
    places = places.select(*others, "idx", "__key", covered)
    salt = F.pmod(F.xxhash64(*[c for c in places.columns if c not in ("__key", "__w")]), F.lit(SALTS))
    salted = side.withColumn("__psalt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    bytes_ = F.expr("substring(__w, 1, n)")
    folded = F.encode(ascii_fold(F.decode(bytes_, "ISO-8859-1")), "ISO-8859-1")
    exact = F.when(F.col("nocase"), folded == F.col("__pf")).otherwise(bytes_ == F.col("__p"))
    return places.join(salted.hint("merge"), (F.col("__key") == F.col("__pkey")) & (salt == F.col("__psalt")) & exact)


def _window_hits(rows: DataFrame, side: DataFrame, id_col: str, data: str) -> tuple[DataFrame, int]:
    """(``__group``, ``__ids``, ``__w`` and the pattern's columns: short patterns without a
    position rule; number of tasks). Texts go by id into groups of about ``GROUP_BYTES``; a
    window of bytes that may be a pattern is shuffled once a group, with the ids of the texts
    that have it, to the shuffled dictionary."""
    keyed = materialize(pattern_keys(side.drop("__pkey"), "__pf"), "anchor-keys")
    rows = rows.select(id_col, data).filter(F.octet_length(data) > 0)
    size = rows.agg(F.sum(F.octet_length(data))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / DEAL_BYTES))
    group = F.pmod(F.xxhash64(id_col), F.lit(max(tasks, math.ceil(size / GROUP_BYTES)))).alias("__group")
    dealt = rows.select(group, id_col, data).repartition(tasks, "__group").sortWithinPartitions("__group")
    windows = grouped_windows(dealt, "__group", id_col, data, keyed).withColumn("__salt", F.pmod("__group", F.lit(SALTS)))
    salted = keyed.withColumn("__psalt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return windows.join(salted.hint("merge"), (F.col("__key") == F.col("__pkey"))
                        & (F.col("__salt") == F.col("__psalt")) & same_bytes()), tasks


def _grouped_hits(docs: DataFrame, side: DataFrame, id_col: str, text: str) -> DataFrame:
    """(``__ids``, pattern_id) of short patterns without a position rule: every (id, pattern) once."""
    rows = docs.select(id_col, F.encode(text, "UTF-8").alias("__data"))
    found, tasks = _window_hits(rows, _byte_side(side), id_col, "__data")
    # one window in two cases, or in two parts of a text, is one hit
    return (found.select("__group", "pattern_id", "__ids").repartition(tasks, "__group", "pattern_id")
            .groupBy("__group", "pattern_id").agg(F.array_distinct(F.flatten(F.collect_list("__ids"))).alias("__ids"))
            .select("__ids", "pattern_id"))


def short_free() -> Column:
    """Whether a pattern has no position rule and at most ``ANCHOR_BYTES``."""
    return (F.col("offset") == 0) & (F.col("depth") == 0) & (F.octet_length("pattern") <= ANCHOR_BYTES)


def first_occurrences(rows: DataFrame, patterns: DataFrame, data: str, after: str) -> DataFrame:
    """The other columns of ``rows`` with pattern_id and idx: ``short_free`` patterns in a
    BINARY column that end behind byte ``after`` (a column), each at its first place, and a
    few at later ones too (a word in two cases; texts beyond ``SCAN_BYTES``). The dictionary is
    broadcast in blocks as for every occurrence; only different windows become rows."""
    side = materialize(pattern_keys(_byte_side(_pattern_side(patterns)).drop("__pkey"), "__pf"), "scan-keys")
    others = [c for c in rows.columns if c != data]
    size, _, _ = _uses(side)
    out = None
    for block in _blocks(side, size):
        part = first_windows(rows, data, after, block).join(
            F.broadcast(block), (F.col("__key") == F.col("__pkey")) & same_bytes()).select(*others, "pattern_id", "idx")
        out = part if out is None else out.unionByName(part)
    return out


def raw_occurrences(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id",
                    text: str = "text", keep: list[str] = (), shuffled: bool = False) -> DataFrame:
    """Every occurrence before position rules: ``(id, pattern_id, idx, end_idx, n, offset,
    depth, keep...)``."""
    rows = docs.select(id_col, F.encode(text, "UTF-8").alias("__data"))
    return byte_occurrences(rows, patterns, "__data", keep, shuffled).select(
        id_col, "pattern_id", "idx", "end_idx", "n", "offset", "depth", *keep)


def keyword_occurrences(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id",
                        text: str = "text", keep: list[str] | None = None,
                        shuffled: bool = False) -> DataFrame:
    """Occurrences that pass the case and position rules.

    ``keep`` names pattern columns to carry along (e.g. ``payload``, ``policy``).
    """
    keep = [c for c in (keep or []) if c not in ("pattern_id", "n", "offset", "depth")]
    return (raw_occurrences(docs, patterns, id_col, text, keep, shuffled).filter(position_rule())
            .select(id_col, "pattern_id", "idx", "end_idx", "n", *keep))


def occurrence_counts(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id",
                      text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Occurrences per (document, pattern) under both rules, combined map-side."""
    return (keyword_occurrences(docs, patterns, id_col, text, keep)
            .groupBy(id_col, "pattern_id", *(keep or [])).agg(F.count(F.lit(1)).alias("occurrences")))


def _ruled(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns without a position rule, patterns with one)."""
    p = _pattern_side(patterns)
    free = (F.col("offset") == 0) & (F.col("depth") == 0)
    return p.filter(free), p.filter(~free)


def keyword_hits(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id",
                 text: str = "text", strategy: str = "keys") -> DataFrame:
    """Distinct (document, pattern) pairs where the pattern occurs under its case
    and position rules. ``contains`` and ``regex`` take the patterns without a
    position rule by their method and the others by keys."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    if strategy in ("keys", "anchor"):
        return _key_hits(docs, patterns, id_col, text, strategy == "anchor")
    free, ranged = _ruled(patterns)
    by_method = _contains_hits if strategy == "contains" else _regex_hits
    return by_method(docs, free, id_col, text).unionByName(
        _key_hits(docs, ranged, id_col, text))


def alike_patterns(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns that differ, each under the smallest id of its equals; ``__head`` and
    ``pattern_id`` of all, for a join once hits are distinct)."""
    p = _pattern_side(patterns)
    alike = ["pattern", "nocase", "offset", "depth"]
    heads = p.groupBy(*alike).agg(F.min("pattern_id").alias("__head"))
    return heads.withColumnRenamed("__head", "pattern_id"), p.join(heads, alike).select("__head", "pattern_id")


def _key_hits(docs: DataFrame, patterns: DataFrame, id_col: str, text: str,
              shuffled: bool = False) -> DataFrame:
    """Equal patterns (a word listed many times) are found once, under the smallest id,
    and take their own ids only after the hits of a text are distinct."""
    heads, members = alike_patterns(patterns)
    if shuffled:
        heads, members = materialize(heads, "anchor-heads"), materialize(members, "anchor-members")
        if heads.filter(~short_free()).isEmpty():
            groups = _grouped_hits(docs, _pattern_side(heads), id_col, text).withColumnRenamed("pattern_id", "__head")
            return groups.join(members, "__head").select(F.explode("__ids").alias(id_col), "pattern_id")
        # a position rule needs every position
        pairs = keyword_occurrences(docs, heads, id_col, text, shuffled=True).select(id_col, "pattern_id")
    else:
        pairs = keyword_occurrences(docs, heads, id_col, text).select(id_col, "pattern_id")
    found = pairs.withColumnRenamed("pattern_id", "__head").distinct()
    return found.join(members, "__head").select(id_col, "pattern_id")


def any_match_docs(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id",
                   text: str = "text", strategy: str = "keys") -> DataFrame:
    """Documents with at least one hit; ids are made distinct before the join."""
    hit_ids = keyword_hits(docs, patterns, id_col, text, strategy).select(id_col).distinct()
    return docs.join(hit_ids, id_col, "left_semi")


def no_match_docs(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id",
                  text: str = "text", strategy: str = "keys") -> DataFrame:
    """Documents with no hit at all."""
    hit_ids = keyword_hits(docs, patterns, id_col, text, strategy).select(id_col).distinct()
    return docs.join(hit_ids, id_col, "left_anti")


# -- contains -----------------------------------------------------------------

def ci_literal_regex(col) -> Column:
    """``(?i)`` + the quoted literal. Java's ``(?i)`` without UNICODE_CASE folds
    ASCII letters only, exactly the matcher's case rule."""
    quoted = F.concat(F.lit("\\Q"), F.replace(col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                      F.lit("\\E"))
    return F.concat(F.lit("(?i)"), quoted)


def _contains_hits(docs: DataFrame, patterns: DataFrame, id_col: str, text: str) -> DataFrame:
    """One native test per (text, pattern): exact patterns against the text, folded
    patterns against a folded copy made once per text. For few patterns."""
    p = patterns.select("pattern_id", "nocase", F.when(F.col("nocase"), ascii_fold("pattern"))
                        .otherwise(F.col("pattern")).alias("__p"))
    d = docs.select(id_col, F.col(text).alias("__t"), ascii_fold(text).alias("__f"))
    held = F.contains(F.when(F.col("nocase"), F.col("__f")).otherwise(F.col("__t")), F.col("__p"))
    return d.join(p, held).select(id_col, "pattern_id")


# -- regex ----------------------------------------------------------------------

def _trie_regex(words: list[str]) -> str:
    """Alternation of ``words`` factored as a trie; at each position the longest
    word that matches is taken (longer branches are tried first). Built without
    recursion: a stretch without a branch or end is one literal run, and nested
    groups arise only where words really part."""
    trie: dict = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    done: dict[int, str] = {}
    stack = [(trie, False)]
    while stack:
        node, seen = stack.pop()
        if not seen:
            stack.append((node, True))
            stack.extend((child, False) for ch, child in node.items() if ch)
            continue
        branches = [regex_quote(ch) + done.pop(id(child)) for ch, child in sorted(node.items()) if ch]
        if not branches:
            done[id(node)] = ""
            continue
        plain = len(branches) == 1
        body = branches[0] if plain else "(?:" + "|".join(branches) + ")"
        done[id(node)] = f"(?:{body})?" if "" in node else body
    return "(?s)(?=(" + done[id(trie)] + "))"


def _regex_hits(docs: DataFrame, patterns: DataFrame, id_col: str, text: str) -> DataFrame:
    """Trie regex per case class and block of words; each text's distinct longest
    matches are cut into their prefixes (all per row) and equi-joined to the patterns."""
    p = patterns.withColumn("__pat_f", ascii_fold("pattern"))
    d = docs.select(id_col, text)
    out = d.select(id_col, F.lit(None).cast(patterns.schema["pattern_id"].dataType).alias("pattern_id")).limit(0)
    for nocase, col_name, flags in ((False, "pattern", ""), (True, "__pat_f", "(?i)")):
        mine = p.filter(F.col("nocase") == F.lit(nocase))
        words = mine.select(F.col(col_name).alias("w")).distinct()
        blocks = math.ceil(words.count() / REGEX_WORDS)
        for b in range(blocks):
            own = words.filter(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b)
            rx = flags + _trie_regex(sorted(r["w"] for r in own.collect()))
            longest = F.filter(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rx), 1)),
                               lambda x: x != F.lit(""))
            if nocase:
                longest = F.transform(longest, lambda x: ascii_fold(x))
            prefixes = F.array_distinct(F.flatten(F.transform(longest, lambda w: F.transform(
                F.sequence(F.lit(1), F.char_length(w)), lambda i: F.substring(w, F.lit(1), i)))))
            found = d.select(id_col, F.explode(prefixes).alias("__prefix"))
            side = (mine.join(own, F.col(col_name) == F.col("w"), "left_semi")
                    .select("pattern_id", F.col(col_name).alias("__prefix")))
            out = out.unionByName(found.join(side, "__prefix").select(id_col, "pattern_id"))
    return out
