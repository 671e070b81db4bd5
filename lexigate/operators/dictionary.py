"""Keyword dictionaries: categories, tokens, merged keyword index, patterns.

A dictionary may grow with the data: ordinals come from the range-partitioned
``ordinal`` operators, so no single task sees the whole dictionary or a whole hot
word. These write the sorted rows once when called (see ``ordinal``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.functions import atoi, category_code, split_tokens
from lexigate.operators.ordinal import global_ordinal


def dictionary_source(dictionary: DataFrame) -> DataFrame:
    """The four positional columns of the dictionary table, in id order."""
    return dictionary.select("id", "groupid", "grouptype", "keywordlist")


def categories(dictionary: DataFrame) -> DataFrame:
    """One row per dictionary row: 1-based ``cat_index`` in id order and the packed code.

    ``groupid``/``grouptype`` go through ``atoi`` (text cells, leading integer).
    """
    d = dictionary.select(
        "id", "keywordlist",
        category_code(atoi("grouptype"), atoi("groupid")).alias("category"))
    # Number the (narrow) ids only, then join the rows back on id: the keyword
    # lists are shuffled once instead of sorted, written and re-read.
    numbered = d.join(global_ordinal(d.select("id"), ["id"], "cat_index"), "id")
    return numbered.select("cat_index", "id", F.col("category").cast("int").alias("category"), "keywordlist")


def dictionary_tokens(cats: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Split each keyword list on ',' (empty tokens vanish, no trimming, order kept)."""
    return cats.select(
        "cat_index", "category", *keep,
        F.posexplode(split_tokens("keywordlist")).alias("pos", "word")
    ).select("cat_index", "category", *keep, (F.col("pos") + 1).cast("int").alias("pos"), "word")


def keyword_ids(tokens: DataFrame) -> DataFrame:
    """Distinct words with a dense 1-based ``iid`` in first-appearance order,
    plus ``cat_num`` (list length, duplicates kept)."""
    first = _appearance()
    words = tokens.groupBy("word").agg(F.min(first).alias("first"),
                                       F.count(F.lit(1)).alias("cat_num"))
    return global_ordinal(words, ["first"], "iid").select("iid", "word", "cat_num")


def _appearance() -> F.Column:
    """(cat_index, pos) packed in one number: a map-side combined hash aggregate
    without a bound on the number of categories (pos is a 32-bit int)."""
    return F.col("cat_index").cast("decimal(28,0)") * F.lit(1 << 32) + F.col("pos")


SALT_ROWS = 100_000  # entries per (word, bucket) join key for a hot word


def keyword_index(tokens: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Equal words merged over all categories, in long form.

    One row per (word, entry of its category list): ``k`` is the 1-based place
    in the word's list (first-seen order, duplicates kept). The list of a hot
    word is never gathered into one row or one task.

    Every entry gets its global position ``g`` in
    (word, cat_index, pos) order (range-partitioned, written once); one hash
    aggregate per word gives its first position, list length and first
    appearance; ``k = g - first + 1``. The per-word row is joined back on
    (word, g div salt_rows), repeated once per bucket its entries span, so no
    join key holds more than ``salt_rows`` entries, however hot the word.
    """
    g = global_ordinal(tokens.select("word", "cat_index", "pos"),
                       ["word", "cat_index", "pos"], "g")
    first = _appearance()
    words = g.groupBy("word").agg(F.min("g").alias("g0"), F.count(F.lit(1)).alias("cat_num"),
                                  F.min(first).alias("first"))
    ids = global_ordinal(words, ["first"], "iid").withColumn(
        "__b", F.explode(F.sequence(F.expr(f"g0 div {salt_rows}"),
                                    F.expr(f"(g0 + cat_num - 1) div {salt_rows}"))))
    return (g.withColumn("__b", F.expr(f"g div {salt_rows}"))
            .join(ids, ["word", "__b"])
            .withColumn("k", F.col("g") - F.col("g0") + 1)
            .select("iid", "word", "cat_num", "k", "cat_index"))


def keyword_lists(index: DataFrame) -> DataFrame:
    """Array form ``(iid, word, cat_num, cat_index ARRAY)``: each word's list in one
    row, for looking at a dictionary; matching uses the long form."""
    return (index.groupBy("iid", "word", "cat_num")
            .agg(F.array_sort(F.collect_list(F.struct("k", "cat_index"))).alias("l"))
            .select("iid", "word", "cat_num",
                    F.transform("l", lambda x: x["cat_index"]).alias("cat_index")))


def category_totals(cats: DataFrame, tokens: DataFrame) -> DataFrame:
    """Words per category (duplicates counted); categories with no word get 0."""
    counts = tokens.groupBy("cat_index").agg(F.count(F.lit(1)).alias("total_words"))
    return (cats.select("cat_index", "category").join(counts, "cat_index", "left")
            .select("cat_index", "category",
                    F.coalesce("total_words", F.lit(0)).cast("bigint").alias("total_words")))


def pattern_table(df: DataFrame, pattern_id: str, pattern: str, nocase=False,
                  offset=0, depth=0, payload: list[str] | None = None,
                  extra: list[str] | None = None) -> DataFrame:
    """Registered patterns with their attributes; empty patterns are rejected.

    Duplicated patterns are kept: each reports its own hits.
    """
    def lit_or_col(v):
        return F.col(v) if isinstance(v, str) else F.lit(v)
    cols = [F.col(pattern_id).cast("long").alias("pattern_id"),
            F.col(pattern).alias("pattern"),
            F.octet_length(pattern).cast("int").alias("n"),
            lit_or_col(nocase).cast("boolean").alias("nocase"),
            lit_or_col(offset).cast("int").alias("offset"),
            lit_or_col(depth).cast("int").alias("depth")]
    if payload:
        cols.append(F.struct(*payload).alias("payload"))
    cols += [F.col(c) for c in (extra or [])]
    return df.select(*cols).filter(F.col("n") > 0)


def service_patterns(index_or_ids: DataFrame) -> DataFrame:
    """One case-sensitive, unbounded pattern per merged word (id = ``iid``)."""
    ids = index_or_ids.select("iid", "word", "cat_num").dropDuplicates(["iid"])
    return pattern_table(ids, "iid", "word", payload=["iid", "cat_num"])


def pattern_count(patterns: DataFrame) -> DataFrame:
    return patterns.agg(F.count(F.lit(1)).alias("pattern_count"))


def pattern_union(*pattern_sets: DataFrame) -> DataFrame:
    """All patterns of several sets in one matcher input, duplicates kept."""
    out = pattern_sets[0]
    for p in pattern_sets[1:]:
        out = out.unionByName(p)
    return out


# -- policies ---------------------------------------------------------------

def policy_source(policies: DataFrame) -> DataFrame:
    return policies.select("name", "percent")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail the load when ``df`` has no row (checks one row only)."""
    if df.isEmpty():
        raise ValueError(f"{what}: no row")
    return df


def policy_keyword_source(keywords: DataFrame, group_name: str | None = None) -> DataFrame:
    """``keyword`` rows of one group (pushed to the scan), or of all groups."""
    if group_name is not None:
        keywords = keywords.filter(F.col("group_name") == group_name)
    return keywords.select("group_name", "keyword")


def policy_keyword_rows(policies: DataFrame, keywords: DataFrame, check: bool = True) -> DataFrame:
    """Policies joined to their keywords, with the group's keyword count
    ``content_num``; not numbered yet. A group with no keyword fails the load when
    ``check`` is set."""
    if check:
        empty = policies.join(keywords, policies["name"] == keywords["group_name"], "left_anti")
        if not empty.isEmpty():
            raise ValueError("policy with no keyword: " + str(empty.first()["name"]))
    sizes = keywords.groupBy("group_name").agg(F.count(F.lit(1)).alias("content_num"))
    # One row per policy (with its size); the keyword side may hold a hot group: the
    # runtime broadcasts a small policy side or splits the group's partition.
    groups = (policies.select(F.col("id").alias("policy_id"), F.col("name").alias("policy"),
                              "percent")
              .join(sizes, F.col("policy") == F.col("group_name")).drop("group_name"))
    return (keywords.select(F.col("id").alias("keyword_id"), "group_name", "keyword")
            .join(groups, F.col("policy") == F.col("group_name"))
            .filter(F.octet_length("keyword") > 0))


def policy_patterns(policies: DataFrame, keywords: DataFrame, check: bool = True) -> DataFrame:
    """Policies joined to their keywords, as patterns. Pattern ids run on across
    groups (group id order, then keyword id order)."""
    joined = policy_keyword_rows(policies, keywords, check)
    numbered = global_ordinal(joined, ["policy_id", "keyword_id"], "pattern_id")
    return pattern_table(numbered, "pattern_id", "keyword",
                         extra=["policy", "percent", "content_num"])
