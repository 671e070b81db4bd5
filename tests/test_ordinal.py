"""The range-partitioned ordinals equal a plain row_number, also for a hot key
that spans many partitions."""

import collections

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigate.operators.ordinal import global_ordinal, group_ordinal


def _skewed(spark, n=20000):
    # one key holds a third of the rows; ties in the order column included
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"),
        (F.col("id") % 1000).alias("o"), F.col("id").alias("uid"))


def test_group_ordinal_matches_window(spark):
    df = _skewed(spark)
    got = group_ordinal(df, ["key"], ["o", "uid"], "k", partitions=16)
    w = Window.partitionBy("key").orderBy("o", "uid")
    want = df.withColumn("k", F.row_number().over(w))
    assert got.select("uid", "k").exceptAll(want.select("uid", "k")).count() == 0
    assert got.count() == df.count()


def test_hot_key_is_split(spark):
    df = _skewed(spark)
    got = group_ordinal(df, ["key"], ["o", "uid"], "k", partitions=16)
    parts = (got.filter("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count()
             .collect())
    assert len(parts) > 1  # the hot key is spread over several tasks


def test_global_ordinal_dense(spark):
    df = _skewed(spark)
    got = global_ordinal(df, ["key", "o", "uid"], "r", partitions=7)
    w = Window.orderBy("key", "o", "uid")
    want = df.withColumn("r", F.row_number().over(w))
    assert got.select("uid", "r").exceptAll(want.select("uid", "r")).count() == 0


def test_ordinal_survives_union(spark):
    df = _skewed(spark, 3000)
    a = global_ordinal(df, ["uid"], "r", partitions=5)
    b = global_ordinal(df, ["uid"], "r", partitions=5)
    u = a.unionByName(b)
    assert u.filter("r <> uid + 1").count() == 0


def test_keyword_index_salted_join(spark):
    """Hot words joined in buckets give the same index as the plain join."""
    from lexigate.operators import dictionary as D
    rows = [(i + 1, "1", "1", ",".join(["the"] * 9 + ["a", "the", "b"])) for i in range(5)]
    d = spark.createDataFrame(rows, "id long, groupid string, grouptype string, "
                                    "keywordlist string")
    toks = D.dictionary_tokens(D.categories(d))
    small = sorted(map(tuple, D.keyword_index(toks, salt_rows=4).collect()))
    entries = sorted((r["word"], r["cat_index"], r["pos"]) for r in toks.collect())
    first = {}
    for w, c, p in sorted(entries, key=lambda e: e[1:]):
        first.setdefault(w, len(first) + 1)
    count = collections.Counter(w for w, _, _ in entries)
    seen = collections.Counter()
    plain = []
    for w, c, _ in entries:
        seen[w] += 1
        plain.append((first[w], w, count[w], seen[w], c))
    assert small == sorted(plain)
    assert max(r[3] for r in small) == 50  # "the": 10 entries in each of 5 lists
