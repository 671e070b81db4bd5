"""Positions in a total order without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task, and
``row_number().over(Window.partitionBy(key)...)`` moves a hot key (say a third
of all rows) into one task. Both ordinals here range-partition the rows on the
full sort key instead, so a hot key is spread over many tasks, and stitch the
partitions together with a per-partition summary that has one row per
partition (bounded by the partition count, never by the data).

The sorted rows are written to the checkpoint folder once, each with its
``monotonically_increasing_id`` taken in that write (range partition index and
place in it), so every later pass sees the same numbering (also when the result
is unioned, which renumbers tasks) and the lineage is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.session import ensure_checkpoint_dir, materialize

_KEY = "__lx_key"
_MID = "__lx_mid"
_LOCAL_BITS = 33  # monotonically_increasing_id: partition index above bit 33


def global_ordinal(df: DataFrame, order_cols: Sequence[str], name: str = "ordinal",
                   partitions: int | None = None) -> DataFrame:
    """Add a 1-based position of each row in the order of ``order_cols``.

    JVM only: the written, range-partitioned and sorted rows carry
    ``monotonically_increasing_id`` (partition index and place in partition);
    partition offsets come from one count per partition. Ties are broken once,
    by the written sort, and stay fixed afterwards.
    """
    order_cols = list(order_cols)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                         .withColumn(_MID, F.monotonically_increasing_id()), "ordinal")
    pid = F.shiftright(F.col(_MID), _LOCAL_BITS)
    counts = {r["p"]: r["c"] for r in ranged.groupBy(pid.alias("p"))
              .agg(F.count(F.lit(1)).alias("c")).collect()}
    offsets, running = [], 0
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(running)]
        running += counts[p]
    offset = F.element_at(F.create_map(*offsets), pid) if offsets else F.lit(0)
    local = F.col(_MID).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return ranged.withColumn(name, (offset + local + 1).cast("long")).drop(_MID)


def group_ordinal(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                  name: str = "k", partitions: int | None = None) -> DataFrame:
    """Add a 1-based position of each row inside its group, in ``order_cols`` order.

    Same result as ``row_number().over(partitionBy(group).orderBy(order))`` but a
    group larger than one task is split over consecutive range partitions. The
    partition summary (first key, last key and its run length, row count) is
    computed with aggregates over the written rows: one row per partition.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if len(group_cols) == 1:
        key = F.coalesce(F.col(group_cols[0]).cast("string"), F.lit("\u0001null\u0001"))
    else:
        key = F.to_json(F.struct(*[F.col(c) for c in group_cols]))
    sort_cols = group_cols + order_cols
    ranged = materialize(df.withColumn(_KEY, key).repartitionByRange(n, *sort_cols)
                         .sortWithinPartitions(*sort_cols)
                         .withColumn(_MID, F.monotonically_increasing_id()), "group_ordinal")
    pid = F.shiftright(F.col(_MID), _LOCAL_BITS)
    ends = (ranged.groupBy(pid.alias("p"))
            .agg(F.min(_MID).alias("lo"), F.max(_MID).alias("hi"),
                 F.count(F.lit(1)).alias("n")).collect())
    edge_ids = [r["lo"] for r in ends] + [r["hi"] for r in ends]
    keys = {r[_MID]: r[_KEY] for r in ranged.filter(F.col(_MID).isin(edge_ids))
            .select(_MID, _KEY).collect()}
    parts = {r["p"]: {"n": r["n"], "first_key": keys[r["lo"]], "last_key": keys[r["hi"]]}
             for r in ends}
    last_pairs = spark.createDataFrame([(p, v["last_key"]) for p, v in parts.items()],
                                       "p long, last_key string")
    runs = (ranged.join(F.broadcast(last_pairs),
                        (pid == F.col("p")) & (F.col(_KEY) == F.col("last_key")))
            .groupBy("p").agg(F.count(F.lit(1)).alias("n_last")).collect())
    for r in runs:
        parts[r["p"]]["n_last"] = r["n_last"]
    carry: dict[int, int] = {}
    run_key, run_n = None, 0
    for p in sorted(parts):
        r = parts[p]
        carry[p] = run_n if r["first_key"] == run_key else 0
        if r["first_key"] == r["last_key"] == run_key and r["n_last"] == r["n"]:
            run_n += r["n"]
        else:
            run_key, run_n = r["last_key"], r["n_last"]
    carried = [(p, parts[p]["first_key"], c) for p, c in carry.items() if c]

    # Place inside the group = distance to the group's first row in this range
    # partition (a per-(partition, key) minimum: a numeric hash aggregate), plus
    # the rows of the same group in earlier partitions for a partition's first key.
    starts = ranged.groupBy(pid.alias("__p"), F.col(_KEY).alias("__k")).agg(
        F.min(_MID).alias("__start"))
    numbered = ranged.join(starts, (pid == F.col("__p")) & (F.col(_KEY) == F.col("__k")))
    k = F.col(_MID) - F.col("__start") + 1
    if carried:
        carry_df = F.broadcast(spark.createDataFrame(carried, "__cp long, __ck string, __c long"))
        numbered = numbered.join(carry_df, (F.col("__p") == F.col("__cp"))
                                 & (F.col("__k") == F.col("__ck")), "left")
        k = k + F.coalesce(F.col("__c"), F.lit(0))
    out_cols = [c for c in df.columns]
    return numbered.select(*out_cols, k.cast("long").alias(name))
