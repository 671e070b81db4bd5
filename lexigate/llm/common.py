"""Shared pieces of the operators: words, lines, row-local helpers, stored tables.

White space is always the fixed set space, \\t, \\n, \\v, \\f, \\r. A word is a
maximal run of other characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigate.session import new_folder
from lexigate.sources.tables import read_table

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *columns)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression (a lambda reads it many times)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def words(col: Column) -> Column:
    """Words in order; an empty array for null or blank text."""
    text = strip(F.coalesce(col, F.lit("")))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SPACE))


def ascii_lower(col: Column) -> Column:
    """A-Z lowered, every other character kept. ``lower`` agrees on pure ASCII and
    is much faster there."""
    return (F.when(F.octet_length(col) == F.char_length(col), F.lower(col))
            .otherwise(F.translate(col, UPPER, LOWER)))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder (``session.release``
    deletes it)."""
    return new_folder(spark, "tables", name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read from there: cuts the lineage, so a
    lost executor repeats only what comes after."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a written folder before the session's release."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def packed(docs: DataFrame, name: str = "__row") -> Column:
    """All columns as one struct, so that names a stage adds cannot clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def unpacked(df: DataFrame, like: DataFrame, name: str = "__row", **changed: Column) -> DataFrame:
    """The columns of ``like`` back from the struct, some of them replaced."""
    return df.select(*[changed.get(c, F.col(f"{name}.`{c}`")).alias(c) for c in like.columns])
