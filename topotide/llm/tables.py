"""Reading the tables that the queries of this package use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.plans.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the workers get this package at the same time."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly_named(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with names that clash with nothing: the ``used`` columns keep theirs, the others are numbered.

    Columns are taken by position, so dots, operators' own helper names and
    names that differ in case alone do no harm; ``toDF`` with the old names
    turns the result back.
    """
    names = docs.columns
    return docs.toDF(*[n if n in used and names.index(n) == i else f"column_{i}" for i, n in enumerate(names)])


def unique_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with one row for each key.

    Only keys that occur more than once are shuffled with their texts; of the
    rows of such a key the smallest in the order of all columns stays.
    """
    often = docs.groupBy(key).count().where("count > 1").select(F.col(key).alias("__often"))
    if often.isEmpty():
        return docs
    same = F.col(key).eqNullSafe(F.col("__often"))
    once = docs.join(often, same, "left_anti")
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    more = docs.join(often, same, "left_semi").groupBy(F.col(key).alias("__key")).agg(F.min(struct).alias("__row"))
    return once.unionByName(more.select("__row.*"))
