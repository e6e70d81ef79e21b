"""The benchmark tables as occurrences, check-ins and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.operators.grid import drop_origin_cell, with_cell
from topotide.operators.timeline import with_bucket

SIZE = 14.5
UNIT = 21600


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), t.alias("t"))


def _points(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("lat", (F.col(key) * 37) % 140 - 59.75).withColumn("lon", (F.col(key) * 73) % 340 - 169.75)


def occ_events(spark: SparkSession, sf_dir: str, size: float = SIZE, unit: int = UNIT) -> DataFrame:
    """Occurrences: topic t0..t99, points by user, the origin cell dropped."""
    rows = _points(_events(spark, sf_dir).withColumn("topic", F.concat(F.lit("t"), "k")), "user_id")
    return with_bucket(drop_origin_cell(with_cell(rows, size)), unit).select("topic", "lat", "lon", "t", "ci", "cj", "cell", "bucket")


def occ_pairs(spark: SparkSession, sf_dir: str, unit: int = UNIT) -> DataFrame:
    """Dense occurrences: 25 locations."""
    rows = _events(spark, sf_dir).select(F.concat(F.lit("t"), "k").alias("topic"), (F.col("user_id") % 25).alias("loc"), "t", "k", "event_type")
    return with_bucket(rows, unit)


def occ_few_topics(spark: SparkSession, sf_dir: str, unit: int = 3600) -> DataFrame:
    """Occurrences of 20 topics in hourly buckets, for prediction."""
    rows = _events(spark, sf_dir).select(F.concat(F.lit("t"), F.col("k") % 20).alias("topic"), (F.col("user_id") % 25).alias("loc"), "t")
    return with_bucket(rows, unit)


def location_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(loc, lat, lon) of the locations that ``occ_pairs`` has."""
    locs = _events(spark, sf_dir).select((F.col("user_id") % 25).alias("loc")).distinct()
    return locs.withColumn("lat", (F.col("loc") * 37) % 140 - 59.75).withColumn("lon", (F.col("loc") * 73) % 340 - 169.75)


def occ_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume variant: 200 topics at the nations of suppliers, by day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_shipdate")
    nations = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("loc"))
    rows = lines.join(nations, "l_suppkey").select(F.concat(F.lit("p"), F.col("l_partkey") % 200).alias("topic"), "loc", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"))
    return with_bucket(rows, 86400)


def checkins(spark: SparkSession, sf_dir: str, size: float = 29.0) -> DataFrame:
    """(user, network, cell, t): points by event, so that users visit several cells."""
    rows = _points(_events(spark, sf_dir), "event_id").select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("network"), "lat", "lon", "t")
    return drop_origin_cell(with_cell(rows, size)).select("user", "network", "cell", "ci", "cj", "lat", "lon", "t")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, topics, text): the source of a document is its topic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.when(F.col("source").isNotNull(), F.array("source")).otherwise(F.array()).cast("array<string>").alias("topics"), "text")
