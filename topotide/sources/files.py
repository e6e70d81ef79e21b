"""Readers and writers of the file formats that posts, check-ins and results come in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.operators.grid import with_cell

POST = "id long, user struct<id:long,l:string>, t string, h array<string>, tx string, geo array<double>, bb array<double>, place struct<bounding_box:struct<coordinates:array<array<array<double>>>>>"
CHECKIN_TSV = "user string, id string, lat double, lon double, at string, text string, place string"
LABELS = "id int, topic string, class int"
#: Format of a post's time, behind the name of the day.
POST_TIME = "MMM dd HH:mm:ss Z yyyy"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(id, user, ts, topics, text, lat, lon, year, month) from JSON lines, plain or gzip.

    The point is geo, else bb, else the mean of the place's ring, given as
    (lon, lat); rows without any and rows that aren't JSON drop out.
    """
    raw = spark.read.schema(POST).option("mode", "DROPMALFORMED").json(path)
    ring = F.col("place.bounding_box.coordinates")[0]
    mean = lambda i: F.aggregate(F.transform(ring, lambda p: p[i]), F.lit(0.0), lambda a, x: a + x) / F.size(ring)
    point = F.coalesce(F.when(F.size("geo") == 2, F.col("geo")), F.when(F.size("bb") == 2, F.col("bb")), F.when(ring.isNotNull(), F.array(mean(1), mean(0))))
    ts = F.try_to_timestamp(F.regexp_replace("t", r"^\w+ ", ""), F.lit(POST_TIME))
    rows = raw.select("id", F.col("user.id").alias("user"), ts.alias("ts"), F.col("h").alias("topics"), F.col("tx").alias("text"), point[0].alias("lat"), point[1].alias("lon"))
    return rows.where("lat is not null and ts is not null").withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))


def write_posts(posts: DataFrame, path: str) -> None:
    """Write posts partitioned by month, so that ranges of months read only their own files."""
    posts.write.partitionBy("year", "month").parquet(path)


def month_partitions(posts: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Posts of the closed range of (year, month)."""
    month = F.col("year") * 12 + F.col("month")
    years = F.col("year").between(start[0], end[0])
    return posts.where(years & month.between(start[0] * 12 + start[1], end[0] * 12 + end[1]))


def read_occurrences(posts: DataFrame, size: float) -> DataFrame:
    """(topic, lat, lon, t, ci, cj, cell): one row for each topic of each post, topics in lower case."""
    rows = posts.select(F.explode("topics").alias("topic"), "lat", "lon", F.unix_seconds("ts").alias("t"))
    return with_cell(rows.withColumn("topic", F.lower("topic")), size)


def read_checkins_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(user, id, lat, lon, ts, text, place) from tab-separated lines of six or seven fields."""
    rows = spark.read.schema(CHECKIN_TSV).option("sep", "\t").option("mode", "PERMISSIVE").csv(path)
    return rows.withColumn("ts", F.to_timestamp("at", "yyyy-MM-dd HH:mm:ss")).drop("at").where("ts is not null and lat is not null and lon is not null")


def read_checkins_ws(spark: SparkSession, path: str, network: str) -> DataFrame:
    """(user, ts, lat, lon, place) from lines of ``user time lat lon place``; users get the network's name in front."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(f) >= 5)
    out = rows.select(F.concat_ws("_", F.lit(network), f[0]).alias("user"), F.try_to_timestamp(f[1]).alias("ts"), f[2].try_cast("double").alias("lat"), f[3].try_cast("double").alias("lon"), f[4].alias("place"))
    return out.where("ts is not null and lat is not null and lon is not null")


def read_topic_objects(spark: SparkSession, path: str) -> DataFrame:
    """(topic, t, loc): occurrences of exported topics; parameter records and second objects of a topic are skipped."""
    raw = spark.read.schema("topic string, n long, occurrences array<struct<t:long,loc:string>>").json(path)
    one = raw.where("topic is not null").dropDuplicates(["topic"])
    return one.select("topic", F.explode("occurrences").alias("o")).select("topic", "o.t", "o.loc")


def read_topic_labels(spark: SparkSession, path: str) -> DataFrame:
    """(topic, class) of labelled topics; class 0 is unlabelled and drops out."""
    return spark.read.schema(LABELS).csv(path).where("class <> 0").select("topic", "class")


def write_result(df: DataFrame, path: str, params: dict) -> None:
    """Write a result and, apart from it, its parameters as a table of one row."""
    df.write.parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.json(f"{path}/params")


def export_public(occ: DataFrame) -> DataFrame:
    """(topic, n, occurrences array<struct<t,loc>>) in order of time."""
    loc = F.format_string("%d_%d", "ci", "cj")
    return occ.groupBy("topic").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("t", loc.alias("loc")))).alias("occurrences"))


def input_sample_by_cell(points: DataFrame) -> DataFrame:
    """(cell, points): the raw points of the origin cell, for a look at bad geocodes."""
    return points.where("ci = 0 and cj = 0").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("lat", "lon"))).alias("points"))
