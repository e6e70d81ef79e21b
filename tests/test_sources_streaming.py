"""File formats and streams."""

import gzip
import json

from pyspark.sql import functions as F

from topotide.sources import files
from topotide.streaming import live


def test_posts(spark, tmp_path):
    posts = [
        {"id": 1, "user": {"id": 7, "l": "x"}, "t": "Tue Feb 08 12:00:30 +0000 2011", "h": ["Ab", "c"], "tx": "hi", "geo": [40.0, -73.0]},
        {"id": 2, "user": {"id": 8, "l": ""}, "t": "Fri Mar 04 01:00:00 +0000 2011", "h": [], "tx": "yo", "bb": [1.0, 2.0]},
        {"id": 3, "user": {"id": 9, "l": ""}, "t": "Fri Mar 04 01:00:00 +0000 2011", "h": ["z"], "tx": "", "place": {"bounding_box": {"coordinates": [[[0.0, 10.0], [2.0, 10.0], [2.0, 12.0], [0.0, 12.0]]]}}},
        {"id": 4, "user": {"id": 9, "l": ""}, "t": "Fri Mar 04 01:00:00 +0000 2011", "h": ["z"], "tx": ""},
    ]
    with gzip.open(tmp_path / "p.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, posts)) + "\nnot json\n")
    got = files.read_posts(spark, str(tmp_path / "p.json.gz"))
    rows = {r["id"]: r for r in got.collect()}
    assert set(rows) == {1, 2, 3} and (rows[3]["lat"], rows[3]["lon"]) == (11.0, 1.0) and rows[1]["month"] == 2
    files.write_posts(got, str(tmp_path / "out"))
    assert {r["id"] for r in files.month_partitions(spark.read.parquet(str(tmp_path / "out")), (2011, 3), (2011, 12)).collect()} == {2, 3}
    occ = files.read_occurrences(got, 14.5)
    assert sorted(r["topic"] for r in occ.collect()) == ["ab", "c", "z"]
    files.export_public(occ).write.json(str(tmp_path / "objects"))
    assert files.read_topic_objects(spark, str(tmp_path / "objects")).count() == 3
    files.write_result(occ, str(tmp_path / "result"), {"k": 1})
    assert spark.read.parquet(str(tmp_path / "result/data")).count() == 3


def test_checkins_and_labels(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("u\t1\t1.5\t2.5\t2011-01-01 00:00:00\ttext\n" + "v\t2\t1.5\t2.5\t2011-01-01 00:00:00\ttext\tplace\n" + "w\tx\n")
    assert {r["user"]: r["place"] for r in files.read_checkins_tsv(spark, str(tmp_path / "a.tsv")).collect()} == {"u": None, "v": "place"}
    (tmp_path / "b.txt").write_text("1 2012-05-06T07:08:09Z 30.2  -97.7 77\nbad line\n2 x y z w\n")
    assert [(r["user"], r["lat"]) for r in files.read_checkins_ws(spark, str(tmp_path / "b.txt"), "net").collect()] == [("net_1", 30.2)]
    (tmp_path / "l.csv").write_text("1,a,0\n2,b,3\n")
    assert [tuple(r) for r in files.read_topic_labels(spark, str(tmp_path / "l.csv")).collect()] == [("b", 3)]


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(60)
    return query


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("t"), F.col("id") % 3).alias("topic"), (F.col("id") % 4).alias("loc"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 97).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "topic string, loc long, ts timestamp"
    stream = live.read_events(spark, str(tmp_path / "in"), schema)
    run(live.topic_cell_counts(stream), "counts", "complete")
    batch = rows.groupBy(F.window("ts", "1 hour").start.alias("start"), "topic", "loc").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    run(live.active_sessions(live.read_events(spark, str(tmp_path / "in"), schema)), "sessions", "complete")
    assert sum(r["n"] for r in spark.table("sessions").collect()) == 500
