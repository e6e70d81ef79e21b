"""Operators as streams.

A stream of occurrences has topic, loc, t (epoch seconds) and ts (event time).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "1 hour"


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def topic_cell_counts(stream: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """(start, topic, loc, n) in tumbling windows; rows later than the watermark are left out."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "topic", "loc").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "topic", "loc", "n")


def history_counts(stream: DataFrame, history: str = "6 hours", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    """(end, loc, topic, n) in sliding windows."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", history, slide), "loc", "topic").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.end").alias("end"), "loc", "topic", "n")


def active_sessions(stream: DataFrame, gap: str = "13 hours", late: str = LATE) -> DataFrame:
    """(topic, start, end, n): spans without a gap; small buckets aren't left out first, as the batch operator does."""
    spans = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "topic").agg(F.count("*").alias("n"))
    return spans.select("topic", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class Leader(StatefulProcessor):
    """Keeps each location's cumulative loss by model and names the leader at each time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.losses = handle.getMapState("losses", "model string", "loss double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        df = pd.concat(list(rows)).sort_values(["tu", "model"])
        out = []
        for tu, part in df.groupby("tu"):
            values = dict(zip(part["model"], part["accuracy"]))
            past = {m: (self.losses.getValue((m,))[0] if self.losses.containsKey((m,)) else 0.0) for m in values}
            best = min(values, key=lambda m: (round(past[m], 9), m))
            out.append((key[0], int(tu), best, float(values[best])))
            for m, v in values.items():
                self.losses.updateValue((m,), (past[m] + 1 - v,))
        yield pd.DataFrame(out, columns=["loc", "tu", "model", "value"])

    def close(self) -> None:
        pass


def follow_the_leader(performance: DataFrame) -> DataFrame:
    """(loc, tu, model, value) of a stream of (loc, tu, model, accuracy) whose times arrive in order; ties go by name."""
    return performance.groupBy("loc").transformWithStateInPandas(Leader(), "loc long, tu long, model string, value double", "Append", "None")


def epoch_edges(counts: DataFrame, least: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Write each batch's (start, u, v, w) edges of closed windows of ``topic_cell_counts`` to a sink."""

    def edges(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col("n") >= least)
        a, b = rows.select("start", "topic", F.col("loc").alias("u"), F.col("n").alias("a")), rows.select("start", "topic", F.col("loc").alias("v"), F.col("n").alias("b"))
        sink(a.join(b, ["start", "topic"]).where("u < v").groupBy("start", "u", "v").agg(F.sum(F.least("a", "b")).alias("w")), number)

    return counts.writeStream.foreachBatch(edges).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
