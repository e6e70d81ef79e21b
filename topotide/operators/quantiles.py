"""Exact percentiles of groups of any size, by histograms of ever narrower ranges.

Each pass counts a group's values in equal bins of the range that is known to
hold the wanted place, and goes on with the bin that holds it, between the
smallest and the largest value in it.  A task sends a row for each bin, so the
values of a large group never meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topotide.plans.scratch import new_path, remove, written

BINS = 1024


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """(keys, q array<double>): the percentiles of a numeric column at ``shares``, interpolated as ``percentile`` does.

    Nulls are left out, and a group of nulls makes no row.  Ends are exact
    values of the column, so the passes stop when a range is a single value,
    for each place of each group; a pass narrows every range.
    """
    keys = list(keys)
    spark = rows.sparkSession
    values = written(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")), "values")
    whole = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * s), F.ceil((F.col("n") - 1) * s)) for s in shares])))
    path = new_path(spark, "places")
    state = whole.select(*keys, "n", "low", "high", F.explode(places).alias("place")).withColumn("left", F.col("place"))
    state = written(state, "places", path)
    while not state.where("low < high").isEmpty():
        open_ = state.where("low < high").select(*keys, "low", "high", "left").distinct()
        ranges = open_.select(*keys, "low", "high").distinct()
        inside = (values.join(ranges, keys) if keys else values.crossJoin(F.broadcast(ranges))).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))  # without keys a range for each share
        # halves, so that a range of any two doubles doesn't overflow
        bin_ = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins), F.lit(bins - 1))
        counts = inside.groupBy(*keys, "low", "high", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "low", "high").orderBy("bin"))
        counts = counts.withColumn("upto", upto)
        found = open_.join(counts, [*keys, "low", "high"]).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c")))
        found = found.select(*keys, "low", "high", "left", "from", "to", (F.col("left") - (F.col("upto") - F.col("c"))).alias("rest"))
        next_path = new_path(spark, "places")
        moved = state.join(found, [*keys, "low", "high", "left"], "left")
        state = written(moved.select(*keys, "n", F.coalesce("from", "low").alias("low"), F.coalesce("to", "high").alias("high"), "place", F.coalesce("rest", "left").alias("left")), "places", next_path)
        remove(spark, path)
        path = next_path
    at = F.map_from_entries(F.collect_list(F.struct("place", "low"))).alias("at")  # two places a share
    known = state.groupBy(*keys, "n").agg(at)
    each = []
    for s in shares:
        place = (F.col("n") - 1) * s
        a, b = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        each.append(a + (place - F.floor(place)) * (b - a))
    return known.select(*keys, F.array(*each).alias("q"))
