"""Locality of topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topotide.functions.columns import bin_up, entropy_of, haversine
from topotide.operators.quantiles import exact_percentiles
from topotide.operators.timeline import by_topic, drop_outliers, highest_active_region, active_regions, interval_counts, peak_interval, with_bucket


def entropy_focus(occ: DataFrame, keys: list[str], loc: str = "cell") -> DataFrame:
    """(keys, n, entropy, focus_cell, focus) of the distribution over locations; ties go to the smallest location."""
    counts = occ.groupBy(*keys, loc).agg(F.count(F.lit(1)).alias("c"))
    whole = counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("clogc"), F.min(F.struct((-F.col("c")).alias("m"), F.col(loc).alias("cell"))).alias("b")
    )
    return whole.select(*keys, "n", (F.log2("n") - F.col("clogc") / F.col("n")).alias("entropy"), F.col("b.cell").alias("focus_cell"), (-F.col("b.m") / F.col("n")).alias("focus"))


def spread(occ: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spread): root mean squared miles of occurrences to their centre.

    Occurrences at one point count together, so that what meets the centre of
    a frequent topic are its points.
    """
    points = occ.groupBy(*keys, "lat", "lon").agg(F.count(F.lit(1)).alias("c"))
    mean = lambda x: F.sum(F.col(x) * F.col("c")) / F.sum("c")
    centre = points.groupBy(*keys).agg(mean("lat").alias("clat"), mean("lon").alias("clon"))
    miles = haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return points.join(centre, keys).groupBy(*keys).agg(F.sqrt(F.sum(miles * miles * F.col("c")) / F.sum("c")).alias("spread"))


def radius(occ: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, radius): mean miles to the centre after dropping far outliers."""
    centre = occ.groupBy(*keys).agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    far = occ.join(centre, keys).select(*keys, F.round(haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 6).alias("miles"))
    return drop_outliers(far, keys, "miles", upper_only=True).groupBy(*keys).agg(F.avg("miles").alias("radius"))


def topic_metrics(occ: DataFrame, unit: int) -> DataFrame:
    """(topic, n, peak_iid, focus_cell, focus, entropy, spread)."""
    local = entropy_focus(occ, ["topic"])
    return local.join(peak_interval(interval_counts(occ, unit)), "topic").join(spread(occ, ["topic"]), "topic").select("topic", "n", "peak_iid", "focus_cell", "focus", "entropy", "spread")


def interval_metrics(occ: DataFrame, unit: int) -> DataFrame:
    """(topic, iid, n, entropy, focus_cell, focus, spread) of each observed interval."""
    first = F.min("bucket").over(by_topic())
    rows = occ.withColumn("iid", ((F.col("bucket") - first) / unit).cast("bigint"))
    return entropy_focus(rows, ["topic", "iid"]).join(spread(rows, ["topic", "iid"]), ["topic", "iid"])


def aligned_interval_stats(occ: DataFrame, unit: int) -> DataFrame:
    """(norm_iid, mean_share, entropy, focus, spread, d_entropy, d_focus, d_spread): means over topics by distance to the peak."""
    whole = topic_metrics(occ, unit).select("topic", F.col("n").alias("total"), "peak_iid", F.col("entropy").alias("e0"), F.col("focus").alias("f0"), F.col("spread").alias("s0"))
    rows = interval_metrics(occ, unit).join(whole, "topic")
    return rows.groupBy((F.col("iid") - F.col("peak_iid")).alias("norm_iid")).agg(
        F.avg(F.col("n") / F.col("total")).alias("mean_share"),
        F.avg("entropy").alias("entropy"),
        F.avg("focus").alias("focus"),
        F.avg("spread").alias("spread"),
        F.avg(F.col("e0") - F.col("entropy")).alias("d_entropy"),
        F.avg(F.col("f0") - F.col("focus")).alias("d_focus"),
        F.avg(F.col("s0") - F.col("spread")).alias("d_spread"),
    )


def focus_locations(occ: DataFrame, unit: int, around: int | None = 30) -> DataFrame:
    """(topic, cell, iid): focus cells of a topic's intervals, each at its first interval; near the peak or over the whole life."""
    rows = occ.withColumn("iid", ((F.col("bucket") - F.min("bucket").over(by_topic())) / unit).cast("bigint"))
    local = entropy_focus(rows, ["topic", "iid"])
    if around is not None:
        local = local.join(peak_interval(interval_counts(occ, unit)), "topic").where(F.abs(F.col("iid") - F.col("peak_iid")) <= around)
    return local.groupBy("topic", F.col("focus_cell").alias("cell")).agg(F.min("iid").alias("iid"))


def focus_location_counts(occ: DataFrame, unit: int) -> DataFrame:
    """(n_cells, n_topics, cdf) over the whole life."""
    per = focus_locations(occ, unit, None).groupBy("topic").agg(F.count(F.lit(1)).alias("n_cells"))
    counts = per.groupBy("n_cells").agg(F.count(F.lit(1)).alias("n_topics"))
    return counts.select("n_cells", "n_topics", (F.sum("n_topics").over(Window.orderBy("n_cells")) / F.sum("n_topics").over(Window.partitionBy())).alias("cdf"))


def topics_of_focus_location(occ: DataFrame, unit: int) -> DataFrame:
    """(cell, n_topics, topics): distinct topics of each focus cell, joined in order."""
    got = focus_locations(occ, unit).groupBy("cell").agg(F.array_sort(F.collect_set("topic")).alias("t"))
    return got.select("cell", F.size("t").cast("bigint").alias("n_topics"), F.array_join("t", ",").alias("topics"))


def classify_topic(occ: DataFrame, far: float = 500.0, unit: int = 300, sudden: int = 50, gap: int = 12, min_bucket: int = 3) -> DataFrame:
    """(topic, radius, is_local, is_sudden): locality of the active region, and whether its first bucket is large."""
    fine = with_bucket(occ, unit)
    region = highest_active_region(fine, unit, gap, min_bucket)
    local = radius(region, ["topic"])
    start = active_regions(fine, unit, gap, min_bucket).where("is_highest").select("topic", F.col("start_bucket").alias("bucket"))
    first = fine.join(start, ["topic", "bucket"]).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return local.join(first, "topic").select("topic", "radius", (F.col("radius") < far).alias("is_local"), (F.col("n") > sudden).alias("is_sudden"))


def valid_topics(spans: DataFrame, bounds: dict[int, float]) -> DataFrame:
    """Topics (topic, class_id, hours) whose active span keeps to the bound of their class."""
    bound = F.lit(None).cast("double")
    for c, hours in bounds.items():
        bound = F.when(F.col("class_id") == c, F.lit(float(hours))).otherwise(bound)
    return spans.where(F.col("hours") <= bound)


def global_locality(occ: DataFrame, loc: str = "cell") -> DataFrame:
    """(entropy, focus_cell, focus) of all occurrences."""
    counts = occ.groupBy(loc).agg(F.count(F.lit(1)).alias("c"))
    share = counts.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy()))
    return share.agg(entropy_of(F.col("p")).alias("entropy"), F.min(F.struct((-F.col("p")).alias("m"), F.col(loc).alias("cell"))).alias("b")).select("entropy", F.col("b.cell").alias("focus_cell"), (-F.col("b.m")).alias("focus"))


def early_radius_error(occ: DataFrame, unit: int, first: Sequence[int], width: int = 50, more_than: int = 10, least: int = 3) -> DataFrame:
    """(units, bin, n_topics): how far the radius of a topic's first units is from its final radius, in bins of ``width`` miles.

    Topics count that have more than ``more_than`` occurrences in these units,
    and bins that have at least ``least`` topics.
    """
    rows = occ.withColumn("place", F.floor((F.col("t") - F.min("t").over(by_topic())) / unit))
    early = rows.withColumn("units", F.explode(F.array(*[F.lit(int(u)) for u in first]))).where("place < units")
    enough = early.groupBy("topic", "units").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    near = radius(early.join(enough, ["topic", "units"], "left_semi"), ["topic", "units"]).withColumnRenamed("radius", "early")
    gap = F.abs(F.col("early") - F.col("radius"))
    both = near.join(radius(occ, ["topic"]), "topic").select("units", bin_up(F.round(gap, 6), width).alias("bin"))
    return both.groupBy("units", "bin").agg(F.count(F.lit(1)).alias("n_topics")).where(F.col("n_topics") >= least)


def outlier_bound(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, bound, mean): the upper outlier bound of a value, and the mean of what keeps to it."""
    q = exact_percentiles(rows, keys, value, (0.25, 0.75))
    bound = q.select(*keys, (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("bound"))
    joined = rows.join(bound, list(keys)) if keys else rows.crossJoin(F.broadcast(bound))
    return joined.where(F.col(value) <= F.col("bound")).groupBy(*keys, "bound").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
