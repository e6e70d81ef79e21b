"""Filters and windows over the life of topics.

``occ`` is a table of occurrences with topic, t (epoch seconds), lat, lon,
cell and bucket.  Every ordering ends in a unique key, so results don't depend
on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from topotide.functions.columns import bucket, haversine
from topotide.operators.quantiles import exact_percentiles


def by_topic() -> WindowSpec:
    """The rows of one topic."""
    return Window.partitionBy("topic")


def with_bucket(df: DataFrame, unit: int) -> DataFrame:
    return df.withColumn("bucket", bucket(F.col("t"), unit))


def _topics(occ: DataFrame, keep: str) -> DataFrame:
    life = occ.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    return occ.join(life.where(keep).select("topic"), "topic", "left_semi")


def topics_started_after(occ: DataFrame, min_n: int, start: int) -> DataFrame:
    return _topics(occ, f"n >= {min_n} and first >= {start}")


def topics_inside_window(occ: DataFrame, min_n: int, start: int, end: int) -> DataFrame:
    return _topics(occ, f"n >= {min_n} and first >= {start} and last <= {end}")


def occurrences_in_window(occ: DataFrame, min_n: int, start: int, end: int) -> DataFrame:
    return _topics(occ.where(F.col("t").between(start, end)), f"n >= {min_n}")


def _counted(occ: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    groups = occ.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= at_least).drop("__n")
    return occ.join(groups, list(keys), "left_semi")


def dense(occ: DataFrame, min_per_loc: int = 5, loc: str = "cell") -> DataFrame:
    """Occurrences of (topic, location) groups of enough size."""
    return _counted(occ, ["topic", loc], min_per_loc)


def busy_buckets(occ: DataFrame, min_n: int = 5) -> DataFrame:
    return _counted(occ, ["topic", "bucket"], min_n)


def min_topic_at_location(occ: DataFrame, k: int, loc: str = "cell") -> DataFrame:
    return _counted(occ, [loc, "topic"], k)


def min_topics_per_location_bucket(occ: DataFrame, k: int, loc: str = "cell") -> DataFrame:
    groups = occ.groupBy("bucket", loc).agg(F.count_distinct("topic").alias("n")).where(F.col("n") >= k)
    return occ.join(groups.select("bucket", loc), ["bucket", loc], "left_semi")


def drop_outliers(df: DataFrame, keys: Sequence[str], value: str, upper_only: bool = False, hot: bool = False) -> DataFrame:
    """Without values beyond one and a half quartile ranges from the quartiles of their group.

    ``hot`` says that a group may have more distinct values than a task should
    hold; quartiles then come from passes of histograms, with the same rows.
    """
    if hot:
        q = exact_percentiles(df, keys, value, (0.25, 0.75)).withColumnRenamed("q", "__q")
    else:
        q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    a, b = F.col("__q")[0], F.col("__q")[1]
    keep = F.col(value) <= b + 1.5 * (b - a)
    keep = keep if upper_only else keep & (F.col(value) >= a - 1.5 * (b - a))
    joined = df.join(q, list(keys)) if keys else df.crossJoin(F.broadcast(q))
    return joined.where(keep).drop("__q")


def interval_counts(occ: DataFrame, unit: int) -> DataFrame:
    """(topic, iid, n): counts by number of units since the topic's first bucket."""
    counts = occ.groupBy("topic", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("topic", ((F.col("bucket") - F.min("bucket").over(by_topic())) / unit).cast("bigint").alias("iid"), "n")


def peak_interval(intervals: DataFrame) -> DataFrame:
    """(topic, peak_iid): the earliest interval with the highest count."""
    return intervals.groupBy("topic").agg(F.min(F.struct((-F.col("n")).alias("n"), "iid")).getField("iid").alias("peak_iid"))


def _shares(intervals: DataFrame) -> DataFrame:
    """Intervals with share and cumulative share of their topic."""
    total = F.sum("n").over(by_topic())
    run = F.sum("n").over(by_topic().orderBy("iid"))
    return intervals.select("topic", "iid", "n", (F.col("n") / total).alias("share"), (run / total).alias("cum_share"))


def interval_stats(intervals: DataFrame) -> DataFrame:
    """(iid, n_peaks, mean_share, mean_cum_share)."""
    rows = _shares(intervals).join(peak_interval(intervals), "topic")
    return rows.groupBy("iid").agg(F.sum((F.col("iid") == F.col("peak_iid")).cast("bigint")).alias("n_peaks"), F.avg("share").alias("mean_share"), F.avg("cum_share").alias("mean_cum_share"))


def interval_change(intervals: DataFrame, peak_below: int = 288) -> DataFrame:
    """(iid, mean_change): mean change from the interval observed before, as a share of the topic."""
    early = peak_interval(intervals).where(F.col("peak_iid") < peak_below)
    rows = intervals.join(early, "topic", "left_semi")
    change = (F.col("n") - F.lag("n", 1, 0).over(by_topic().orderBy("iid"))) / F.sum("n").over(by_topic())
    return rows.select("iid", change.alias("change")).groupBy("iid").agg(F.avg("change").alias("mean_change"))


def decay_curve(intervals: DataFrame, first: int = 200) -> DataFrame:
    return interval_change(intervals).orderBy("iid").limit(first)


def rank_share(occ: DataFrame, k: int = 10, loc: str = "cell") -> DataFrame:
    """(rank, mean_cum_share, mean_share) over topics; past its last location a topic counts as (1, 0)."""
    counts = occ.groupBy("topic", loc).agg(F.count(F.lit(1)).alias("n"))
    order = by_topic().orderBy(F.desc("n"), loc)
    total = F.sum("n").over(by_topic())
    ranked = counts.select("topic", F.row_number().over(order).alias("rank"), (F.col("n") / total).alias("share"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cum"))
    sums = ranked.where(F.col("rank") <= k).groupBy("rank").agg(F.sum("share").alias("s"), F.sum("cum").alias("c"), F.count(F.lit(1)).alias("m"))
    topics = occ.agg(F.count_distinct("topic").alias("topics"))
    return sums.crossJoin(F.broadcast(topics)).select(F.col("rank").cast("bigint").alias("rank"), ((F.col("c") + F.col("topics") - F.col("m")) / F.col("topics")).alias("mean_cum_share"), (F.col("s") / F.col("topics")).alias("mean_share"))


def location_rank_curve(occ: DataFrame, loc: str = "cell") -> DataFrame:
    """(rank, share, cum_share) of locations by occurrences; one row a location."""
    counts = occ.groupBy(loc).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), loc)  # one row for each location
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(F.row_number().over(order).cast("bigint").alias("rank"), (F.col("n") / total).alias("share"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cum_share"))


def cdf(df: DataFrame, value: str, digits: int = 2) -> DataFrame:
    """(x, n, cdf, ccdf) of a rounded value; ccdf is the share at or above x."""
    counts = df.groupBy(F.round(value, digits).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    run = F.sum("n").over(Window.orderBy("x"))  # one row for each rounded value
    return counts.select("x", "n", (run / total).alias("cdf"), ((total - run + F.col("n")) / total).alias("ccdf"))


def peak_distribution(intervals: DataFrame, below: int = 288) -> DataFrame:
    """(peak_iid, n, cdf) of peaks below a bound."""
    peaks = peak_interval(intervals).where(F.col("peak_iid") < below)
    return cdf(peaks, "peak_iid", 0).select(F.col("x").alias("peak_iid"), "n", "cdf")


def active_regions(occ: DataFrame, unit: int = 3600, gap: int = 12, min_bucket: int = 3) -> DataFrame:
    """(topic, region, start_bucket, end_bucket, total, is_first, is_highest).

    Buckets with fewer than ``min_bucket`` occurrences don't count; a region
    ends where more than ``gap`` units without a bucket follow.  Empty buckets
    are never made: the distance to the bucket before tells.
    """
    busy = occ.groupBy("topic", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_bucket)
    order = by_topic().orderBy("bucket")
    empty = (F.col("bucket") - F.lag("bucket").over(order)) / unit - 1
    marked = busy.withColumn("new", F.when(empty > gap, 1).otherwise(0))
    marked = marked.withColumn("region", F.sum("new").over(order))
    regions = marked.groupBy("topic", "region").agg(F.min("bucket").alias("start_bucket"), F.max("bucket").alias("end_bucket"), F.sum("n").alias("total"))
    best = F.row_number().over(by_topic().orderBy(F.desc("total"), "start_bucket"))
    return regions.select("topic", F.col("region").cast("bigint").alias("region"), "start_bucket", "end_bucket", "total", (F.col("region") == 0).alias("is_first"), (best == 1).alias("is_highest"))


def highest_active_region(occ: DataFrame, unit: int = 3600, gap: int = 12, min_bucket: int = 3) -> DataFrame:
    """Occurrences inside the span of their topic's largest region, with is_first."""
    top = active_regions(occ, unit, gap, min_bucket).where("is_highest").select("topic", "start_bucket", "end_bucket", "is_first")
    return occ.join(top, "topic").where(F.col("bucket").between(F.col("start_bucket"), F.col("end_bucket"))).drop("start_bucket", "end_bucket")


def source_cell_early(region_occ: DataFrame, first: int = 10, least: int = 5) -> DataFrame:
    """(topic, cell, n): the commonest cell of the earliest occurrences, if common enough and in the first region."""
    rank = F.row_number().over(by_topic().orderBy("t", "cell"))
    early = region_occ.where("is_first").withColumn("rank", rank).where(F.col("rank") <= first)
    counts = early.groupBy("topic", "cell").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("topic").agg(F.min(F.struct((-F.col("n")).alias("m"), "cell")).alias("b"))
    return best.select("topic", F.col("b.cell").alias("cell"), (-F.col("b.m")).alias("n")).where(F.col("n") >= least)


def topics_by_source_cell(region_occ: DataFrame, first: int = 10) -> DataFrame:
    return source_cell_early(region_occ, first, 1).groupBy("cell").agg(F.count(F.lit(1)).alias("n_topics"))


def source_cell_percent(occ: DataFrame, share: float = 0.01) -> DataFrame:
    """(topic, cell, is_sure): the commonest cell of the earliest share of the occurrences."""
    rank = F.row_number().over(by_topic().orderBy("t", "cell"))
    some = F.floor(F.count(F.lit(1)).over(by_topic()) * share)
    early = occ.select("topic", "cell", rank.alias("rank"), some.alias("some")).where("rank <= some")
    counts = early.groupBy("topic", "some", "cell").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("topic", "some").agg(F.min(F.struct((-F.col("n")).alias("m"), "cell")).alias("b"))
    return best.select("topic", F.col("b.cell").alias("cell"), (-F.col("b.m") / F.col("some") >= 0.5).alias("is_sure"))


def displacement_by_day(occ: DataFrame, day: int = 86400) -> DataFrame:
    """(topic, day, n, miles): mean distance of a day's occurrences to their own centre."""
    days = occ.withColumn("day", bucket(F.col("t"), day))
    centre = days.groupBy("topic", "day").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    miles = haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return days.join(centre, ["topic", "day"]).groupBy("topic", "day").agg(F.count(F.lit(1)).alias("n"), F.avg(miles).alias("miles"))


def life_span(occ: DataFrame) -> DataFrame:
    """(topic, minutes) between first and last bucket, after the outlier filter over the topic's buckets."""
    clean = drop_outliers(occ.select("topic", "bucket"), ["topic"], "bucket")
    return clean.groupBy("topic").agg(((F.max("bucket") - F.min("bucket")) / 60).alias("minutes"))


def occurrences_by_life_fraction(occ: DataFrame) -> DataFrame:
    """(fraction, mean_share): share of occurrences by place in the topic's life, to 0.01, meaned over topics."""
    first, last = F.min("t").over(by_topic()), F.max("t").over(by_topic())
    place = occ.select("topic", F.when(last > first, F.floor((F.col("t") - first) * 100 / (last - first)) / 100).otherwise(0.0).alias("fraction"))
    counts = place.groupBy("topic", "fraction").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(by_topic()))
    topics = shares.agg(F.count_distinct("topic").alias("m"))
    return shares.groupBy("fraction").agg(F.sum("share").alias("s")).crossJoin(F.broadcast(topics)).select("fraction", (F.col("s") / F.col("m")).alias("mean_share"))


def occurrences_by_age(occ: DataFrame) -> DataFrame:
    """(age, share, cum_share): by bucket age in seconds after the outlier filter, mean share over all topics' occurrences."""
    ages = occ.select("topic", (F.col("bucket") - F.min("bucket").over(by_topic())).alias("age"))
    counts = drop_outliers(ages, ["topic"], "age").groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("age", (F.col("n") / total).alias("share"), (F.sum("n").over(Window.orderBy("age")) / total).alias("cum_share"))


def majority_time(occ: DataFrame, shares: Sequence[float] = (0.15,), more_than: int = 10) -> DataFrame:
    """(topic, cell, share, bucket): when a share of a group's occurrences has happened; groups of more than ``more_than``."""
    group = Window.partitionBy("topic", "cell")
    ranked = occ.select("topic", "cell", "bucket", F.row_number().over(group.orderBy("t", "bucket")).alias("rank"), F.count(F.lit(1)).over(group).alias("n"))
    ranked = ranked.where(F.col("n") > more_than).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return ranked.where("rank = floor(share * n) + 1").select("topic", "cell", "share", "bucket")


def propagation_matrix(occ: DataFrame, gap: float = 0.1, more_than: int = 25) -> DataFrame:
    """(p, q, mean_seconds): mean time between shares p < q of a group's occurrences, outliers left out."""
    steps = [round(gap * i, 6) for i in range(1, int(round(1 / gap)) + 1)]
    group = Window.partitionBy("topic", "cell")
    ranked = occ.select("topic", "cell", "t", F.row_number().over(group.orderBy("t")).alias("rank"), F.count(F.lit(1)).over(group).alias("n")).where(F.col("n") > more_than)
    at = ranked.withColumn("p", F.explode(F.array(*[F.lit(s) for s in steps]))).where("rank = greatest(floor(round(p * n, 6)), 1)")
    at = at.select("topic", "cell", "p", "t")
    later = at.select("topic", "cell", F.col("p").alias("q"), F.col("t").alias("t2"))
    both = at.join(later, ["topic", "cell"]).where("p < q").select("p", "q", (F.col("t2") - F.col("t")).alias("seconds"))
    return drop_outliers(both, ["p", "q"], "seconds").groupBy("p", "q").agg(F.avg("seconds").alias("mean_seconds"))


def life_fraction_at_share(occ: DataFrame, gap: float = 0.05, more_than: int = 10) -> DataFrame:
    """(p, place, weight): where in its life, in hundredths, a group reaches each share; weights of one p sum to one."""
    steps = [round(gap * i, 6) for i in range(1, int(round(1 / gap)) + 1)]
    group = Window.partitionBy("topic", "cell")
    first, last = F.min("t").over(group), F.max("t").over(group)
    ranked = occ.select("t", F.row_number().over(group.orderBy("t")).alias("rank"), F.count(F.lit(1)).over(group).alias("n"), first.alias("a"), last.alias("b")).where(F.col("n") > more_than).where("b > a")
    at = ranked.withColumn("p", F.explode(F.array(*[F.lit(s) for s in steps]))).where("rank = greatest(floor(round(p * n, 6)), 1)")
    counts = at.groupBy("p", F.floor((F.col("t") - F.col("a")) * 100 / (F.col("b") - F.col("a"))).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("p", "place", (F.col("n") / F.sum("n").over(Window.partitionBy("p"))).alias("weight"))


def locations_per_topic_ccdf(majority: DataFrame) -> DataFrame:
    """(x, n, cdf, ccdf) of the number of majority cells of a topic."""
    return cdf(majority.groupBy("topic").agg(F.count_distinct("cell").alias("cells")), "cells", 0)


def locations_by_age(majority: DataFrame) -> DataFrame:
    """(age, share, cum_share): cells reached by time since their topic's first majority bucket."""
    ages = majority.select("topic", (F.col("bucket") - F.min("bucket").over(by_topic())).alias("age"))
    counts = ages.groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("age", (F.col("n") / total).alias("share"), (F.sum("n").over(Window.orderBy("age")) / total).alias("cum_share"))


def cells_by_arrival(occ: DataFrame, batch: int = 20) -> DataFrame:
    """(topic, cell, first_t, n, place, batch): cells in the order in which a topic reached them."""
    cells = occ.groupBy("topic", "cell").agg(F.min("t").alias("first_t"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(by_topic().orderBy("first_t", "cell")) - 1
    return cells.select("topic", "cell", "first_t", "n", place.cast("bigint").alias("place"), F.floor(place / batch).alias("batch"))


def spread_frames(occ: DataFrame, step: int = 3600, steps: int = 24) -> DataFrame:
    """(topic, step, n_cells): cells that a topic has reached by the end of each observed step of its first ``steps``."""
    first = occ.groupBy("topic", "cell").agg(F.min("t").alias("t"))
    start = F.min("t").over(by_topic())
    at = first.select("topic", F.floor((F.col("t") - start) / step).alias("step")).where(F.col("step") < steps)
    counts = at.groupBy("topic", "step").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("topic", "step", F.sum("n").over(by_topic().orderBy("step")).alias("n_cells"))
