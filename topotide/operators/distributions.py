"""Counts and distributions of occurrences, topics and locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topotide.functions.columns import bin_up, haversine
from topotide.functions.statistics import correlation, pearson_p
from topotide.operators.timeline import drop_outliers



def occurrence_stats(occ: DataFrame, loc: str = "cell") -> DataFrame:
    """(n_occurrences, n_topics, n_cells)."""
    return occ.agg(F.count("*").alias("n_occurrences"), F.count_distinct("topic").alias("n_topics"), F.count_distinct(loc).alias("n_cells"))


def post_stats(posts: DataFrame) -> DataFrame:
    """(n_posts, n_with_topic, n_mentions, n_topics) of posts with an array column topics."""
    t = F.explode_outer("topics")
    base = posts.select(F.size(F.coalesce("topics", F.array())).alias("k"))
    counts = base.agg(F.count("*").alias("n_posts"), F.sum((F.col("k") > 0).cast("bigint")).alias("n_with_topic"), F.sum("k").cast("bigint").alias("n_mentions"))
    return counts.crossJoin(F.broadcast(posts.select(t.alias("t")).agg(F.count_distinct("t").alias("n_topics"))))


def histogram_of_groups(df: DataFrame, key: str, distinct: str | None = None) -> DataFrame:
    """(size, n): how many keys have so many rows, or so many distinct values of a column."""
    size = F.count_distinct(distinct) if distinct else F.count("*")
    return df.groupBy(key).agg(size.alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def topics_by_occurrence_bin(occ: DataFrame, width: int = 100) -> DataFrame:
    """(bin, n_topics); bin is the upper edge."""
    return occ.groupBy("topic").agg(F.count("*").alias("n")).groupBy(bin_up(F.col("n"), width).alias("bin")).agg(F.count("*").alias("n_topics"))


def occurrences_per_cell(occ: DataFrame, more_than: int = 0, loc: str = "cell") -> DataFrame:
    return occ.groupBy(loc).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def location_profile(occ: DataFrame, loc: str = "cell") -> DataFrame:
    """(cell, n, n_topics)."""
    return occ.groupBy(loc).agg(F.count("*").alias("n"), F.count_distinct("topic").alias("n_topics"))


def occurrences_by_hour_at(occ: DataFrame, cells: DataFrame, offset_hours: int = -5, loc: str = "cell") -> DataFrame:
    """(cell, hour, n, share) by local hour of day for the chosen cells."""
    hour = F.pmod(F.floor((F.col("t") + offset_hours * 3600) / 3600), F.lit(24)).cast("bigint")
    counts = occ.join(cells.select(loc).distinct(), loc, "left_semi").groupBy(loc, hour.alias("hour")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(loc)))


def cell_topic_counts(occ: DataFrame, min_total: int = 1250, loc: str = "cell") -> DataFrame:
    """(cell, topic, n, total) of cells with enough occurrences."""
    counts = occ.groupBy(loc, "topic").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(loc))).where(F.col("total") >= min_total)


def cell_pair_common(counts: DataFrame, least: int = 100, loc: str = "cell") -> DataFrame:
    """(cell, nbr, n_common): directed pairs that share enough topics."""
    other = counts.select("topic", F.col(loc).alias("nbr"))
    return counts.select(loc, "topic").join(other, "topic").where(F.col(loc) != F.col("nbr")).groupBy(loc, "nbr").agg(F.count("*").alias("n_common")).where(F.col("n_common") >= least)


def topic_cell_counts_rollup(occ: DataFrame, loc: str = "cell") -> DataFrame:
    """(topic, cell, n): counts by topic and cell, by topic (cell null), and of all (both null)."""
    return occ.rollup("topic", loc).agg(F.count("*").alias("n"))


def neighbour_summary(common: DataFrame, loc: str = "cell") -> DataFrame:
    """(cell, n_neighbours, mean_common)."""
    return common.groupBy(loc).agg(F.count("*").alias("n_neighbours"), F.avg("n_common").alias("mean_common"))


def cell_load_by_size(points: DataFrame, sizes: list[float], at_least: int) -> DataFrame:
    """(size, ci, cj, n): cells of several lattices with enough points."""
    s = points.withColumn("size", F.explode(F.array(*[F.lit(float(x)) for x in sizes])))
    cells = s.groupBy("size", (F.col("lat") / F.col("size")).cast("bigint").alias("ci"), (F.col("lon") / F.col("size")).cast("bigint").alias("cj"))
    return cells.agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def metric_by_bin(metrics: DataFrame, by: str, width: int = 25, least: int = 10) -> DataFrame:
    """(bin, n_topics, entropy, focus, spread): means by bins of ``by`` with more than ``least`` topics."""
    rows = metrics.groupBy(bin_up(F.col(by), width).alias("bin")).agg(F.count("*").alias("n_topics"), F.avg("entropy").alias("entropy"), F.avg("focus").alias("focus"), F.avg("spread").alias("spread"))
    return rows.where(F.col("n_topics") > least)


def entropy_by_focus(metrics: DataFrame, digits: int = 2) -> DataFrame:
    """(focus, n_topics, entropy, peak_iid): means by rounded focus."""
    return metrics.groupBy(F.round("focus", digits).alias("focus")).agg(F.count("*").alias("n_topics"), F.avg("entropy").alias("entropy"), F.avg("peak_iid").alias("peak_iid"))


def spread_classes(metrics: DataFrame) -> DataFrame:
    """(spread_class, n_topics, share, median_entropy, median_focus): spread up to 1600, up to 4000 and beyond are classes 800, 1600, 4000."""
    cls = F.when(F.col("spread") <= 1600, 800).when(F.col("spread") <= 4000, 1600).otherwise(4000)
    rows = metrics.groupBy(cls.alias("spread_class")).agg(F.count("*").alias("n_topics"), F.percentile("entropy", F.lit(0.5)).alias("median_entropy"), F.percentile("focus", F.lit(0.5)).alias("median_focus"))
    return rows.withColumn("share", F.col("n_topics") / F.sum("n_topics").over(Window.partitionBy()))


def peak_categories(metrics: DataFrame, early: int = 6, late: int = 120) -> DataFrame:
    """(peak_class, n_topics, share)."""
    cls = F.when(F.col("peak_iid") <= early, "early").when(F.col("peak_iid") <= late, "middle").otherwise("late")
    rows = metrics.groupBy(cls.alias("peak_class")).agg(F.count("*").alias("n_topics"))
    return rows.withColumn("share", F.col("n_topics") / F.sum("n_topics").over(Window.partitionBy()))


def locality_by_focus_location(metrics: DataFrame, top: int = 100) -> DataFrame:
    """(focus_cell, n_topics, entropy, spread) of the cells that most topics focus on."""
    rows = metrics.groupBy("focus_cell").agg(F.count("*").alias("n_topics"), F.avg("entropy").alias("entropy"), F.avg("spread").alias("spread"))
    return rows.orderBy(F.desc("n_topics"), "focus_cell").limit(top)


def example_topics_by_location(metrics: DataFrame, k: int = 5) -> DataFrame:
    """(focus_cell, topic, side, rank): the k most and least global topics of each focus cell."""
    glob = F.row_number().over(Window.partitionBy("focus_cell").orderBy("focus", F.desc("entropy"), "topic"))
    local = F.row_number().over(Window.partitionBy("focus_cell").orderBy(F.desc("focus"), "entropy", "topic"))
    ranked = metrics.select("focus_cell", "topic", glob.alias("g"), local.alias("l"))
    sides = F.explode(F.array(F.struct(F.lit("global").alias("side"), F.col("g").alias("rank")), F.struct(F.lit("local").alias("side"), F.col("l").alias("rank"))))
    return ranked.select("focus_cell", "topic", sides.alias("s")).select("focus_cell", "topic", "s.side", F.col("s.rank").cast("bigint").alias("rank")).where(F.col("rank") <= k)


def topics_by_entropy_class(metrics: DataFrame, examples: int = 25) -> DataFrame:
    """(entropy_class, n_topics, examples): the first examples by topic, joined by commas."""
    cls = F.round("entropy", 0)
    ranked = metrics.select(cls.alias("entropy_class"), "topic", F.row_number().over(Window.partitionBy(cls).orderBy("topic")).alias("r"))
    some = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("topic")))), ",")
    return ranked.groupBy("entropy_class").agg(F.count("*").alias("n_topics"), some.alias("examples"))


def top_locations(occ: DataFrame, k: int = 5, loc: str = "cell") -> DataFrame:
    return occ.groupBy(loc).agg(F.count("*").alias("n")).orderBy(F.desc("n"), loc).limit(k)


def global_and_local_topics(metrics: DataFrame, k: int = 20) -> DataFrame:
    """(topic, side): the most global and the most local topics by focus, then entropy."""
    cols = metrics.select("topic", F.round("focus", 9).alias("focus"), F.round("entropy", 9).alias("entropy"))
    glob = cols.orderBy("focus", F.desc("entropy"), "topic").limit(k).select("topic", F.lit("global").alias("side"))
    return glob.unionByName(cols.orderBy(F.desc("focus"), "entropy", F.desc("topic")).limit(k).select("topic", F.lit("local").alias("side")))


def affinity_by_distance(pairs: DataFrame, value: str, width: int = 100, more_than: int = 0) -> DataFrame:
    """(bin, n, mean) of a value of location pairs by distance bin."""
    rows = pairs.groupBy(bin_up(F.col("distance"), width).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.where(F.col("n") > more_than)


def locality_correlation(pairs: DataFrame, value: str, width: int = 100, more_than: int = 0) -> DataFrame:
    """(n_bins, r): Pearson r of distance bins with the bins' means; NaN without spread."""
    return affinity_by_distance(pairs, value, width, more_than).agg(F.count("*").alias("n_bins"), correlation("bin", "mean").alias("r"))


def with_distance(pairs: DataFrame, points: DataFrame, loc: str = "cell") -> DataFrame:
    """Add distance to pairs (l, r) of locations whose points are (loc, lat, lon)."""
    a = points.select(F.col(loc).alias("l"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    b = points.select(F.col(loc).alias("r"), F.col("lat").alias("lb"), F.col("lon").alias("lp"))
    d = haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    return pairs.join(a, "l").join(b, "r").withColumn("distance", d).drop("la", "lo", "lb", "lp")


def rare_and_distant_pairs(pairs: DataFrame, k: int = 50) -> DataFrame:
    return pairs.orderBy(F.desc("distance"), "n", "l", "r").limit(k)


def class_stats(topics: DataFrame, labels: DataFrame) -> DataFrame:
    """(class, n_topics): labelled topics by class; class 0 is unlabelled."""
    return topics.select("topic").distinct().join(labels.where("class <> 0"), "topic").groupBy("class").agg(F.count("*").alias("n_topics"))


def word_count(lines: DataFrame, column: str = "text") -> DataFrame:
    """(word, n) of white-space words."""
    return lines.select(F.explode(F.split(F.col(column), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def checkins_per_user(checkins: DataFrame, least: int = 100) -> DataFrame:
    """Check-ins of users with enough of them."""
    some = checkins.groupBy("user").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return checkins.join(some.select("user"), "user", "left_semi")


def checkins_by_network(checkins: DataFrame, least: int = 100) -> DataFrame:
    """(cell, network, n, total) of cells with enough check-ins over all networks."""
    counts = checkins.groupBy("cell", "network").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("cell"))).where(F.col("total") >= least)


def loyal_locations(checkins: DataFrame, min_user_visits: int = 3, min_total: int = 100) -> DataFrame:
    """(cell, user, n): visits of loyal users, at cells where these are enough."""
    visits = checkins.groupBy("cell", "user").agg(F.count("*").alias("n")).where(F.col("n") >= min_user_visits)
    return visits.withColumn("total", F.sum("n").over(Window.partitionBy("cell"))).where(F.col("total") >= min_total).drop("total")


def checkin_summary(loyal: DataFrame) -> DataFrame:
    return loyal.agg(F.count_distinct("user").alias("n_users"), F.sum("n").cast("bigint").alias("n_checkins"), F.count_distinct("cell").alias("n_cells"))


def topics_at_location(occ: DataFrame, loc: str = "cell") -> DataFrame:
    """(loc, topic, n, first_t, last_t): what a location saw of each topic."""
    return occ.groupBy(loc, "topic").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def occurrences_by_time_unit(occ: DataFrame, unit: int, loc: str = "cell") -> DataFrame:
    """(tu, topic, loc, n): occurrences by time unit."""
    return occ.groupBy((F.col("t") - F.pmod(F.col("t"), F.lit(unit))).alias("tu"), "topic", loc).agg(F.count("*").alias("n"))


def occurrences_by_country(cells: DataFrame) -> DataFrame:
    """(country, n, share) of rows (country, n) of cells; cells outside all countries are left out."""
    sums = cells.where("country is not null").groupBy("country").agg(F.sum("n").alias("n"))
    return sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def entropy_by_focus_by_peak(metrics: DataFrame, bounds: Sequence[int], digits: int = 2) -> DataFrame:
    """``entropy_by_focus`` of the topics whose peak is before each of ``bounds``, with the bound."""
    rows = metrics.select("*", F.explode(F.array(*[F.lit(int(b)) for b in bounds])).alias("before")).where("peak_iid < before")
    return rows.groupBy("before", F.round("focus", digits).alias("focus")).agg(F.count("*").alias("n_topics"), F.avg("entropy").alias("entropy"), F.avg("peak_iid").alias("peak_iid"))


def spread_classes_by_peak(metrics: DataFrame, early: int = 6, late: int = 120) -> DataFrame:
    """(peak_class, spread_class, n_topics, share): the mix of spread classes in each class of peaks."""
    peak = F.when(F.col("peak_iid") <= early, "early").when(F.col("peak_iid") <= late, "middle").otherwise("late")
    cls = F.when(F.col("spread") <= 1600, 800).when(F.col("spread") <= 4000, 1600).otherwise(4000)
    rows = metrics.groupBy(peak.alias("peak_class"), cls.alias("spread_class")).agg(F.count("*").alias("n_topics"))
    return rows.withColumn("share", F.col("n_topics") / F.sum("n_topics").over(Window.partitionBy("peak_class")))


def co_occurrence_by_distance(pairs: DataFrame, count: str = "n", width: int = 100) -> DataFrame:
    """(bin, n, share) of common topics of location pairs by distance bin."""
    rows = pairs.groupBy(bin_up(F.col("distance"), width).alias("bin")).agg(F.sum(count).alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def filtered_affinity_by_distance(pairs: DataFrame, value: str, width: int = 100, more_than: int = 0) -> DataFrame:
    """``affinity_by_distance`` without values far from the others of their bin.

    Values have nine digits, so that decimals sum them exactly and a mean that
    lies between two roundings doesn't hang on the order of the rows.
    """
    rows = pairs.select(bin_up(F.col("distance"), width).alias("bin"), F.round(value, 9).alias(value))
    known = F.sum(F.col(value).cast("decimal(28,9)")).cast("double")
    kept = drop_outliers(rows, ["bin"], value).groupBy("bin").agg(F.count("*").alias("n"), F.try_divide(known, F.count(value)).alias("mean"))
    return kept.where(F.col("n") > more_than)


def pair_correlation(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r): Pearson r over pairs, without bins; NaN without spread."""
    return pairs.agg(F.count("*").alias("n"), correlation(x, y).alias("r"))


def correlation_test(pairs: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, r, p): Pearson r of a key's pairs and its two-sided p-value by Student's t; null p below three pairs, null r without spread."""
    known = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = known.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("xy"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("spread"))
    found = sums.select(*keys, "n", F.when(F.col("spread") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / F.col("spread")))).alias("r"))
    return found.withColumn("p", F.when(F.col("r").isNotNull(), pearson_p(F.col("r"), F.col("n"))))


def ks_statistic(rows: DataFrame, value: str, side: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_a, n_b, d): the largest gap between the distributions of two samples, told apart by a boolean column.

    Running sums go over the distinct values of a key.
    """
    counts = rows.groupBy(*keys, value).agg(F.sum(F.when(F.col(side), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(side), 0).otherwise(1)).alias("b"))
    upto = Window.partitionBy(*keys).orderBy(value)
    both = Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(both) - F.sum("b").over(upto) / F.sum("b").over(both))
    return counts.withColumn("gap", gap).groupBy(*keys).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.max("gap").alias("d"))


def top_bottom(rows: DataFrame, group: str, name: str, score: str, k: int) -> DataFrame:
    """(group, name, score, side, rank): the k highest and the k lowest of each group; ties go by name."""
    high = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round(score, 9)), name))
    low = F.row_number().over(Window.partitionBy(group).orderBy(F.round(score, 9), name))
    ranked = rows.select(group, name, score, high.alias("h"), low.alias("l"))
    sides = F.explode(F.array(F.struct(F.lit("top").alias("side"), F.col("h").alias("rank")), F.struct(F.lit("bottom").alias("side"), F.col("l").alias("rank"))))
    return ranked.select(group, name, score, sides.alias("s")).select(group, name, score, "s.side", F.col("s.rank").cast("bigint").alias("rank")).where(F.col("rank") <= k)
