"""Registered queries over the benchmark tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.operators import association as assoc
from topotide.operators import clusters as cl
from topotide.operators import distributions as dist
from topotide.operators import graphs, grid
from topotide.operators import influence as infl
from topotide.operators import metrics as met
from topotide.operators import pairs as pr
from topotide.operators import linear, locality, selection
from topotide.operators import predict as pred
from topotide.operators import timeline as tl
from topotide.sources import adapter as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_EVENTS = "ev AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"
_POINT = "({0} * 37) % 140 - 59.75 AS lat, ({0} * 73) % 340 - 169.75 AS lon"
_CELLS = "CAST(trunc(lat / {0}) AS BIGINT) AS ci, CAST(trunc(lon / {0}) AS BIGINT) AS cj"
_OCC = (
    f"WITH {_EVENTS}, p AS (SELECT 't' || k AS topic, {_POINT.format('user_id')}, t FROM ev), "
    f"c AS (SELECT *, {_CELLS.format(14.5)} FROM p), "
    "occ AS (SELECT topic, lat, lon, t, ci, cj, ci * 10000000 + cj AS cell, t - t % 21600 AS bucket FROM c WHERE NOT (ci = 0 AND cj = 0)), "
    "iv AS (SELECT topic, CAST((bucket - min(bucket) OVER (PARTITION BY topic)) // 21600 AS BIGINT) AS iid, n FROM (SELECT topic, bucket, count(*) AS n FROM occ GROUP BY ALL)), "
    "pk AS (SELECT topic, first(iid ORDER BY n DESC, iid) AS peak_iid FROM iv GROUP BY topic)"
)
_HAV = "2 * 3958.761 * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_MET = (
    _OCC + ", tc AS (SELECT topic, cell, count(*) AS c FROM occ GROUP BY ALL), ef AS (SELECT topic, CAST(sum(c) AS BIGINT) AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy, "
    "first(cell ORDER BY c DESC, cell) AS focus_cell, max(c) / sum(c) AS focus FROM tc GROUP BY topic), "
    "ce AS (SELECT topic, avg(lat) AS a, avg(lon) AS b FROM occ GROUP BY topic), "
    f"sp AS (SELECT topic, sqrt(avg(pow({_HAV.format('lat', 'lon', 'a', 'b')}, 2))) AS spread FROM occ JOIN ce USING (topic) GROUP BY topic), "
    "met AS (SELECT topic, n, peak_iid, focus_cell, focus, entropy, spread FROM ef JOIN pk USING (topic) JOIN sp USING (topic))"
)
_PAIRS = f"WITH {_EVENTS}, occ AS (SELECT 't' || k AS topic, user_id % 25 AS loc, t, k, event_type, t - t % 21600 AS bucket FROM ev)"
_FEW = f"WITH {_EVENTS}, occ AS (SELECT 't' || (k % 20) AS topic, user_id % 25 AS loc, t, t - t % 3600 AS bucket FROM ev)"
_CHECK = f"WITH {_EVENTS}, p AS (SELECT CAST(user_id AS VARCHAR) AS \"user\", event_type AS network, {_POINT.format('event_id')}, t FROM ev), q AS (SELECT *, {_CELLS.format('29.0')} FROM p), ch AS (SELECT *, ci * 10000000 + cj AS cell FROM q WHERE NOT (ci = 0 AND cj = 0))"
_LOCT = ", lt AS (SELECT loc, topic, min(t) AS first_t, count(*) AS n FROM occ GROUP BY ALL), sz AS (SELECT loc, count(*) AS k FROM lt GROUP BY loc)"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _query(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "") -> None:
    """Register; doubles, in both results, are rounded to six digits."""
    QUERIES[name] = lambda spark, sf_dir: _rounded(make(spark, sf_dir))
    if sql:
        SQL[name] = _with_rounding(sql, doubles)


def _with_rounding(sql: str, doubles: str) -> str:
    if not doubles:
        return sql
    cols = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
    head, _, body = sql.rpartition("\nSELECT ")
    return f"{head}\nSELECT * REPLACE ({cols}) FROM (SELECT {body})"


def _occ(spark: SparkSession, d: str) -> DataFrame:
    return src.occ_events(spark, d)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return met.topic_metrics(_occ(spark, d), src.UNIT)


# metrics and life of topics
_query("topic_metrics", _metrics, _MET + "\nSELECT * FROM met", "focus entropy spread")
_query("occurrence_stats", lambda s, d: dist.occurrence_stats(_occ(s, d)), _OCC + "\nSELECT count(*) AS n_occurrences, count(DISTINCT topic) AS n_topics, count(DISTINCT cell) AS n_cells FROM occ")
_query(
    "post_stats",
    lambda s, d: dist.post_stats(src.posts(s, d)),
    "SELECT count(*) AS n_posts, CAST(count(source) AS BIGINT) AS n_with_topic, CAST(count(source) AS BIGINT) AS n_mentions, count(DISTINCT source) AS n_topics FROM documents",
)
_query("topics_by_occurrences", lambda s, d: dist.histogram_of_groups(_occ(s, d), "topic"), _OCC + "\nSELECT size, count(*) AS n FROM (SELECT topic, count(*) AS size FROM occ GROUP BY topic) GROUP BY size")
_query("topics_by_occurrence_bin", lambda s, d: dist.topics_by_occurrence_bin(_occ(s, d), 10), _OCC + "\nSELECT CAST(c // 10 * 10 + 10 AS BIGINT) AS bin, count(*) AS n_topics FROM (SELECT topic, count(*) AS c FROM occ GROUP BY topic) GROUP BY 1")
_query("topics_by_locations", lambda s, d: dist.histogram_of_groups(_occ(s, d), "topic", "cell"), _OCC + "\nSELECT size, count(*) AS n FROM (SELECT topic, count(DISTINCT cell) AS size FROM occ GROUP BY topic) GROUP BY size")
_query("locations_by_occurrences", lambda s, d: dist.histogram_of_groups(_occ(s, d), "cell"), _OCC + "\nSELECT size, count(*) AS n FROM (SELECT cell, count(*) AS size FROM occ GROUP BY cell) GROUP BY size")
_query("occurrences_per_cell", lambda s, d: dist.occurrences_per_cell(_occ(s, d), 20), _OCC + "\nSELECT cell, count(*) AS n FROM occ GROUP BY cell HAVING count(*) > 20")
_query(
    "dense_stats",
    lambda s, d: dist.occurrence_stats(tl.dense(_occ(s, d), 2)),
    _OCC + "\nSELECT count(*) AS n_occurrences, count(DISTINCT topic) AS n_topics, count(DISTINCT cell) AS n_cells FROM (SELECT *, count(*) OVER (PARTITION BY topic, cell) AS g FROM occ) WHERE g >= 2",
)
_query("location_profile", lambda s, d: dist.location_profile(tl.dense(_occ(s, d), 2)), _OCC + "\nSELECT cell, count(*) AS n, count(DISTINCT topic) AS n_topics FROM (SELECT *, count(*) OVER (PARTITION BY topic, cell) AS g FROM occ) WHERE g >= 2 GROUP BY cell")
_query(
    "occurrences_by_hour_at",
    lambda s, d: dist.occurrences_by_hour_at(_occ(s, d), dist.top_locations(_occ(s, d), 5)),
    _OCC + ", top AS (SELECT cell FROM occ GROUP BY cell ORDER BY count(*) DESC, cell LIMIT 5)\nSELECT cell, hour, n, n / sum(n) OVER (PARTITION BY cell) AS share FROM (SELECT cell, CAST(((t - 18000) // 3600) % 24 AS BIGINT) AS hour, count(*) AS n FROM occ WHERE cell IN (FROM top) GROUP BY ALL)",
    "share",
)
_query("topic_time_histogram", lambda s, d: _occ(s, d).groupBy("topic", "bucket").agg(F.count(F.lit(1)).alias("n")), _OCC + "\nSELECT topic, bucket, count(*) AS n FROM occ GROUP BY ALL")
_query("topic_cell_histogram", lambda s, d: _occ(s, d).groupBy("topic", "cell").agg(F.count(F.lit(1)).alias("n")), _OCC + "\nSELECT topic, cell, count(*) AS n FROM occ GROUP BY ALL")
_query(
    "cell_topic_counts",
    lambda s, d: dist.cell_topic_counts(_occ(s, d), 50),
    _OCC + "\nSELECT cell, topic, n, CAST(total AS BIGINT) AS total FROM (SELECT cell, topic, n, sum(n) OVER (PARTITION BY cell) AS total FROM (SELECT cell, topic, count(*) AS n FROM occ GROUP BY ALL)) WHERE total >= 50",
)
_PAIR_COMMON = _OCC + ", ct AS (SELECT cell, topic FROM (SELECT cell, topic, sum(count(*)) OVER (PARTITION BY cell) AS total FROM occ GROUP BY cell, topic) WHERE total >= 50), cm AS (SELECT a.cell, b.cell AS nbr, count(*) AS n_common FROM ct a JOIN ct b USING (topic) WHERE a.cell <> b.cell GROUP BY ALL HAVING count(*) >= 20)"
_query("cell_pair_common", lambda s, d: dist.cell_pair_common(dist.cell_topic_counts(_occ(s, d), 50), 20), _PAIR_COMMON + "\nSELECT * FROM cm")
_query("neighbour_summary", lambda s, d: dist.neighbour_summary(dist.cell_pair_common(dist.cell_topic_counts(_occ(s, d), 50), 20)), _PAIR_COMMON + "\nSELECT cell, count(*) AS n_neighbours, avg(n_common) AS mean_common FROM cm GROUP BY cell", "mean_common")
_query("topic_cell_counts_rollup", lambda s, d: dist.topic_cell_counts_rollup(_occ(s, d)), _OCC + "\nSELECT topic, cell, count(*) AS n FROM occ GROUP BY ROLLUP (topic, cell)")
_query(
    "cell_load_by_size",
    lambda s, d: dist.cell_load_by_size(_occ(s, d), [14.5, 29.0, 58.0], 40),
    _OCC + "\nSELECT size, CAST(trunc(lat / size) AS BIGINT) AS ci, CAST(trunc(lon / size) AS BIGINT) AS cj, count(*) AS n FROM occ, (SELECT unnest([14.5, 29.0, 58.0]::DOUBLE[]) AS size) GROUP BY ALL HAVING count(*) >= 40",
    "size",
)
_query("word_count", lambda s, d: dist.word_count(s.read.parquet(f"{d}/benchmark.parquet")), r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word")
_query("global_locality", lambda s, d: met.global_locality(_occ(s, d)), _OCC + ", g AS (SELECT cell, count(*) / sum(count(*)) OVER () AS p FROM occ GROUP BY cell)\nSELECT sum(-p * log2(p)) AS entropy, first(cell ORDER BY p DESC, cell) AS focus_cell, max(p) AS focus FROM g", "entropy focus")
_query(
    "metric_by_occurrence_bin",
    lambda s, d: dist.metric_by_bin(_metrics(s, d), "n", 25, 3),
    _MET + "\nSELECT CAST(n // 25 * 25 + 25 AS BIGINT) AS bin, count(*) AS n_topics, avg(entropy) AS entropy, avg(focus) AS focus, avg(spread) AS spread FROM met GROUP BY 1 HAVING count(*) > 3",
    "entropy focus spread",
)
_query("entropy_by_focus", lambda s, d: dist.entropy_by_focus(_metrics(s, d)), _MET + "\nSELECT round(focus, 2) AS focus, count(*) AS n_topics, avg(entropy) AS entropy, avg(peak_iid) AS peak_iid FROM met GROUP BY 1", "focus entropy peak_iid")
_query(
    "spread_classes",
    lambda s, d: dist.spread_classes(_metrics(s, d)),
    _MET + "\nSELECT CASE WHEN spread <= 1600 THEN 800 WHEN spread <= 4000 THEN 1600 ELSE 4000 END AS spread_class, count(*) AS n_topics, quantile_cont(entropy, 0.5) AS median_entropy, quantile_cont(focus, 0.5) AS median_focus, count(*) / sum(count(*)) OVER () AS share FROM met GROUP BY 1",
    "median_entropy median_focus share",
)
_query("peak_categories", lambda s, d: dist.peak_categories(_metrics(s, d), 6, 60), _MET + "\nSELECT CASE WHEN peak_iid <= 6 THEN 'early' WHEN peak_iid <= 60 THEN 'middle' ELSE 'late' END AS peak_class, count(*) AS n_topics, count(*) / sum(count(*)) OVER () AS share FROM met GROUP BY 1", "share")
_query("locality_by_focus_location", lambda s, d: dist.locality_by_focus_location(_metrics(s, d), 20), _MET + "\nSELECT focus_cell, count(*) AS n_topics, avg(entropy) AS entropy, avg(spread) AS spread FROM met GROUP BY focus_cell ORDER BY n_topics DESC, focus_cell LIMIT 20", "entropy spread")
_query("topics_by_entropy_class", lambda s, d: dist.topics_by_entropy_class(_metrics(s, d)), _MET + "\nSELECT round(entropy, 0) AS entropy_class, count(*) AS n_topics, string_agg(topic, ',' ORDER BY topic) FILTER (r <= 25) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY round(entropy, 0) ORDER BY topic) AS r FROM met) GROUP BY 1", "entropy_class")
_query("top_locations", lambda s, d: dist.top_locations(_occ(s, d), 5), _OCC + "\nSELECT cell, count(*) AS n FROM occ GROUP BY cell ORDER BY n DESC, cell LIMIT 5")
_query(
    "global_and_local_topics",
    lambda s, d: dist.global_and_local_topics(_metrics(s, d), 10),
    _MET + ", r AS (SELECT topic, round(focus, 9) AS f, round(entropy, 9) AS e FROM met)\nSELECT * FROM (SELECT topic, 'global' AS side FROM r ORDER BY f, e DESC, topic LIMIT 10) UNION ALL SELECT * FROM (SELECT topic, 'local' AS side FROM r ORDER BY f DESC, e, topic DESC LIMIT 10)",
)
_query("interval_counts", lambda s, d: tl.interval_counts(_occ(s, d), src.UNIT), _OCC + "\nSELECT * FROM iv")
_query("peak_interval", lambda s, d: tl.peak_interval(tl.interval_counts(_occ(s, d), src.UNIT)), _OCC + "\nSELECT * FROM pk")
_query(
    "interval_stats",
    lambda s, d: tl.interval_stats(tl.interval_counts(_occ(s, d), src.UNIT)),
    _OCC + ", sh AS (SELECT topic, iid, n / sum(n) OVER (PARTITION BY topic) AS a, sum(n) OVER (PARTITION BY topic ORDER BY iid) / sum(n) OVER (PARTITION BY topic) AS b FROM iv)\nSELECT iid, CAST(sum(CASE WHEN iid = peak_iid THEN 1 ELSE 0 END) AS BIGINT) AS n_peaks, avg(a) AS mean_share, avg(b) AS mean_cum_share FROM sh JOIN pk USING (topic) GROUP BY iid",
    "mean_share mean_cum_share",
)
_query(
    "interval_change",
    lambda s, d: tl.interval_change(tl.interval_counts(_occ(s, d), src.UNIT), 60),
    _OCC + ", ch AS (SELECT iid, (n - lag(n, 1, 0) OVER (PARTITION BY topic ORDER BY iid)) / sum(n) OVER (PARTITION BY topic) AS x FROM iv JOIN pk USING (topic) WHERE peak_iid < 60)\nSELECT iid, avg(x) AS mean_change FROM ch GROUP BY iid",
    "mean_change",
)
_query(
    "aligned_interval_stats",
    lambda s, d: met.aligned_interval_stats(_occ(s, d), src.UNIT),
    _MET + ", oi AS (SELECT *, (bucket - min(bucket) OVER (PARTITION BY topic)) // 21600 AS iid FROM occ), ic AS (SELECT topic, iid, cell, count(*) AS c FROM oi GROUP BY ALL), ie AS (SELECT topic, iid, sum(c) AS m, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e, max(c) / sum(c) AS f FROM ic GROUP BY ALL), ix AS (SELECT topic, iid, avg(lat) AS a, avg(lon) AS b FROM oi GROUP BY ALL), "
    f"iw AS (SELECT topic, iid, sqrt(avg(pow({_HAV.format('lat', 'lon', 'a', 'b')}, 2))) AS s FROM oi JOIN ix USING (topic, iid) GROUP BY ALL)"
    "\nSELECT CAST(iid - peak_iid AS BIGINT) AS norm_iid, avg(m / n) AS mean_share, avg(e) AS entropy, avg(f) AS focus, avg(s) AS spread, avg(met.entropy - e) AS d_entropy, avg(met.focus - f) AS d_focus, avg(met.spread - s) AS d_spread FROM ie JOIN iw USING (topic, iid) JOIN met USING (topic) GROUP BY 1",
    "mean_share entropy focus spread d_entropy d_focus d_spread",
)
_query(
    "rank_share",
    lambda s, d: tl.rank_share(_occ(s, d), 8),
    _OCC + ", r AS (SELECT topic, row_number() OVER w AS rank, n / sum(n) OVER (PARTITION BY topic) AS a, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY topic) AS b FROM (SELECT topic, cell, count(*) AS n FROM occ GROUP BY ALL) WINDOW w AS (PARTITION BY topic ORDER BY n DESC, cell)), m AS (SELECT count(DISTINCT topic) AS m FROM occ)\nSELECT rank, (sum(b) + max(m) - count(*)) / max(m) AS mean_cum_share, sum(a) / max(m) AS mean_share FROM r, m WHERE rank <= 8 GROUP BY rank",
    "mean_cum_share mean_share",
)
_query("location_rank_curve", lambda s, d: tl.location_rank_curve(_occ(s, d)), _OCC + "\nSELECT row_number() OVER (ORDER BY n DESC, cell) AS rank, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY n DESC, cell ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cum_share FROM (SELECT cell, count(*) AS n FROM occ GROUP BY cell)", "share cum_share")
_query("focus_cdf", lambda s, d: tl.cdf(_metrics(s, d), "focus"), _MET + "\nSELECT x, n, sum(n) OVER (ORDER BY x) / sum(n) OVER () AS cdf, sum(n) OVER (ORDER BY x DESC) / sum(n) OVER () AS ccdf FROM (SELECT round(focus, 2) AS x, count(*) AS n FROM met GROUP BY 1)", "x cdf ccdf")
_query("peak_distribution", lambda s, d: tl.peak_distribution(tl.interval_counts(_occ(s, d), src.UNIT), 100), _OCC + "\nSELECT peak_iid, n, sum(n) OVER (ORDER BY peak_iid) / sum(n) OVER () AS cdf FROM (SELECT peak_iid, count(*) AS n FROM pk WHERE peak_iid < 100 GROUP BY 1)", "cdf")
_REGION = ", busy AS (SELECT topic, bucket, count(*) AS n FROM occ GROUP BY ALL), mk AS (SELECT *, CASE WHEN (bucket - lag(bucket) OVER (PARTITION BY topic ORDER BY bucket)) / 21600 - 1 > 2 THEN 1 ELSE 0 END AS fresh FROM busy), rg AS (SELECT *, sum(fresh) OVER (PARTITION BY topic ORDER BY bucket) AS region FROM mk), ar AS (SELECT topic, CAST(region AS BIGINT) AS region, min(bucket) AS start_bucket, max(bucket) AS end_bucket, CAST(sum(n) AS BIGINT) AS total, region = 0 AS is_first FROM rg GROUP BY topic, region), reg AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY total DESC, start_bucket) = 1 AS is_highest FROM ar), ho AS (SELECT occ.*, is_first FROM occ JOIN reg USING (topic) WHERE is_highest AND bucket BETWEEN start_bucket AND end_bucket)"


def _regions(s: SparkSession, d: str) -> DataFrame:
    return tl.highest_active_region(_occ(s, d), src.UNIT, 2, 1)


_query("active_regions", lambda s, d: tl.active_regions(_occ(s, d), src.UNIT, 2, 1), _OCC + _REGION + "\nSELECT * FROM reg")
_query("highest_active_region", lambda s, d: _regions(s, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.max("is_first").alias("is_first")), _OCC + _REGION + "\nSELECT topic, count(*) AS n, bool_or(is_first) AS is_first FROM ho GROUP BY topic")
_EARLY = ", ea AS (SELECT topic, cell, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY t, cell) AS r FROM ho WHERE is_first) WHERE r <= 10 GROUP BY ALL), so AS (SELECT topic, first(cell ORDER BY n DESC, cell) AS cell, max(n) AS n FROM ea GROUP BY topic)"
_query("source_cell_early", lambda s, d: tl.source_cell_early(_regions(s, d), 10, 1), _OCC + _REGION + _EARLY + "\nSELECT * FROM so")
_query("topics_by_source_cell", lambda s, d: tl.topics_by_source_cell(_regions(s, d)), _OCC + _REGION + _EARLY + "\nSELECT cell, count(*) AS n_topics FROM so GROUP BY cell")
_query(
    "source_cell_percent",
    lambda s, d: tl.source_cell_percent(_occ(s, d), 0.1),
    _OCC + ", r AS (SELECT topic, cell, row_number() OVER (PARTITION BY topic ORDER BY t, cell) AS r, floor(count(*) OVER (PARTITION BY topic) * 0.1) AS m FROM occ), g AS (SELECT topic, m, cell, count(*) AS n FROM r WHERE r <= m GROUP BY ALL)\nSELECT topic, first(cell ORDER BY n DESC, cell) AS cell, max(n) / m >= 0.5 AS is_sure FROM g GROUP BY topic, m",
)
_query(
    "displacement_by_day",
    lambda s, d: tl.displacement_by_day(_occ(s, d)),
    _OCC + f", dd AS (SELECT *, t - t % 86400 AS day FROM occ), c2 AS (SELECT topic, day, avg(lat) AS a, avg(lon) AS b FROM dd GROUP BY ALL)\nSELECT topic, day, count(*) AS n, avg({_HAV.format('lat', 'lon', 'a', 'b')}) AS miles FROM dd JOIN c2 USING (topic, day) GROUP BY topic, day",
    "miles",
)
_query(
    "locality_index",
    lambda s, d: locality.locality_index(_occ(s, d), src.SIZE, (0.5, 0.75)).drop("ci", "cj"),
    _OCC + f", tc AS (SELECT topic, ci, cj, count(*) AS n FROM occ GROUP BY ALL), tt AS (SELECT topic, sum(n) AS total FROM tc GROUP BY topic), ds AS (SELECT a.topic, a.ci AS x, a.cj AS y, b.n, round({_HAV.format('a.ci * 14.5', 'a.cj * 14.5', 'b.ci * 14.5', 'b.cj * 14.5')}, 6) AS miles FROM tc a JOIN tc b USING (topic)), rn AS (SELECT topic, miles, sum(n) OVER (PARTITION BY topic, x, y ORDER BY miles) AS run FROM ds)\nSELECT topic, k, min(miles) AS radius FROM rn JOIN tt USING (topic), (SELECT unnest([0.5, 0.75]::DOUBLE[]) AS k) WHERE run / total >= k GROUP BY topic, k",
    "k radius",
)
_OUT = "quantile_cont({0}, 0.25) OVER (PARTITION BY {1}) AS q1, quantile_cont({0}, 0.75) OVER (PARTITION BY {1}) AS q3"
_query("life_span", lambda s, d: tl.life_span(_occ(s, d)), _OCC + f", q AS (SELECT topic, bucket, {_OUT.format('bucket', 'topic')} FROM occ)\nSELECT topic, (max(bucket) - min(bucket)) / 60 AS minutes FROM q WHERE bucket BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY topic", "minutes")
_query(
    "occurrences_by_life_fraction",
    lambda s, d: tl.occurrences_by_life_fraction(_occ(s, d)),
    _OCC + ", pl AS (SELECT topic, CASE WHEN b > a THEN floor((t - a) * 100 / (b - a)) / 100 ELSE 0 END AS fraction FROM (SELECT topic, t, min(t) OVER (PARTITION BY topic) AS a, max(t) OVER (PARTITION BY topic) AS b FROM occ)), s AS (SELECT topic, fraction, count(*) / sum(count(*)) OVER (PARTITION BY topic) AS x FROM pl GROUP BY topic, fraction)\nSELECT fraction, sum(x) / (SELECT count(DISTINCT topic) FROM occ) AS mean_share FROM s GROUP BY fraction",
    "fraction mean_share",
)
_query(
    "occurrences_by_age",
    lambda s, d: tl.occurrences_by_age(_occ(s, d)),
    _OCC + f", ag AS (SELECT topic, bucket - min(bucket) OVER (PARTITION BY topic) AS age FROM occ), q AS (SELECT age, {_OUT.format('age', 'topic')} FROM ag), c3 AS (SELECT age, count(*) AS n FROM q WHERE age BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY age)\nSELECT age, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY age) / sum(n) OVER () AS cum_share FROM c3",
    "share cum_share",
)
_MAJ = ", rk AS (SELECT topic, loc AS cell, bucket, row_number() OVER (PARTITION BY topic, loc ORDER BY t, bucket) AS r, count(*) OVER (PARTITION BY topic, loc) AS n FROM occ), mj AS (SELECT topic, cell, share, bucket FROM rk, (SELECT unnest([0.15, 0.5]::DOUBLE[]) AS share) WHERE n > 2 AND r = floor(share * n) + 1), m1 AS (FROM mj WHERE share = 0.15)"


def _majority(s: SparkSession, d: str, shares: tuple[float, ...] = (0.15,)) -> DataFrame:
    return tl.majority_time(src.occ_pairs(s, d).withColumnRenamed("loc", "cell"), shares, 2)


_query("majority_time", lambda s, d: _majority(s, d, (0.15, 0.5)), _PAIRS + _MAJ + "\nSELECT * FROM mj", "share")
_query("locations_per_topic_ccdf", lambda s, d: tl.locations_per_topic_ccdf(_majority(s, d)).withColumn("x", F.col("x").cast("bigint")), _PAIRS + _MAJ + "\nSELECT x, n, sum(n) OVER (ORDER BY x) / sum(n) OVER () AS cdf, sum(n) OVER (ORDER BY x DESC) / sum(n) OVER () AS ccdf FROM (SELECT x, count(*) AS n FROM (SELECT topic, count(DISTINCT cell) AS x FROM m1 GROUP BY topic) GROUP BY x)", "cdf ccdf")
_query("locations_by_age", lambda s, d: tl.locations_by_age(_majority(s, d)), _PAIRS + _MAJ + ", g AS (SELECT age, count(*) AS n FROM (SELECT bucket - min(bucket) OVER (PARTITION BY topic) AS age FROM m1) GROUP BY age)\nSELECT age, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY age) / sum(n) OVER () AS cum_share FROM g", "share cum_share")
_query(
    "lead_lag_status",
    lambda s, d: assoc.lead_lag_status(_majority(s, d), (5, 25)),
    _PAIRS + _MAJ + ", pp AS (SELECT a.cell AS l, b.cell AS r, count(*) AS n, avg(sign(a.bucket - b.bucket)) AS mean_status FROM m1 a JOIN m1 b USING (topic) WHERE a.cell < b.cell AND a.bucket <> b.bucket GROUP BY ALL)\nSELECT CAST(min_common AS INTEGER) AS min_common, l, r, n, mean_status FROM pp, (SELECT unnest([5, 25]) AS min_common) WHERE n >= min_common",
    "mean_status",
)
_query(
    "propagation_matrix",
    lambda s, d: tl.propagation_matrix(src.occ_pairs(s, d).withColumnRenamed("loc", "cell"), 0.25, 3),
    _PAIRS + f", rk AS (SELECT topic, loc, t, row_number() OVER (PARTITION BY topic, loc ORDER BY t) AS r, count(*) OVER (PARTITION BY topic, loc) AS n FROM occ), x AS (SELECT topic, loc, p, t FROM rk, (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS p) WHERE n > 3 AND r = greatest(floor(p * n), 1)), y AS (SELECT a.p, b.p AS q, b.t - a.t AS s FROM x a JOIN x b USING (topic, loc) WHERE a.p < b.p), z AS (SELECT *, {_OUT.format('s', 'p, q')} FROM y)\nSELECT p, q, avg(s) AS mean_seconds FROM z WHERE s BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY p, q",
    "p q mean_seconds",
)
_query("cells_by_arrival", lambda s, d: tl.cells_by_arrival(_occ(s, d)), _OCC + "\nSELECT topic, cell, first_t, n, place, CAST(place // 20 AS BIGINT) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY first_t, cell) - 1 AS place FROM (SELECT topic, cell, min(t) AS first_t, count(*) AS n FROM occ GROUP BY ALL))")
_query("spread_frames", lambda s, d: tl.spread_frames(_occ(s, d), 21600, 24), _OCC + ", f AS (SELECT topic, cell, min(t) AS t FROM occ GROUP BY ALL), g AS (SELECT topic, (t - min(t) OVER (PARTITION BY topic)) // 21600 AS step FROM f)\nSELECT topic, step, CAST(sum(n) OVER (PARTITION BY topic ORDER BY step) AS BIGINT) AS n_cells FROM (SELECT topic, CAST(step AS BIGINT) AS step, count(*) AS n FROM g WHERE step < 24 GROUP BY ALL)")

# filters
_START = 1704067200
for _name, _df, _sql in (
    ("topics_started_after", lambda o: tl.topics_started_after(o, 50, _START + 3600), f"n >= 50 AND a >= {_START + 3600}"),
    ("topics_inside_window", lambda o: tl.topics_inside_window(o, 50, _START + 3600, _START + 2589000), f"n >= 50 AND a >= {_START + 3600} AND b <= {_START + 2589000}"),
):
    _query(_name, lambda s, d, f=_df: f(_occ(s, d)).groupBy("topic").agg(F.count(F.lit(1)).alias("n")), _OCC + f"\nSELECT topic, n FROM (SELECT topic, count(*) AS n, min(t) AS a, max(t) AS b FROM occ GROUP BY topic) WHERE {_sql}")
_query("occurrences_in_window", lambda s, d: tl.occurrences_in_window(_occ(s, d), 20, _START, _START + 864000).groupBy("topic").agg(F.count(F.lit(1)).alias("n")), _OCC + f"\nSELECT topic, count(*) AS n FROM occ WHERE t BETWEEN {_START} AND {_START + 864000} GROUP BY topic HAVING count(*) >= 20")
_query("busy_buckets", lambda s, d: tl.busy_buckets(_occ(s, d), 3), _OCC + "\nSELECT topic, lat, lon, t, ci, cj, cell, bucket FROM (SELECT *, count(*) OVER (PARTITION BY topic, bucket) AS g FROM occ) WHERE g >= 3", "lat lon")
_query("topics_in_area", lambda s, d: tl.topics_started_after(grid.within_bbox(_occ(s, d), (-20.0, -100.0, 60.0, 50.0)), 10, _START).groupBy("topic").agg(F.count(F.lit(1)).alias("n")), _OCC + f"\nSELECT topic, count(*) AS n FROM occ WHERE lat BETWEEN -20 AND 60 AND lon BETWEEN -100 AND 50 GROUP BY topic HAVING count(*) >= 10 AND min(t) >= {_START}")
_query("min_topics_per_location_bucket", lambda s, d: tl.min_topics_per_location_bucket(_occ(s, d), 2).groupBy("cell", "bucket").agg(F.count_distinct("topic").alias("n_topics")), _OCC + "\nSELECT cell, bucket, count(DISTINCT topic) AS n_topics FROM occ GROUP BY ALL HAVING count(DISTINCT topic) >= 2")
_query(
    "label_area",
    lambda s, d: grid.label_area(_occ(s, d), [("north", (20.0, -180.0, 90.0, 180.0)), ("west", (-90.0, -180.0, 90.0, 0.0))]).groupBy("area").agg(F.count(F.lit(1)).alias("n")),
    _OCC + "\nSELECT CASE WHEN lat BETWEEN 20 AND 90 AND lon BETWEEN -180 AND 180 THEN 'north' WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 0 THEN 'west' END AS area, count(*) AS n FROM occ GROUP BY 1",
)

# focus cells and pairs
_FOCUS = _OCC + ", fo AS (SELECT topic, cell, min(iid) AS iid FROM (SELECT topic, iid, first(cell ORDER BY c DESC, cell) AS cell FROM (SELECT topic, CAST(iid AS BIGINT) AS iid, cell, count(*) AS c FROM (SELECT *, (bucket - min(bucket) OVER (PARTITION BY topic)) // 21600 AS iid FROM occ) GROUP BY ALL) GROUP BY ALL) JOIN pk USING (topic) WHERE abs(iid - peak_iid) <= 30 GROUP BY topic, cell)"


def _focus(s: SparkSession, d: str) -> DataFrame:
    return met.focus_locations(_occ(s, d), src.UNIT)


_query("focus_locations", _focus, _FOCUS + "\nSELECT * FROM fo")
_query("topics_of_focus_location", lambda s, d: met.topics_of_focus_location(_occ(s, d), src.UNIT), _FOCUS + "\nSELECT cell, count(*) AS n_topics, string_agg(topic, ',' ORDER BY topic) AS topics FROM fo GROUP BY cell")
_query(
    "focus_pairs",
    lambda s, d: pr.focus_pairs(_focus(s, d), 5),
    _FOCUS + ", k AS (SELECT cell, count(*) AS k FROM fo GROUP BY cell), p2 AS (SELECT a.cell AS l, b.cell AS r, count(*) AS n, avg(abs(a.iid - b.iid)) AS mean_lag FROM fo a JOIN fo b USING (topic) WHERE a.cell < b.cell GROUP BY ALL HAVING count(*) >= 5)\nSELECT l, r, n, mean_lag, n / (x.k + y.k - n) AS jaccard FROM p2 JOIN k x ON x.cell = l JOIN k y ON y.cell = r",
    "mean_lag jaccard",
)
_query(
    "location_similarity_lag",
    lambda s, d: pr.location_similarity_lag(src.occ_pairs(s, d), "loc", 10, src.UNIT),
    _PAIRS + f", f AS (SELECT loc, topic, min(bucket) AS b FROM occ GROUP BY ALL), q AS (SELECT *, {_OUT.format('b', 'topic')} FROM f), g AS (SELECT loc, topic, b FROM q WHERE b BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), k AS (SELECT loc, count(*) AS k FROM g GROUP BY loc), p2 AS (SELECT x.loc AS l, y.loc AS r, count(*) AS n_common, avg(abs(x.b - y.b) / 21600) AS adoption_lag FROM g x JOIN g y USING (topic) WHERE x.loc < y.loc GROUP BY ALL HAVING count(*) > 10)\nSELECT l, r, n_common, n_common / (u.k + v.k - n_common) AS similarity, adoption_lag FROM p2 JOIN k u ON u.loc = l JOIN k v ON v.loc = r",
    "similarity adoption_lag",
)


def _loc_topics(s: SparkSession, d: str) -> DataFrame:
    return pr.location_topics(src.occ_pairs(s, d), "loc")


_LINK = ", lk AS (SELECT a.loc, b.loc AS nbr, count(*) AS n_common FROM lt a JOIN lt b USING (topic) WHERE a.loc <> b.loc GROUP BY ALL)"
_query("lattice_graph", lambda s, d: pr.lattice_graph(_loc_topics(s, d), 5), _PAIRS + _LOCT + _LINK + "\nSELECT * FROM lk WHERE n_common >= 5")
_query("sharing_graph", lambda s, d: pr.sharing_graph(_loc_topics(s, d)), _PAIRS + _LOCT + _LINK + "\nSELECT loc, nbr, n_common / k AS p FROM lk JOIN sz USING (loc) WHERE n_common / k >= 0.1", "p")
_query("transmitting_probability", lambda s, d: pr.transmitting_probability(_loc_topics(s, d)), _PAIRS + _LOCT + ", tr AS (SELECT a.loc, b.loc AS nbr, count(*) AS c FROM lt a JOIN lt b USING (topic) WHERE a.loc <> b.loc AND a.first_t < b.first_t GROUP BY ALL)\nSELECT loc, nbr, c / k AS p FROM tr JOIN sz USING (loc)", "p")
_query("sharing_probability", lambda s, d: pr.sharing_probability(_loc_topics(s, d)), _PAIRS + _LOCT + "\nSELECT loc, k / (SELECT count(DISTINCT topic) FROM lt) AS p_observe FROM sz", "p_observe")


def _periods(s: SparkSession, d: str) -> DataFrame:
    return src.occ_pairs(s, d).groupBy("topic").agg((F.max("t") - F.min("t")).alias("period"))


_PERIOD = ", pe AS (SELECT topic, max(t) - min(t) AS period FROM occ GROUP BY topic)"
_SCORE = "CASE WHEN {0} = 0 THEN 1.0 WHEN {0} >= period THEN 0.0 ELSE 1 - ln({0}) / ln(period) END"
_query(
    "temporal_closeness_graph",
    lambda s, d: pr.temporal_closeness_graph(_loc_topics(s, d), _periods(s, d), 0.05, 3),
    _PAIRS + _LOCT + _PERIOD + f", sc AS (SELECT a.loc AS l, b.loc AS r, {_SCORE.format('abs(a.first_t - b.first_t)')} AS x FROM lt a JOIN lt b USING (topic) JOIN pe USING (topic) WHERE a.loc < b.loc)\nSELECT l, r, count(*) AS n_topics, avg(x) AS mean_score FROM sc WHERE x >= 0.05 GROUP BY l, r HAVING count(*) >= 3",
    "mean_score",
)
_query(
    "pair_distances",
    lambda s, d: pr.pair_distances(_loc_topics(s, d), src.location_points(s, d)),
    _PAIRS + _LOCT + f", pt AS (SELECT DISTINCT loc, {_POINT.format('loc')} FROM occ), p2 AS (SELECT a.loc AS l, b.loc AS r, count(*) AS n_common, avg(abs(a.first_t - b.first_t)) AS mean_gap FROM lt a JOIN lt b USING (topic) WHERE a.loc < b.loc GROUP BY ALL)\nSELECT l, r, n_common, n_common / (x.k + y.k - n_common) AS jaccard, mean_gap, {_HAV.format('u.lat', 'u.lon', 'v.lat', 'v.lon')} AS distance FROM p2 JOIN sz x ON x.loc = l JOIN sz y ON y.loc = r JOIN pt u ON u.loc = l JOIN pt v ON v.loc = r",
    "jaccard mean_gap distance",
)
_LOYAL = _CHECK + ', vi AS (SELECT cell, "user", count(*) AS n FROM ch GROUP BY ALL HAVING count(*) >= 1), lo AS (SELECT cell, "user", n FROM (SELECT *, sum(n) OVER (PARTITION BY cell) AS total FROM vi) WHERE total >= 20)'


def _loyal(s: SparkSession, d: str) -> DataFrame:
    return dist.loyal_locations(src.checkins(s, d), 1, 20)


_query("checkins_per_user", lambda s, d: dist.checkins_per_user(src.checkins(s, d), 8).groupBy("user").agg(F.count(F.lit(1)).alias("n")), _CHECK + '\nSELECT "user", count(*) AS n FROM ch GROUP BY "user" HAVING count(*) >= 8')
_query("checkins_by_network", lambda s, d: dist.checkins_by_network(src.checkins(s, d), 20), _CHECK + "\nSELECT cell, network, n, CAST(total AS BIGINT) AS total FROM (SELECT cell, network, n, sum(n) OVER (PARTITION BY cell) AS total FROM (SELECT cell, network, count(*) AS n FROM ch GROUP BY ALL)) WHERE total >= 20")
_query("loyal_locations", _loyal, _LOYAL + "\nSELECT * FROM lo")
_query("checkin_summary", lambda s, d: dist.checkin_summary(_loyal(s, d)), _LOYAL + '\nSELECT count(DISTINCT "user") AS n_users, CAST(sum(n) AS BIGINT) AS n_checkins, count(DISTINCT cell) AS n_cells FROM lo')
_query("checkin_graph", lambda s, d: pr.checkin_graph(_loyal(s, d)), _LOYAL + ', k AS (SELECT cell, count(*) AS k FROM lo GROUP BY cell), p2 AS (SELECT a.cell AS u, b.cell AS v, count(*) AS n_common FROM lo a JOIN lo b USING ("user") WHERE a.cell < b.cell GROUP BY ALL)\nSELECT u, v, n_common, n_common / greatest(x.k, y.k) AS w FROM p2 JOIN k x ON x.cell = u JOIN k y ON y.cell = v', "w")
_EPOCH = _FEW + ", r AS (SELECT t - t % 86400 AS ep, topic, loc, count(*) AS n FROM occ GROUP BY ALL HAVING count(*) >= 2), eg AS (SELECT a.ep, a.loc AS u, b.loc AS v, CAST(sum(least(a.n, b.n)) AS BIGINT) AS w FROM r a JOIN r b USING (ep, topic) WHERE a.loc < b.loc GROUP BY ALL)"


def _epochs(s: SparkSession, d: str) -> DataFrame:
    return pr.epoch_graph(src.occ_few_topics(s, d), 86400, 2, "loc")


_DAY0 = _START // 86400
_query("epoch_graph", _epochs, _EPOCH + "\nSELECT * FROM eg")
_query("combine_graphs", lambda s, d: pr.combine_graphs(_epochs(s, d), _START, _START + 10 * 86400), _EPOCH + f"\nSELECT u, v, CAST(sum(w) AS BIGINT) AS w FROM eg WHERE ep >= {_START} AND ep < {_START + 864000} GROUP BY u, v")
_query("trim_edges", lambda s, d: pr.trim_edges(_edges(s, d), 0.25), _EPOCH + ", g AS (SELECT u, v, CAST(sum(w) AS BIGINT) AS w FROM eg GROUP BY u, v), gr AS (SELECT u, v, w, row_number() OVER (ORDER BY w DESC, u, v) AS rank, count(*) OVER () AS m FROM g)\nSELECT u, v, w FROM gr WHERE rank <= ceil(m * 0.25)")
_query("dyadic_range", lambda s, d: pr.dyadic_range(pr.dyadic_rollup(_epochs(s, d), 86400), _DAY0 + 1, _DAY0 + 20), _EPOCH + f"\nSELECT u, v, CAST(sum(w) AS BIGINT) AS w FROM eg WHERE ep >= {(_DAY0 + 1) * 86400} AND ep < {(_DAY0 + 20) * 86400} GROUP BY u, v")
_query(
    "components",
    lambda s, d: graphs.components(_edges(s, d)),
    "WITH RECURSIVE" + _EPOCH[4:] + ", ed AS (SELECT DISTINCT u, v FROM eg), bo AS (SELECT u AS a, v AS b FROM ed UNION SELECT v, u FROM ed), re AS (SELECT DISTINCT a AS node, a AS seen FROM bo UNION SELECT re.node, bo.b FROM re JOIN bo ON re.seen = bo.a)\nSELECT node, min(seen) AS component FROM re GROUP BY node",
)
_query(
    "cluster_agreement",
    lambda s, d: pr.cluster_agreement(*[s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("node"), (F.col("user_id") % m).alias("cluster")).distinct() for m in (4, 6)]),
    "WITH u AS (SELECT DISTINCT user_id, user_id % 4 AS x, user_id % 6 AS y FROM events), c AS (SELECT x, y, count(*) AS n FROM u GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY x)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY y)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS al)\nSELECT (ij - a * b / al) / ((a + b) / 2 - a * b / al) AS adjusted_rand FROM s",
    "adjusted_rand",
)
_query(
    "location_clusters",
    lambda s, d: pr.location_clusters(src.occ_pairs(s, d), "loc", 0.03, 10, 0.1),
    _PAIRS + ", c AS (SELECT loc, topic, count(*) AS n FROM occ GROUP BY ALL), h AS (SELECT loc, topic FROM (SELECT *, n / sum(n) OVER (PARTITION BY topic) AS s FROM c) WHERE s >= 0.03), k AS (SELECT loc, count(*) AS k FROM h GROUP BY loc HAVING count(*) >= 10), g AS (FROM h WHERE loc IN (SELECT loc FROM k)), p2 AS (SELECT a.loc AS l, b.loc AS r, count(*) AS n_common FROM g a JOIN g b USING (topic) WHERE a.loc < b.loc GROUP BY ALL)\nSELECT l, r, n_common, n_common / (x.k + y.k - n_common) AS jaccard FROM p2 JOIN k x ON x.loc = l JOIN k y ON y.loc = r WHERE n_common / (x.k + y.k - n_common) >= 0.1",
    "jaccard",
)

# influence
_BA = _PAIRS + ", sc AS (SELECT a.topic, a.loc, b.loc AS nbr, sum(sign(b.t - a.t)) / (any_value(x.n) * any_value(y.n)) AS aggregate, any_value(sign(y.f - x.f)) AS first_occurrence, any_value(sign(y.m - x.m)) AS mean_occurrence, (any_value(x.n) * sum(CASE WHEN a.t < b.t THEN 1 ELSE 0 END) - any_value(y.n) * sum(CASE WHEN a.t > b.t THEN 1 ELSE 0 END)) / (any_value(x.n) + any_value(y.n)) / (any_value(x.n) * any_value(y.n)) AS weighted_aggregate FROM occ a JOIN occ b ON a.topic = b.topic AND a.loc <> b.loc JOIN own x ON x.topic = a.topic AND x.loc = a.loc JOIN own y ON y.topic = b.topic AND y.loc = b.loc GROUP BY a.topic, a.loc, b.loc), k AS (SELECT loc, count(*) AS k, sum(n) AS total FROM own GROUP BY loc)"
_BA = _BA.replace(", sc AS", ", own AS (SELECT topic, loc, count(*) AS n, min(t) AS f, avg(t) AS m FROM occ GROUP BY ALL), sc AS", 1)
for _m in ("first_occurrence", "mean_occurrence", "aggregate", "weighted_aggregate"):
    _query(f"pure_influence_{_m}", lambda s, d, m=_m: infl.pure_influence(src.occ_pairs(s, d), m), _BA + f"\nSELECT loc, nbr, count(*) AS n_common, avg({_m}) AS score FROM sc GROUP BY ALL", "score")
_query("pure_influence_extra", lambda s, d: infl.pure_influence(src.occ_pairs(s, d), "aggregate", True), _BA + ", g AS (SELECT loc, nbr, count(*) AS n_common, sum(aggregate) AS s FROM sc GROUP BY ALL)\nSELECT g.loc, g.nbr, n_common, (s + a.k - b.k) / (a.k + b.k - n_common) AS score FROM g JOIN k a ON a.loc = g.loc JOIN k b ON b.loc = g.nbr", "score")
_INF = _BA + ", inf AS (SELECT sc.loc, nbr, count(*) AS n_common, avg(aggregate * n / total) * count(*) / any_value(k) AS score FROM sc JOIN own USING (topic, loc) JOIN k ON k.loc = sc.loc GROUP BY sc.loc, nbr)"


def _influence(s: SparkSession, d: str) -> DataFrame:
    return infl.influence(src.occ_pairs(s, d))


_query("influence", _influence, _INF + "\nSELECT * FROM inf", "score")
_query("boundary_influence", lambda s, d: infl.boundary_influence(_influence(s, d), 25), _INF + ", b AS (SELECT loc, sum(CASE WHEN score < 0 THEN -score ELSE 0 END) AS i, sum(CASE WHEN score > 0 THEN score ELSE 0 END) AS o FROM inf GROUP BY loc)\nSELECT loc, CASE WHEN i > o THEN -i ELSE o END / 25 AS score FROM b", "score")
_query("influence_similarity", lambda s, d: infl.influence_similarity(infl.influence_vectors(_influence(s, d))), _INF + ", v AS (SELECT loc, nbr, CASE WHEN z > 0 THEN score / z ELSE 0 END AS x FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY loc)) AS z FROM inf))\nSELECT a.loc AS l, b.loc AS r, sum(a.x * b.x) AS similarity FROM v a JOIN v b USING (nbr) WHERE a.loc < b.loc GROUP BY ALL", "similarity")
_query("topic_influence", lambda s, d: infl.topic_influence(src.occ_pairs(s, d)), _BA + "\nSELECT topic, loc, avg(aggregate) AS score FROM sc GROUP BY ALL", "score")
_query("top_influencers", lambda s, d: infl.top_influencers(_influence(s, d), 25, 10), _INF + "\nSELECT nbr, sum(-score) / 25 AS score FROM inf WHERE score < 0 GROUP BY nbr ORDER BY round(sum(-score) / 25, 9) DESC, nbr LIMIT 10", "score")
_query(
    "rank_accuracy",
    lambda s, d: infl.rank_accuracy(src.location_points(s, d).select("loc", F.col("loc").alias("rank")), src.occ_pairs(s, d)),
    _PAIRS + ", f AS (SELECT topic, loc, min(t) AS t FROM occ GROUP BY ALL), r AS (SELECT topic, loc, row_number() OVER (PARTITION BY topic ORDER BY t, loc) AS pos, count(*) OVER (PARTITION BY topic) AS n FROM f), w AS (SELECT a.topic, a.loc, any_value(a.n) AS n, sum(CASE WHEN (a.pos - b.pos) * (a.loc - b.loc) < 0 THEN 1 ELSE 0 END) AS bad FROM r a JOIN r b USING (topic) WHERE a.n > 1 GROUP BY ALL)\nSELECT topic, avg(1 - bad / (n - 1)) AS accuracy FROM w GROUP BY topic",
    "accuracy",
)

# prediction
_HP = _FEW + ", b AS (SELECT bucket, loc, topic, count(*) AS n FROM occ GROUP BY ALL), hi AS (SELECT tu, loc, topic, sum(n) AS n FROM (SELECT *, unnest(range(bucket + 3600, bucket + 21601, 3600)) AS tu FROM b) GROUP BY ALL), fu AS (SELECT tu, loc, topic, sum(n) AS n FROM (SELECT *, unnest(range(bucket - 3600, bucket + 1, 3600)) AS tu FROM b) GROUP BY ALL), ideal AS (SELECT tu, loc, topic, n / sum(n) OVER (PARTITION BY tu, loc) AS share FROM fu)"
_GREEDY = ", sco AS (SELECT tu, loc, topic, 'greedy' AS model, n / sum(n) OVER (PARTITION BY tu, loc) AS score FROM hi)"
_COVER = f", pt AS (SELECT DISTINCT loc, {_POINT.format('loc')} FROM occ), ke AS (SELECT a.loc, b.loc AS nbr, pow(1.01, -({_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')})) AS w FROM pt a, pt b), raw AS (SELECT tu, ke.loc, topic, sum(n * w) AS s FROM hi JOIN ke ON ke.nbr = hi.loc GROUP BY ALL)"
_EVAL = ", be AS (SELECT *, row_number() OVER (PARTITION BY tu, loc ORDER BY round(share, 9) DESC, topic) AS br FROM ideal), mi AS (SELECT *, row_number() OVER (PARTITION BY tu, loc, model ORDER BY round(score, 9) DESC, topic) AS rank FROM sco), ks AS (SELECT unnest([1, 5]) AS k), wh AS (SELECT tu, loc, k, count(*) AS m, sum(share) AS bs FROM be, ks WHERE br <= k GROUP BY ALL), he AS (SELECT tu, loc, model, k, sum(CASE WHEN br <= k THEN 1 ELSE 0 END) AS hits, sum(share) AS got FROM mi JOIN be USING (tu, loc, topic), ks WHERE rank <= k GROUP BY ALL), ev2 AS (SELECT wh.tu, wh.loc, x.model, wh.k, coalesce(hits, 0) / m AS accuracy, coalesce(got, 0) / bs AS impact, CASE WHEN pr.model IS NULL THEN 1.0 ELSE bs - coalesce(got, 0) END AS difference FROM wh CROSS JOIN (SELECT DISTINCT model FROM sco) x LEFT JOIN (SELECT DISTINCT tu, loc, model FROM sco) pr ON pr.tu = wh.tu AND pr.loc = wh.loc AND pr.model = x.model LEFT JOIN he ON he.tu = wh.tu AND he.loc = wh.loc AND he.model = x.model AND he.k = wh.k)"


def _windows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return pred.window_counts(src.occ_few_topics(s, d), 6, 2)


def _two_models(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h, f = _windows(s, d)
    return pred.predict_greedy(h).unionByName(pred.predict_coverage(h, src.location_points(s, d))), f


_BOTH = _GREEDY.replace("sco AS", "sg AS") + _COVER + ", sco AS (FROM sg UNION ALL SELECT tu, loc, topic, 'coverage_probability' AS model, CASE WHEN sum(s) OVER (PARTITION BY tu, topic) > 0 THEN s / sum(s) OVER (PARTITION BY tu, topic) ELSE 1.0 END AS score FROM raw)"
_query("ideal_ranking", lambda s, d: pred.top_k(pred.ideal_ranking(_windows(s, d)[1]), 5, ("tu", "loc")).withColumn("rank", F.col("rank").cast("bigint")), _HP + "\nSELECT tu, loc, topic, share AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY tu, loc ORDER BY round(share, 9) DESC, topic) AS rank FROM ideal) WHERE rank <= 5", "score")
_query("predict_greedy", lambda s, d: pred.predict_greedy(_windows(s, d)[0]), _HP + _GREEDY + "\nSELECT * FROM sco", "score")
_query("predict_coverage_probability", lambda s, d: pred.predict_coverage(_windows(s, d)[0], src.location_points(s, d)), _HP + _COVER + "\nSELECT tu, loc, topic, 'coverage_probability' AS model, s / sum(s) OVER (PARTITION BY tu, topic) AS score FROM raw", "score")
_query("predict_coverage_distance", lambda s, d: pred.predict_coverage(_windows(s, d)[0], src.location_points(s, d), "distance"), _HP + _COVER + "\nSELECT tu, loc, topic, 'coverage_distance' AS model, s / sum(s) OVER (PARTITION BY tu, loc) AS score FROM raw", "score")
for _n, _kind in (("sharing", pr.sharing_graph), ("transmitting", pr.transmitting_probability)):
    _cond = "" if _n == "sharing" else " AND a.first_t < b.first_t"
    _least = " WHERE c / k >= 0.1" if _n == "sharing" else ""
    _query(
        f"predict_{_n}",
        lambda s, d, n=_n, f=_kind: pred.predict_by_links(_windows(s, d)[0], f(pr.location_topics(src.occ_few_topics(s, d), "loc")), n),
        _HP + _LOCT + f", tr AS (SELECT a.loc, b.loc AS nbr, count(*) AS c FROM lt a JOIN lt b USING (topic) WHERE a.loc <> b.loc{_cond} GROUP BY ALL), pp AS (SELECT loc, nbr, c / k AS p FROM tr JOIN sz USING (loc){_least} UNION ALL SELECT DISTINCT loc, loc, 1.0 FROM hi)\nSELECT tu, pp.loc, topic, sum(p) AS score, '{_n}' AS model FROM hi JOIN pp ON pp.nbr = hi.loc GROUP BY tu, pp.loc, topic",
        "score",
    )
_query("predict_random", lambda s, d: pred.predict_random(_windows(s, d)[0]))
_ORDER = ("greedy", "coverage_probability")
_query("evaluate", lambda s, d: pred.evaluate(*_two_models(s, d), (1, 5), _ORDER), _HP + _BOTH + _EVAL + "\nSELECT * FROM ev2", "accuracy impact difference")
_query("model_performance", lambda s, d: pred.model_performance(pred.evaluate(*_two_models(s, d), (1, 5), _ORDER)), _HP + _BOTH + _EVAL + "\nSELECT model, k, count(*) AS n, avg(accuracy) AS accuracy, avg(impact) AS impact, avg(difference) AS difference FROM ev2 GROUP BY model, k", "accuracy impact difference")
_LOSS = _EVAL + ", ls AS (SELECT g.loc, g.tu, g.model, g.o, coalesce(e.accuracy, 0) AS value FROM (SELECT DISTINCT loc, tu, m.model, m.o FROM ev2, (VALUES ('greedy', 1), ('coverage_probability', 2)) m(model, o)) g LEFT JOIN ev2 e ON e.loc = g.loc AND e.tu = g.tu AND e.model = g.model AND e.k = 5), pa AS (SELECT *, coalesce(sum(1 - value) OVER (PARTITION BY loc, model ORDER BY tu ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM ls)"


def _performance(s: SparkSession, d: str) -> DataFrame:
    return pred.evaluate(*_two_models(s, d), (1, 5), _ORDER).where("k = 5")


_FTL = ", fl AS (SELECT loc, tu, first(model ORDER BY round(past, 9), o) AS model, first(value ORDER BY round(past, 9), o) AS value FROM pa GROUP BY loc, tu)"
_query("follow_the_leader", lambda s, d: pred.follow_the_leader(_performance(s, d), _ORDER), _HP + _BOTH + _LOSS + _FTL + "\nSELECT * FROM fl", "value")
_query("hedging_expected", lambda s, d: pred.hedging_expected(_performance(s, d), _ORDER), _HP + _BOTH + _LOSS + "\nSELECT loc, tu, sum(pow(0.5, past - lo) * value) / sum(pow(0.5, past - lo)) AS value FROM (SELECT *, min(past) OVER (PARTITION BY loc, tu) AS lo FROM pa) GROUP BY loc, tu", "value")
_query("flipping_ratio", lambda s, d: pred.flipping_ratio(pred.follow_the_leader(_performance(s, d), _ORDER)), _HP + _BOTH + _LOSS + _FTL + ", x AS (SELECT loc, model = lag(model) OVER (PARTITION BY loc ORDER BY tu) AS same FROM fl)\nSELECT loc, count(*) AS n, 1 - sum(CASE WHEN same THEN 1 ELSE 0 END) / count(*) AS ratio FROM x GROUP BY loc", "ratio")
_query("winning_topics", lambda s, d: pred.winning_topics(_windows(s, d)[0]), _HP + "\nSELECT loc, first(topic ORDER BY n DESC, topic) AS topic, CAST(max(n) AS BIGINT) AS n FROM (SELECT loc, topic, sum(n) AS n FROM hi GROUP BY ALL) GROUP BY loc")

# words and topics
_WORDS = r"WITH w AS (SELECT lower(source) AS topic, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) AS word FROM documents WHERE source IS NOT NULL), c AS (SELECT topic, word, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 10), fr AS (SELECT topic, word, n FROM (SELECT *, count(*) OVER (PARTITION BY topic) AS k FROM c) WHERE k < 5000), ct AS (SELECT word, topic, n AS n00, CAST(wt - n AS BIGINT) AS n01, CAST(tt - n AS BIGINT) AS n10, CAST(al - wt - tt + n AS BIGINT) AS n11 FROM (SELECT word, topic, n, sum(n) OVER (PARTITION BY word) AS wt, count(*) OVER (PARTITION BY word) AS k, sum(n) OVER (PARTITION BY topic) AS tt, sum(n) OVER () AS al FROM fr) WHERE k <= 10)"


def _table(s: SparkSession, d: str) -> DataFrame:
    return assoc.contingency(assoc.frequent_words(assoc.topic_words(src.posts(s, d)), 10, 5000), 10)


_query("word_topic_contingency", _table, _WORDS + "\nSELECT * FROM ct")
_query("chi_square", lambda s, d: assoc.chi_square(_table(s, d)), _WORDS + ", x AS (SELECT *, (n00 + n01 + n10 + n11)::DOUBLE AS nn, greatest(abs(n00::DOUBLE * n11 - n01::DOUBLE * n10) - (n00 + n01 + n10 + n11) / 2, 0) AS o, (n00 + n01)::DOUBLE * (n10 + n11) * (n00 + n10) * (n01 + n11) AS mg FROM ct), y AS (SELECT word, topic, n00, n01, n10, n11, CASE WHEN mg > 0 THEN nn * o * o / mg ELSE 0 END AS chi2 FROM x)\nSELECT *, chi2 > 6.6349 AS is_significant FROM y", "chi2")
_query("fisher_exact", lambda s, d: assoc.fisher_exact(_table(s, d)))
_query("topic_groups", lambda s, d: assoc.topic_groups(assoc.chi_square(_table(s, d)).where("is_significant")))
_query("volume_similarity_lag", lambda s, d: pr.location_similarity_lag(src.occ_lineitem(s, d), "loc", 10, 86400))


# clusters, patterns, selection and learning
def _edges(s: SparkSession, d: str) -> DataFrame:
    return _epochs(s, d).groupBy("u", "v").agg(F.sum("w").alias("w"))


_query("markov_clusters", lambda s, d: cl.markov_clusters(_edges(s, d)))
_query("affinity_clusters", lambda s, d: cl.affinity_clusters(_edges(s, d)))
_query("influence_zones", lambda s, d: cl.influence_zones(infl.boundary_influence(_influence(s, d), 25), 0.00002))
_TESTED = _PAIRS + _MAJ + ", pp AS (SELECT a.cell AS l, b.cell AS r, count(*) AS n, avg(sign(a.bucket - b.bucket)) AS mean_status FROM m1 a JOIN m1 b USING (topic) WHERE a.cell < b.cell AND a.bucket <> b.bucket GROUP BY ALL HAVING count(*) >= 5), bt AS (SELECT l, r, n, mean_status, CAST(ceil(round(n * (1 + abs(mean_status)) / 2, 6)) AS BIGINT) AS k FROM pp), tp AS (SELECT l, r, n, mean_status, least(1.0, 2 * list_sum(list_transform(range(k, n + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) - n * ln(2.0))))) AS p FROM bt)"


def _tested(s: SparkSession, d: str) -> DataFrame:
    return cl.binomial_p(assoc.lead_lag_status(_majority(s, d), (5,)))


_query("lead_lag_p", lambda s, d: _tested(s, d).drop("min_common"), _TESTED + "\nSELECT * FROM tp", "mean_status p")
_query("non_random_share", lambda s, d: cl.non_random_share(_tested(s, d)), _TESTED + "\nSELECT 5 AS min_common, count(*) AS n, avg(CASE WHEN p <= 0.05 THEN 1.0 ELSE 0.0 END) AS share FROM tp HAVING count(*) > 0", "share")
_query("lead_lag_kde", lambda s, d: assoc.kde(assoc.lead_lag_status(_majority(s, d), (5,)), "mean_status"))
_STEP = _PAIRS + ", st AS (SELECT topic, loc, (t - min(t) OVER (PARTITION BY topic)) // 21600 AS step FROM occ), se AS (SELECT topic, loc, count(*) AS n FROM st WHERE step < 40 GROUP BY ALL), gr AS (SELECT topic, loc, row_number() OVER (PARTITION BY topic ORDER BY n DESC, loc) AS rank FROM se)"


def _steps(s: SparkSession, d: str) -> DataFrame:
    return selection.replay_units(src.occ_pairs(s, d), 21600)


def _seen(s: SparkSession, d: str) -> DataFrame:
    return selection.seen(_steps(s, d), 40)


_query("select_greedy", lambda s, d: selection.select_greedy(_seen(s, d), 5), _STEP + "\nSELECT * FROM gr WHERE rank <= 5")
_query("select_random", lambda s, d: selection.select_random(_seen(s, d), 5))
_query(
    "select_coverage",
    lambda s, d: selection.select_coverage(_seen(s, d), src.location_points(s, d), 5),
    _STEP + f", pt AS (SELECT DISTINCT loc, {_POINT.format('loc')} FROM occ), ke AS (SELECT a.loc, b.loc AS nbr, pow(1.01, -({_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')})) AS w FROM pt a, pt b), rw AS (SELECT topic, ke.loc, sum(n * w) AS s FROM se JOIN ke ON ke.nbr = se.loc GROUP BY ALL), sh AS (SELECT topic, loc, s / sum(s) OVER (PARTITION BY topic) AS x FROM rw)\nSELECT topic, loc, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(x, 9) DESC, loc) AS rank FROM sh) WHERE rank <= 5",
)
_query("select_coverage_greedy", lambda s, d: selection.filled(selection.select_greedy(_seen(s, d), 3), selection.select_coverage(_seen(s, d), src.location_points(s, d), 5), 5))
_query("select_sharing", lambda s, d: selection.select_by_links(_seen(s, d), pr.sharing_graph(_loc_topics(s, d)), pr.sharing_probability(_loc_topics(s, d)), 5))
_query("select_transmitting", lambda s, d: selection.select_by_links(_seen(s, d), pr.transmitting_probability(_loc_topics(s, d)), pr.sharing_probability(_loc_topics(s, d)), 5))
_query(
    "selection_metrics",
    lambda s, d: selection.selection_metrics(selection.select_greedy(_seen(s, d), 5), _steps(s, d), 40, 5),
    _STEP + ", lo AS (SELECT topic, loc, CAST(sum(CASE WHEN step >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS later, count(*) AS n FROM st GROUP BY ALL), be AS (SELECT lo.*, row_number() OVER (PARTITION BY lo.topic ORDER BY later DESC, lo.loc) <= 5 AND later > 0 AS best, gr.rank IS NOT NULL AS hit FROM lo LEFT JOIN (FROM gr WHERE rank <= 5) gr ON gr.topic = lo.topic AND gr.loc = lo.loc)\nSELECT topic, sum(later) FILTER (hit) / nullif(sum(later), 0) AS hit_rate, sum(later) FILTER (best) / nullif(sum(later), 0) AS best_rate, 1 - sum(later) / sum(n) AS miss_before, count(*) FILTER (best AND hit) / nullif(count(*) FILTER (best), 0) AS target_accuracy FROM be GROUP BY topic",
    "hit_rate best_rate miss_before target_accuracy",
)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    scored, future = _two_models(s, d)
    return pred.time_split(pred.feature_vectors(scored, future, _ORDER))


def _varied(vectors: DataFrame) -> DataFrame:
    """Rows with both values, of locations whose predictor isn't constant, as there the line is not determined."""
    rows = vectors.where("actual is not null and greedy is not null")
    return rows.join(rows.groupBy("loc").agg(F.min("greedy").alias("a"), F.max("greedy").alias("b")).where("a < b").select("loc"), "loc", "left_semi")


_VEC = _HP + _BOTH + ", wd AS (SELECT tu, loc, topic, max(score) FILTER (model = 'greedy') AS greedy, max(score) FILTER (model = 'coverage_probability') AS coverage_probability FROM sco WHERE EXISTS (FROM fu WHERE fu.tu = sco.tu AND fu.loc = sco.loc) GROUP BY ALL), fv AS (SELECT coalesce(wd.tu, i.tu) AS tu, coalesce(wd.loc, i.loc) AS loc, coalesce(wd.topic, i.topic) AS topic, greedy, coverage_probability, share AS actual FROM wd FULL JOIN ideal i ON i.tu = wd.tu AND i.loc = wd.loc AND i.topic = wd.topic), tm AS (SELECT loc, tu, row_number() OVER (PARTITION BY loc ORDER BY tu) - 1 AS r, floor(count(*) OVER (PARTITION BY loc) * 0.75) AS m FROM (SELECT DISTINCT loc, tu FROM fv)), pv AS (SELECT loc, tu AS last_train FROM tm WHERE r = m)"
_query("feature_vectors", _vectors, _VEC + "\nSELECT fv.*, tu > last_train AS is_test FROM fv JOIN pv USING (loc)", "greedy coverage_probability actual")
_query("learning_to_rank", lambda s, d: pred.top_k(linear.ranked_by_regression(_vectors(s, d), _ORDER), 5))
_query("least_squares_one", lambda s, d: linear.least_squares(_varied(_vectors(s, d)), ["loc"], ["greedy"], "actual").select("loc", "n", F.col("coefficients")[0].alias("intercept"), F.col("coefficients")[1].alias("slope")), _VEC + "\nSELECT loc, count(*) AS n, regr_intercept(actual, greedy) AS intercept, regr_slope(actual, greedy) AS slope FROM fv JOIN pv USING (loc) WHERE actual IS NOT NULL AND greedy IS NOT NULL GROUP BY loc HAVING min(greedy) < max(greedy)", "intercept slope")
_query("significant_neighbours", lambda s, d: linear.significant_neighbours(linear.regression_frames(dist.cell_topic_counts(_occ(s, d), 50), dist.cell_pair_common(dist.cell_topic_counts(_occ(s, d), 50), 20)), 100))
_query("class_stats", lambda s, d: dist.class_stats(_occ(s, d), _occ(s, d).select("topic", (F.substring("topic", 2, 9).cast("bigint") % 7).alias("class")).distinct()), _OCC + "\nSELECT CAST(substr(topic, 2) AS BIGINT) % 7 AS class, count(DISTINCT topic) AS n_topics FROM occ WHERE CAST(substr(topic, 2) AS BIGINT) % 7 <> 0 GROUP BY 1")
_query("influence_histogram", lambda s, d: infl.influence_histogram(infl.pure_influence(src.occ_pairs(s, d))), _BA + ", pi AS (SELECT loc, nbr, round(avg(aggregate), 9) AS score FROM sc GROUP BY ALL)\nSELECT CAST(least(floor((score + 1) / 2 * 20), 19) AS BIGINT) AS bin, count(*) / sum(count(*)) OVER () AS share FROM pi GROUP BY 1", "share")
_query("classify_topic", lambda s, d: met.classify_topic(_occ(s, d), 500.0, src.UNIT, 1, 2, 1))
_query("affinity_by_distance", lambda s, d: dist.affinity_by_distance(pr.pair_distances(_loc_topics(s, d), src.location_points(s, d)), "jaccard", 500))
_query("locality_correlation", lambda s, d: dist.locality_correlation(pr.pair_distances(_loc_topics(s, d), src.location_points(s, d)), "jaccard", 500))
_query("life_fraction_at_share", lambda s, d: tl.life_fraction_at_share(src.occ_pairs(s, d).withColumnRenamed("loc", "cell"), 0.25, 3))
_query("in_out_closeness", lambda s, d: pr.in_out_closeness_graph(_loc_topics(s, d), tl.source_cell_percent(src.occ_pairs(s, d).withColumnRenamed("loc", "cell"), 0.1).select("topic", F.col("cell").alias("loc")), _periods(s, d), 0.05, 1))
_query("metric_cells", lambda s, d: grid.with_metric_cell(_occ(s, d), 100_000).groupBy("utm_cell").agg(F.count("*").alias("n")))

from topotide import queries_more  # noqa: E402, F401  registers more queries, which use the fragments above
from topotide import queries_depth  # noqa: E402, F401
