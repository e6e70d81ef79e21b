"""Registered queries of pyramids, inversion counts and tail probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.operators import association as assoc
from topotide.operators import clusters as cl
from topotide.operators import distributions as dist
from topotide.operators import grid
from topotide.operators import influence as infl
from topotide.operators import linear
from topotide.operators import locality
from topotide.operators import pairs as pr
from topotide.operators import predict as pred
from topotide.operators import timeline as tl
from topotide.queries import SQL, _COVER, _EVAL, _FEW, _HAV, _LOCT, _MAJ, _MET, _OCC, _PAIRS, _influence, _loc_topics, _majority, _metrics, _occ, _query
from topotide.queries_more import _DIST, _distances
from topotide.sources import adapter as src

# smallest covering radius
_SHARES = "(SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]::DOUBLE[]) AS k)"


def _covering_sql(keys: str, extra: str = "") -> str:
    miles = _HAV.format("a.ci * 14.5", "a.cj * 14.5", "b.ci * 14.5", "b.cj * 14.5")
    return (
        _OCC + f", tc AS (SELECT topic, {extra} ci, cj, count(*) AS n FROM occ GROUP BY ALL), tt AS (SELECT {keys}, sum(n) AS total FROM tc GROUP BY ALL), "
        f"ds AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.ci, a.cj, b.n, round({miles}, 6) AS miles FROM tc a JOIN tc b USING ({keys})), "
        f"rn AS (SELECT {keys}, ci, cj, miles, sum(n) OVER (PARTITION BY {keys}, ci, cj ORDER BY miles) AS run FROM ds), "
        f"cv AS (SELECT {keys}, k, ci, cj, min(miles) AS radius FROM rn JOIN tt USING ({keys}), {_SHARES} WHERE run / total >= k GROUP BY ALL)\n"
        f"SELECT {keys}, k, radius, ci, cj FROM cv QUALIFY row_number() OVER (PARTITION BY {keys}, k ORDER BY radius, ci, cj) = 1"
    )


_query("locality_index_cells", lambda s, d: locality.locality_index(_occ(s, d), src.SIZE), _covering_sql("topic"), "k radius")
_query("locality_index_by_day", lambda s, d: locality.locality_index(_occ(s, d), src.SIZE, day=86400), _covering_sql("topic, day", "t - t % 86400 AS day,"), "k radius")


# order of arrival against a model's order
def _order(s: SparkSession, d: str, zones: int = 1) -> DataFrame:
    return src.location_points(s, d).select("loc", F.floor(F.col("loc") / zones).alias("rank"))


def _accuracy_sql(zone: str) -> str:
    return (
        _PAIRS + ", f AS (SELECT topic, loc, min(t) AS t FROM occ GROUP BY ALL), r AS (SELECT topic, " + zone + " AS z, row_number() OVER (PARTITION BY topic ORDER BY t, loc) AS pos, count(*) OVER (PARTITION BY topic) AS n FROM f), "
        "w AS (SELECT a.topic, a.pos, any_value(a.n) AS n, sum(CASE WHEN (a.pos - b.pos) * (a.z - b.z) < 0 THEN 1 ELSE 0 END) AS bad FROM r a JOIN r b USING (topic) WHERE a.n > 1 GROUP BY ALL), "
        "ra AS (SELECT topic, avg(1 - bad / (n - 1)) AS accuracy FROM w GROUP BY topic)"
    )


_query("rank_accuracy_zones", lambda s, d: infl.rank_accuracy(_order(s, d, 5), src.occ_pairs(s, d)), _accuracy_sql("loc // 5") + "\nSELECT topic, accuracy FROM ra", "accuracy")
_query(
    "rank_accuracy_by_bin",
    lambda s, d: infl.rank_accuracy_by_bin(_order(s, d), src.occ_pairs(s, d), width=5),
    _accuracy_sql("loc") + ", oc AS (SELECT topic, CAST(count(*) // 5 * 5 + 5 AS BIGINT) AS bin FROM occ GROUP BY topic)\nSELECT bin, count(*) AS n_topics, avg(accuracy) AS accuracy FROM ra JOIN oc USING (topic) GROUP BY bin",
    "accuracy",
)
_query("rank_accuracy_shuffled", lambda s, d: infl.rank_accuracy_by_bin(_order(s, d), src.occ_pairs(s, d), width=5, seed=7))

# correlations with their p-values: a finite series of the angle, for whole degrees of freedom
_T_TAIL = (
    "1 - CASE WHEN nu % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, nu // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - 0.5 * ln(pi())) * pow(cos(th), 2 * j))) "
    "ELSE 2 / pi() * (th + coalesce(sin(th) * cos(th) * list_sum(list_transform(range(0, (nu - 1) // 2), lambda j: exp(0.5 * ln(pi()) + lgamma(j + 1.0) - lgamma(j + 1.5) - ln(2.0)) * pow(cos(th), 2 * j))), 0)) END"
)


def _both_ends(s: SparkSession, d: str) -> DataFrame:
    rows = _distances(s, d)
    return rows.select(F.col("l").alias("loc"), "distance", "jaccard", "mean_gap").unionByName(rows.select(F.col("r").alias("loc"), "distance", "jaccard", "mean_gap"))


def _correlation_sql(y: str) -> str:
    return (
        _DIST + f", be AS (SELECT l AS loc, distance, {y} AS y FROM pd UNION ALL SELECT r, distance, {y} FROM pd), co AS (SELECT loc, count(*) AS n, corr(distance, y) AS r FROM be GROUP BY loc), "
        "an AS (SELECT loc, n, r, n - 2 AS nu, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) AS th FROM co)\n"
        f"SELECT loc, n, r, {_T_TAIL} AS p FROM an"
    )


_query("similarity_correlation_by_location", lambda s, d: dist.correlation_test(_both_ends(s, d), "distance", "jaccard", ["loc"]), _correlation_sql("jaccard"), "r p")
_query("lag_correlation_by_location", lambda s, d: dist.correlation_test(_both_ends(s, d), "distance", "mean_gap", ["loc"]), _correlation_sql("mean_gap"), "r p")

# quartiles of one group that holds the whole table
_query(
    "event_values_within_bounds",
    lambda s, d: tl.drop_outliers(s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value"), ["event_type"], "value", hot=True).groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean")),
    "WITH q AS (SELECT event_type, value, quantile_cont(value, 0.25) OVER (PARTITION BY event_type) AS a, quantile_cont(value, 0.75) OVER (PARTITION BY event_type) AS b FROM events)\nSELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean FROM q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY event_type",
    "low high mean",
)

# regions with parts and holes
def _regions(s: SparkSession) -> DataFrame:
    box = lambda a, b, c, e: [{"lat": a, "lon": b}, {"lat": c, "lon": b}, {"lat": c, "lon": e}, {"lat": a, "lon": e}]
    rows = [("islands", [box(-50.5, -160.5, -10.5, -90.5), box(20.5, 60.5, 70.5, 140.5), box(30.5, 80.5, 50.5, 120.5)]), ("The Inland", [box(30.5, 80.5, 50.5, 120.5)])]
    return s.createDataFrame(rows, "country string, rings array<array<struct<lat:double,lon:double>>>")


_query(
    "occurrences_by_region",
    lambda s, d: dist.occurrences_by_country(grid.country_of(_occ(s, d).groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n")), _regions(s), src.SIZE, {"The Inland": "inland"})),
    _OCC + ", pt AS (SELECT ci * 14.5 AS la, cj * 14.5 AS lo FROM occ), k AS (SELECT CASE WHEN la BETWEEN 30.5 AND 50.5 AND lo BETWEEN 80.5 AND 120.5 THEN 'inland' WHEN la BETWEEN -50.5 AND -10.5 AND lo BETWEEN -160.5 AND -90.5 OR la BETWEEN 20.5 AND 70.5 AND lo BETWEEN 60.5 AND 140.5 THEN 'islands' END AS country FROM pt)\nSELECT country, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM k WHERE country IS NOT NULL GROUP BY country",
    "share",
)

# every model, window and k
MODELS = ("greedy", "coverage_probability", "coverage_distance", "sharing", "transmitting", *[f"{n}_coverage_{k}" for n in ("sharing", "transmitting") for k in ("probability", "distance")])
LEARNT = MODELS[:5]


def _every_model(s: SparkSession, d: str, history: DataFrame) -> DataFrame:
    rows = pr.location_topics(src.occ_few_topics(s, d), "loc")
    return pred.all_models(history, src.location_points(s, d), pr.sharing_graph(rows), pr.transmitting_probability(rows))


def _every_model_sql(h: int, p: int, ks: str) -> str:
    """(model, k, n, accuracy, impact, difference) of all models."""
    windows = (
        _FEW + f", b AS (SELECT bucket, loc, topic, count(*) AS n FROM occ GROUP BY ALL), hi AS (SELECT tu, loc, topic, sum(n) AS n FROM (SELECT *, unnest(range(bucket + 3600, bucket + {h * 3600 + 1}, 3600)) AS tu FROM b) GROUP BY ALL), "
        f"fu AS (SELECT tu, loc, topic, sum(n) AS n FROM (SELECT *, unnest(range(bucket - {(p - 1) * 3600}, bucket + 1, 3600)) AS tu FROM b) GROUP BY ALL), ideal AS (SELECT tu, loc, topic, n / sum(n) OVER (PARTITION BY tu, loc) AS share FROM fu)"
    )
    parts = ["SELECT tu, loc, topic, 'greedy' AS model, n / sum(n) OVER (PARTITION BY tu, loc) AS score FROM hi"]
    links = ""
    for kind, over in (("probability", "topic"), ("distance", "loc")):
        links += f", c{kind[0]} AS (SELECT tu, loc, topic, s / sum(s) OVER (PARTITION BY tu, {over}) AS c FROM raw)"
        parts.append(f"SELECT tu, loc, topic, 'coverage_{kind}', c FROM c{kind[0]}")
    for name, later, least in (("sharing", "", " WHERE c / k >= 0.1"), ("transmitting", " AND a.first_t < b.first_t", "")):
        x = name[0]
        links += f", tt{x} AS (SELECT a.loc, b.loc AS nbr, count(*) AS c FROM lt a JOIN lt b USING (topic) WHERE a.loc <> b.loc{later} GROUP BY ALL), pp{x} AS (SELECT loc, nbr, c / k AS p FROM tt{x} JOIN sz USING (loc){least} UNION ALL SELECT DISTINCT loc, loc, 1.0 FROM hi)"
        parts.append(f"SELECT tu, pp{x}.loc, topic, '{name}', sum(p) FROM hi JOIN pp{x} ON pp{x}.nbr = hi.loc GROUP BY tu, pp{x}.loc, topic")
        for kind in ("probability", "distance"):
            parts.append(f"SELECT tu, pp{x}.loc, topic, '{name}_coverage_{kind}', sum(p * c) FROM (SELECT c{kind[0]}.* FROM c{kind[0]} JOIN hi USING (tu, loc, topic)) sn JOIN pp{x} ON pp{x}.nbr = sn.loc GROUP BY tu, pp{x}.loc, topic")
    scores = windows + _COVER + _LOCT + links + ", sco AS (" + " UNION ALL ".join(parts) + ")"
    return scores + _EVAL.replace("unnest([1, 5])", f"unnest({ks})") + "\nSELECT model, k, count(*) AS n, avg(accuracy) AS accuracy, avg(impact) AS impact, avg(difference) AS difference FROM ev2 GROUP BY model, k"


def _curve(s: SparkSession, d: str) -> DataFrame:
    h, f = pred.window_counts(src.occ_few_topics(s, d), 6, 2)
    return pred.model_performance(pred.performance_curve(_every_model(s, d, h), f, 24, MODELS)).withColumn("k", F.col("k").cast("bigint"))


_query("model_performance_curve", _curve, _every_model_sql(6, 2, "range(1, 25)"), "accuracy impact difference")
_WINDOWS = ((6, 2), (3, 1), (12, 4))


def _all_windows(s: SparkSession, d: str) -> DataFrame:
    grid = pred.performance_grid(src.occ_few_topics(s, d), lambda h: _every_model(s, d, h), _WINDOWS, (1, 5, 10), MODELS)
    means = [F.avg(c).alias(c) for c in ("accuracy", "impact", "difference")]
    return grid.groupBy("h", "p", "model", "k").agg(F.count("*").alias("n"), *means)


_query(
    "model_performance_windows",
    _all_windows,
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {h} AS h, {p} AS p, * FROM ({_every_model_sql(h, p, '[1, 5, 10]')})" for h, p in _WINDOWS) + ")\nSELECT *",
)
SQL["model_performance_windows"] = "SELECT * REPLACE (round(accuracy, 6) + 0.0 AS accuracy, round(impact, 6) + 0.0 AS impact, round(difference, 6) + 0.0 AS difference) FROM (" + SQL["model_performance_windows"].rpartition("\n")[0] + ")"


def _learnt_curve(s: SparkSession, d: str) -> DataFrame:
    """Learning to rank from five models, for every k."""
    h, f = pred.window_counts(src.occ_few_topics(s, d), 6, 2)
    scored = _every_model(s, d, h).where(F.col("model").isin(*LEARNT))
    vectors = pred.time_split(pred.feature_vectors(scored, f, LEARNT))
    ranked = linear.ranked_by_regression(vectors, LEARNT)
    times = vectors.where("is_test").select("tu", "loc").distinct()
    curve = pred.performance_curve(ranked, f.join(times, ["tu", "loc"], "left_semi"), 24, ("learning_to_rank",))
    return pred.model_performance(curve)


_query("learning_to_rank_curve", _learnt_curve)

# clusterings
_query("influence_zones_linked", lambda s, d: cl.influence_zones(infl.boundary_influence(_influence(s, d), 25), 0.00002, pr.lattice_graph(_loc_topics(s, d), 5)))

_query("sharing_forest", lambda s, d: cl.spanning_forest(_distances(s, d).select(F.col("l").alias("u"), F.col("r").alias("v"), F.round("jaccard", 9).alias("w"))))


def _sharing_clusters(s: SparkSession, d: str) -> DataFrame:
    forest = cl.spanning_forest(_distances(s, d).select(F.col("l").alias("u"), F.col("r").alias("v"), F.round("jaccard", 9).alias("w")))
    return cl.cut_forest(forest, src.location_points(s, d).select(F.col("loc").alias("node")), clusters=6)


_query("sharing_clusters", _sharing_clusters)


def _by_gaps(s: SparkSession, d: str, value: str, width: float) -> DataFrame:
    """Topics in zones of near values, as a clustering."""
    zones = cl.influence_zones(_metrics(s, d).select(F.col("topic").alias("loc"), F.round(value, 9).alias("score")), width)
    return zones.select(F.col("loc").alias("node"), F.col("zone").alias("cluster"))


def _gaps_sql(name: str, value: str, width: float) -> str:
    return (
        f"{name}0 AS (SELECT topic, round({value}, 9) AS s FROM met), {name}1 AS (SELECT *, CASE WHEN s - lag(s) OVER (ORDER BY s, topic) > {width} THEN 1 ELSE 0 END AS w FROM {name}0), "
        f"{name}2 AS (SELECT topic, sum(w) OVER (ORDER BY s, topic) AS z FROM {name}1), {name} AS (SELECT topic, CASE WHEN count(*) OVER (PARTITION BY z) = 1 THEN -1 ELSE z END AS z FROM {name}2)"
    )


_CLUSTERINGS = _MET + ", " + _gaps_sql("ca", "entropy", 0.02) + ", " + _gaps_sql("cb", "focus", 0.002)
_CELLS_OF = ", ct0 AS (SELECT a.z AS x, b.z AS y, count(*) AS n FROM ca a JOIN cb b USING (topic) GROUP BY ALL)"
_query("cluster_mapping_sizes", lambda s, d: pr.cluster_mapping(_by_gaps(s, d, "entropy", 0.02), _by_gaps(s, d, "focus", 0.002)).select("n", "share"), _CLUSTERINGS + _CELLS_OF + ", sa AS (SELECT z AS x, count(*) AS i FROM ca GROUP BY z), sb AS (SELECT z AS y, count(*) AS j FROM cb GROUP BY z), mb AS (SELECT y, max(n) AS n FROM ct0 GROUP BY y)\nSELECT n, max(n / least(i, j)) AS share FROM mb JOIN ct0 USING (y, n) JOIN sa USING (x) JOIN sb USING (y) GROUP BY y, n HAVING max(n / least(i, j)) >= 0.5", "share")
_query(
    "zone_agreement",
    lambda s, d: pr.cluster_agreement(_by_gaps(s, d, "entropy", 0.02), _by_gaps(s, d, "focus", 0.002)),
    _CLUSTERINGS + _CELLS_OF + ", su AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct0) AS ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct0 GROUP BY x)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct0 GROUP BY y)) AS b, (SELECT sum(n) FROM ct0) AS t)\nSELECT (ij - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)) AS adjusted_rand FROM su",
    "adjusted_rand",
)

# patterns against chance
_choose = lambda m, k: f"(lgamma({m} + 1.0) - lgamma({k} + 1.0) - lgamma({m} - {k} + 1.0))"
_EXPECTED = (
    "rd AS (SELECT *, unnest(range(0, n + 1)) AS h FROM pt0), "
    f"wp AS (SELECT l, r, exp({_choose('n', 'h')} - n * ln(2.0)) * CASE WHEN ones = h THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(greatest(ones, h), least(n, ones + h) + 1), "
    f"lambda x: exp({_choose('(ones + h)', 'x')} + {_choose('(2 * n - ones - h)', '(n - x)')} - {_choose('(2 * n)', 'n')})))) END AS w FROM rd), "
    "xp AS (SELECT l, r, sum(w) AS p FROM wp GROUP BY ALL)"
)
_SHARED = (
    _PAIRS + ", c AS (SELECT loc, topic, count(*) AS n FROM occ GROUP BY ALL), h AS (SELECT loc, topic FROM (SELECT *, n / sum(n) OVER (PARTITION BY topic) AS s FROM c) WHERE s >= 0.03), k AS (SELECT loc, count(*) AS k FROM h GROUP BY loc HAVING count(*) >= 10), g AS (FROM h WHERE loc IN (SELECT loc FROM k)), "
    "p2 AS (SELECT a.loc AS l, b.loc AS r, count(*) AS n_common FROM g a JOIN g b USING (topic) WHERE a.loc < b.loc GROUP BY ALL), pt0 AS (SELECT l, r, n_common AS ones, x.k + y.k - n_common AS n FROM p2 JOIN k x ON x.loc = l JOIN k y ON y.loc = r WHERE n_common / (x.k + y.k - n_common) >= 0.1), " + _EXPECTED
)
_query("location_clusters_tested", lambda s, d: pr.location_clusters(src.occ_pairs(s, d), "loc", 0.03, 10, 0.1, 1.0), _SHARED + "\nSELECT l, r, ones AS n_common, ones / n AS jaccard, p FROM pt0 JOIN xp USING (l, r) WHERE p <= 1", "jaccard p")
_query("location_clusters_sampled", lambda s, d: pr.location_clusters(src.occ_pairs(s, d), "loc", 0.03, 10, 0.1, 1.0, draws=30))


def _status(s: SparkSession, d: str) -> DataFrame:
    return assoc.lead_lag_status(_majority(s, d), (5,))


_PATTERNS = (
    _PAIRS + _MAJ + ", pp AS (SELECT a.cell AS l, b.cell AS r, count(*) AS n, avg(sign(a.bucket - b.bucket)) AS mean_status FROM m1 a JOIN m1 b USING (topic) WHERE a.cell < b.cell AND a.bucket <> b.bucket GROUP BY ALL HAVING count(*) >= 5), "
    "pt0 AS (SELECT l, r, n, mean_status, CAST(round(n * (1 + mean_status) / 2) AS BIGINT) AS ones FROM pp), " + _EXPECTED
)
_query("lead_lag_permutation", lambda s, d: cl.permutation_p(_status(s, d)).drop("min_common"), _PATTERNS + "\nSELECT l, r, n, mean_status, p FROM pt0 JOIN xp USING (l, r)", "mean_status p")
_query("lead_lag_permutation_sampled", lambda s, d: cl.permutation_p(_status(s, d), draws=3, replicates=200))
_query(
    "p_value_cdf",
    lambda s, d: cl.p_value_cdf(cl.permutation_p(_status(s, d))).drop("min_common"),
    _PATTERNS + ", b AS (SELECT round(p, 2) AS p, count(*) AS n FROM xp GROUP BY 1)\nSELECT p, n, sum(n) OVER (ORDER BY p) / sum(n) OVER () AS cdf, 1 - sum(n) OVER (ORDER BY p) / sum(n) OVER () AS ccdf FROM b",
    "p cdf ccdf",
)
_query(
    "p_value_examples",
    lambda s, d: cl.p_value_examples(cl.permutation_p(_status(s, d))).drop("min_common"),
    _PATTERNS + ", x AS (SELECT p > 0.05 AS is_random, l, r, p, row_number() OVER (PARTITION BY p > 0.05 ORDER BY CASE WHEN p > 0.05 THEN -round(p, 9) ELSE round(p, 9) END, l, r) AS rank FROM xp)\nSELECT is_random, rank, l, r, p FROM x WHERE rank <= 5",
    "p",
)
