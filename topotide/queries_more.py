"""More registered queries: combined predictors, grids of performance, learners, selection, and pair and area distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.operators import association as assoc
from topotide.operators import clusters as cl
from topotide.operators import distributions as dist
from topotide.operators import grid, selection
from topotide.operators import influence as infl
from topotide.operators import metrics as met
from topotide.operators import pairs as pr
from topotide.operators import predict as pred
from topotide.operators import timeline as tl
from topotide.queries import _BA, _BOTH, _COVER, _EVAL, _FEW, _FOCUS, _FTL, _HAV, _HP, _INF, _LINK, _LOCT, _LOSS, _MAJ, _MET, _OCC, _ORDER, _PAIRS, _PERIOD, _POINT, _REGION, _SCORE, _STEP, _WORDS, _focus, _influence, _loc_topics, _metrics, _occ, _performance, _query, _seen, _steps, _table, _two_models, _windows, _with_rounding
from topotide.queries import SQL as _sql
from topotide.sources import adapter as src

FAMILIES = {"greedy": "community", "coverage_probability": "spatial"}
_FAMILY = "CASE {0}.model WHEN 'greedy' THEN 'community' ELSE 'spatial' END"
BOX = (-60.0, -100.0, 60.0, 50.0)
_AREA = "CASE WHEN lat BETWEEN -60 AND 60 AND lon BETWEEN -100 AND 50 THEN 'inner' ELSE 'outer' END"


# combined predictors and rankings
def _links(s: SparkSession, d: str, name: str) -> DataFrame:
    rows = pr.location_topics(src.occ_few_topics(s, d), "loc")
    return pr.sharing_graph(rows) if name == "sharing" else pr.transmitting_probability(rows)


def _with_coverage(s: SparkSession, d: str, name: str, kind: str) -> DataFrame:
    h, _ = _windows(s, d)
    cover = pred.predict_coverage(h, src.location_points(s, d), kind)
    return pred.predict_with_coverage(h, _links(s, d, name), cover, f"{name}_coverage_{kind}")


for _name in ("sharing", "transmitting"):
    for _kind in ("probability", "distance"):
        _later = "" if _name == "sharing" else " AND a.first_t < b.first_t"
        _least = " WHERE c / k >= 0.1" if _name == "sharing" else ""
        _over = "topic" if _kind == "probability" else "loc"
        _query(
            f"predict_{_name}_with_coverage_{_kind}",
            lambda s, d, n=_name, k=_kind: _with_coverage(s, d, n, k),
            _HP + _COVER + _LOCT + f", tr AS (SELECT a.loc, b.loc AS nbr, count(*) AS c FROM lt a JOIN lt b USING (topic) WHERE a.loc <> b.loc{_later} GROUP BY ALL), pp AS (SELECT loc, nbr, c / k AS p FROM tr JOIN sz USING (loc){_least} UNION ALL SELECT DISTINCT loc, loc, 1.0 FROM hi), cv AS (SELECT tu, loc, topic, s / sum(s) OVER (PARTITION BY tu, {_over}) AS c FROM raw), sn AS (SELECT cv.* FROM cv JOIN hi USING (tu, loc, topic))\nSELECT tu, pp.loc, topic, sum(p * c) AS score, '{_name}_coverage_{_kind}' AS model FROM sn JOIN pp ON pp.nbr = sn.loc GROUP BY tu, pp.loc, topic",
            "score",
        )


def _rankings(s: SparkSession, d: str) -> DataFrame:
    return pred.ranking_dataset(*_two_models(s, d), 5)


_RANK = _HP + _BOTH + ", al AS (SELECT tu, loc, model, topic, score FROM sco UNION ALL SELECT tu, loc, 'ideal', topic, share FROM ideal), rk AS (SELECT tu, loc, model, topic, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY tu, loc, model ORDER BY round(score, 9) DESC, topic) AS rank FROM al) WHERE rank <= 5), gd AS (SELECT tu, loc FROM rk WHERE rank <= 3 GROUP BY ALL HAVING count(DISTINCT model) = 3 AND sum(CASE WHEN model = 'ideal' THEN 1 ELSE 0 END) >= 3), rl AS (SELECT rk.* FROM rk JOIN gd USING (tu, loc) WHERE rank <= 3)"
_query("ranking_dataset", _rankings, _RANK + "\nSELECT * FROM rk", "score")
_query("rankings_by_location", lambda s, d: pred.rankings_by_location(_rankings(s, d), 3), _RANK + "\nSELECT * FROM rl", "score")
_query(
    "model_gap_examples",
    lambda s, d: pred.model_gaps(pred.rankings_by_location(_rankings(s, d), 3).join(grid.within_bbox(src.location_points(s, d), BOX), "loc", "left_semi"), "coverage_probability", "greedy"),
    _RANK + ", hi2 AS (SELECT a.tu, a.loc, a.model, a.topic IN (SELECT topic FROM rl i WHERE i.model = 'ideal' AND i.tu = a.tu AND i.loc = a.loc) AS hit FROM rl a JOIN pt USING (loc) WHERE a.model <> 'ideal' AND lat BETWEEN -60 AND 60 AND lon BETWEEN -100 AND 50), gp AS (SELECT tu, loc, count(*) FILTER (hit AND model = 'coverage_probability') AS better, count(*) FILTER (hit AND model = 'greedy') AS worse FROM hi2 GROUP BY ALL)\nSELECT tu, loc, better, worse, better - worse AS gap FROM gp",
)


# performance by the lengths of history and future, by location and by area
def _grid(s: SparkSession, d: str) -> DataFrame:
    return pred.performance_grid(src.occ_few_topics(s, d), pred.predict_greedy, ((6, 2), (6, 1), (6, 4), (3, 1), (12, 1)), (1, 5, 10), ("greedy",))


_GRID = (
    _FEW + ", b AS (SELECT bucket, loc, topic, count(*) AS n FROM occ GROUP BY ALL), hp AS (SELECT * FROM (VALUES (6, 2), (6, 1), (6, 4), (3, 1), (12, 1)) v(h, p)), "
    "hi AS (SELECT h, tu, loc, topic, sum(n) AS n FROM (SELECT b.*, h, unnest(range(bucket + 3600, bucket + h * 3600 + 1, 3600)) AS tu FROM b, (SELECT DISTINCT h FROM hp)) GROUP BY ALL), "
    "fu AS (SELECT p, tu, loc, topic, sum(n) AS n FROM (SELECT b.*, p, unnest(range(bucket - (p - 1) * 3600, bucket + 1, 3600)) AS tu FROM b, (SELECT DISTINCT p FROM hp)) GROUP BY ALL), "
    "be AS (SELECT *, row_number() OVER (PARTITION BY p, tu, loc ORDER BY round(share, 9) DESC, topic) AS br FROM (SELECT p, tu, loc, topic, n / sum(n) OVER (PARTITION BY p, tu, loc) AS share FROM fu)), "
    "mi AS (SELECT *, row_number() OVER (PARTITION BY h, tu, loc ORDER BY round(score, 9) DESC, topic) AS rank FROM (SELECT h, tu, loc, topic, n / sum(n) OVER (PARTITION BY h, tu, loc) AS score FROM hi)), "
    "ks AS (SELECT unnest([1, 5, 10]) AS k), wh AS (SELECT p, tu, loc, k, count(*) AS m, sum(share) AS bs FROM be, ks WHERE br <= k GROUP BY ALL), "
    "he AS (SELECT hp.h, hp.p, mi.tu, mi.loc, k, sum(CASE WHEN br <= k THEN 1 ELSE 0 END) AS hits, sum(share) AS got FROM hp JOIN mi ON mi.h = hp.h JOIN be ON be.p = hp.p AND be.tu = mi.tu AND be.loc = mi.loc AND be.topic = mi.topic, ks WHERE rank <= k GROUP BY ALL), "
    "gr AS (SELECT hp.h, hp.p, wh.tu, wh.loc, 'greedy' AS model, wh.k, coalesce(hits, 0) / m AS accuracy, coalesce(got, 0) / bs AS impact FROM hp JOIN wh ON wh.p = hp.p LEFT JOIN he ON he.h = hp.h AND he.p = hp.p AND he.tu = wh.tu AND he.loc = wh.loc AND he.k = wh.k)"
)
for _param, _fixed in (("k", {"h": 6, "p": 2}), ("p", {"h": 6, "k": 10}), ("h", {"p": 1, "k": 10})):
    _where = " AND ".join(f"{a} = {b}" for a, b in _fixed.items())
    _query(f"performance_by_{_param}", lambda s, d, x=_param, f=_fixed: pred.performance_by(_grid(s, d), x, **f), _GRID + f"\nSELECT {_param} AS param, model, count(*) AS n, avg(accuracy) AS accuracy, avg(impact) AS impact FROM gr WHERE {_where} GROUP BY ALL", "accuracy impact")
_AT5 = _HP + _BOTH + _EVAL
_query("performance_by_location", lambda s, d: pred.performance_by_location(_performance(s, d)), _AT5 + "\nSELECT loc, model, max(accuracy) AS accuracy, max(impact) AS impact FROM ev2 WHERE k = 5 GROUP BY ALL", "accuracy impact")


def _best(s: SparkSession, d: str) -> DataFrame:
    return pred.best_model_by_location(_performance(s, d), _ORDER)


def _areas(s: SparkSession, d: str) -> DataFrame:
    return grid.label_area(src.location_points(s, d), [("inner", BOX)]).select("loc", F.coalesce("area", F.lit("outer")).alias("area"))


_BEST = _AT5 + f", bl AS (SELECT loc, first(model ORDER BY round(accuracy, 9) DESC, o) AS model, first(accuracy ORDER BY round(accuracy, 9) DESC, o) AS accuracy FROM (SELECT loc, model, CASE model WHEN 'greedy' THEN 1 ELSE 2 END AS o, avg(accuracy) AS accuracy FROM ev2 WHERE k = 5 GROUP BY ALL) GROUP BY loc), ar AS (SELECT bl.*, {_AREA} AS area FROM bl JOIN pt USING (loc))"
_query("best_model_by_location", _best, _BEST + "\nSELECT * FROM bl", "accuracy")
_query("performance_by_area", lambda s, d: pred.performance_by_area(_best(s, d), _areas(s, d)), _BEST + "\nSELECT area, model, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY area) AS share FROM ar GROUP BY area, model", "share")
_query("score_distribution_by_area", lambda s, d: pred.score_distribution(_best(s, d), _areas(s, d)), _BEST + ", bi AS (SELECT area, CAST(least(floor(round(accuracy, 9) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM ar GROUP BY ALL)\nSELECT area, bin, n, sum(n) OVER (PARTITION BY area ORDER BY bin DESC) / sum(n) OVER (PARTITION BY area) AS ccdf FROM bi", "ccdf")
_query(
    "top_bottom_by_area",
    lambda s, d: dist.top_bottom(_best(s, d).join(_areas(s, d), "loc"), "area", "loc", "accuracy", 3),
    _BEST + ", rn AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY round(accuracy, 9) DESC, loc) AS h, row_number() OVER (PARTITION BY area ORDER BY round(accuracy, 9), loc) AS l FROM ar)\nSELECT area, loc, accuracy, 'top' AS side, h AS rank FROM rn WHERE h <= 3 UNION ALL SELECT area, loc, round(accuracy, 6), 'bottom', l FROM rn WHERE l <= 3",
    "accuracy",
)
_query("winning_topics_by_coverage", lambda s, d: pred.winning_topics_by_score(pred.predict_coverage(_windows(s, d)[0], src.location_points(s, d))), _HP + _BOTH + ", m AS (SELECT loc, topic, sum(score) AS score FROM sco WHERE model = 'coverage_probability' GROUP BY ALL)\nSELECT loc, first(topic ORDER BY round(score, 9) DESC, topic) AS topic, first(score ORDER BY round(score, 9) DESC, topic) AS score FROM m GROUP BY loc", "score")

# learners
_query("learner_history", lambda s, d: pred.learner_history(_performance(s, d), _ORDER), _HP + _BOTH + _LOSS + ", w AS (SELECT loc, tu, model, past, pow(0.5, past - min(past) OVER (PARTITION BY loc, tu)) AS w FROM pa)\nSELECT loc, tu, model, past, w / sum(w) OVER (PARTITION BY loc, tu) AS weight FROM w", "past weight")
_query("random_learner", lambda s, d: pred.random_learner(_performance(s, d), _ORDER), _HP + _BOTH + _LOSS + ", q AS (SELECT *, md5(concat_ws('|', 1, loc, tu, model)) AS h FROM pa)\nSELECT loc, tu, first(model ORDER BY h) AS model, first(value ORDER BY h) AS value FROM q GROUP BY loc, tu", "value")
_query("hedging_sampled", lambda s, d: pred.hedging_sampled(_performance(s, d), _ORDER))
_query("final_family", lambda s, d: pred.final_family(_performance(s, d), _ORDER, FAMILIES), _HP + _BOTH + _LOSS + f", t AS (SELECT loc, model, round(sum(1 - value), 9) AS loss FROM pa GROUP BY ALL), b AS (SELECT loc, {_FAMILY.format('t')} AS family FROM t QUALIFY loss = min(loss) OVER (PARTITION BY loc))\nSELECT loc, min(family) AS family FROM b GROUP BY loc HAVING count(DISTINCT family) = 1".replace(", b AS (SELECT loc,", ", bb AS (SELECT loc,").replace("FROM b GROUP", "FROM bb GROUP"))


def _leader(s: SparkSession, d: str) -> DataFrame:
    return pred.follow_the_leader(_performance(s, d), _ORDER)


_FLIP = _HP + _BOTH + _LOSS + _FTL
_query("flips_by_time", lambda s, d: pred.flips_by_time(_leader(s, d), FAMILIES), _FLIP + ", y AS (SELECT tu, model, lag(model) OVER (PARTITION BY loc ORDER BY tu) AS was FROM fl)\nSELECT tu, count(*) AS n, avg(CASE WHEN model <> was THEN 1.0 ELSE 0.0 END) AS share FROM y WHERE was IS NOT NULL GROUP BY tu", "share")


def _flipping_by_volume(s: SparkSession, d: str, width: int = 50, least: int = 2) -> DataFrame:
    return pred.flipping_by_volume(pred.flipping_ratio(_leader(s, d)), src.occ_few_topics(s, d).groupBy("loc").agg(F.count("*").alias("n")), width, least)


_VOLUME = _FLIP + ", x AS (SELECT loc, model = lag(model) OVER (PARTITION BY loc ORDER BY tu) AS same FROM fl), fr AS (SELECT loc, round(1 - sum(CASE WHEN same THEN 1 ELSE 0 END) / count(*), 9) AS ratio FROM x GROUP BY loc), vo AS (SELECT loc, CAST(count(*) // 50 * 50 + 50 AS BIGINT) AS bin FROM occ GROUP BY loc), qq AS (SELECT bin, ratio, quantile_cont(ratio, 0.25) OVER (PARTITION BY bin) AS q1, quantile_cont(ratio, 0.75) OVER (PARTITION BY bin) AS q3 FROM fr JOIN vo USING (loc)), vb AS (SELECT bin, count(*) AS n, avg(ratio) AS ratio FROM qq WHERE ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY bin HAVING count(*) >= 2)"
_query("flipping_by_volume", _flipping_by_volume, _VOLUME + "\nSELECT * FROM vb", "ratio")
_query("flipping_line", lambda s, d: pred.line_fit(_flipping_by_volume(s, d), "bin", "ratio"), _VOLUME + "\nSELECT count(*) AS n, corr(bin, ratio) AS r, regr_slope(ratio, bin) AS slope, regr_intercept(ratio, bin) AS intercept FROM vb", "r slope intercept")

# target selection
_SHARE = _STEP + _LOCT + _LINK + f", ob AS (SELECT loc, k / (SELECT count(DISTINCT topic) FROM lt) AS po FROM sz), sg AS (SELECT loc, nbr, n_common / k AS p FROM lk JOIN sz USING (loc) WHERE n_common / k >= 0.1), tg AS (SELECT a.loc, b.loc AS nbr, count(*) / any_value(k) AS p FROM lt a JOIN lt b USING (topic) JOIN sz ON sz.loc = a.loc WHERE a.loc <> b.loc AND a.first_t < b.first_t GROUP BY a.loc, b.loc), pt AS (SELECT DISTINCT loc, {_POINT.format('loc')} FROM occ), ke AS (SELECT a.loc, b.loc AS nbr, pow(1.01, -({_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')})) AS w FROM pt a, pt b), rw AS (SELECT topic, ke.loc, sum(n * w) AS s FROM se JOIN ke ON ke.nbr = se.loc GROUP BY ALL), sh AS (SELECT topic, loc, s / sum(s) OVER (PARTITION BY topic) AS x FROM rw)"
_FILL = ", fi AS (SELECT topic, loc, min((o, rank)) AS b FROM (SELECT topic, loc, 0 AS o, rank FROM gr WHERE rank <= {0} UNION ALL SELECT topic, loc, 1, rank FROM mo WHERE rank <= {1}) GROUP BY ALL), fr AS (SELECT topic, loc, row_number() OVER (PARTITION BY topic ORDER BY b, loc) AS rank FROM fi)"
for _name, _t in (("sharing", "sg"), ("transmitting", "tg")):
    _sql[f"select_{_name}"] = _SHARE + f", sc AS (SELECT topic, nbr AS loc, sum(ln(po) + ln(p)) AS x FROM se JOIN ob USING (loc) JOIN {_t} USING (loc) GROUP BY topic, nbr)\nSELECT topic, loc, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(x, 9) DESC, loc) AS rank FROM sc) WHERE rank <= 5"
    _query(
        f"select_coverage_{_name}",
        lambda s, d, n=_name: selection.select_coverage_links(_seen(s, d), src.location_points(s, d), pr.sharing_graph(_loc_topics(s, d)) if n == "sharing" else pr.transmitting_probability(_loc_topics(s, d)), pr.sharing_probability(_loc_topics(s, d)), 8),
        _SHARE + f", sc AS (SELECT se.topic, nbr AS loc, sum(ln(po) + ln(p) + ln(sh.x)) AS x FROM se JOIN ob USING (loc) JOIN {_t} USING (loc) JOIN sh ON sh.topic = se.topic AND sh.loc = nbr GROUP BY se.topic, nbr), mo AS (SELECT topic, loc, row_number() OVER (PARTITION BY topic ORDER BY round(x, 9) DESC, loc) AS rank FROM sc)" + _FILL.format(8, 16) + "\nSELECT topic, loc, rank FROM fr WHERE rank <= 8",
    )
_sql["select_coverage_greedy"] = _SHARE + ", mo AS (SELECT topic, loc, row_number() OVER (PARTITION BY topic ORDER BY round(x, 9) DESC, loc) AS rank FROM sh)" + _FILL.format(3, 5) + "\nSELECT topic, loc, rank FROM fr WHERE rank <= 5"


def _train(s: SparkSession, d: str) -> DataFrame:
    """Four of five topics."""
    return src.occ_pairs(s, d).select("topic").distinct().where("cast(substring(topic, 2, 9) as bigint) % 5 <> 0")


_query("select_sharing_local", lambda s, d: selection.select_sharing_local(_seen(s, d), src.location_points(s, d), pr.sharing_graph(_loc_topics(s, d)), pr.sharing_probability(_loc_topics(s, d)), src.occ_pairs(s, d).select("topic").distinct().where("cast(substring(topic, 2, 9) as bigint) % 2 = 0"), 8, 4000.0))
_query("select_regression", lambda s, d: selection.select_regression(_steps(s, d), _train(s, d), 40, 5))
_query("regression_error", lambda s, d: selection.regression_error(_steps(s, d), _train(s, d), (20, 40)))
_query("locality_features", lambda s, d: selection.locality_features(_occ(s, d), (10, 40), src.UNIT, 4000.0))
_query("locality_classifier", lambda s, d: selection.locality_classifier(selection.locality_features(_occ(s, d), (10, 40), src.UNIT, 4000.0), (10, 40)))


def _selection_grid(s: SparkSession, d: str) -> DataFrame:
    return selection.selection_grid(_steps(s, d), {"greedy": selection.select_greedy}, (20, 40), (3, 5))


_REPORT = _PAIRS + ", st AS (SELECT topic, loc, (t - min(t) OVER (PARTITION BY topic)) // 21600 AS step FROM occ), ub AS (SELECT * FROM (VALUES (20, 3), (20, 5), (40, 3), (40, 5)) v(until, budget)), lo AS (SELECT until, budget, topic, loc, sum(CASE WHEN step >= until THEN 1 ELSE 0 END) AS later, sum(CASE WHEN step < until THEN 1 ELSE 0 END) AS before, count(*) AS n FROM st, ub GROUP BY ALL), be AS (SELECT *, row_number() OVER (PARTITION BY until, budget, topic ORDER BY later DESC, loc) <= budget AS best, before > 0 AND row_number() OVER (PARTITION BY until, budget, topic ORDER BY before DESC, loc) <= budget AS hit FROM lo), rp AS (SELECT 'greedy' AS model, CAST(until AS INTEGER) AS until, CAST(budget AS INTEGER) AS budget, topic, coalesce(sum(later) FILTER (best), 0) / sum(n) AS best_rate, coalesce(sum(later) FILTER (hit), 0) / sum(n) AS hit_rate, coalesce(sum(later) FILTER (hit), 0) / nullif(sum(later), 0) AS hit_rate_after, 1 - sum(later) / sum(n) AS miss_before, count(*) FILTER (best AND hit) / budget AS target_accuracy, (coalesce(sum(later) FILTER (best), 0) - coalesce(sum(later) FILTER (hit), 0)) / sum(n) AS rate_lag FROM be GROUP BY until, budget, topic HAVING bool_or(hit))"
_MEASURES = "best_rate hit_rate hit_rate_after miss_before target_accuracy rate_lag"
_query("selection_report", _selection_grid, _REPORT + "\nSELECT * FROM rp", _MEASURES)
for _by in ("until", "budget"):
    _query(f"selection_means_by_{_by}", lambda s, d, b=_by: selection.selection_means(_selection_grid(s, d), b), _REPORT + f"\nSELECT model, {_by}, count(*) AS n, " + ", ".join(f"avg({m}) AS {m}" for m in _MEASURES.split()) + f" FROM rp GROUP BY model, {_by}", _MEASURES)

# places, peaks and distances
_query("topics_at_location", lambda s, d: dist.topics_at_location(_occ(s, d)), _OCC + "\nSELECT cell, topic, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM occ GROUP BY ALL")
_query("occurrences_by_time_unit", lambda s, d: dist.occurrences_by_time_unit(_occ(s, d), 86400), _OCC + "\nSELECT t - t % 86400 AS tu, topic, cell, count(*) AS n FROM occ GROUP BY ALL")


def _countries(s: SparkSession) -> DataFrame:
    boxes = [("north", 1.0, -170.5, 79.5, 160.5), ("south", -60.5, -170.5, 1.0, 160.5)]
    rings = [(n, [{"lat": a, "lon": b}, {"lat": c, "lon": b}, {"lat": c, "lon": e}, {"lat": a, "lon": e}]) for n, a, b, c, e in boxes]
    return s.createDataFrame(rings, "country string, ring array<struct<lat:double,lon:double>>")


_query(
    "occurrences_by_country",
    lambda s, d: dist.occurrences_by_country(grid.country_of(_occ(s, d).groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n")), _countries(s), 14.5)),
    _OCC + ", k AS (SELECT CASE WHEN cj * 14.5 BETWEEN -170.5 AND 160.5 THEN CASE WHEN ci * 14.5 BETWEEN 1.0 AND 79.5 THEN 'north' WHEN ci * 14.5 BETWEEN -60.5 AND 1.0 THEN 'south' END END AS country FROM occ)\nSELECT country, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM k WHERE country IS NOT NULL GROUP BY country",
    "share",
)
_query("entropy_by_focus_by_peak", lambda s, d: dist.entropy_by_focus_by_peak(_metrics(s, d), (30, 60)), _MET + "\nSELECT CAST(before AS INTEGER) AS before, round(focus, 2) AS focus, count(*) AS n_topics, avg(entropy) AS entropy, avg(peak_iid) AS peak_iid FROM met, (SELECT unnest([30, 60]) AS before) WHERE peak_iid < before GROUP BY 1, 2", "focus entropy peak_iid")
_query("spread_classes_by_peak", lambda s, d: dist.spread_classes_by_peak(_metrics(s, d), 6, 60), _MET + ", c AS (SELECT CASE WHEN peak_iid <= 6 THEN 'early' WHEN peak_iid <= 60 THEN 'middle' ELSE 'late' END AS peak_class, CASE WHEN spread <= 1600 THEN 800 WHEN spread <= 4000 THEN 1600 ELSE 4000 END AS spread_class FROM met)\nSELECT peak_class, spread_class, count(*) AS n_topics, count(*) / sum(count(*)) OVER (PARTITION BY peak_class) AS share FROM c GROUP BY peak_class, spread_class".replace(", c AS (", ", cc AS (").replace("FROM c GROUP", "FROM cc GROUP"), "share")
_query("metric_by_spread_bin", lambda s, d: dist.metric_by_bin(_metrics(s, d), "spread", 250, 2), _MET + "\nSELECT CAST(floor(spread / 250) * 250 + 250 AS BIGINT) AS bin, count(*) AS n_topics, avg(entropy) AS entropy, avg(focus) AS focus, avg(spread) AS spread FROM met GROUP BY 1 HAVING count(*) > 2", "entropy focus spread")
_query("example_topics_by_location", lambda s, d: dist.example_topics_by_location(_metrics(s, d), 2), _MET + ", r AS (SELECT focus_cell, topic, row_number() OVER (PARTITION BY focus_cell ORDER BY focus, entropy DESC, topic) AS g, row_number() OVER (PARTITION BY focus_cell ORDER BY focus DESC, entropy, topic) AS l FROM met)\nSELECT focus_cell, topic, 'global' AS side, g AS rank FROM r WHERE g <= 2 UNION ALL SELECT focus_cell, topic, 'local', l FROM r WHERE l <= 2")


def _distances(s: SparkSession, d: str) -> DataFrame:
    return pr.pair_distances(_loc_topics(s, d), src.location_points(s, d))


_DIST = _PAIRS + _LOCT + f", pt AS (SELECT DISTINCT loc, {_POINT.format('loc')} FROM occ), p2 AS (SELECT a.loc AS l, b.loc AS r, count(*) AS n_common, avg(abs(a.first_t - b.first_t)) AS mean_gap FROM lt a JOIN lt b USING (topic) WHERE a.loc < b.loc GROUP BY ALL), pd AS (SELECT l, r, n_common, n_common / (x.k + y.k - n_common) AS jaccard, mean_gap, {_HAV.format('u.lat', 'u.lon', 'v.lat', 'v.lon')} AS distance FROM p2 JOIN sz x ON x.loc = l JOIN sz y ON y.loc = r JOIN pt u ON u.loc = l JOIN pt v ON v.loc = r)"
_BIN = "CAST(floor(distance / 500) * 500 + 500 AS BIGINT)"
_query("co_occurrence_by_distance", lambda s, d: dist.co_occurrence_by_distance(_distances(s, d), "n_common", 500), _DIST + f"\nSELECT {_BIN} AS bin, CAST(sum(n_common) AS BIGINT) AS n, sum(n_common) / sum(sum(n_common)) OVER () AS share FROM pd GROUP BY 1", "share")
_query("lag_by_distance", lambda s, d: dist.affinity_by_distance(_distances(s, d), "mean_gap", 500, 3), _DIST + f"\nSELECT {_BIN} AS bin, count(*) AS n, avg(mean_gap) AS mean FROM pd GROUP BY 1 HAVING count(*) > 3", "mean")
_sql["affinity_by_distance"] = _DIST.replace("\nSELECT", " SELECT") + f"\nSELECT bin, n, round(mean, 6) + 0.0 AS mean FROM (SELECT {_BIN} AS bin, count(*) AS n, avg(jaccard) AS mean FROM pd GROUP BY 1)"
_sql["locality_correlation"] = _DIST + f"\nSELECT count(*) AS n_bins, round(corr(bin, mean), 6) + 0.0 AS r FROM (SELECT {_BIN} AS bin, avg(jaccard) AS mean FROM pd GROUP BY 1)"
_OUTLIERS = "quantile_cont({0}, 0.25) OVER (PARTITION BY {1}) AS q1, quantile_cont({0}, 0.75) OVER (PARTITION BY {1}) AS q3"
_query("filtered_affinity_by_distance", lambda s, d: dist.filtered_affinity_by_distance(_distances(s, d), "jaccard", 500, 2), _DIST + f", q AS (SELECT bin, jaccard, {_OUTLIERS.format('jaccard', 'bin')} FROM (SELECT {_BIN} AS bin, round(jaccard, 9) AS jaccard FROM pd))\nSELECT bin, count(*) AS n, avg(jaccard) AS mean FROM q WHERE jaccard BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY bin HAVING count(*) > 2", "mean")
_query("pair_correlation", lambda s, d: dist.pair_correlation(_distances(s, d), "distance", "jaccard"), _DIST + "\nSELECT count(*) AS n, corr(distance, jaccard) AS r FROM pd", "r")
_query("rare_and_distant_pairs", lambda s, d: _distances(s, d).transform(lambda p: dist.rare_and_distant_pairs(p.select("l", "r", F.round("distance", 6).alias("distance"), F.col("n_common").alias("n")), 20)), _DIST + "\nSELECT l, r, round(distance, 6) + 0.0 AS distance, n_common AS n FROM pd ORDER BY round(distance, 6) DESC, n_common, l, r LIMIT 20")
_query("ks_statistic", lambda s, d: dist.ks_statistic(_occ(s, d).select("topic", "t", (F.col("lat") > 0).alias("north")), "t", "north", ["topic"]), _OCC + ", c AS (SELECT topic, t, sum(CASE WHEN lat > 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN lat > 0 THEN 0 ELSE 1 END) AS b FROM occ GROUP BY ALL), g AS (SELECT topic, a, b, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY topic) - sum(b) OVER w / sum(b) OVER (PARTITION BY topic)) AS gap FROM c WINDOW w AS (PARTITION BY topic ORDER BY t))\nSELECT topic, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, max(gap) AS d FROM g GROUP BY topic".replace(", c AS (SELECT topic, t, sum", ", kc AS (SELECT topic, t, sum").replace("AS gap FROM c WINDOW", "AS gap FROM kc WINDOW"), "d")
_FAR = f"{_HAV.format('lat', 'lon', 'a', 'b')}"
_RADIUS = "{0} AS (SELECT {1}, avg(m) AS radius FROM (SELECT {1}, m, quantile_cont(m, 0.25) OVER (PARTITION BY {1}) AS q1, quantile_cont(m, 0.75) OVER (PARTITION BY {1}) AS q3 FROM (SELECT {1}, round(" + _FAR + ", 6) AS m FROM {2} JOIN (SELECT {1}, avg(lat) AS a, avg(lon) AS b FROM {2} GROUP BY {1}) USING ({1}))) WHERE m <= q3 + 1.5 * (q3 - q1) GROUP BY {1})"
_query(
    "early_radius_error",
    lambda s, d: met.early_radius_error(_occ(s, d), src.UNIT, (20, 60), 500, 10, 2),
    _OCC + ", pl AS (SELECT *, (t - min(t) OVER (PARTITION BY topic)) // 21600 AS place FROM occ), ex AS (SELECT topic, lat, lon, units FROM pl, (SELECT unnest([20, 60]) AS units) WHERE place < units QUALIFY count(*) OVER (PARTITION BY topic, units) > 10), " + _RADIUS.format("er", "topic, units", "ex") + ", " + _RADIUS.format("fr", "topic", "occ") + "\nSELECT CAST(units AS INTEGER) AS units, CAST(floor(round(abs(er.radius - fr.radius), 6) / 500) * 500 + 500 AS BIGINT) AS bin, count(*) AS n_topics FROM er JOIN fr USING (topic) GROUP BY 1, 2 HAVING count(*) >= 2",
)


def _spans(s: SparkSession, d: str) -> DataFrame:
    reg = tl.active_regions(_occ(s, d), src.UNIT, 2, 1).where("is_highest")
    return reg.select("topic", (F.substring("topic", 2, 9).cast("bigint") % 3).alias("class_id"), ((F.col("end_bucket") - F.col("start_bucket")) / 3600).alias("hours"))


_SPAN = _OCC + _REGION + ", sn AS (SELECT topic, CAST(substr(topic, 2) AS BIGINT) % 3 AS class_id, (end_bucket - start_bucket) / 3600 AS hours FROM reg WHERE is_highest), sq AS (SELECT *, quantile_cont(hours, 0.25) OVER (PARTITION BY class_id) AS q1, quantile_cont(hours, 0.75) OVER (PARTITION BY class_id) AS q3 FROM sn)"
_query("life_span_outlier_bound", lambda s, d: met.outlier_bound(_spans(s, d), "hours", ["class_id"]), _SPAN + "\nSELECT class_id, q3 + 1.5 * (q3 - q1) AS bound, count(*) AS n, avg(hours) AS mean FROM sq WHERE hours <= q3 + 1.5 * (q3 - q1) GROUP BY class_id, q1, q3", "bound mean")
_query("valid_topics", lambda s, d: met.valid_topics(_spans(s, d), {0: 400.0, 1: 500.0, 2: 600.0}), _SPAN + "\nSELECT topic, class_id, hours FROM sn WHERE hours <= CASE class_id WHEN 0 THEN 400 WHEN 1 THEN 500 ELSE 600 END", "hours")
_query("lag_outlier_bound", lambda s, d: met.outlier_bound(_distances(s, d), "mean_gap"), _DIST + ", q AS (SELECT mean_gap, quantile_cont(mean_gap, 0.25) OVER () AS q1, quantile_cont(mean_gap, 0.75) OVER () AS q3 FROM pd)\nSELECT q3 + 1.5 * (q3 - q1) AS bound, count(*) AS n, avg(mean_gap) AS mean FROM q WHERE mean_gap <= q3 + 1.5 * (q3 - q1) GROUP BY q1, q3", "bound mean")
_query("focus_location_counts", lambda s, d: met.focus_location_counts(_occ(s, d), src.UNIT), _OCC + ", fo AS (SELECT topic, cell FROM (SELECT topic, iid, first(cell ORDER BY c DESC, cell) AS cell FROM (SELECT topic, (bucket - (SELECT min(bucket) FROM occ i WHERE i.topic = o.topic)) // 21600 AS iid, cell, count(*) AS c FROM occ o GROUP BY ALL) GROUP BY ALL) GROUP BY ALL), fc AS (SELECT n_cells, count(*) AS n_topics FROM (SELECT topic, count(*) AS n_cells FROM fo GROUP BY topic) GROUP BY n_cells)\nSELECT n_cells, n_topics, sum(n_topics) OVER (ORDER BY n_cells) / sum(n_topics) OVER () AS cdf FROM fc", "cdf")

# pairs, graphs and influence
_query("filtered_sharing", lambda s, d: pr.filtered_sharing(_loc_topics(s, d)), _PAIRS + _LOCT + f", lg AS (SELECT a.loc AS l, b.loc AS r, a.first_t AS tl, b.first_t AS tr, abs(a.first_t - b.first_t) AS lag FROM lt a JOIN lt b USING (topic) WHERE a.loc < b.loc), lq AS (SELECT *, {_OUTLIERS.format('lag', 'l, r')} FROM lg), ok AS (SELECT * FROM lq WHERE lag BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), di AS (SELECT l AS loc, r AS nbr, tl < tr AS early FROM ok UNION ALL SELECT r, l, tr < tl FROM ok)\nSELECT di.loc, nbr, count(*) / any_value(k) AS p_share, count(*) FILTER (early) / any_value(k) AS p_transmit FROM di JOIN sz ON sz.loc = di.loc GROUP BY di.loc, nbr", "p_share p_transmit")
_query("node_weights", lambda s, d: pr.node_weights(src.occ_few_topics(s, d), 86400, 2, "loc"), _FEW + ", nr AS (SELECT t - t % 86400 AS ep, topic, loc, count(*) AS n FROM occ GROUP BY ALL HAVING count(*) >= 2), nw AS (SELECT ep, loc, n FROM nr QUALIFY count(*) OVER (PARTITION BY ep, topic) >= 2)\nSELECT ep, loc AS node, CAST(sum(n) AS BIGINT) AS w FROM nw GROUP BY ep, loc")
_query(
    "probability_graph",
    lambda s, d: pr.probability_graph(_loc_topics(s, d), grid.within_bbox(src.location_points(s, d), BOX), 0.25),
    _PAIRS + _LOCT + _LINK + f", pt AS (SELECT DISTINCT loc, {_POINT.format('loc')} FROM occ), ib AS (SELECT loc FROM pt WHERE lat BETWEEN -60 AND 60 AND lon BETWEEN -100 AND 50), pg AS (SELECT lk.loc AS u, nbr AS v, round(k / (SELECT count(DISTINCT topic) FROM lt) * (n_common / k), 9) AS w FROM lk JOIN sz USING (loc) WHERE lk.loc IN (FROM ib) AND nbr IN (FROM ib)), pq AS (SELECT *, row_number() OVER (ORDER BY w DESC, u, v) AS rank, count(*) OVER () AS m FROM pg)\nSELECT u, v, w FROM pq WHERE rank <= ceil(m * 0.25)",
    "w",
)
_query("probability_graph_clusters", lambda s, d: cl.markov_clusters(_undirected(pr.probability_graph(_loc_topics(s, d), grid.within_bbox(src.location_points(s, d), BOX), 0.25))))


def _undirected(directed: DataFrame) -> DataFrame:
    """Undirected (u, v, w) of directed edges, with the larger weight."""
    return directed.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w"))


_query(
    "coarse_cell_pairs",
    lambda s, d: grid.coarse_cell_pairs(pr.focus_pairs(_focus(s, d), 2), 14.5, 2, 2),
    _FOCUS + f", fp AS (SELECT a.cell AS l, b.cell AS r FROM fo a JOIN fo b USING (topic) WHERE a.cell < b.cell GROUP BY ALL HAVING count(*) >= 2), ix AS (SELECT CAST(round(l / 1e7) AS BIGINT) AS li, CAST(round(r / 1e7) AS BIGINT) AS ri, l, r FROM fp), wi AS (SELECT CAST(trunc(li / 2) AS BIGINT) AS a, CAST(trunc((l - li * 10000000) / 2) AS BIGINT) AS b, CAST(trunc(ri / 2) AS BIGINT) AS c, CAST(trunc((r - ri * 10000000) / 2) AS BIGINT) AS e FROM ix), wk AS (SELECT a * 10000000 + b AS x, c * 10000000 + e AS y FROM wi), wp AS (SELECT least(x, y) AS l, greatest(x, y) AS r, count(*) AS n FROM wk WHERE x <> y GROUP BY 1, 2), wj AS (SELECT l, r, n, round(l / 1e7) AS p, round(r / 1e7) AS q FROM wp), wd AS (SELECT l, r, n, CAST(round({_HAV.format('p * 29.0', '(l - p * 10000000) * 29.0', 'q * 29.0', '(r - q * 10000000) * 29.0')}) AS BIGINT) AS distance FROM wj)\nSELECT l, r, distance, n FROM wd QUALIFY row_number() OVER (PARTITION BY distance ORDER BY n DESC, l, r) <= 2",
)
_query(
    "top_bottom_neighbours",
    lambda s, d: dist.top_bottom(_influence(s, d), "loc", "nbr", "score", 2),
    _INF + ", rn AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY round(score, 9) DESC, nbr) AS h, row_number() OVER (PARTITION BY loc ORDER BY round(score, 9), nbr) AS l FROM inf)\nSELECT loc, nbr, score, 'top' AS side, h AS rank FROM rn WHERE h <= 2 UNION ALL SELECT loc, nbr, round(score, 6), 'bottom', l FROM rn WHERE l <= 2",
    "score",
)
for _kind, _cond in (("incoming", "score < 0"), ("outgoing", "score > 0")):
    _query(f"influencers_{_kind}", lambda s, d, k=_kind: infl.influencers(_influence(s, d), k, 3), _INF + f", ir AS (SELECT loc, nbr AS other, abs(score) AS score, row_number() OVER (PARTITION BY loc ORDER BY abs(score) DESC, nbr) AS rank FROM inf WHERE {_cond})\nSELECT loc, other, score FROM ir WHERE rank <= 3", "score")
    _query(f"influence_vectors_{_kind}", lambda s, d, k=_kind: infl.directed_vectors(_influence(s, d), k, 5), _INF + f", vr AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY abs(score) DESC, nbr) AS rank FROM inf WHERE {_cond}), vt AS (FROM vr WHERE rank <= 5)\nSELECT loc, nbr, score / sqrt(sum(score * score) OVER (PARTITION BY loc)) AS x FROM vt", "x")


def _similarity(s: SparkSession, d: str) -> DataFrame:
    both = infl.similarity_with_jaccard(infl.influence_vectors(_influence(s, d)), src.occ_pairs(s, d))
    return dist.with_distance(both, src.location_points(s, d), "loc")


_SIMILAR = _INF + f", v AS (SELECT loc, nbr, CASE WHEN z > 0 THEN score / z ELSE 0 END AS x FROM (SELECT *, sqrt(sum(score * score) OVER (PARTITION BY loc)) AS z FROM inf)), vs AS (SELECT a.loc AS l, b.loc AS r, sum(a.x * b.x) AS similarity FROM v a JOIN v b USING (nbr) WHERE a.loc < b.loc GROUP BY ALL), jc AS (SELECT a.loc AS l, b.loc AS r, count(*) AS c FROM own a JOIN own b USING (topic) WHERE a.loc < b.loc GROUP BY ALL), jx AS (SELECT l, r, c / (x.k + y.k - c) AS jaccard FROM jc JOIN k x ON x.loc = l JOIN k y ON y.loc = r), pt AS (SELECT DISTINCT loc, {_POINT.format('loc')} FROM occ), sm AS (SELECT vs.l, vs.r, similarity, jaccard, {_HAV.format('u.lat', 'u.lon', 'w.lat', 'w.lon')} AS distance FROM vs JOIN jx ON jx.l = vs.l AND jx.r = vs.r JOIN pt u ON u.loc = vs.l JOIN pt w ON w.loc = vs.r)"
_query("influence_similarity_jaccard", lambda s, d: _similarity(s, d).drop("distance"), _SIMILAR + "\nSELECT l, r, similarity, jaccard FROM sm", "similarity jaccard")
_query("similarity_by_jaccard", lambda s, d: infl.similarity_by(_similarity(s, d), F.round("jaccard", 1)), _SIMILAR + "\nSELECT round(jaccard, 1) AS bin, count(*) AS n, avg(similarity) AS similarity FROM sm GROUP BY 1", "bin similarity")
_query("similarity_by_distance", lambda s, d: infl.similarity_by(_similarity(s, d), (F.floor(F.col("distance") / 500) * 500 + 500).cast("bigint")), _SIMILAR + f"\nSELECT {_BIN} AS bin, count(*) AS n, avg(similarity) AS similarity FROM sm GROUP BY 1", "similarity")
_query("similarity_correlation", lambda s, d: dist.pair_correlation(_similarity(s, d), "jaccard", "similarity"), _SIMILAR + "\nSELECT count(*) AS n, corr(jaccard, similarity) AS r FROM sm", "r")
_CLASS = "CAST(substr(topic, 2) AS BIGINT) % 3"
_query(
    "transmission_by_class",
    lambda s, d: infl.transmission_by_class(src.occ_pairs(s, d), src.occ_pairs(s, d).select("topic", (F.substring("topic", 2, 9).cast("bigint") % 3).alias("class")).distinct()),
    _BA + f", ow AS (SELECT *, {_CLASS} AS class FROM own), kc AS (SELECT class, loc, count(*) AS k, sum(n) AS total FROM ow GROUP BY ALL)\nSELECT ow.class, sc.loc, sc.nbr, count(*) AS n_common, avg(sc.aggregate * ow.n / kc.total) * count(*) / any_value(kc.k) AS score FROM sc JOIN ow ON ow.topic = sc.topic AND ow.loc = sc.loc JOIN kc ON kc.loc = sc.loc AND kc.class = ow.class WHERE ow.class <> 0 GROUP BY ow.class, sc.loc, sc.nbr",
    "score",
)
_query("zone_spans", lambda s, d: infl.zone_spans(cl.influence_zones(infl.boundary_influence(_influence(s, d), 25), 0.00002)))


def _overlap(s: SparkSession, d: str) -> DataFrame:
    both = infl.before_after(src.occ_pairs(s, d))
    return infl.model_overlap(*[infl.mean_scores(both, m).groupBy("loc").agg(F.sum("score").alias("score")) for m in ("aggregate", "first_occurrence")], 10)


_query("model_overlap", _overlap, _BA + ", ta AS (SELECT loc, sum(a) AS x, sum(f) AS y FROM (SELECT topic, loc, avg(aggregate) AS a, avg(first_occurrence) AS f FROM sc GROUP BY ALL) GROUP BY loc), to_ AS (SELECT row_number() OVER (ORDER BY round(x, 9) DESC, loc) AS i, row_number() OVER (ORDER BY round(y, 9) DESC, loc) AS j FROM ta)\nSELECT count(*) / 10 AS overlap FROM to_ WHERE i <= 10 AND j <= 10", "overlap")

# words and topics
_query("all_word_pairs", lambda s, d: assoc.all_pairs(_table(s, d)), _WORDS + "\nSELECT *, 0.0 AS p, true AS is_significant FROM ct", "p")
_query("only_locations", lambda s, d: grid.only_locations(_occ(s, d), dist.top_locations(_occ(s, d), 20)).groupBy("cell").agg(F.count("*").alias("n")), _OCC + "\nSELECT cell, count(*) AS n FROM occ GROUP BY cell ORDER BY n DESC, cell LIMIT 20")
_query("min_topic_at_location", lambda s, d: tl.min_topic_at_location(_occ(s, d), 2).groupBy("cell").agg(F.count("*").alias("n")), _OCC + "\nSELECT cell, CAST(sum(n) AS BIGINT) AS n FROM (SELECT cell, topic, count(*) AS n FROM occ GROUP BY ALL HAVING count(*) >= 2) GROUP BY cell")
_query("cell_points", lambda s, d: grid.cell_point(_occ(s, d).select("ci", "cj").distinct(), 14.5), _OCC + "\nSELECT DISTINCT ci, cj, ci * 14.5 AS cell_lat, cj * 14.5 AS cell_lon FROM occ", "cell_lat cell_lon")
_query("decay_curve", lambda s, d: tl.decay_curve(tl.interval_counts(_occ(s, d), src.UNIT), 50), _OCC + ", ch AS (SELECT iid, (n - lag(n, 1, 0) OVER (PARTITION BY topic ORDER BY iid)) / sum(n) OVER (PARTITION BY topic) AS change FROM iv JOIN pk USING (topic) WHERE peak_iid < 288)\nSELECT iid, avg(change) AS mean_change FROM ch GROUP BY iid ORDER BY iid LIMIT 50", "mean_change")

# SQL of queries that are registered elsewhere
_CHI = _WORDS + ", x AS (SELECT *, (n00 + n01 + n10 + n11)::DOUBLE AS nn, greatest(abs(n00::DOUBLE * n11 - n01::DOUBLE * n10) - (n00 + n01 + n10 + n11) / 2, 0) AS o, (n00 + n01)::DOUBLE * (n10 + n11) * (n00 + n10) * (n01 + n11) AS mg FROM ct), sg AS (SELECT word, topic FROM x WHERE mg > 0 AND nn * o * o / mg > 6.6349)"
_sql["topic_groups"] = "WITH RECURSIVE" + _CHI[4:] + ", tt AS (SELECT DISTINCT a.topic AS a, b.topic AS b FROM sg a JOIN sg b USING (word)), re AS (SELECT a AS node, b AS seen FROM tt UNION SELECT re.node, tt.b FROM re JOIN tt ON re.seen = tt.a), gl AS (SELECT node AS topic, min(seen) AS g FROM re GROUP BY node), gt AS (SELECT g, count(*) AS n_topics FROM gl GROUP BY g), mem AS (SELECT g, 't:' || topic AS node FROM gl UNION SELECT g, 'w:' || word FROM sg JOIN gl USING (topic))\nSELECT 't:' || g AS group_id, node, n_topics FROM mem JOIN gt USING (g)"
_sql["volume_similarity_lag"] = _with_rounding(
    f"WITH occ AS (SELECT 'p' || (l_partkey % 200) AS topic, s_nationkey AS loc, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), f AS (SELECT loc, topic, min(t - t % 86400) AS ft FROM occ GROUP BY ALL), q AS (SELECT *, {_OUTLIERS.format('ft', 'topic')} FROM f), g AS (SELECT loc, topic, ft FROM q WHERE ft BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), k AS (SELECT loc, count(*) AS k FROM g GROUP BY loc), p2 AS (SELECT a.loc AS l, b.loc AS r, count(*) AS n_common, avg(abs(a.ft - b.ft) / 86400) AS adoption_lag FROM g a JOIN g b USING (topic) WHERE a.loc < b.loc GROUP BY ALL HAVING count(*) > 10)\nSELECT l, r, n_common, n_common / (x.k + y.k - n_common) AS similarity, adoption_lag FROM p2 JOIN k x ON x.loc = l JOIN k y ON y.loc = r",
    "similarity adoption_lag",
)
_sql["life_fraction_at_share"] = _with_rounding(_PAIRS + ", w AS (SELECT t, row_number() OVER (PARTITION BY topic, loc ORDER BY t) AS rank, count(*) OVER (PARTITION BY topic, loc) AS n, min(t) OVER (PARTITION BY topic, loc) AS a, max(t) OVER (PARTITION BY topic, loc) AS b FROM occ), at_ AS (SELECT p, CAST(floor((t - a) * 100 / (b - a)) AS BIGINT) AS place FROM w, (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS p) WHERE n > 3 AND b > a AND rank = greatest(floor(round(p * n, 6)), 1))\nSELECT p, place, count(*) / sum(count(*)) OVER (PARTITION BY p) AS weight FROM at_ GROUP BY p, place", "p weight")
_sql["in_out_closeness"] = _with_rounding(
    _PAIRS + _LOCT + _PERIOD + f", er AS (SELECT topic, loc, row_number() OVER (PARTITION BY topic ORDER BY t, loc) AS rank, floor(count(*) OVER (PARTITION BY topic) * 0.1) AS upto FROM occ), so AS (SELECT topic, first(loc ORDER BY n DESC, loc) AS s FROM (SELECT topic, loc, count(*) AS n FROM er WHERE rank <= upto GROUP BY ALL) GROUP BY topic), la AS (SELECT so.s, lt.loc, {_SCORE.format('(lt.first_t - o.first_t)')} AS x FROM so JOIN lt o ON o.topic = so.topic AND o.loc = so.s JOIN lt ON lt.topic = so.topic AND lt.loc <> so.s AND lt.first_t > o.first_t JOIN pe ON pe.topic = so.topic), io AS (SELECT s AS loc, loc AS nbr, 'out_link' AS link_type, x FROM la WHERE x >= 0.05 UNION ALL SELECT loc, s, 'in_link', x FROM la WHERE x >= 0.05)\nSELECT loc, nbr, link_type, count(*) AS n_topics, avg(x) AS mean_score FROM io GROUP BY loc, nbr, link_type",
    "mean_score",
)
_sql["classify_topic"] = _with_rounding(_OCC + _REGION + ", " + _RADIUS.format("cr", "topic", "ho") + ", fb AS (SELECT topic, count(*) AS n FROM occ JOIN reg USING (topic) WHERE is_highest AND bucket = start_bucket GROUP BY topic)\nSELECT topic, radius, radius < 500 AS is_local, n > 1 AS is_sudden FROM cr JOIN fb USING (topic)", "radius")
_sql["lead_lag_kde"] = _with_rounding(
    _PAIRS + _MAJ + ", pp AS (SELECT a.cell AS l, b.cell AS r, count(*) AS n, avg(sign(a.bucket - b.bucket)) AS m FROM m1 a JOIN m1 b USING (topic) WHERE a.cell < b.cell AND a.bucket <> b.bucket GROUP BY ALL HAVING count(*) >= 5), vc AS (SELECT round(m, 4) AS v, count(*) AS c FROM pp GROUP BY 1), sd AS (SELECT stddev_samp(m) * 0.25 AS h, count(*) AS n FROM pp), gx AS (SELECT unnest(range(0, 100)) AS i)\nSELECT -1.0::DOUBLE + i * (2.0::DOUBLE / 99) AS x, sum(c * exp(-pow((-1.0::DOUBLE + i * (2.0::DOUBLE / 99) - v) / h, 2) / 2) / (n * h * 2.5066282746310002)) AS density FROM gx, vc, sd GROUP BY i",
    "x density",
)
_LG = "lgamma({} + 1)"
_LP = f"(base - {_LG.format('{0}')} - {_LG.format('(r - {0})')} - {_LG.format('(c - {0})')} - {_LG.format('(n - r - c + {0})')})"
_sql["fisher_exact"] = _with_rounding(_WORDS + f", mg AS (SELECT *, n00 + n01 AS r, n00 + n10 AS c, n00 + n01 + n10 + n11 AS n FROM ct), ba AS (SELECT *, {_LG.format('r')} + {_LG.format('(n - r)')} + {_LG.format('c')} + {_LG.format('(n - c)')} - {_LG.format('n')} AS base FROM mg), su AS (SELECT word, topic, n00, n01, n10, n11, {_LP.format('n00')} AS own, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) AS x, r, c, n, base FROM ba)\nSELECT word, topic, n00, n01, n10, n11, least(sum(CASE WHEN {_LP.format('x')} <= own + 1e-7 THEN exp({_LP.format('x')}) ELSE 0 END), 1.0) AS p FROM su GROUP BY word, topic, n00, n01, n10, n11", "p")
