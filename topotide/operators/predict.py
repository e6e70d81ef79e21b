"""Predicting the topics of locations, and learning which model to trust.

Windows, models and k are columns: one plan covers every hour.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topotide.functions.columns import bin_up, haversine, spread_kernel
from topotide.functions.statistics import correlation
from topotide.operators.timeline import drop_outliers


def window_counts(occ: DataFrame, history: int, future: int, unit: int = 3600, loc: str = "loc") -> tuple[DataFrame, DataFrame]:
    """History and future counts (tu, loc, topic, n): each bucket is dealt to the windows that hold it.

    The history of tu is [tu - history, tu), its future [tu, tu + future), in
    units; only times with both count.
    """
    b = occ.groupBy((F.col("t") - F.pmod(F.col("t"), F.lit(unit))).alias("b"), F.col(loc).alias("loc"), "topic").agg(F.count("*").alias("n"))
    past = b.withColumn("tu", F.explode(F.sequence(F.col("b") + unit, F.col("b") + history * unit, F.lit(unit).cast("bigint"))))
    ahead = b.withColumn("tu", F.explode(F.sequence(F.col("b") - (future - 1) * unit, F.col("b"), F.lit(unit).cast("bigint"))))
    h = past.groupBy("tu", "loc", "topic").agg(F.sum("n").alias("n"))
    f = ahead.groupBy("tu", "loc", "topic").agg(F.sum("n").alias("n"))
    return h, f


def top_k(scored: DataFrame, k: int, keys: Sequence[str] = ("tu", "loc", "model")) -> DataFrame:
    """The k best topics of each ranking, with rank; scores that agree to nine digits tie and go by topic."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "topic")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ideal_ranking(future: DataFrame) -> DataFrame:
    """(tu, loc, topic, score): share of each topic in the location's future."""
    total = F.sum("n").over(Window.partitionBy("tu", "loc"))
    return future.select("tu", "loc", "topic", (F.col("n") / total).alias("score"))


def predict_random(history: DataFrame, seed: int = 1) -> DataFrame:
    """Topics of the history in an order by hash."""
    topics = history.select("tu", "topic").distinct()
    rows = history.select("tu", "loc").distinct().join(topics, "tu")
    return rows.select("tu", "loc", "topic", F.lit("random").alias("model"), (F.pmod(F.xxhash64(F.lit(seed), "tu", "loc", "topic"), F.lit(1 << 30)) / float(1 << 30)).alias("score"))


def predict_greedy(history: DataFrame) -> DataFrame:
    return ideal_ranking(history).withColumn("model", F.lit("greedy"))


def predict_by_links(history: DataFrame, links: DataFrame, model: str) -> DataFrame:
    """Sum of p(loc, nbr) over neighbours with the topic; the location itself counts 1."""
    seen = history.select("tu", F.col("loc").alias("nbr"), "topic").distinct()
    own = history.select("loc").distinct().select("loc", F.col("loc").alias("nbr"), F.lit(1.0).alias("p"))
    p = links.select("loc", "nbr", F.col("p").cast("double").alias("p")).where("loc <> nbr").unionByName(own)
    return seen.join(p, "nbr").groupBy("tu", "loc", "topic").agg(F.sum("p").alias("score")).withColumn("model", F.lit(model))


def predict_with_coverage(history: DataFrame, links: DataFrame, coverage: DataFrame, model: str) -> DataFrame:
    """Sum over neighbours with the topic of p(loc, nbr) times the topic's coverage score at the neighbour; the location itself has p = 1."""
    seen = history.select("tu", F.col("loc").alias("nbr"), "topic").distinct()
    cover = seen.join(coverage.select("tu", F.col("loc").alias("nbr"), "topic", F.col("score").alias("c")), ["tu", "nbr", "topic"])
    own = history.select("loc").distinct().select("loc", F.col("loc").alias("nbr"), F.lit(1.0).alias("p"))
    p = links.select("loc", "nbr", F.col("p").cast("double").alias("p")).where("loc <> nbr and p <> 0").unionByName(own)
    return cover.join(p, "nbr").groupBy("tu", "loc", "topic").agg(F.sum(F.col("p") * F.col("c")).alias("score")).withColumn("model", F.lit(model))


def ranking_dataset(scored: DataFrame, future: DataFrame, k: int) -> DataFrame:
    """(tu, loc, model, topic, score, rank): the k best topics of each model, and of the future as the model ideal."""
    both = scored.select("tu", "loc", "model", "topic", "score").unionByName(ideal_ranking(future).select("tu", "loc", F.lit("ideal").alias("model"), "topic", "score"))
    return top_k(both, k).withColumn("rank", F.col("rank").cast("bigint"))


def rankings_by_location(rankings: DataFrame, k: int) -> DataFrame:
    """Rows of ``rankings`` up to rank k where all models have a ranking and the ideal one has k topics."""
    models = rankings.agg(F.count_distinct("model").alias("models"))
    sizes = rankings.where(F.col("rank") <= k).groupBy("tu", "loc").agg(F.count_distinct("model").alias("m"), F.sum(F.when(F.col("model") == "ideal", 1).otherwise(0)).alias("n"))
    good = sizes.crossJoin(F.broadcast(models)).where((F.col("m") == F.col("models")) & (F.col("n") >= k)).select("tu", "loc")
    return rankings.where(F.col("rank") <= k).join(good, ["tu", "loc"], "left_semi")


def model_gaps(rankings: DataFrame, better: str, worse: str) -> DataFrame:
    """(tu, loc, better, worse, gap): how many ideal topics two models have, for ``rankings_by_location`` rows."""
    ideal = rankings.where("model = 'ideal'").select("tu", "loc", "topic")
    n = rankings.where(F.col("model").isin(better, worse)).join(ideal.withColumn("hit", F.lit(1)), ["tu", "loc", "topic"], "left")
    count = lambda m: F.sum(F.when((F.col("model") == m) & (F.col("hit") == 1), 1).otherwise(0))
    both = n.groupBy("tu", "loc").agg(count(better).alias("better"), count(worse).alias("worse"))
    return both.withColumn("gap", F.col("better") - F.col("worse"))


def window_grid(occ: DataFrame, windows: Sequence[tuple[int, int]], unit: int = 3600, loc: str = "loc") -> tuple[DataFrame, DataFrame]:
    """``window_counts`` of all (h, p) of ``windows`` in one plan: tu is a struct of h, p and the time.

    Every predictor and measure takes tu as a key alone, so each window goes
    through them as times of its own.
    """
    sizes = F.explode(F.array(*[F.struct(F.lit(int(h)).alias("h"), F.lit(int(p)).alias("p")) for h, p in windows])).alias("w")
    b = occ.groupBy((F.col("t") - F.pmod(F.col("t"), F.lit(unit))).alias("b"), F.col(loc).alias("loc"), "topic").agg(F.count("*").alias("n")).select("*", sizes)
    step = F.lit(unit).cast("bigint")
    past, ahead = F.sequence(F.col("b") + unit, F.col("b") + F.col("w.h") * unit, step), F.sequence(F.col("b") - (F.col("w.p") - 1) * unit, F.col("b"), step)
    key = F.struct(F.col("w.h").alias("h"), F.col("w.p").alias("p"), F.col("at").alias("tu")).alias("tu")
    return tuple(b.withColumn("at", F.explode(x)).groupBy(key, "loc", "topic").agg(F.sum("n").alias("n")) for x in (past, ahead))


def performance_grid(occ: DataFrame, rank: Callable[[DataFrame], DataFrame], windows: Sequence[tuple[int, int]], ks: Sequence[int], names: Sequence[str] | None = None, unit: int = 3600, loc: str = "loc") -> DataFrame:
    """``evaluate`` rows with the lengths h and p of history and future, for each (h, p) of ``windows``; ``rank`` scores a history."""
    history, future = window_grid(occ, windows, unit, loc)
    rows = evaluate(rank(history), future, ks, names)
    return rows.select("tu.h", "tu.p", "tu.tu", *[c for c in rows.columns if c != "tu"])


def all_models(history: DataFrame, points: DataFrame, sharing: DataFrame, transmitting: DataFrame, seed: int | None = None) -> DataFrame:
    """The rankings of every model: greedy, by links, by coverage, their combinations, and with a seed random."""
    coverage = {k: predict_coverage(history, points, k) for k in ("probability", "distance")}
    links = {"sharing": sharing, "transmitting": transmitting}
    parts = [predict_greedy(history), *coverage.values()]
    parts += [predict_by_links(history, p, name) for name, p in links.items()]
    parts += [predict_with_coverage(history, p, c, f"{name}_coverage_{k}") for name, p in links.items() for k, c in coverage.items()]
    parts += [predict_random(history, seed)] if seed is not None else []
    return reduce(DataFrame.unionByName, [p.select("tu", "loc", "topic", "model", "score") for p in parts])


def performance_curve(scored: DataFrame, future: DataFrame, most: int = 24, names: Sequence[str] | None = None) -> DataFrame:
    """``evaluate`` rows for every k from 1 to ``most``, from one ranking a model.

    A predicted topic counts from its rank on for the impact, and from the
    later of its rank and its place among the best for the accuracy; so the
    values at all k are running sums over at most ``most`` topics, and no
    ranking is repeated for each k.
    """
    ideal = ideal_ranking(future)
    best = top_k(ideal, most, ("tu", "loc")).select("tu", "loc", "topic", F.col("rank").alias("place"))
    shares = ideal.select("tu", "loc", "topic", F.col("score").alias("share")).join(best, ["tu", "loc", "topic"], "left")
    wholes = shares.where("place is not null").groupBy("tu", "loc").agg(F.sort_array(F.collect_list(F.struct("place", "share"))).alias("best"))
    mine = top_k(scored, most).select("tu", "loc", "model", "topic", "rank").join(shares, ["tu", "loc", "topic"])
    hits = mine.groupBy("tu", "loc", "model").agg(F.sort_array(F.collect_list(F.struct("rank", F.greatest("rank", "place").alias("both"), "share", "place"))).alias("hits"))
    if names is None:
        named = wholes.crossJoin(F.broadcast(scored.select("model").distinct()))  # a handful of names
    else:
        named = wholes.withColumn("model", F.explode(F.array(*[F.lit(m) for m in names])))
    present = scored.select("tu", "loc", "model").distinct().withColumn("ranked", F.lit(True))
    rows = named.join(hits, ["tu", "loc", "model"], "left").join(present, ["tu", "loc", "model"], "left")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    total = lambda name, upto, value: F.aggregate(F.filter(F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType)), upto), F.lit(0.0), lambda s, x: s + value(x))
    m = F.least(F.col("k"), F.size("best"))
    best_share = total("best", lambda x: x["place"] <= F.col("k"), lambda x: x["share"])
    hit = total("hits", lambda x: x["place"].isNotNull() & (x["both"] <= F.col("k")), lambda x: F.lit(1.0))
    got = total("hits", lambda x: x["rank"] <= F.col("k"), lambda x: x["share"])
    sums = rows.select("tu", "loc", "model", "k", m.alias("m"), best_share.alias("whole"), hit.alias("hit"), got.alias("got"), F.coalesce("ranked", F.lit(False)).alias("ranked"))
    return sums.select("tu", "loc", "model", "k", (F.col("hit") / F.col("m")).alias("accuracy"), (F.col("got") / F.col("whole")).alias("impact"), F.when(F.col("ranked"), F.col("whole") - F.col("got")).otherwise(1.0).alias("difference"))


def performance_by(grid: DataFrame, param: str, **fixed: int) -> DataFrame:
    """(param, model, n, accuracy, impact): means by h, p or k with the other two fixed."""
    for name, value in fixed.items():
        grid = grid.where(F.col(name) == value)
    return grid.groupBy(F.col(param).alias("param"), "model").agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy"), F.avg("impact").alias("impact"))


def performance_by_location(evaluated: DataFrame) -> DataFrame:
    """(loc, model, accuracy, impact): the best values of each location and model."""
    return evaluated.groupBy("loc", "model").agg(F.max("accuracy").alias("accuracy"), F.max("impact").alias("impact"))


def best_model_by_location(evaluated: DataFrame, order: Sequence[str]) -> DataFrame:
    """(loc, model, accuracy): the model with the highest mean accuracy; ties go by ``order``."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    means = evaluated.groupBy("loc", "model").agg(F.avg("accuracy").alias("accuracy"))
    best = means.groupBy("loc").agg(F.min(F.struct((-F.round("accuracy", 9)).alias("a"), place.alias("o"), "model", "accuracy")).alias("b"))
    return best.select("loc", "b.model", "b.accuracy")


def performance_by_area(best: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, model, n, share): the mix of best models in each area; ``areas`` has (loc, area)."""
    counts = best.join(areas, "loc").groupBy("area", "model").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("area")))


def score_distribution(best: DataFrame, areas: DataFrame, bins: int = 20) -> DataFrame:
    """(area, bin, n, ccdf): how many locations of an area have a score in each bin, and the share in it or above."""
    b = F.least(F.floor(F.round("accuracy", 9) * bins), F.lit(bins - 1))
    counts = best.join(areas, "loc").groupBy("area", b.alias("bin")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("area").orderBy(F.desc("bin"))
    return counts.withColumn("ccdf", F.sum("n").over(above) / F.sum("n").over(Window.partitionBy("area")))


def predict_coverage(history: DataFrame, points: DataFrame, kind: str = "probability") -> DataFrame:
    """Counts of the history spread to every location by the distance kernel.

    probability normalises a topic over locations, distance a location over
    topics.  The kernel is one row for each ordered pair of ``points``
    (loc, lat, lon), the model's parameters; the counts join it by location.
    """
    a = points.select(F.col("loc").alias("nbr"), F.col("lat").alias("x"), F.col("lon").alias("y"))
    kernel = points.crossJoin(a).select("loc", "nbr", spread_kernel(haversine(F.col("lat"), F.col("lon"), F.col("x"), F.col("y"))).alias("w"))
    raw = history.select("tu", F.col("loc").alias("nbr"), "topic", "n").join(kernel, "nbr").groupBy("tu", "loc", "topic").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    over = ("tu", "topic") if kind == "probability" else ("tu", "loc")
    total = F.sum("s").over(Window.partitionBy(*over))
    return raw.select("tu", "loc", "topic", F.lit(f"coverage_{kind}").alias("model"), F.when(total > 0, F.col("s") / total).otherwise(1.0).alias("score"))


def evaluate(scored: DataFrame, future: DataFrame, ks: Sequence[int], names: Sequence[str] | None = None) -> DataFrame:
    """(tu, loc, model, k, accuracy, impact, difference) for every model at every location that has a future.

    accuracy is the share of the best topics that are predicted, impact the
    predicted topics' share of the future relative to that of the best, and
    difference the gap between both shares.  Where a model has no ranking it
    scores 0, and its difference is 1.  ``names`` are the models; where they
    aren't given, the scores are read once more to find them.
    """
    ideal = ideal_ranking(future)
    best = top_k(ideal, max(ks), ("tu", "loc")).select("tu", "loc", "topic", F.col("score").alias("share"), F.col("rank").alias("best_rank"))
    mine = top_k(scored, max(ks)).select("tu", "loc", "model", "topic", "rank")
    k = F.explode(F.array(*[F.lit(int(x)) for x in ks])).alias("k")
    whole = best.select("*", k).where("best_rank <= k").groupBy("tu", "loc", "k").agg(F.count("*").alias("m"), F.sum("share").alias("best_share"))
    hit = mine.join(ideal.withColumnRenamed("score", "share"), ["tu", "loc", "topic"], "left").join(best.select("tu", "loc", "topic", "best_rank"), ["tu", "loc", "topic"], "left")
    hit = hit.select("*", k).where("rank <= k").groupBy("tu", "loc", "model", "k").agg(F.sum(F.when(F.col("best_rank") <= F.col("k"), 1).otherwise(0)).alias("hits"), F.sum(F.coalesce("share", F.lit(0.0))).alias("got"))
    if names is None:
        named = whole.crossJoin(F.broadcast(scored.select("model").distinct()))  # a handful of names
    else:
        named = whole.withColumn("model", F.explode(F.array(*[F.lit(m) for m in names])))
    rows = named.join(hit, ["tu", "loc", "model", "k"], "left")
    accuracy, impact = F.coalesce(F.col("hits") / F.col("m"), F.lit(0.0)), F.coalesce(F.col("got") / F.col("best_share"), F.lit(0.0))
    return rows.select("tu", "loc", "model", "k", accuracy.alias("accuracy"), impact.alias("impact"), F.coalesce(F.col("best_share") - F.col("got"), F.lit(1.0)).alias("difference"))


def model_performance(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("model", "k").agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy"), F.avg("impact").alias("impact"), F.avg("difference").alias("difference"))


def feature_vectors(scored: DataFrame, future: DataFrame, models: Sequence[str]) -> DataFrame:
    """(tu, loc, topic, one column a model, actual): scores of each model and the share that came; null if none did."""
    wide = scored.groupBy("tu", "loc", "topic").pivot("model", list(models)).agg(F.first("score"))
    actual = ideal_ranking(future).select("tu", "loc", "topic", F.col("score").alias("actual"))
    known = future.select("tu", "loc").distinct()
    return wide.join(known, ["tu", "loc"], "left_semi").join(actual, ["tu", "loc", "topic"], "full")


def time_split(rows: DataFrame, test_share: float = 0.25) -> DataFrame:
    """Add is_test: times after the one at place int(n * (1 - share)) of the location's distinct times, from 0."""
    times = rows.select("loc", "tu").distinct()
    w = Window.partitionBy("loc")
    ranked = times.select("loc", "tu", F.row_number().over(w.orderBy("tu")).alias("r"), F.count("*").over(w).alias("n"))
    pivot = ranked.where(F.col("r") - 1 == F.floor(F.col("n") * (1 - test_share))).select("loc", F.col("tu").alias("pivot"))
    return rows.join(pivot, "loc").withColumn("is_test", F.col("tu") > F.col("pivot")).drop("pivot")


def follow_the_leader(performance: DataFrame, order: Sequence[str], metric: str = "accuracy") -> DataFrame:
    """(loc, tu, model, value): at each time the model with the least loss so far; ties and the start go by ``order``.

    A model without a ranking at some time of a location scores 0 there.
    """
    losses = _losses(performance, order, metric)
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    best = losses.groupBy("loc", "tu").agg(F.min(F.struct(F.round("past", 9).alias("p"), place.alias("o"), F.col("model"), F.col("value"))).alias("b"))
    return best.select("loc", "tu", "b.model", "b.value")


def _losses(performance: DataFrame, order: Sequence[str], metric: str) -> DataFrame:
    known = F.map_from_entries(F.collect_list(F.struct("model", F.col(metric).alias("v"))))
    times = performance.groupBy("loc", "tu").agg(known.alias("known")).withColumn("model", F.explode(F.array(*[F.lit(m) for m in order])))
    rows = times.select("loc", "tu", "model", F.coalesce(F.expr("known[model]"), F.lit(0.0)).alias("value"))
    past = F.sum(1 - F.col("value")).over(Window.partitionBy("loc", "model").orderBy("tu").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("loc", "tu", "model", "value", F.coalesce(past, F.lit(0.0)).alias("past"))


def hedging_expected(performance: DataFrame, order: Sequence[str], beta: float = 0.5, metric: str = "accuracy") -> DataFrame:
    """(loc, tu, value): expected value of choosing models in proportion to beta to the power of their past loss."""
    rows = _losses(performance, order, metric).withColumn("least", F.min("past").over(Window.partitionBy("loc", "tu")))
    weight = F.pow(F.lit(beta), F.col("past") - F.col("least"))
    return rows.groupBy("loc", "tu").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))


def learner_history(performance: DataFrame, order: Sequence[str], beta: float = 0.5, metric: str = "accuracy") -> DataFrame:
    """(loc, tu, model, past, weight): each model's loss before a time, and its weight among the models."""
    rows = _losses(performance, order, metric).withColumn("least", F.min("past").over(Window.partitionBy("loc", "tu")))
    w = F.pow(F.lit(beta), F.col("past") - F.col("least"))
    return rows.select("loc", "tu", "model", "past", (w / F.sum(w).over(Window.partitionBy("loc", "tu"))).alias("weight"))


def random_learner(performance: DataFrame, order: Sequence[str], seed: int = 1, metric: str = "accuracy") -> DataFrame:
    """(loc, tu, model, value): a model by hash at each time."""
    rows = _losses(performance, order, metric)
    best = rows.groupBy("loc", "tu").agg(F.min(F.struct(F.md5(F.concat_ws("|", F.lit(seed), "loc", "tu", "model")).alias("h"), "model", "value")).alias("b"))
    return best.select("loc", "tu", "b.model", "b.value")


def hedging_sampled(performance: DataFrame, order: Sequence[str], beta: float = 0.5, seed: int = 1, metric: str = "accuracy") -> DataFrame:
    """(loc, tu, model, value): a model drawn by hash with the chances of ``learner_history``."""
    rows = learner_history(performance, order, beta, metric).join(_losses(performance, order, metric).select("loc", "tu", "model", "value"), ["loc", "tu", "model"])
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    upto = F.sum("weight").over(Window.partitionBy("loc", "tu").orderBy(place))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "loc", "tu")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    got = rows.withColumn("upto", F.round(upto, 9)).withColumn("o", place).where(F.col("upto") > F.least(u, F.lit(1 - 1e-8)))
    first = got.groupBy("loc", "tu").agg(F.min(F.struct("o", "model", "value")).alias("b"))
    return first.select("loc", "tu", "b.model", "b.value")


def final_family(performance: DataFrame, order: Sequence[str], families: Mapping[str, str], metric: str = "accuracy") -> DataFrame:
    """(loc, family): the family of the models with the least loss over all times, where it is a single one."""
    rows = _losses(performance, order, metric).groupBy("loc", "model").agg(F.round(F.sum(1 - F.col("value")), 9).alias("loss"))
    best = rows.withColumn("least", F.min("loss").over(Window.partitionBy("loc"))).where("loss = least").select("loc", family_of(families).alias("family"))
    one = best.groupBy("loc").agg(F.count_distinct("family").alias("n"), F.min("family").alias("family"))
    return one.where("n = 1").select("loc", "family")


def family_of(families: Mapping[str, str]) -> Column:
    """The family of the column model."""
    out = F.lit(None).cast("string")
    for model, family in families.items():
        out = F.when(F.col("model") == model, F.lit(family)).otherwise(out)
    return out


def flips_by_time(chosen: DataFrame, families: Mapping[str, str]) -> DataFrame:
    """(tu, n, share): the share of locations whose family isn't that of their time before; n counts locations with one before."""
    w = Window.partitionBy("loc").orderBy("tu")
    rows = chosen.withColumn("family", family_of(families)).withColumn("before", F.lag("family").over(w)).where("before is not null")
    return rows.groupBy("tu").agg(F.count("*").alias("n"), F.avg((F.col("family") != F.col("before")).cast("double")).alias("share"))


def flipping_by_volume(ratios: DataFrame, volumes: DataFrame, width: int, least: int = 5) -> DataFrame:
    """(bin, n, ratio): mean flipping ratio by bin of a location's occurrences (loc, n), without far outliers of a bin, for bins with enough."""
    rows = ratios.select("loc", "ratio").join(volumes, "loc").select(bin_up(F.col("n"), width).alias("bin"), F.round("ratio", 9).alias("ratio"))
    kept = drop_outliers(rows, ["bin"], "ratio")
    return kept.groupBy("bin").agg(F.count("*").alias("n"), F.avg("ratio").alias("ratio")).where(F.col("n") >= least)


def line_fit(binned: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, slope, intercept) of y on x; without spread r is NaN, and where x has none so is the slope."""
    slope = F.coalesce(F.regr_slope(y, x), F.when(F.regr_count(y, x) > 0, float("nan")))
    return binned.agg(F.count("*").alias("n"), correlation(x, y).alias("r"), slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def flipping_ratio(chosen: DataFrame) -> DataFrame:
    """(loc, n, ratio): share of a location's times whose model isn't that of the time before."""
    w = Window.partitionBy("loc").orderBy("tu")
    rows = chosen.select("loc", (F.col("model") == F.lag("model").over(w)).alias("same"))
    return rows.groupBy("loc").agg(F.count("*").alias("n"), (1 - F.sum(F.when(F.col("same"), 1).otherwise(0)) / F.count("*")).alias("ratio"))


def winning_topics(history: DataFrame) -> DataFrame:
    """(loc, topic, n): each location's commonest topic over all times."""
    counts = history.groupBy("loc", "topic").agg(F.sum("n").alias("n"))
    best = counts.groupBy("loc").agg(F.min(F.struct((-F.col("n")).alias("m"), "topic")).alias("b"))
    return best.select("loc", "b.topic", (-F.col("b.m")).alias("n"))


def winning_topics_by_score(scored: DataFrame) -> DataFrame:
    """(loc, topic, score): each location's topic with the highest sum of scores over all times."""
    means = scored.groupBy("loc", "topic").agg(F.sum("score").alias("score"))
    best = means.groupBy("loc").agg(F.min(F.struct((-F.round("score", 9)).alias("m"), "topic", "score")).alias("b"))
    return best.select("loc", "b.topic", "b.score")
