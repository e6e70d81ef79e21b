"""Choosing target locations for a topic while it spreads, and the quality of the choice."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topotide.functions.columns import haversine, spread_kernel
from topotide.operators.blockmatrix import BLOCK, numbered, solve
from topotide.operators.metrics import radius
from topotide.operators.timeline import by_topic
from topotide.plans.scratch import written


def replay_units(occ: DataFrame, unit: int = 300) -> DataFrame:
    """Add step: units since the topic's first occurrence."""
    return occ.withColumn("step", F.floor((F.col("t") - F.min("t").over(by_topic())) / unit))


def _top(scored: DataFrame, budget: int) -> DataFrame:
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("score", 9)), "loc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget).select("topic", "loc", F.col("rank").cast("bigint").alias("rank"))


def seen(steps: DataFrame, until: int, loc: str = "loc") -> DataFrame:
    """(topic, loc, n) of the occurrences before step ``until``."""
    return steps.where(F.col("step") < until).groupBy("topic", F.col(loc).alias("loc")).agg(F.count("*").alias("n"))


def select_greedy(counts: DataFrame, budget: int) -> DataFrame:
    return _top(counts.withColumn("score", F.col("n").cast("double")), budget)


def select_random(counts: DataFrame, budget: int, seed: int = 1) -> DataFrame:
    return _top(counts.withColumn("score", F.pmod(F.xxhash64(F.lit(seed), "topic", "loc"), F.lit(1 << 30)).cast("double")), budget)


def coverage(counts: DataFrame, points: DataFrame) -> DataFrame:
    """(topic, loc, score): a topic's counts spread with distance to the valid locations ``points`` (loc, lat, lon), as shares."""
    a = points.select(F.col("loc").alias("src"), F.col("lat").alias("x"), F.col("lon").alias("y"))
    kernel = points.crossJoin(a).select("loc", "src", spread_kernel(haversine(F.col("lat"), F.col("lon"), F.col("x"), F.col("y"))).alias("w"))
    raw = counts.withColumnRenamed("loc", "src").join(kernel, "src").groupBy("topic", "loc").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    return raw.select("topic", "loc", (F.col("s") / F.sum("s").over(Window.partitionBy("topic"))).alias("score"))


def select_coverage(counts: DataFrame, points: DataFrame, budget: int) -> DataFrame:
    """Locations by the topic's counts spread with distance; points (loc, lat, lon) are the valid locations."""
    return _top(coverage(counts, points), budget)


def link_scores(counts: DataFrame, links: DataFrame, observing: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """(topic, loc, score): the sum, over seen locations, of ln P(observed) + ln P(link), and of ln coverage of the neighbour if ``spread`` is given."""
    rows = counts.join(observing, "loc").join(links.where("p > 0"), "loc").select("topic", F.col("nbr").alias("loc"), (F.ln("p_observe") + F.ln("p")).alias("x"))
    if spread is not None:
        rows = rows.join(spread.where("score > 0").select("topic", "loc", F.ln("score").alias("c")), ["topic", "loc"]).withColumn("x", F.col("x") + F.col("c"))
    return rows.groupBy("topic", "loc").agg(F.sum("x").alias("score"))


def select_by_links(counts: DataFrame, links: DataFrame, observing: DataFrame, budget: int) -> DataFrame:
    """Locations by the sum, over seen ones, of ln P(observed) + ln P(link); links (loc, nbr, p), observing (loc, p_observe)."""
    return _top(link_scores(counts, links, observing), budget)


def select_coverage_links(counts: DataFrame, points: DataFrame, links: DataFrame, observing: DataFrame, budget: int) -> DataFrame:
    """The topic's most frequent locations, then locations by links and coverage together, up to the budget."""
    return filled(select_greedy(counts, budget), _top(link_scores(counts, links, observing, coverage(counts, points)), budget * 2), budget)


def select_sharing_local(counts: DataFrame, points: DataFrame, links: DataFrame, observing: DataFrame, local: DataFrame, budget: int, miles: float = 500.0) -> DataFrame:
    """The most frequent locations, then for local topics those by links that keep the chosen ones within a radius.

    ``local`` has (topic) of the topics predicted to be local.  Candidates are
    tried from the best; each choice depends on those before, so a topic's
    locations, at most as many as there are ``points``, go through one call.
    """
    first = _top(counts.withColumn("score", F.col("n").cast("double")), budget).withColumn("o", F.lit(0)).withColumn("score", -F.col("rank").cast("double"))
    more = link_scores(counts, links, observing).join(local.select("topic"), "topic", "left_semi").withColumn("o", F.lit(1))
    rows = first.select("topic", "loc", "o", "score").unionByName(more.select("topic", "loc", "o", F.round("score", 9).alias("score"))).join(points, "loc")

    def choose(topic: tuple, group: pd.DataFrame) -> pd.DataFrame:
        chosen: list = []
        spots = np.zeros((0, 2))
        for r in group.sort_values(["o", "score", "loc"], ascending=[True, False, True]).itertuples():
            if len(chosen) >= budget:
                break
            if r.loc in chosen:
                continue
            both = np.vstack((spots, [[r.lat, r.lon]]))
            if r.o == 0 or _mean_miles(both) <= miles:
                chosen.append(r.loc)
                spots = both
        return pd.DataFrame({"topic": topic[0], "loc": chosen, "rank": np.arange(1, len(chosen) + 1)})

    kind = rows.schema["loc"].dataType.simpleString()
    return rows.select("topic", "loc", "o", "score", "lat", "lon").groupBy("topic").applyInPandas(choose, f"topic string, loc {kind}, rank long")


def _mean_miles(spots: np.ndarray) -> float:
    """Mean miles of points to their centre."""
    lat, lon = np.radians(spots).T
    a, b = lat.mean(), lon.mean()
    h = np.sin((a - lat) / 2) ** 2 + np.cos(lat) * np.cos(a) * np.sin((b - lon) / 2) ** 2
    return float((2 * 3958.761 * np.arcsin(np.sqrt(np.minimum(1.0, h)))).mean())


def share_vectors(steps: DataFrame, until: int, loc: str = "loc") -> tuple[DataFrame, DataFrame]:
    """(topic, loc, x) shares of a topic's occurrences before a step, and (topic, loc, y) of all, for topics with any before."""
    early = seen(steps, until, loc)
    x = early.select("topic", "loc", (F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).alias("x"))
    whole = steps.groupBy("topic", F.col(loc).alias("loc")).agg(F.count("*").alias("n")).join(early.select("topic").distinct(), "topic", "left_semi")
    return x, whole.select("topic", "loc", (F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).alias("y"))


def share_regression(x: DataFrame, y: DataFrame, ridge: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """(loc, src, coefficient): for every location, the linear model of its final share on the early shares of all (src).

    All locations have the same predictors, so their products, which come from
    one self-join, make one system with a right side for each location.  It is
    solved in blocks of ``block`` locations (``blockmatrix.solve``); a little
    ridge makes it unique.
    """
    sources, targets = written(numbered(x, "loc", "number"), "sources"), written(numbered(y, "loc", "number"), "targets")
    early = x.join(sources, "loc").select("topic", F.col("number").alias("row"), F.col("x").alias("a"))
    gram = early.join(early.select("topic", F.col("row").alias("col"), F.col("a").alias("b")), "topic").groupBy("row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("value"))
    n = sources.count()
    gram = written(gram.unionByName(sources.select(F.col("number").alias("row"), F.col("number").alias("col"), F.lit(float(ridge)).alias("value"))), "gram")
    final = y.join(targets, "loc").select("topic", F.col("number").alias("col"), "y")
    cross = written(early.join(final, "topic").groupBy("row", "col").agg(F.sum(F.col("a") * F.col("y")).alias("value")), "cross")
    found = solve(gram, cross, n, block)
    named = found.join(sources.select(F.col("number").alias("row"), F.col("loc").alias("src")), "row").join(targets.select(F.col("number").alias("col"), "loc"), "col")
    return named.select("loc", "src", F.col("value").alias("coefficient"))


def predicted_shares(x: DataFrame, model: DataFrame) -> DataFrame:
    """(topic, loc, score) of ``share_regression``."""
    return x.withColumnRenamed("loc", "src").join(model, "src").groupBy("topic", "loc").agg(F.sum(F.col("x") * F.col("coefficient")).alias("score"))


def select_regression(steps: DataFrame, train: DataFrame, until: int, budget: int, loc: str = "loc") -> DataFrame:
    """Locations by the final share that a regression on the topics ``train`` (topic) predicts from the early shares."""
    x, y = share_vectors(steps, until, loc)
    model = share_regression(x.join(train, "topic", "left_semi"), y.join(train, "topic", "left_semi"))
    return _top(predicted_shares(x.join(train, "topic", "left_anti"), model), budget)


def regression_error(steps: DataFrame, train: DataFrame, untils: Sequence[int], loc: str = "loc") -> DataFrame:
    """(until, n, error): mean squared error over the other topics' final shares, all above zero, for each time of decision."""
    parts = []
    for until in untils:
        x, y = share_vectors(steps, until, loc)
        model = share_regression(x.join(train, "topic", "left_semi"), y.join(train, "topic", "left_semi"))
        got = y.join(train, "topic", "left_anti").join(predicted_shares(x, model), ["topic", "loc"], "left")
        gap = F.col("y") - F.coalesce("score", F.lit(0.0))
        parts.append(got.agg(F.count("*").alias("n"), F.avg(gap * gap).alias("error")).select(F.lit(until).alias("until"), "n", "error"))
    return reduce(DataFrame.unionByName, parts)


def locality_features(occ: DataFrame, untils: Sequence[int], unit: int, far: float = 500.0) -> DataFrame:
    """(topic, until, n, early, is_local): occurrences and radius of a topic's first units, and whether its final radius is below ``far``."""
    rows = replay_units(occ, unit).withColumn("until", F.explode(F.array(*[F.lit(int(u)) for u in untils]))).where("step < until")
    counts = rows.groupBy("topic", "until").agg(F.count("*").alias("n"))
    early = radius(rows, ["topic", "until"]).withColumnRenamed("radius", "early")
    final = radius(occ, ["topic"]).select("topic", (F.col("radius") < far).cast("int").alias("is_local"))
    return counts.join(early, ["topic", "until"]).join(final, "topic")


def locality_classifier(features: DataFrame, untils: Sequence[int]) -> DataFrame:
    """(until, n, accuracy): a logistic regression of locality for each number of first units; a fifth of the topics, by hash, is for testing."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["n", "early"], outputCol="features").transform(features.withColumn("label", F.col("is_local").cast("double")))
    rows = rows.withColumn("test", F.pmod(F.crc32(F.encode("topic", "utf-8")), F.lit(5)) == 0)
    parts = []
    for until in untils:
        some = rows.where(F.col("until") == until)
        model = LogisticRegression(maxIter=50, regParam=1e-3).fit(some.where("not test"))
        got = model.transform(some.where("test")).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        parts.append(got.select(F.lit(until).alias("until"), "n", "accuracy"))
    return reduce(DataFrame.unionByName, parts)


def filled(first: DataFrame, then: DataFrame, budget: int) -> DataFrame:
    """The first choice, then what the second adds to it, best first, up to the budget."""
    both = first.withColumn("o", F.lit(0)).unionByName(then.withColumn("o", F.lit(1)))
    one = both.groupBy("topic", "loc").agg(F.min(F.struct("o", "rank")).alias("b"))
    order = Window.partitionBy("topic").orderBy("b.o", "b.rank", "loc")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget).select("topic", "loc", F.col("rank").cast("bigint").alias("rank"))


def selection_metrics(chosen: DataFrame, steps: DataFrame, until: int, budget: int, loc: str = "loc") -> DataFrame:
    """(topic, hit_rate, best_rate, miss_before, target_accuracy): what the chosen locations catch.

    hit_rate is the share of the topic's later occurrences at chosen
    locations, best_rate that of the best ``budget`` locations, miss_before
    the share of all occurrences before the choice, target_accuracy the share
    of the best locations that were chosen.
    """
    rows = steps.groupBy("topic", F.col(loc).alias("loc")).agg(F.sum((F.col("step") >= until).cast("bigint")).alias("later"), F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("later"), "loc")) <= budget
    rows = rows.withColumn("best", best & (F.col("later") > 0)).join(chosen.select("topic", "loc", F.lit(True).alias("chosen")), ["topic", "loc"], "left")
    hit = F.coalesce("chosen", F.lit(False))
    sums = rows.groupBy("topic").agg(
        F.sum("later").alias("all"), F.sum("n").alias("n"), F.sum(F.when(hit, F.col("later")).otherwise(0)).alias("hit"), F.sum(F.when(F.col("best"), F.col("later")).otherwise(0)).alias("top"),
        F.sum(F.when(F.col("best"), 1).otherwise(0)).alias("m"), F.sum(F.when(F.col("best") & hit, 1).otherwise(0)).alias("both"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.select("topic", ratio("hit", "all").alias("hit_rate"), ratio("top", "all").alias("best_rate"), (1 - F.col("all") / F.col("n")).alias("miss_before"), ratio("both", "m").alias("target_accuracy"))


def selection_report(chosen: DataFrame, steps: DataFrame, until: int, budget: int, loc: str = "loc") -> DataFrame:
    """(topic, best_rate, hit_rate, hit_rate_after, miss_before, target_accuracy, rate_lag) of chosen locations; null without a choice or base.

    best_rate and hit_rate are the later occurrences at the best ``budget``
    and at the chosen locations over all, rate_lag their difference;
    hit_rate_after is over the later ones; miss_before is the share of all
    before the choice; target_accuracy is the share of the budget that names a
    best location.
    """
    rows = steps.groupBy("topic", F.col(loc).alias("loc")).agg(F.sum((F.col("step") >= until).cast("bigint")).alias("later"), F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("later"), "loc")) <= budget
    rows = rows.withColumn("best", best).join(chosen.select("topic", "loc", F.lit(True).alias("chosen")), ["topic", "loc"], "left")
    hit = F.coalesce("chosen", F.lit(False))
    total = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    sums = rows.join(chosen.select("topic").distinct(), "topic", "left_semi").groupBy("topic").agg(
        F.sum("later").alias("all"), F.sum("n").alias("n"), total(hit, "later").alias("hit"), total(F.col("best"), "later").alias("top"), F.sum((F.col("best") & hit).cast("bigint")).alias("both")
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.select(
        "topic", over("top", "n").alias("best_rate"), over("hit", "n").alias("hit_rate"), over("hit", "all").alias("hit_rate_after"), (1 - F.col("all") / F.col("n")).alias("miss_before"), (F.col("both") / budget).alias("target_accuracy"), ((F.col("top") - F.col("hit")) / F.col("n")).alias("rate_lag")
    )


def selection_grid(steps: DataFrame, models: Mapping[str, Callable[[DataFrame, int], DataFrame]], untils: Sequence[int], budgets: Sequence[int], loc: str = "loc") -> DataFrame:
    """``selection_report`` rows with (model, until, budget) for every model, time and budget; a model chooses from (counts so far, budget)."""
    parts = []
    for until in untils:
        counts = seen(steps, until, loc)
        for budget in budgets:
            for name, choose in models.items():
                parts.append(selection_report(choose(counts, budget), steps, until, budget, loc).select(F.lit(name).alias("model"), F.lit(until).alias("until"), F.lit(budget).alias("budget"), "*"))
    return reduce(DataFrame.unionByName, parts)


def selection_means(grid: DataFrame, by: str) -> DataFrame:
    """(model, by, n, means of the measures) over topics, by budget or until; nulls are skipped."""
    measures = ("best_rate", "hit_rate", "hit_rate_after", "miss_before", "target_accuracy", "rate_lag")
    return grid.groupBy("model", by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in measures])
