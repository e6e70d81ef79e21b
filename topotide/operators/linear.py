"""Least squares over groups: sums of products in Spark, one small solve for each key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topotide.functions.statistics import student_tail
from topotide.plans.shipping import ship


def regression_frames(counts: DataFrame, links: DataFrame) -> DataFrame:
    """(target, predictor, topic, x, y): topic counts of a cell and of each neighbour; a missing count is 0.

    ``counts`` is (cell, topic, n), ``links`` (cell, nbr).  Topics that neither
    has make no row, as zeros add nothing to sums of products.
    """
    pairs = links.select(F.col("cell").alias("target"), F.col("nbr").alias("predictor"))
    y = pairs.join(counts.select(F.col("cell").alias("target"), "topic", F.col("n").alias("y")), "target")
    x = pairs.join(counts.select(F.col("cell").alias("predictor"), "topic", F.col("n").alias("x")), "predictor")
    both = y.join(x, ["target", "predictor", "topic"], "full")
    return both.select("target", "predictor", "topic", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


def least_squares(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """(keys, n, coefficients array<double>): intercept first; nulls of features are 0, rows without a target are left out.

    Only the sums of products, a few numbers for each key, reach the solver.
    """
    known = rows.where(F.col(target).isNotNull())
    values = [F.lit(1.0), *[F.coalesce(F.col(f), F.lit(0.0)) for f in features]]
    p = len(values)
    sums = [F.sum(values[i] * values[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(values[i] * F.col(target)).alias(f"y{i}") for i in range(p)]
    gram = known.groupBy(*keys).agg(F.count("*").alias("n"), *sums)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for _, r in df.iterrows():
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
                out.append(np.linalg.lstsq(g, np.array([r[f"y{i}"] for i in range(p)]), rcond=1e-12)[0].tolist())
            yield df[[*keys, "n"]].assign(coefficients=out)

    schema = ", ".join(f"{k} {gram.schema[k].dataType.simpleString()}" for k in keys) + ", n long, coefficients array<double>"
    return gram.mapInPandas(solve, schema)


def predicted(rows: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``rows`` with score: the model of its key applied to its features."""
    c = F.col("coefficients")
    score = c[0]
    for i, f in enumerate(features):
        score = score + c[i + 1] * F.coalesce(F.col(f), F.lit(0.0))
    return rows.join(models.select(*keys, "coefficients"), list(keys)).withColumn("score", score).drop("coefficients")


def significant_neighbours(frames: DataFrame, n_topics: int, alpha: float = 0.05) -> DataFrame:
    """(cell, neighbours): neighbours whose counts predict the cell's, after the least significant are dropped one by one.

    A neighbour stays if the two-sided p-value of its coefficient, by Student's
    t with as many degrees of freedom as topics are left, is at most ``alpha``.

    Cross products of a target's predictors come from a self-join on (target,
    topic) of non-zero counts; each target's matrix, as wide as its
    neighbourhood, goes through the elimination by itself.
    """
    ship(frames.sparkSession)
    x = frames.where("x <> 0").select("target", "topic", F.col("predictor").alias("a"), F.col("x").cast("double").alias("xa"))
    gram = x.join(x.select("target", "topic", F.col("a").alias("b"), F.col("xa").alias("xb")), ["target", "topic"]).groupBy("target", "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("v"))
    own = frames.groupBy("target", "predictor").agg(F.sum(F.col("x") * F.col("y")).cast("double").alias("v"))
    total = frames.select("target", "topic", "y").distinct().groupBy("target").agg(F.sum(F.col("y") * F.col("y")).cast("double").alias("v"))
    rows = gram.unionByName(own.select("target", F.col("predictor").alias("a"), F.lit(None).cast("bigint").alias("b"), "v")).unionByName(total.select("target", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), "v"))

    def eliminate(df: pd.DataFrame) -> pd.DataFrame:
        names = sorted(df["a"].dropna().unique())
        place = {a: i for i, a in enumerate(names)}
        g, h, yy = np.zeros((len(names), len(names))), np.zeros(len(names)), 0.0
        for a, b, v in zip(df["a"], df["b"], df["v"]):
            if pd.isna(a):
                yy = v
            elif pd.isna(b):
                h[place[a]] = v
            else:
                g[place[a], place[b]] = v
        keep = list(range(len(names)))
        while keep:
            inv = np.linalg.pinv(g[np.ix_(keep, keep)])
            beta = inv @ h[keep]
            left = max(n_topics - len(keep), 1)
            var = max(yy - beta @ h[keep], 1e-12) / left
            t = np.abs(beta) / np.sqrt(np.maximum(np.diag(inv) * var, 1e-12))
            worst = int(np.argmin(t))
            if student_tail(float(t[worst]), left) <= alpha:
                break
            del keep[worst]
        return pd.DataFrame({"cell": [df["target"].iloc[0]], "neighbours": [[int(names[i]) for i in keep]]})

    return rows.groupBy("target").applyInPandas(eliminate, "cell long, neighbours array<long>")


def ranked_by_regression(vectors: DataFrame, features: Sequence[str]) -> DataFrame:
    """(tu, loc, topic, model, score) of test rows, from each location's regression over its training rows.

    ``vectors`` has is_test and actual; rows without an actual share, or with
    share 0, don't train.
    """
    train = vectors.where("not is_test and actual > 0")
    models = least_squares(train, ["loc"], features, "actual")
    return predicted(vectors.where("is_test"), models, ["loc"], features).select("tu", "loc", "topic", F.lit("learning_to_rank").alias("model"), "score")


