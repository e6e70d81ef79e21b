"""Evaluation, learners, target selection and clusters: hand-made cases and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topotide.operators import clusters, distributions, influence, metrics, pairs, predict, selection
from topotide.plans.scratch import first_rows


def test_a_model_without_a_ranking_scores_nothing(spark):
    future = spark.createDataFrame([(0, 1, "a", 3), (0, 1, "b", 1), (0, 2, "a", 2)], "tu long, loc long, topic string, n long")
    scored = spark.createDataFrame([(0, 1, "a", "m", 1.0), (0, 1, "x", "m", 0.5), (0, 2, "x", "m", 1.0), (0, 1, "b", "g", 1.0)], "tu long, loc long, topic string, model string, score double")
    for names in (None, ("m", "g")):
        got = {(r["loc"], r["model"]): (r["accuracy"], r["impact"], r["difference"]) for r in predict.evaluate(scored, future, (2,), names).collect()}
        assert got == {(1, "m"): (0.5, 0.75, 0.25), (2, "m"): (0.0, 0.0, 1.0), (1, "g"): (0.5, 0.25, 0.75), (2, "g"): (0.0, 0.0, 1.0)}
    means = {r["model"]: (r["n"], r["accuracy"]) for r in predict.model_performance(predict.evaluate(scored, future, (2,))).collect()}
    assert means == {"m": (2, 0.25), "g": (2, 0.25)}


def performance(spark):
    rng = random.Random(3)
    rows = [(loc, tu, m, rng.random()) for loc in range(4) for tu in range(30) for m in ("a", "b") if rng.random() < 0.9]
    return rows, spark.createDataFrame(rows, "loc long, tu long, model string, accuracy double")


def test_learners_follow_past_losses(spark):
    rows, df = performance(spark)
    value = {(loc, tu, m): v for loc, tu, m, v in rows}
    chosen = {(r["loc"], r["tu"]): r["model"] for r in predict.follow_the_leader(df, ("a", "b")).collect()}
    weights = {(r["loc"], r["tu"], r["model"]): r["weight"] for r in predict.learner_history(df, ("a", "b")).collect()}
    for loc in range(4):
        past = {"a": 0.0, "b": 0.0}
        for tu in sorted({t for x, t, _, _ in rows if x == loc}):
            assert chosen[loc, tu] == min(("a", "b"), key=lambda m: (round(past[m], 9), m))
            whole = sum(0.5 ** past[m] for m in past)
            for m in past:
                assert weights[loc, tu, m] == pytest.approx(0.5 ** past[m] / whole)
                past[m] += 1 - value.get((loc, tu, m), 0.0)
    sampled = predict.hedging_sampled(df, ("a", "b")).collect()
    assert len(sampled) == len(chosen) and sorted(map(tuple, sampled)) == sorted(map(tuple, predict.hedging_sampled(df.repartition(3), ("a", "b")).collect()))
    assert {r["model"] for r in predict.random_learner(df, ("a", "b")).collect()} == {"a", "b"}


def test_trimmed_edges_are_the_heaviest(spark):
    rng = random.Random(4)
    rows = [(u, v, rng.randint(1, 4)) for u in range(12) for v in range(u + 1, 12)]
    df = spark.createDataFrame(rows, "u long, v long, w long").repartition(5)
    for keep in (0.0, 0.1, 0.5, 1.0):
        want = sorted(rows, key=lambda e: (-e[2], e[0], e[1]))[: math.ceil(len(rows) * keep)]
        assert sorted(map(tuple, pairs.trim_edges(df, keep).collect())) == sorted(want)
    assert sorted(map(tuple, first_rows(df, 7, "v", "u").collect())) == sorted(sorted(rows, key=lambda e: (e[1], e[0]))[:7])
    assert pairs.trim_edges(df.limit(0), 0.5).count() == 0


def test_binomial_tails(spark):
    rows = [(n, (2 * k - n) / n) for n in (1, 2, 7, 40) for k in range(n + 1)] + [(3000, 0.02)]
    for r in clusters.binomial_p(spark.createDataFrame(rows, "n long, mean_status double")).collect():
        k = math.ceil(round(r["n"] * (1 + abs(r["mean_status"])) / 2, 6))
        tail = sum(math.comb(r["n"], x) for x in range(k, r["n"] + 1)) / 2 ** r["n"]
        assert r["p"] == pytest.approx(min(1.0, 2 * tail), rel=1e-9)


def two_cliques(spark):
    rows = [(a + b, a + c, 5) for a in (0, 10) for b, c in itertools.combinations(range(5), 2)] + [(4, 10, 1)]
    return spark.createDataFrame(rows, "u long, v long, w long")


def test_clusters_split_two_cliques(spark):
    for found in (clusters.markov_clusters(two_cliques(spark)), clusters.affinity_clusters(two_cliques(spark))):
        labels = {r["node"]: r["cluster"] for r in found.collect()}
        assert len(labels) == 10 and len({labels[i] for i in range(5)}) == 1 and len({labels[i] for i in range(10, 15)}) == 1 and labels[0] != labels[10]


def test_influence_zones_part_at_wide_steps(spark):
    scores = [(1, 0.0), (2, 0.01), (3, 0.5), (4, 0.51), (5, 2.0), (6, 3.0)]
    got = {r["loc"]: r["zone"] for r in clusters.influence_zones(spark.createDataFrame(scores, "loc long, score double"), 0.1).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[5] == got[6] and len(set(got.values())) == 3
    spans = {r["zone"]: (r["n"], r["low"], r["high"]) for r in influence.zone_spans(spark.createDataFrame([(z, s) for (i, s), z in zip(scores, [got[i] for i, _ in scores])], "zone long, score double")).collect()}
    assert spans[got[1]] == (2, 0.0, 0.01)


def test_regression_finds_a_linear_rule(spark):
    rng = np.random.default_rng(5)
    w = rng.random((4, 4))
    xs, ys = [], []
    for t in range(40):
        x = rng.dirichlet(np.ones(4))
        xs += [(f"t{t}", i, float(x[i])) for i in range(4)]
        ys += [(f"t{t}", i, float((x @ w)[i])) for i in range(4)]
    x, y = spark.createDataFrame(xs, "topic string, loc long, x double"), spark.createDataFrame(ys, "topic string, loc long, y double")
    model = {(r["src"], r["loc"]): r["coefficient"] for r in selection.share_regression(x, y, 1e-9).collect()}
    assert all(model[i, j] == pytest.approx(w[i, j], abs=1e-4) for i in range(4) for j in range(4))
    got = {(r["topic"], r["loc"]): r["score"] for r in selection.predicted_shares(x, selection.share_regression(x, y, 1e-9)).collect()}
    assert all(got[t, i] == pytest.approx(v, abs=1e-4) for t, i, v in ys)


def test_local_topics_stay_in_their_radius(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 1.0, 0.0), (4, 50.0, 50.0)], "loc long, lat double, lon double")
    counts = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "topic string, loc long, n long")
    links = spark.createDataFrame([(1, 4, 0.9), (1, 2, 0.5), (1, 3, 0.4)], "loc long, nbr long, p double")
    observing = spark.createDataFrame([(1, 1.0)], "loc long, p_observe double")
    chosen = selection.select_sharing_local(counts, points, links, observing, spark.createDataFrame([("a",)], "topic string"), 3, 500.0)
    assert sorted(map(tuple, chosen.collect())) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)]


def test_selection_report(spark):
    steps = spark.createDataFrame([("a", 1, 0), ("a", 1, 5), ("a", 2, 5), ("a", 2, 6), ("a", 3, 7), ("b", 1, 0)], "topic string, loc long, step long")
    chosen = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "topic string, loc long, rank long")
    got = {r["topic"]: r for r in selection.selection_report(chosen, steps, 5, 1).collect()}
    a = got["a"]
    assert (a["best_rate"], a["hit_rate"], a["hit_rate_after"], a["miss_before"], a["target_accuracy"], a["rate_lag"]) == pytest.approx((0.4, 0.2, 0.25, 0.2, 0.0, 0.2))
    assert got["b"]["hit_rate_after"] is None and got["b"]["miss_before"] == 1.0


def test_ks_statistic_and_bounds(spark):
    rng = random.Random(6)
    rows = [("k", rng.randint(0, 20), rng.random() < 0.4) for _ in range(200)]
    got = distributions.ks_statistic(spark.createDataFrame(rows, "g string, v long, s boolean"), "v", "s", ["g"]).first()
    a, b = [v for _, v, s in rows if s], [v for _, v, s in rows if not s]
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in range(21))
    assert got["d"] == pytest.approx(want) and (got["n_a"], got["n_b"]) == (len(a), len(b))
    spans = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "hours double")
    r = metrics.outlier_bound(spans, "hours").first()
    assert (r["bound"], r["n"], r["mean"]) == (7.0, 4, 2.5)


def test_locality_classifier_learns_a_threshold(spark):
    rows = [(f"t{i}", 10, 20, float(i), int(i < 60)) for i in range(120)]
    got = selection.locality_classifier(spark.createDataFrame(rows, "topic string, until int, n long, early double, is_local int"), (10,)).first()
    assert got["n"] > 10 and got["accuracy"] > 0.9


@pytest.mark.parametrize("kind", ["complete", "outgoing", "incoming"])
def test_directed_vectors_have_length_one(spark, kind):
    rows = [(1, 2, 0.3), (1, 3, -0.4), (1, 4, 0.1), (2, 1, -0.2)]
    got = influence.directed_vectors(spark.createDataFrame(rows, "loc long, nbr long, score double"), kind).collect()
    for loc in {r["loc"] for r in got}:
        assert sum(r["x"] ** 2 for r in got if r["loc"] == loc) == pytest.approx(1.0)
    assert all((r["x"] > 0) == (kind == "outgoing") for r in got) or kind == "complete"
