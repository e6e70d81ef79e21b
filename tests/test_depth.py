"""Pyramids, inversion counts and tail probabilities against brute force."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from topotide.functions import statistics as st
from topotide.operators import clusters, influence, linear, locality, pairs, predict, regions, timeline
from topotide.operators.distributions import correlation_test
from topotide.operators.quantiles import exact_percentiles


def miles(a, b):
    (x, y), (u, v) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
    return 2 * 3958.761 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("levels", [None, (4,), (16, 4, 2)])
def test_covering_radius_equals_all_pairs(spark, levels):
    rng = random.Random(3)
    rows = []
    for topic in ("near", "spread", "one"):
        cells = {(rng.randrange(-20, 20), rng.randrange(-40, 40)) for _ in range(1 if topic == "one" else 60)}
        if topic == "near":
            cells |= {(5 + i % 3, 7 + i // 3) for i in range(9)}
        rows += [(topic, i, j, 40 if topic == "near" and 5 <= i < 8 and 7 <= j < 10 else rng.randrange(1, 6)) for i, j in sorted(cells)]
    size, shares = 1.5, (0.5, 0.75, 1.0)
    got = {(r.topic, r.k): (r.radius, r.ci, r.cj) for r in locality.covering_radius(spark.createDataFrame(rows, "topic string, ci long, cj long, n long"), ["topic"], size, shares, levels).collect()}
    by = defaultdict(list)
    for t, i, j, n in rows:
        by[t].append((i, j, n))
    for t, cells in by.items():
        total = sum(n for *_, n in cells)
        for k in shares:
            best = None
            for i, j, _ in cells:
                run = 0
                for d, n in sorted((round(miles((i * size, j * size), (u * size, v * size)), 6), n) for u, v, n in cells):
                    run += n
                    if run / total >= k:
                        break
                best = min(best, (d, i, j)) if best else (d, i, j)
            assert abs(got[t, k][0] - best[0]) < 1e-5 and got[t, k][1:] == best[1:], (t, k)
    assert locality.levels_for(200) == [] and locality.levels_for(1_000_000) == [32, 8, 2]
    assert locality.covering_radius(spark.createDataFrame([], "topic string, ci long, cj long, n long"), ["topic"], size).count() == 0


def test_misranked_pairs_and_shuffles(spark):
    rng = random.Random(4)
    rows = [(t, p, rng.randrange(0, 7)) for t in "abc" for p in range(1, 40 if t != "c" else 3)]
    got = {r.topic: (r.n, r.wrong) for r in influence.misranked(spark.createDataFrame(rows, "topic string, pos long, rank long"), ["topic"]).collect()}
    for t in "abc":
        own = sorted((p, r) for x, p, r in rows if x == t)
        assert got[t] == (len(own), sum(a[1] > b[1] for a, b in itertools.combinations(own, 2)))
    occ = spark.createDataFrame([(f"t{i}", loc, rng.random()) for i in range(40) for loc in range(12)], "topic string, loc long, t double")
    order = spark.createDataFrame([(loc, loc) for loc in range(12)], "loc long, rank long")
    first = sorted(map(tuple, influence.rank_accuracy_by_bin(order, occ, seed=5).collect()))
    assert first == sorted(map(tuple, influence.rank_accuracy_by_bin(order, occ, seed=5).collect()))
    assert 0.4 < first[0][3] < 0.6
    right = spark.createDataFrame([("t", loc, float(loc)) for loc in range(12)], "topic string, loc long, t double")
    assert influence.rank_accuracy(order, right).first()["accuracy"] == 1.0


def density_tail(t, df, n=4000):
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h, f = abs(t) / n, lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * h / 3 * (f(0) + f(abs(t)) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n)))


def test_t_tail_equals_the_integral_of_the_density(spark):
    rows = [(t, df) for t in (0.0, 0.3, 1.96, -2.2, 6.0) for df in (1, 2, 5, 30, 1000)]
    for r in spark.createDataFrame(rows, "t double, df long").withColumn("p", st.t_tail(F.col("t"), F.col("df"))).collect():
        assert abs(r.p - density_tail(r.t, r.df)) < 1e-9 and abs(r.p - st.student_tail(r.t, r.df)) < 1e-10
    pts = [("line", float(i), 2.0 * i) for i in range(5)] + [("flat", float(i), 1.0) for i in range(5)] + [("two", 0.0, 1.0), ("two", 1.0, 3.0)] + [("some", float(i), float(i * 7 % 5)) for i in range(12)]
    got = {r.g: r for r in correlation_test(spark.createDataFrame(pts, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert abs(got["line"].r - 1) < 1e-12 and got["line"].p < 1e-12 and got["flat"].p is None and got["two"].p is None
    r = got["some"].r
    assert abs(got["some"].p - density_tail(r * math.sqrt(10 / (1 - r * r)), 10)) < 1e-9


def dealt(n, a, b):
    k = a + b
    return sum(math.comb(k, x) * math.comb(2 * n - k, n - x) for x in range(max(0, k - n), min(n, k) + 1) if abs(2 * x - k) >= abs(a - b)) / math.comb(2 * n, n)


def test_permutation_p_within_its_error_of_the_exact_value(spark):
    rows = [(n, a, b) for n in (1, 2, 7, 40) for a in range(0, n + 1, max(1, n // 4)) for b in range(0, n + 1, max(1, n // 3))]
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "n long, a long, b long").select("n", "a", "b", st.two_sample_p(n, a, b).alias("p"), st.dealt_p(n, a, b, 400, F.lit(7)).alias("q"), st.random_pattern_p(n, a).alias("m"))
    for r in df.collect():
        assert abs(r.p - dealt(r.n, r.a, r.b)) < 1e-9
        assert abs(r.q - r.p) <= 4 * math.sqrt(r.p * (1 - r.p) / 400) + 1e-9
        assert abs(r.m - sum(math.comb(r.n, k) / 2**r.n * dealt(r.n, r.a, k) for k in range(r.n + 1))) < 1e-9
    patterns = spark.createDataFrame([(1, 50, 0.0), (2, 50, 0.6), (3, 8, 1.0)], "id long, n long, mean_status double")
    exact = {r.id: r.p for r in clusters.permutation_p(patterns).collect()}
    one, two = ({r.id: r.p for r in clusters.permutation_p(patterns, draws=40, replicates=r).collect()} for r in (100, None))
    for i, size, ones in ((1, 50, 25), (2, 50, 40), (3, 8, 8)):
        assert abs(exact[i] - sum(math.comb(size, k) / 2**size * dealt(size, ones, k) for k in range(size + 1))) < 1e-9
    assert all(abs(one[i] - exact[i]) < 0.15 and abs(two[i] - exact[i]) < 0.15 for i in exact)
    assert two == {r.id: r.p for r in clusters.permutation_p(patterns, draws=40).collect()}
    heads = spark.range(300).select(st.coin_heads(F.lit(200), F.lit(1), F.col("id")).alias("h")).agg(F.avg("h"), F.min("h"), F.max("h")).first()
    assert abs(heads[0] - 100) < 2 and 50 < heads[1] < heads[2] < 150


def test_clusters_of_locations_by_p(spark):
    rng = random.Random(6)
    rows = [(f"t{i}", loc, float(rng.random())) for i in range(60) for loc in range(4) if loc < 2 or rng.random() < 0.5 or i < 2]
    occ = spark.createDataFrame(rows, "topic string, loc long, t double")
    all_ = {(r.l, r.r): r.p for r in pairs.location_clusters(occ, "loc", 0.0, 10, 0.0, 1.0).collect()}
    kept = {(r.l, r.r) for r in pairs.location_clusters(occ, "loc", 0.0, 10, 0.0, 0.05).collect()}
    assert kept == {k for k, p in all_.items() if p <= 0.05} and (0, 1) in kept and all_[2, 3] > 0.05


def test_neighbours_stay_by_their_p_value(spark):
    rng = random.Random(8)
    n = 40
    x = {p: [rng.randrange(1, 20) for _ in range(n)] for p in (1, 2)}
    y = [3 * a + rng.randrange(0, 3) for a in x[1]]
    rows = [(0, p, f"t{i}", x[p][i], y[i]) for p in (1, 2) for i in range(n)]
    frames = spark.createDataFrame(rows, "target long, predictor long, topic string, x long, y long")
    found = linear.significant_neighbours(frames, n, 0.001).first()
    assert found["neighbours"] == [1]
    assert linear.significant_neighbours(frames, n, 1.0).first()["neighbours"] == [1, 2]


def inside(rings, lat, lon):
    odd = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (a > lat) != (c > lat) and lon < b + (lat - a) * (d - b) / (c - a):
                odd = not odd
    return odd


@pytest.mark.parametrize("square", [0.5, 3.0])
def test_regions_equal_ray_casting_over_all_edges(spark, square):
    rng = random.Random(11)

    def star(lat, lon, size, n):
        angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
        return [(lat + size * rng.uniform(0.4, 1) * math.sin(a), lon + size * rng.uniform(0.4, 1) * math.cos(a)) for a in angles]

    shapes = {"a": [star(0, 0, 8, 12), star(0, 0, 2, 6)], "b": [star(12, 3, 5, 9), star(-9, -12, 4, 7)], "c": [[(2.0, 2.0), (2.0, 6.0), (6.0, 6.0), (6.0, 2.0), (2.0, 2.0)]]}
    points = [(i, rng.uniform(-16, 18), rng.uniform(-18, 12)) for i in range(500)] + [(500, 2.0, 3.0), (501, 6.0, 3.0), (502, 4.0, 2.0), (503, 4.0, 6.0), (504, None, 1.0)]
    rings = spark.createDataFrame([(k, [[{"lat": a, "lon": b} for a, b in r] for r in v]) for k, v in shapes.items()], "region string, rings array<array<struct<lat:double,lon:double>>>")
    got = {r.id: r.region for r in regions.regions_of(spark.createDataFrame(points, "id long, lat double, lon double"), rings, {"b": "A b"}, square).collect()}
    for i, lat, lon in points:
        own = [{"b": "A b"}.get(k, k) for k, v in shapes.items() if lat is not None and inside(v, lat, lon)]
        assert got.get(i) == (min(own) if own else None), (i, lat, lon)
    squares = regions.covers(regions.region_edges(rings), square).collect()
    assert any(r.inner for r in squares) or square > 1


def test_forest_equals_brute_force_and_its_cuts_single_linkage(spark):
    rng = random.Random(12)
    nodes = list(range(14))
    weights = {(a, b): rng.randrange(1, 9) / 2 for a, b in itertools.combinations(nodes[:12], 2) if rng.random() < 0.3}
    edges = spark.createDataFrame([(a, b, w) if rng.random() < 0.5 else (b, a, w) for (a, b), w in weights.items()], "u long, v long, w double")

    def parts(some):
        label = {n: n for n in nodes}
        for a, b in some:
            x, y = sorted((label[a], label[b]))
            label = {n: x if v == y else v for n, v in label.items()}
        return label

    want, label = 0.0, {n: n for n in nodes}
    for (a, b), w in sorted(weights.items(), key=lambda e: -e[1]):
        if label[a] != label[b]:
            want += w
            x, y = sorted((label[a], label[b]))
            label = {n: x if v == y else v for n, v in label.items()}
    forest = clusters.spanning_forest(edges)
    kept = [((r.u, r.v), r.w) for r in forest.collect()]
    assert abs(sum(w for _, w in kept) - want) < 1e-9 and parts(e for e, _ in kept) == parts(weights) and all(weights[e] == w for e, w in kept)
    frame = spark.createDataFrame([(n,) for n in nodes], "node long")
    for height in (1.0, 2.5, 4.0, 9.0):
        assert {r.node: r.cluster for r in clusters.cut_forest(forest, frame, height).collect()} == parts(e for e, w in weights.items() if w >= height)
    for k in (14, 8, 6, 1):
        assert len({r.cluster for r in clusters.cut_forest(forest, frame, clusters=k).collect()}) == max(k, len(set(parts(weights).values())))
    assert clusters.spanning_forest(edges.where("w < 0")).count() == 0


def test_zones_of_linked_locations(spark):
    scores = spark.createDataFrame([(1, 0.0), (2, 0.05), (3, 0.1), (4, 0.12), (5, 0.9)], "loc long, score double")
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 5), (1, 5)], "loc long, nbr long")
    got = {r["loc"]: r["zone"] for r in clusters.influence_zones(scores, 0.1, links).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert {r["loc"]: r["zone"] for r in clusters.influence_zones(scores, 0.1).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}


def test_clusters_are_mapped_by_their_overlap(spark):
    a = spark.createDataFrame([(i, i // 4) for i in range(12)], "node long, cluster long")
    b = spark.createDataFrame([(0, 9), (1, 9), (2, 9), (4, 8), (5, 8), (3, 7), (6, 7), (8, 7), (9, 6), (10, 6), (11, 6)], "node long, cluster long")
    got = {r.y: (r.x, r.n, r.share) for r in pairs.cluster_mapping(a, b).collect()}
    assert got == {9: (0, 3, 1.0), 8: (1, 2, 1.0), 6: (2, 3, 1.0)}
    assert pairs.cluster_agreement(a, b, 0.5).first()[0] == pytest.approx(1.0)
    assert pairs.cluster_agreement(a, b).first()[0] < 1


@pytest.mark.parametrize("bins", [2, 16])
def test_exact_percentiles_equal_the_aggregate(spark, bins):
    rng = random.Random(13)
    rows = [(k, v) for k, vs in {
        "many": [rng.gauss(0, 5) for _ in range(301)], "ties": [rng.choice([1.0, 2.0, 2.0, 9.0]) for _ in range(80)], "one": [4.0], "two": [1.0, 8.0], "same": [3.0] * 7,
        "far": [-1.7e308, 1.7e308, 0.0, 1e-300, 5.0, 7.0], "none": [None],
    }.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = {r.k: r.q for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("q")).collect()}
    got = {r.k: r.q for r in exact_percentiles(df, ["k"], "v", shares, bins).collect()}
    assert got.keys() == want.keys()
    assert all(a == pytest.approx(b, rel=1e-12) for k in want if k != "far" for a, b in zip(got[k], want[k]))
    assert got["far"][0] == -1.7e308 and got["far"][4] == 1.7e308
    whole = exact_percentiles(df.where("k <> 'far'"), [], "v", (0.5,), bins).first()["q"][0]
    assert whole == pytest.approx(df.where("k <> 'far'").agg(F.percentile("v", 0.5)).first()[0])
    assert exact_percentiles(df.where("v is null"), ["k"], "v", (0.5,)).count() == 0
    rest = lambda hot: sorted(map(tuple, timeline.drop_outliers(df.where("k <> 'far' and v is not null"), ["k"], "v", hot=hot).collect()))
    assert rest(True) == rest(False)


def test_curves_equal_evaluation_at_each_k(spark):
    rng = random.Random(14)
    topics = [f"t{i}" for i in range(9)]
    scored = [(tu, loc, m, t, round(rng.random(), 2)) for tu in range(3) for loc in range(3) for m in "ab" if (loc, m) != (2, "b") for t in rng.sample(topics, rng.randrange(1, 8))]
    ahead = [(tu, loc, t, rng.randrange(1, 5)) for tu in range(3) for loc in range(3) for t in rng.sample(topics, rng.randrange(1, 7))]
    s, f = spark.createDataFrame(scored, "tu long, loc long, model string, topic string, score double"), spark.createDataFrame(ahead, "tu long, loc long, topic string, n long")
    row = lambda r: (r.tu, r.loc, r.model, r.k, round(r.accuracy, 9), round(r.impact, 9), round(r.difference, 9))
    want = sorted(map(row, predict.evaluate(s, f, range(1, 7), ("a", "b")).collect()))
    assert sorted(map(row, predict.performance_curve(s, f, 6, ("a", "b")).collect())) == want
    assert sorted(map(row, predict.performance_curve(s, f, 6).collect())) == want


def test_windows_as_columns_equal_each_by_itself(spark):
    rng = random.Random(15)
    occ = spark.createDataFrame([(f"t{rng.randrange(4)}", rng.randrange(3), rng.randrange(0, 40) * 1800) for _ in range(150)], "topic string, loc long, t long")
    got = predict.performance_grid(occ, predict.predict_greedy, ((3, 1), (5, 2)), (1, 2), ("greedy",))
    for h, p in ((3, 1), (5, 2)):
        past, ahead = predict.window_counts(occ, h, p)
        want = predict.evaluate(predict.predict_greedy(past), ahead, (1, 2), ("greedy",))
        columns = ["tu", "loc", "model", "k", "accuracy", "impact", "difference"]
        assert sorted(map(tuple, got.where((F.col("h") == h) & (F.col("p") == p)).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
