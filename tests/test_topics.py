"""Topic operators: hand-made cases, and queries against their SQL."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from topotide import queries as q
from topotide.functions.columns import haversine, temporal_score
from topotide.operators import association as assoc
from topotide.operators import graphs, grid, linear, metrics, pairs, selection
from topotide.operators import influence as infl
from topotide.operators import timeline as tl

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


SOME = ["topic_metrics", "interval_stats", "active_regions", "location_similarity_lag", "influence", "components", "follow_the_leader", "chi_square", "trim_edges", "dyadic_range", "rank_share", "checkin_graph"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, db, name):
    got = q.QUERIES[name](spark, SF)
    want = db.sql(q.SQL[name])
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)


def occ(spark, rows):
    """Rows of (topic, cell, t)."""
    return tl.with_bucket(spark.createDataFrame(rows, "topic string, cell long, t long"), 3600)


def test_golden_entropy(spark):
    rows = spark.range(2655).select(F.lit("a").alias("topic"), (F.col("id") == 0).cast("long").alias("cell"))
    got = metrics.entropy_focus(rows, ["topic"]).first()
    assert got["entropy"] == pytest.approx(0.00482746495611) and got["focus"] == pytest.approx(0.999623352166) and got["focus_cell"] == 0


def test_focus_and_peak_ties_go_to_the_smallest(spark):
    o = occ(spark, [("a", 2, 0), ("a", 1, 3600), ("b", 5, 7200)])
    assert {r["topic"]: r["focus_cell"] for r in metrics.entropy_focus(o, ["topic"]).collect()} == {"a": 1, "b": 5}
    assert {r["topic"]: r["peak_iid"] for r in tl.peak_interval(tl.interval_counts(o, 3600)).collect()} == {"a": 0, "b": 0}


@pytest.mark.parametrize("empty, regions", [(12, 1), (13, 2)])
def test_regions_split_after_more_than_twelve_empty_buckets(spark, empty, regions):
    rows = [("a", 1, t) for start in (0, (empty + 1) * 3600) for t in range(start, start + 3)]
    got = tl.active_regions(occ(spark, rows)).collect()
    assert len(got) == regions and sum(r["total"] for r in got) == 6
    assert [r["region"] for r in got if r["is_highest"]] == [0]


def test_small_buckets_count_inside_a_region_only(spark):
    rows = [("a", 1, t) for t in (0, 1, 2, 3600, 7200, 7201, 7202, 20 * 3600)]
    assert tl.active_regions(occ(spark, rows)).first()["total"] == 6
    assert tl.highest_active_region(occ(spark, rows)).count() == 7


def test_cells_truncate_toward_zero(spark):
    df = spark.createDataFrame([(-0.05, 51.48), (0.05, -0.01), (-1.5, 1.5)], "lon double, lat double")
    got = [(r["ci"], r["cj"]) for r in grid.with_cell(df, 0.725).collect()]
    assert got == [(71, 0), (0, 0), (2, -2)]
    assert grid.drop_origin_cell(grid.with_cell(df, 0.725)).count() == 2


def test_haversine_and_score(spark):
    d = spark.range(1).select(haversine(F.lit(2.9), F.lit(101.5), F.lit(24.65), F.lit(-79.75)), haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), haversine(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0))).first()
    assert d[0] == pytest.approx(10531.4, abs=0.1) and d[1] == pytest.approx(math.pi * 3958.761) and d[2] == 0
    s = spark.range(1).select(*[temporal_score(F.lit(x), F.lit(10)) for x in (0, 10, 20)]).first()
    assert tuple(s) == (1, 0, 0)


def test_metric_cell(spark):
    got = grid.with_metric_cell(spark.createDataFrame([(43.642567, -79.387139), (-33.8568, 151.2153)], "lat double, lon double"), 1000).collect()
    assert got[0]["zone"] == 17 and got[0]["easting"] == pytest.approx(630084, abs=2) and got[0]["northing"] == pytest.approx(4833439, abs=2)
    assert got[1]["utm_cell"].startswith("56S_")


def test_country_of(spark):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    polygons = spark.createDataFrame([("sq", square)], "country string, ring array<struct<lat:double,lon:double>>")
    cells = spark.createDataFrame([(5, 5), (20, 5)], "ci long, cj long")
    assert {r["ci"]: r["country"] for r in grid.country_of(cells, polygons, 1.0).collect()} == {5: "sq", 20: None}


def test_outliers_of_small_groups_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 99.0), ("c", 1.0), ("c", 1.0), ("c", 1.0), ("c", 1.0), ("c", 50.0)], "k string, v double")
    got = sorted(tuple(r) for r in tl.drop_outliers(df, ["k"], "v").collect())
    assert got == [("a", 1.0), ("b", 1.0), ("b", 99.0)] + [("c", 1.0)] * 4


def test_before_after_equals_pair_counting(spark):
    rng = random.Random(1)
    rows = [("x", rng.randrange(4), rng.randrange(12)) for _ in range(120)]
    got = infl.before_after(spark.createDataFrame(rows, "topic string, loc long, t long")).collect()
    assert len(got) == 6
    for r in got:
        a, b = ([t for _, c, t in rows if c == r[s]] for s in ("l", "r"))
        assert r["before"] == sum(x < y for x in a for y in b) and r["after"] == sum(x > y for x in a for y in b)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionAll(spark.createDataFrame([(500, 501), (7, 7), (None, 3)], "u long, v long"))
    got = {r["node"]: r["component"] for r in graphs.components(edges).collect()}
    assert set(got.values()) == {0, 500} and len(got) == 203 and got[200] == 0


def test_fisher_equals_enumeration(spark):
    rows = [("w", "t", 8, 2, 1, 5), ("w", "u", 3, 0, 4, 90), ("v", "t", 0, 5, 5, 0)]
    got = assoc.fisher_exact(spark.createDataFrame(rows, "word string, topic string, n00 long, n01 long, n10 long, n11 long")).collect()
    for r, (_, _, a, b, c, d) in zip(got, rows):
        n, row, col = a + b + c + d, a + b, a + c
        p = lambda x: math.comb(row, x) * math.comb(n - row, col - x) / math.comb(n, col)
        assert r["p"] == pytest.approx(sum(p(x) for x in range(max(0, row + col - n), min(row, col) + 1) if p(x) <= p(a) * (1 + 1e-7)), rel=1e-6)


def test_least_squares_and_elimination(spark):
    rng = random.Random(2)
    rows = [("k", x := rng.random(), z := rng.random(), 1 + 2 * x - z) for _ in range(50)]
    got = linear.least_squares(spark.createDataFrame(rows, "loc string, a double, b double, y double"), ["loc"], ["a", "b"], "y").first()
    assert got["coefficients"] == pytest.approx([1, 2, -1])
    counts = [(c, f"t{i}", n) for i in range(60) for c, n in ((1, 3 * i + i % 3), (2, i), (3, rng.randrange(50)))]
    frames = linear.regression_frames(spark.createDataFrame(counts, "cell long, topic string, n long"), spark.createDataFrame([(1, 2), (1, 3)], "cell long, nbr long"))
    assert linear.significant_neighbours(frames, 60).first()["neighbours"][0] == 2


def test_selection(spark):
    rows = [("a", 1, 0), ("a", 1, 1), ("a", 2, 2), ("a", 1, 900), ("a", 3, 900), ("a", 2, 1000)]
    steps = selection.replay_units(spark.createDataFrame(rows, "topic string, loc long, t long"))
    chosen = selection.select_greedy(selection.seen(steps, 1), 2)
    assert [(r["loc"], r["rank"]) for r in chosen.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    got = selection.selection_metrics(chosen, steps, 1, 2).first()
    assert got["hit_rate"] == pytest.approx(2 / 3) and got["best_rate"] == pytest.approx(2 / 3) and got["miss_before"] == 0.5 and got["target_accuracy"] == 1


def test_cluster_agreement_of_equal_clusterings(spark):
    a = spark.range(30).select(F.col("id").alias("node"), (F.col("id") % 3).alias("cluster"))
    assert pairs.cluster_agreement(a, a).first()[0] == pytest.approx(1.0)


def test_clusters_see_the_edges_of_all_epochs(spark):
    from topotide import queries as q

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in q._epochs(spark, sf).collect():
        want[r["u"], r["v"]] = want.get((r["u"], r["v"]), 0) + r["w"]
    assert want and {(r["u"], r["v"]): r["w"] for r in q._edges(spark, sf).collect()} == want


def test_affinity_clusters_run_until_choices_settle(spark):
    from topotide.operators import clusters

    rows = [(a, b, 5.0) for k in (0, 10) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(3, 10, 1.0)]
    edges = spark.createDataFrame(rows, "u long, v long, w double")
    got = {r["node"]: r["cluster"] for r in clusters.affinity_clusters(edges, preference=2.0).collect()}
    assert set(got) == {*range(4), *range(10, 14)} and all(got[n] == (0 if n < 4 else 10) for n in got)
    with pytest.raises(RuntimeError):
        clusters.affinity_clusters(edges, rounds=3)
