"""Statistics of values without spread, as tables with many events give them, against DuckDB."""

import math
import statistics
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from topotide.operators import distributions as dist
from topotide.operators import pairs, predict


def alike(a, b):
    return len(a) == len(b) and all(x == y or (x is not None and y is not None and (math.isclose(x, y, abs_tol=1e-9) or (math.isnan(x) and math.isnan(y)))) for x, y in zip(a, b))


@pytest.mark.parametrize("rows", [[(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], [(2.0, 1.0), (2.0, 3.0)], [(1.0, 1.0)], [], [(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 1.0)], [(1.0, 2.0), (2.0, None)]])
def test_correlations_without_spread_equal_sql(spark, rows):
    values = ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in r) + ")" for r in rows) or "(0.0, 0.0)"
    table = f"(SELECT * FROM (VALUES {values}) v(x, y) WHERE {bool(rows)})"
    df = spark.createDataFrame(rows, "x double, y double")
    assert alike(dist.pair_correlation(df, "x", "y").first(), duckdb.sql(f"SELECT count(*), corr(x::DOUBLE, y::DOUBLE) FROM {table}").fetchall()[0])
    assert alike(predict.line_fit(df, "x", "y").first(), duckdb.sql(f"SELECT count(*), corr(x::DOUBLE, y::DOUBLE), regr_slope(y::DOUBLE, x::DOUBLE), regr_intercept(y::DOUBLE, x::DOUBLE) FROM {table}").fetchall()[0])


def test_locality_correlation_of_equal_means(spark):
    df = spark.createDataFrame([(10.0, 1.0), (20.0, 1.0), (1200.0, 1.0)], "distance double, jaccard double")
    got = dist.locality_correlation(df, "jaccard", 500).first()
    assert got["n_bins"] == 2 and math.isnan(got["r"])


def test_agreement_that_chance_explains_is_not_a_number(spark):
    nodes = spark.range(6).select(F.col("id").alias("node"))
    together, apart = nodes.withColumn("cluster", F.lit(1)), nodes.withColumn("cluster", F.col("node"))
    for a, b in ((together, together), (apart, apart), (together.limit(1), apart)):
        assert math.isnan(pairs.cluster_agreement(a, b).first()[0])
    assert pairs.cluster_agreement(together, apart).first()[0] == 0.0
    assert pairs.cluster_agreement(together.limit(0), apart).first()[0] is None


def test_filtered_means_do_not_hang_on_the_order_of_rows(spark):
    for values in ([0.1] * 10, [1.0] * 31 + [0.01], [0.01] + [1.0] * 31, [0.7, 0.1, 0.2] * 9):
        df = spark.createDataFrame([(10.0, v) for v in values], "distance double, jaccard double").coalesce(1)
        got = dist.filtered_affinity_by_distance(df, "jaccard", 500).first()
        low, high = (statistics.quantiles(values, n=4, method="inclusive")[i] for i in (0, 2))
        kept = [v for v in values if low - 1.5 * (high - low) <= v <= high + 1.5 * (high - low)]
        assert (got["n"], got["mean"]) == (len(kept), float(sum(Fraction(str(v)) for v in kept) / len(kept)))
