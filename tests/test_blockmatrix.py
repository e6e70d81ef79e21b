"""Block systems against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topotide.operators import selection
from topotide.operators.blockmatrix import blocked, solve, unblocked

ENTRY = "row long, col long, value double"


def entries(spark, m):
    r, c = np.nonzero(m)
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(r, c)], ENTRY)


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] += r["value"]
    return out


@pytest.mark.parametrize("n, m, size", [(5, 3, 8), (8, 8, 4), (11, 6, 4)])
def test_solution_equals_numpy(spark, n, m, size):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.5)
    a = a @ a.T + np.eye(n) * 0.1
    b = rng.normal(size=(n, m)) * (rng.random((n, m)) < 0.6)
    x = dense(solve(entries(spark, a), entries(spark, b), n, size), (n, m))
    assert np.abs(x - np.linalg.solve(a, b)).max() < 1e-8
    assert np.abs(dense(unblocked(blocked(entries(spark, a), size), size), (n, n)) - a).max() == 0


def test_a_system_without_solution_is_refused(spark):
    a = np.array([[1.0, 1.0], [1.0, 1.0 + 1e-17]])
    with pytest.raises(Exception, match="off by|Singular"):
        solve(entries(spark, a), entries(spark, np.array([[1.0], [2.0]])), 2, 4).collect()


def test_share_regression_equals_one_dense_solve(spark):
    rng = np.random.default_rng(4)
    topics, locs = 30, 9
    early, final = rng.random((topics, locs)) * (rng.random((topics, locs)) < 0.7), rng.random((topics, locs))
    rows = lambda m, name: spark.createDataFrame([(f"t{i}", j * 10, float(m[i, j])) for i in range(topics) for j in range(locs) if m[i, j]], f"topic string, loc long, {name} double")
    model = selection.share_regression(rows(early, "x"), rows(final, "y"), 1e-3, block=4)
    want = np.linalg.solve(early.T @ early + 1e-3 * np.eye(locs), early.T @ final)
    got = {(r["src"], r["loc"]): r["coefficient"] for r in model.collect()}
    assert len(got) == locs * locs
    assert max(abs(got[i * 10, j * 10] - want[i, j]) for i in range(locs) for j in range(locs)) < 1e-8
    shares = {(r["topic"], r["loc"]): r["score"] for r in selection.predicted_shares(rows(early, "x"), model).collect()}
    fit = early @ want
    assert all(abs(v - fit[int(t[1:]), l // 10]) < 1e-8 for (t, l), v in shares.items())
    assert selection.share_regression(rows(early, "x").where(F.lit(False)), rows(final, "y")).count() == 0
