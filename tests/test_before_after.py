"""Before-and-after counts by one pass over sorted times: stretches, tiles and ties against counting of pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from topotide.operators import influence as infl


def counted(rows):
    """(topic, l, r): before, after of rows (topic, loc, t)."""
    want = {}
    for a, l, x in rows:
        for b, r, y in rows:
            if a == b and l < r:
                was = want.get((a, l, r), (0, 0))
                want[a, l, r] = (was[0] + (x < y), was[1] + (x > y))
    return want


def some_rows(seed, n=220):
    rng = random.Random(seed)
    return [(rng.choice("aab"), rng.randrange(7), rng.randrange(40)) for _ in range(n)] + [("alone", 3, 5), ("c", 1, 9), ("c", 2, 9)]


@pytest.mark.parametrize("area", [1 << 21, 14, 1])
def test_stretches_and_tiles_equal_pair_counting(spark, monkeypatch, area):
    monkeypatch.setattr(infl, "AREA", area)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a topic is cut into stretches
    try:
        rows = some_rows(3)
        got = infl.before_after(spark.createDataFrame(rows, "topic string, loc long, t long")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert {(r.topic, r.l, r.r): (r.before, r.after) for r in got} == counted(rows)
    first = Counter()
    for a, l, _ in rows:
        first[a, l] += 1
    assert all(r.nl == first[r.topic, r.l] and r.nr == first[r.topic, r.r] for r in got)


@pytest.mark.parametrize("size, area", [(1, 1 << 21), (3, 1 << 21), (50, 14), (50, 1)])
def test_a_stretch_does_not_depend_on_its_batches(monkeypatch, size, area):
    """Occurrences come once, ties at the ends of batches and chunks included."""
    monkeypatch.setattr(infl, "AREA", area)
    rows = sorted((t, i) for a, i, t in some_rows(5) if a == "a")
    k = 7
    cols = [np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int32), *(np.array(c) for c in zip(*rows)), np.full(len(rows), k, np.int32), np.full(len(rows), k, np.int32)]
    names = ["u", "tile", "t", "i", "k", "high"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + size]) for c in cols], names) for a in range(0, len(rows), size)]
    got = {(i, j): x for b in infl._segments(iter(batches)) for i, j, x in zip(*(b.column(c).to_pylist() for c in ("i", "j", "x"))) if j >= 0}
    want = {(i, j): sum(x > y for x, a in rows for y, b in rows if (a, b) == (i, j)) for i in range(k) for j in range(k) if i != j}
    assert got == {p: n for p, n in want.items() if n}


def test_unknown_times_are_in_no_order(spark):
    rows = [("a", 1, 5), ("a", 2, None), ("a", 2, 7), ("a", 3, None)]
    got = {(r.l, r.r): (r.before, r.after, r.nl, r.nr, r.mean_r) for r in infl.before_after(spark.createDataFrame(rows, "topic string, loc long, t long")).collect()}
    assert got == {(1, 2): (1, 0, 1, 2, 7.0), (1, 3): (0, 0, 1, 1, None), (2, 3): (0, 0, 2, 1, None)}
