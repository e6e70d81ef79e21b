"""Linear systems as tables of square blocks.

A matrix is a table (i, j, data): block row, block column, and the block's
entries as doubles.  A system is solved by block elimination: each round one
block row is divided by its pivot and subtracted from the others through two
joins, so a task holds three blocks at a time, whatever the size of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topotide.plans.scratch import new_path, remove, written

#: Rows and columns of a block.
BLOCK = 256


def numbered(names: DataFrame, name: str, number: str) -> DataFrame:
    """(name, number): distinct names with numbers from 0; one row for each row or column of a matrix."""
    return names.select(name).distinct().withColumn(number, (F.row_number().over(Window.orderBy(name)) - 1).cast("long"))


def blocked(entries: DataFrame, size: int = BLOCK) -> DataFrame:
    """(i, j, data) of the entries (row, col, value), which are numbered from 0; entries of one place are added up."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((size, size))
        np.add.at(block, (rows["row"].to_numpy() % size, rows["col"].to_numpy() % size), rows["value"].to_numpy())
        return pd.DataFrame({"i": [rows["row"].iloc[0] // size], "j": [rows["col"].iloc[0] // size], "data": [block.tobytes()]})

    return entries.groupBy(F.floor(F.col("row") / size).alias("bi"), F.floor(F.col("col") / size).alias("bj")).applyInPandas(fill, "i long, j long, data binary")


def unblocked(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, col, value) of the entries that are not zero."""

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for i, j, data in zip(df["i"], df["j"], df["data"]):
                block = np.frombuffer(data).reshape(size, size)
                r, c = np.nonzero(block)
                yield pd.DataFrame({"row": r + i * size, "col": c + j * size, "value": block[r, c]})

    return blocks.mapInPandas(spread, "row long, col long, value double")


def _through(size: int, make) -> object:
    """A pandas UDF of binary columns: ``make`` gets each row's blocks, null as None, and returns a block."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            rows = zip(*columns)
            yield pd.Series([make(*[None if x is None else np.frombuffer(x).reshape(size, size) for x in row]).tobytes() for row in rows], dtype=object)

    return run


def solve(a: DataFrame, b: DataFrame, n: int, size: int = BLOCK, tolerance: float = 1e-6) -> DataFrame:
    """(row, col, value): the solution X of A X = B for entries (row, col, value) of a symmetric positive definite A of ``n`` rows.

    B may have any number of columns, which are all solved for at once.  A
    round goes over the remaining block columns only and is written to the
    shared folder.  Raises ValueError if A X z and B z, for a vector z of signs,
    differ by more than ``tolerance`` times the largest entry of B z; a pivot
    that isn't invertible fails too.
    """
    steps = -(-n // size)
    padding = a.sparkSession.range(n, steps * size).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))
    left = written(blocked(a.select("row", "col", "value").unionByName(padding), size), "left")
    wanted = written(blocked(b.select("row", "col", "value"), size), "right")
    state, path = left.unionByName(wanted.withColumn("j", F.col("j") + steps)), None

    @F.pandas_udf("binary")
    def divide(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pivots, rows in parts:
            yield pd.Series([np.linalg.solve(np.frombuffer(p).reshape(size, size), np.frombuffer(x).reshape(size, size)).tobytes() for p, x in zip(pivots, rows)], dtype=object)

    subtract = _through(size, lambda own, column, row: (0.0 if own is None else own) - column @ row)
    for k in range(steps):
        pivot = state.where((F.col("i") == k) & (F.col("j") == k)).select(F.col("i").alias("pi"), F.col("data").alias("pivot"))
        row = state.where((F.col("i") == k) & (F.col("j") > k)).join(pivot, F.col("i") == F.col("pi")).select(F.col("j").alias("rj"), divide("pivot", "data").alias("r"))
        row_path, next_path = new_path(a.sparkSession, "row"), new_path(a.sparkSession, "state")
        row = written(row, "row", row_path)
        column = state.where((F.col("j") == k) & (F.col("i") != k)).select(F.col("i").alias("ci"), F.col("data").alias("c"))
        # blocks that become non-zero: a block row with an entry in this column, at each block column of the pivot's row
        touched = column.withColumn("rj", F.explode(F.lit([r["rj"] for r in row.select("rj").collect()]).cast("array<long>"))) if steps > 1 else None
        others = state.where((F.col("j") > k) & (F.col("i") != k))
        if touched is not None:
            both = others.join(touched.join(row, "rj").select("ci", F.col("rj").alias("cj"), "c", "r"), (F.col("i") == F.col("ci")) & (F.col("j") == F.col("cj")), "full")
            kept = both.where("ci is null").select("i", "j", "data")
            changed = both.where("ci is not null").select(F.col("ci").alias("i"), F.col("cj").alias("j"), subtract("data", "c", "r").alias("data"))
            others = kept.unionByName(changed)
        state = written(others.unionByName(row.select(F.lit(k).cast("long").alias("i"), F.col("rj").alias("j"), F.col("r").alias("data"))), "state", next_path)
        if path:
            remove(a.sparkSession, path[0]), remove(a.sparkSession, path[1])
        path = (row_path, next_path)
    x = unblocked(state.where(F.col("j") >= steps).withColumn("j", F.col("j") - steps), size).where(F.col("row") < n)
    _refuse_if_wrong(a, x, b, tolerance)
    return x


def _refuse_if_wrong(a: DataFrame, x: DataFrame, b: DataFrame, tolerance: float) -> None:
    """Compare A (X z) with B z for a vector z of signs by hash: sums along rows, so no product of matrices is made."""
    sign = F.when(F.pmod(F.xxhash64("col"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    along = lambda m: m.groupBy("row").agg(F.sum(F.col("value") * sign).alias("v"))
    xz = along(x).select(F.col("row").alias("col"), "v")
    made = a.join(xz, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("v")).alias("m"))
    both = made.join(along(b), "row", "full").select(F.abs(F.coalesce("m", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))).alias("off"), F.abs(F.coalesce("v", F.lit(0.0))).alias("size"))
    found = both.agg(F.max("off").alias("off"), F.max("size").alias("size")).first()
    if found["off"] is not None and not found["off"] <= tolerance * max(found["size"], 1e-300):
        raise ValueError(f"the solution is off by {found['off']}, more than {tolerance} of the largest right side, {found['size']}")
