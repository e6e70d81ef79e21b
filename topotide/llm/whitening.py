"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries are scaled to whole numbers.  A block of rows is shifted by its
smallest entry in each dimension and cut into bit planes: a plane holds one bit
of one dimension for all rows of the block, packed into 64-bit words.  The sum
of products of two dimensions is the sum over their planes of the popcount of
the planes' AND, weighted by the planes' powers of two.  Blocks are added up as
whole numbers, first in a task, then by Spark, so the scatter is exact whatever
the order of rows; it is centred as whole numbers, and only then becomes the
doubles that ``eigh`` takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.llm.tables import plainly_named, table
from topotide.plans.scratch import written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries of a block, which bound its memory, and its rows at most.
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 19, 8192
#: Whole numbers of this size and more are refused: sums of their products could pass the decimals that Spark adds up.
LARGEST = 1 << 52


class Whitening(NamedTuple):
    """What is needed to whiten a row: count and sums of the fit list, unit eigenvectors in columns, their eigenvalues in falling order, and the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def finite_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows of ``df`` whose vector is not null, has no null, NaN or infinite entry, and has the most frequent length of such vectors."""
    e = F.col(f"`{vector}`")
    fine = df.where(e.isNotNull() & F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))))
    widest = fine.groupBy(F.size(e).alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size(e) == (widest["d"] if widest else 0)) if widest else fine.where(F.lit(False))


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """floor(1024 * entry) + 100000."""
    scaled = np.floor(entries.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST // SCALE}, the largest that can be scaled to a whole number")
    return scaled.astype(np.int64) + OFFSET


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, shift) of the planes of non-negative whole numbers, rows by dimensions.

    The planes of a dimension are as many as its largest number has bits.
    """
    rows, width = y.shape
    bits = [int(m).bit_length() for m in y.max(axis=0)] if rows else [0] * width
    dimension = np.repeat(np.arange(width), bits)
    shift = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if sum(bits) else np.zeros(0, np.int64)
    words = np.zeros((len(shift), -(-rows // 64)), "<u8")
    packed = words.view(np.uint8)
    at = 0
    for a, b in enumerate(bits):
        ones = ((y[:, a][None, :] >> np.arange(b)[:, None]) & 1).astype(np.uint8)
        packed[at : at + b, : -(-rows // 8)] = np.packbits(ones, axis=1)
        at += b
    return words, dimension, shift


def scatter_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, products) of non-negative whole numbers, exact: products[a, b] for a <= b is the sum over rows of y_a * y_b."""
    rows, width = y.shape
    words, dimension, shift = bit_planes(y)
    largest = int(shift.max()) + 1 if len(shift) else 0
    kind = object if 2 * largest + rows.bit_length() > 62 else np.int64
    sums, products = np.zeros(width, kind), np.zeros((width, width), kind)
    if not len(shift):
        return sums, products
    weight = np.array([1 << int(s) for s in shift], dtype=kind)
    present, first = np.unique(dimension, return_index=True)
    for p in range(len(shift)):
        a = int(np.searchsorted(present, dimension[p]))
        start = first[a]
        counts = np.bitwise_count(words[p] & words[start:]).sum(axis=1, dtype=np.int64).astype(kind)
        products[dimension[p], present[a:]] += np.add.reduceat(counts * weight[start:], first[a:] - start) * weight[p]
        sums[dimension[p]] += counts[p - start] * weight[p]  # a plane ANDed with itself counts its ones
    return sums, products


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches that hold a block of rows, with their vectors as whole numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        width = len(batch.column(column)[0])
        step = max(64, min(BLOCK_ROWS, BLOCK_ENTRIES // width // 64 * 64))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, whole_numbers(part.column(column).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def scatter(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(a, b, value): exact sums over rows of x_a * x_b for a <= b, of x_a at b = -1, and the count at a = b = -1.

    A task sends one row for each pair of dimensions, however many rows it has
    read, so its memory and what is shuffled grow with the square of the
    dimensions alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, None, None
        for _, x in _matrices(batches, 0):
            if total is None:
                total, product = np.zeros(x.shape[1], object), np.zeros((x.shape[1],) * 2, object)
            low = x.min(axis=0)
            sums, products = scatter_of(x - low)
            low, sums = low.astype(object), sums.astype(object)
            # from the shifted numbers back to x = y + low
            product += products.astype(object) + np.outer(low, sums) + np.outer(sums, low) + np.outer(low, low) * len(x)
            total += sums + low * len(x)
            n += len(x)
        if n:
            a, b = np.triu_indices(len(total))
            values = [n, *total.tolist(), *product[a, b].tolist()]
            firsts, seconds = np.concatenate(([-1], np.arange(len(total)), a)), np.concatenate(([-1] * (1 + len(total)), b))
            columns = [pa.array(firsts, pa.int32()), pa.array(seconds, pa.int32()), pa.array(list(map(Decimal, values)), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "value"])

    doubles = vectors.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return doubles.mapInArrow(run, "a int, b int, value decimal(38,0)").groupBy("a", "b").agg(F.sum("value").alias("value"))


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``vectors``; null if there are none.

    A row for each pair of dimensions comes to the driver.
    """
    rows = scatter(vectors, vector).collect()
    if not rows:
        return None
    value = {(r["a"], r["b"]): int(r["value"]) for r in rows}
    n, width = value[-1, -1], max(a for a, _ in value) + 1
    sums = np.array([value[a, -1] for a in range(width)], object)
    covariance = np.zeros((width, width))
    for (a, b), v in value.items():
        if b >= 0:
            covariance[a, b] = covariance[b, a] = (n * v - int(sums[a]) * int(sums[b])) / (n * n)  # whole numbers to the last step
    values, basis = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    return Whitening(n, sums, basis[:, order], values[order], float(np.trace(covariance)))


def whitened(vectors: DataFrame, fit: Whitening, vector: str = "embedding") -> DataFrame:
    """``vectors`` with deviation (decimal: the sum over dimensions of (n*x - S)^2, exact) and whitened (array of doubles) in place of the vector.

    A component whose eigenvalue is zero, to the precision of doubles, has no
    scale: its place in whitened is null.
    """
    names, vectors = [c for c in vectors.columns if c != vector], plainly_named(vectors, vector)
    n, width = fit.n, len(fit.sums)
    usable = fit.values > max(float(fit.values[0]), 0.0) * width * np.finfo(float).eps
    scale = np.where(usable, 1 / np.sqrt(np.where(usable, fit.values, 1.0)), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1):
            reach = n * int(np.abs(x).max()) + max(map(abs, map(int, fit.sums)))
            centred = x * np.int64(n) - fit.sums.astype(np.int64) if reach < 1 << 62 else x.astype(object) * n - fit.sums
            farthest = int(np.abs(centred).max())
            exact = centred if farthest * farthest * width < 1 << 62 else centred.astype(object)
            deviation = (exact * exact).sum(axis=1).tolist()
            out = ((centred / n).astype(np.float64) @ fit.vectors) * scale
            flat = pa.array(out.ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(Decimal, deviation)), pa.decimal128(38, 0)), lists], ["key", "deviation", "whitened"])

    others = [f"`{c}`" for c in vectors.columns if c != vector]
    slim = vectors.select(F.struct(*others).alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    made = slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")
    return made.select("key.*", "deviation", "whitened").toDF(*names, "deviation", "whitened")


def identity_error(rows: DataFrame, width: int) -> float | None:
    """The largest absolute entry of the covariance of whitened minus the identity, over the components that have a scale."""
    w = [F.col("whitened")[i] for i in range(width)]
    means = rows.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(w)]).first()
    used = [i for i in range(width) if means[i] is not None]
    if not used:
        return None

    def covariance(i: int, j: int) -> Column:
        return F.avg((w[i] - means[i]) * (w[j] - means[j]))

    pairs = [(i, j) for i in used for j in used if i <= j]
    found = rows.agg(*[covariance(i, j).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def whitening(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_exact) for each row with a finite vector and each component.

    Rows whose vector is null, or has a null or non-finite entry, go; so do
    vectors, the empty one among them, that are not as long as most, which lie
    in no common space.  Rows that repeat and null keys are rows like others.
    deviation is null where it passes the range of long; deviation_exact has
    it still.  Components with equal eigenvalues are any basis of their space.
    Where an eigenvalue is zero (constant dimensions, one row, fewer rows than
    components), whitened is null and the component stays out of
    identity_error; where all are, explained is null too.  An entry of 2^42 or
    more is refused.  An empty table gives no rows.  Other columns are not
    read, whatever their names.
    """
    vectors = finite_vectors(rows.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("embedding")))
    fit = fit_whitening(vectors, components=components)
    if fit is None:
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    made = written(whitened(vectors, fit), "whitened")
    error = F.lit(identity_error(made, len(fit.values))).cast("double")
    shares = F.array(*[F.lit(max(float(e), 0.0) / fit.trace if fit.trace > 0 else None).cast("double") for e in fit.values])
    each = made.select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), shares.alias("e"))).alias("at", "part"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        F.col("part.w").alias("whitened"),
        F.col("part.e").alias("explained"),
        error.alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))
