"""Column expressions: distances, cells, buckets, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.761
#: Factor that makes one whole number of a pair of cell indices.
CELL_STRIDE = 10_000_000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def cell_index(degrees: Column, size: float) -> Column:
    """Index of a lattice cell; truncates toward zero."""
    return (degrees / F.lit(size)).cast("bigint")


def cell_key(ci: Column, cj: Column) -> Column:
    return ci * CELL_STRIDE + cj


def bucket(t: Column, unit: int) -> Column:
    """Epoch seconds floored to a unit."""
    return t - F.pmod(t, F.lit(unit).cast("bigint"))


def bin_up(x: Column, width: int) -> Column:
    """Upper edge of the bin that holds ``x``."""
    return (F.floor(x / width) * width + width).cast("bigint")


def temporal_score(lag: Column, width: Column) -> Column:
    """1 at no lag, falling with its logarithm to 0 at ``width`` and beyond."""
    return F.when(lag == 0, 1.0).when(lag >= width, 0.0).otherwise(1 - F.ln(lag) / F.ln(width))


def spread_kernel(miles: Column) -> Column:
    return F.pow(F.lit(1.01), -miles)


def entropy_of(share: Column) -> Column:
    """Aggregate: base-2 entropy of shares that sum to one."""
    return F.sum(F.when(share > 0, -share * F.log2(share)).otherwise(0.0))
