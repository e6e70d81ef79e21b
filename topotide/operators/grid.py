"""Cells, boxes and areas."""

from __future__ import annotations

import math
from collections.abc import Mapping
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topotide.functions.columns import CELL_STRIDE, cell_index, cell_key, haversine
from topotide.operators.regions import SQUARE, regions_of

Box = tuple[float, float, float, float]


def with_cell(df: DataFrame, size: float = 0.145, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ci, cj (lattice indices, toward zero) and cell (both as one key)."""
    out = df.withColumn("ci", cell_index(F.col(lat), size)).withColumn("cj", cell_index(F.col(lon), size))
    return out.withColumn("cell", cell_key(F.col("ci"), F.col("cj")))


def cell_point(df: DataFrame, size: float) -> DataFrame:
    """Add the reference point, a corner, of each cell."""
    return df.withColumn("cell_lat", F.col("ci") * size).withColumn("cell_lon", F.col("cj") * size)


def drop_origin_cell(df: DataFrame) -> DataFrame:
    """Without the cell at (0, 0), where bad geocodes gather."""
    return df.where("not (ci = 0 and cj = 0)")


def with_metric_cell(df: DataFrame, metres: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add zone, easting, northing, utm_cell: the UTM box of the given width.

    The forward projection is the usual series on the WGS84 ellipsoid, as
    column arithmetic.  The id holds zone, hemisphere, box indices and width.
    """
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(F.col(lat))
    zone = (F.floor((F.col(lon) + 180) / 6) % 60 + 1).cast("int")
    lam = F.radians(F.col(lon) - ((zone - 1) * 6 - 180 + 3))
    n = F.lit(a) / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2)
    al = lam * F.cos(phi)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (al + (1 - t + c) * F.pow(al, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(al, 5) / 120) + 500000
    north = k0 * (m + n * F.tan(phi) * (al * al / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(al, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(al, 6) / 720))
    north = F.when(F.col(lat) < 0, north + 10_000_000).otherwise(north)
    out = df.withColumn("zone", zone).withColumn("easting", east).withColumn("northing", north)
    half = F.when(F.col(lat) < 0, "S").otherwise("N")
    return out.withColumn("utm_cell", F.concat_ws("_", F.concat(F.col("zone").cast("string"), half), F.floor(F.col("easting") / metres), F.floor(F.col("northing") / metres), F.lit(metres)))


def within(box: Box, lat: str = "lat", lon: str = "lon") -> Column:
    """(lat low, lon low, lat high, lon high), closed."""
    return F.col(lat).between(box[0], box[2]) & F.col(lon).between(box[1], box[3])


def within_bbox(df: DataFrame, box: Box) -> DataFrame:
    return df.where(within(box))


def label_area(df: DataFrame, areas: Sequence[tuple[str, Box]]) -> DataFrame:
    """Add area: the name of the first box that holds the point, else null."""
    label = F.lit(None).cast("string")
    for name, box in reversed(list(areas)):
        label = F.when(within(box), F.lit(name)).otherwise(label)
    return df.withColumn("area", label)


def only_locations(df: DataFrame, allowed: DataFrame, key: str = "cell") -> DataFrame:
    """Rows whose location is in ``allowed``."""
    return df.join(allowed.select(key).distinct(), key, "left_semi")


def network_of(user: Column) -> Column:
    """Network of a user id: numbers belong to one network, others are prefixed with theirs."""
    return F.when(user.rlike("^[0-9]+$"), "4sq").otherwise(F.split(user, "_")[0])


def country_of(cells: DataFrame, polygons: DataFrame, size: float, aliases: Mapping[str, str] | None = None, square: float = SQUARE) -> DataFrame:
    """Add country to rows with ci, cj: the polygon that holds the cell's point, null if none does.

    ``polygons`` has (country, ring array<struct<lat,lon>>), or (country, rings
    array of such) with parts and holes; several rows of a country add up.
    Each distinct cell is looked up once.
    """
    rings = F.array("ring") if "ring" in polygons.columns else F.col("rings")
    regions = polygons.select(F.col("country").alias("region"), rings.alias("rings")).groupBy("region").agg(F.flatten(F.collect_list("rings")).alias("rings"))
    points = cell_point(cells.select("ci", "cj").distinct(), size).select("ci", "cj", F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"))
    found = regions_of(points, regions, aliases, square).withColumnRenamed("region", "country")
    return cells.join(found, ["ci", "cj"], "left")


def coarse_cell_pairs(pairs: DataFrame, size: float, factor: int = 10, top: int = 2) -> DataFrame:
    """(l, r, distance, n): pairs of cells rolled up to cells ``factor`` times as wide, the most frequent ``top`` of each distance.

    Pairs inside one wide cell drop out.  distance is in whole miles between
    the wide cells' points.
    """
    def index(c: str) -> tuple[Column, Column]:
        ci = F.round(F.col(c) / CELL_STRIDE).cast("bigint")
        return (ci / factor).cast("bigint"), ((F.col(c) - ci * CELL_STRIDE) / factor).cast("bigint")

    both = pairs.select(cell_key(*index("l")).alias("a"), cell_key(*index("r")).alias("b")).where("a <> b")
    counts = both.groupBy(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    (li, lj), (ri, rj) = ((F.round(F.col(c) / CELL_STRIDE).cast("bigint"), F.col(c) - F.round(F.col(c) / CELL_STRIDE).cast("bigint") * CELL_STRIDE) for c in ("l", "r"))
    wide = size * factor
    rows = counts.withColumn("distance", F.round(haversine(li * wide, lj * wide, ri * wide, rj * wide)).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("distance").orderBy(F.desc("n"), "l", "r"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("l", "r", "distance", "n")


def degrees_of_miles(miles: float) -> float:
    return math.degrees(miles / 3958.761)
