"""Which region holds a point, through a cover of each region by squares.

The border of a region crosses some squares of a lattice.  Between them lie
squares that are inside as a whole, found row by row from the border's
crossings.  A point meets its square in one equi-join: in an inner square the
region is known, and only in a border square are crossings of a ray counted,
against the edges of that row of squares.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Degrees of a square.
SQUARE = 1.0


def region_edges(regions: DataFrame) -> DataFrame:
    """(region, lat1, lon1, lat2, lon2): the edges of all rings of ``regions`` (region, rings array<array<struct<lat,lon>>>).

    A region may have several parts and holes, each a ring, closed or not.
    Level edges cross no ray and are left out.
    """
    ring = regions.select("region", F.explode("rings").alias("ring")).where(F.size("ring") >= 3)
    points = ring.select("region", "ring", F.posexplode("ring").alias("i", "a"))
    b = F.element_at("ring", (F.pmod(F.col("i") + 1, F.size("ring")) + 1).cast("int"))
    edges = points.select("region", F.col("a.lat").alias("lat1"), F.col("a.lon").alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2"))
    return edges.where("lat1 <> lat2 or lon1 <> lon2")


def _lon_at(lat: Column) -> Column:
    """Where an edge meets a latitude; null for a level edge."""
    return F.col("lon1") + F.try_divide((lat - F.col("lat1")) * (F.col("lon2") - F.col("lon1")), F.col("lat2") - F.col("lat1"))


def row_edges(edges: DataFrame, square: float = SQUARE) -> DataFrame:
    """The edges once for each row ``i`` of squares they reach."""
    rows = F.sequence(F.floor(F.least("lat1", "lat2") / square), F.floor(F.greatest("lat1", "lat2") / square))
    return edges.withColumn("i", F.explode(rows))


def covers(edges: DataFrame, square: float = SQUARE) -> DataFrame:
    """(region, i, j, inner): squares that a border crosses, and squares that lie inside as a whole."""
    rows = row_edges(edges, square)
    bottom, top = F.greatest(F.least("lat1", "lat2"), F.col("i") * square), F.least(F.greatest("lat1", "lat2"), (F.col("i") + 1) * square)
    level = F.col("lat1") == F.col("lat2")
    one, two = F.when(level, F.col("lon1")).otherwise(_lon_at(bottom)), F.when(level, F.col("lon2")).otherwise(_lon_at(top))
    slack = 1e-9  # a border that touches a square's side counts for both
    columns = F.sequence(F.floor((F.least(one, two) - slack) / square), F.floor((F.greatest(one, two) + slack) / square))
    border = rows.select("region", "i", F.explode(columns).alias("j"))
    # a vertex on a side between two rows belongs to the row above too, whose edges start there
    border = border.distinct()
    middle = (F.col("i") + 0.5) * square
    crossing = rows.where((F.col("lat1") > middle) != (F.col("lat2") > middle)).select("region", "i", _lon_at(middle).alias("lon"))
    order = Window.partitionBy("region", "i").orderBy("lon")
    spans = crossing.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("lon").over(order)).where("n % 2 = 1 and next is not null")
    low, high = F.ceil(F.col("lon") / square), F.floor(F.col("next") / square) - 1
    inside = spans.where(high >= low).select("region", "i", F.explode(F.sequence(low, high)).alias("j"))
    inner = inside.join(border, ["region", "i", "j"], "left_anti")
    return inner.withColumn("inner", F.lit(True)).unionByName(border.withColumn("inner", F.lit(False)))


def regions_of(points: DataFrame, regions: DataFrame, aliases: Mapping[str, str] | None = None, square: float = SQUARE) -> DataFrame:
    """(key columns, region) of ``points`` (key columns, lat, lon) that lie in a region; the smallest name where regions overlap.

    ``aliases`` gives another name to some regions, as where two spellings of
    one name are in use.  A point whose ray meets an odd number of edges is
    inside.  Points outside of all regions, or with a null, make no row.
    """
    keys = [c for c in points.columns if c not in ("lat", "lon")]
    named = F.col("region")
    for old, new in (aliases or {}).items():
        named = F.when(F.col("region") == old, new).otherwise(named)
    edges = region_edges(regions)
    placed = points.where("lat is not null and lon is not null").withColumn("i", F.floor(F.col("lat") / square)).withColumn("j", F.floor(F.col("lon") / square))
    met = placed.join(covers(edges, square), ["i", "j"])
    sure = met.where("inner").select(*keys, "region")
    rows = row_edges(edges, square).withColumnRenamed("region", "of").withColumnRenamed("i", "row")
    near = met.where("not inner").join(rows, (F.col("region") == F.col("of")) & (F.col("i") == F.col("row")) & ((F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))))
    crossed = near.where(F.col("lon") < _lon_at(F.col("lat"))).groupBy(*keys, "region").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    found = sure.unionByName(crossed.select(*keys, "region"))
    return found.groupBy(*keys).agg(F.min(named).alias("region"))

