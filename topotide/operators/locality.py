"""How near to one cell the occurrences of a topic lie: the smallest covering radius, through a pyramid of wider cells.

For a share k, the index of a topic is the smallest distance within which some
cell of the topic has that share of its occurrences.  Setting all its cells
against each other grows with their square.  Here wider cells stand for what
they hold first: two wide cells, each with a point in its middle and the
distance of its farthest member, bound the distance of any two members from
below and from above, and so bound the radius around any member.  A wide cell
whose lower bound is above the least upper bound can hold no centre, and goes
with all it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topotide.functions.columns import haversine
from topotide.plans.scratch import written

#: Shares of the occurrences.
SHARES = tuple(round(0.5 + 0.05 * i, 2) for i in range(11))
#: Wider cells of a key, above which a still wider level is laid over them.
ENOUGH = 128
#: Miles by which bounds may be off, for rounding.
SLACK = 1e-4


def levels_for(cells: int) -> list[int]:
    """Widths of wider cells, in cells, from wide to narrow, for keys of up to so many cells: none for a few, each four times the next."""
    widths, width = [], 2
    while cells / width**2 > ENOUGH:
        widths.insert(0, width)
        width *= 4
    return widths


def _wide(cells: DataFrame, keys: Sequence[str], size: float, width: int) -> DataFrame:
    """(keys, wi, wj, lat, lon, reach, n): wide cells with a middle, the miles to the farthest of its cells, and its occurrences."""
    wide = cells.withColumn("wi", F.floor(F.col("ci") / width)).withColumn("wj", F.floor(F.col("cj") / width))
    place = [*keys, "wi", "wj"]
    middle = wide.groupBy(*place).agg(((F.min("ci") + F.max("ci")) / 2 * size).alias("lat"), ((F.min("cj") + F.max("cj")) / 2 * size).alias("lon"))
    away = haversine(F.col("lat"), F.col("lon"), F.col("ci") * size, F.col("cj") * size)
    return wide.join(middle, place).groupBy(*place, "lat", "lon").agg(F.max(away).alias("reach"), F.sum("n").alias("n"))


def _reached(pairs: DataFrame, centre: Sequence[str], total: str, distance: str, shares: Sequence[float], name: str) -> DataFrame:
    """(centre, name_0, ...): for each share the smallest distance within which a centre has it."""
    run = F.sum("n").over(Window.partitionBy(*centre).orderBy(distance))  # equal distances come in together
    cover = pairs.withColumn("__run", run / F.col(total))
    return cover.groupBy(*centre).agg(*[F.min(F.when(F.col("__run") >= F.lit(s), F.col(distance))).alias(f"{name}_{i}") for i, s in enumerate(shares)])


def covering_radius(counts: DataFrame, keys: Sequence[str], size: float, shares: Sequence[float] = SHARES, levels: Sequence[int] | None = None) -> DataFrame:
    """(keys, k, radius, ci, cj): the smallest radius around one of a key's cells that covers a share k of its occurrences, and that cell.

    ``counts`` has (keys, ci, cj, n), a row for each cell.  Radii are rounded
    to a millionth of a mile; of equal ones the smallest cell counts.  Bounds
    only leave out cells that can't be centres, so any ``levels``, the widths
    of wider cells from wide to narrow, give the same rows; by default they
    follow the cells of the largest key.
    """
    keys = list(keys)
    parts = 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = Window.partitionBy(*keys)
    cells = written(counts.select(*keys, "ci", "cj", "n", F.sum("n").over(whole).alias("total")), "cells")
    if levels is None:
        levels = levels_for(cells.groupBy(*keys).count().agg(F.max("count").alias("m")).first()["m"] or 0)
    centres = cells.select(*keys, "ci", "cj", "total", F.array(*[F.lit(True)] * len(shares)).alias("alive"))
    for width in levels:
        wide = written(_wide(cells, keys, size, width), "wide")
        place = [F.floor(F.col("ci") / width).alias("ai"), F.floor(F.col("cj") / width).alias("aj")]
        alive = F.array(*[F.max(F.col("alive")[i]) for i in range(len(shares))])
        able = centres.groupBy(*keys, *place, "total").agg(alive.alias("alive"))
        a = able.join(wide.select(*keys, F.col("wi").alias("ai"), F.col("wj").alias("aj"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.col("reach").alias("areach")), [*keys, "ai", "aj"])
        a = a.repartition(parts, *keys, "ai", "aj")  # few rows that meet many: dealt on, whatever their bytes
        miles = haversine(F.col("alat"), F.col("alon"), F.col("lat"), F.col("lon"))
        pairs = a.join(wide, keys).select(*keys, "ai", "aj", "total", "alive", "n", F.greatest(F.lit(0.0), miles - F.col("reach") - F.col("areach")).alias("near"), (miles + F.col("reach") + F.col("areach")).alias("far"))
        centre = [*keys, "ai", "aj", "total", "alive"]
        bounds = written(_reached(pairs, centre, "total", "near", shares, "low").join(_reached(pairs, centre, "total", "far", shares, "high"), centre), "bounds")
        least = bounds.groupBy(*keys).agg(*[F.min(F.when(F.col("alive")[i], F.col(f"high_{i}"))).alias(f"least_{i}") for i in range(len(shares))])
        stays = F.array(*[F.col("alive")[i] & (F.col(f"low_{i}") <= F.col(f"least_{i}") + SLACK) for i in range(len(shares))])
        kept = bounds.join(least, keys).select(*keys, "ai", "aj", stays.alias("stays")).where(F.exists("stays", lambda x: x))
        inner = (F.floor(F.col("ci") / width) == F.col("ai")) & (F.floor(F.col("cj") / width) == F.col("aj"))
        named = kept.select(*[F.col(k).alias(f"__{k}") for k in keys], "ai", "aj", "stays")
        same: Column = inner
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        centres = written(centres.join(named, same).select(*keys, "ci", "cj", "total", F.col("stays").alias("alive")), "centres")
    a = centres.select(*keys, F.col("ci").alias("a"), F.col("cj").alias("b"), "total", "alive").repartition(parts, *keys, "a", "b")
    miles = F.round(haversine(F.col("a") * size, F.col("b") * size, F.col("ci") * size, F.col("cj") * size), 6)
    pairs = a.join(cells.drop("total"), keys).select(*keys, "a", "b", "total", "alive", "n", miles.alias("miles"))
    found = _reached(pairs, [*keys, "a", "b", "total", "alive"], "total", "miles", shares, "r")
    each = [F.when(F.col("alive")[i], F.struct(F.col(f"r_{i}").alias("radius"), F.col("a").alias("ci"), F.col("b").alias("cj"))) for i in range(len(shares))]
    best = found.groupBy(*keys).agg(*[F.min(e).alias(f"b_{i}") for i, e in enumerate(each)])
    rows = F.array(*[F.struct(F.lit(float(s)).alias("k"), F.col(f"b_{i}").alias("best")) for i, s in enumerate(shares)])
    return best.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.k", "x.best.radius", "x.best.ci", "x.best.cj")


def locality_index(occ: DataFrame, size: float, shares: Sequence[float] = SHARES, day: int | None = None) -> DataFrame:
    """(topic, k, radius, ci, cj) of ``covering_radius`` for topics, or (topic, day, ...) for each day of ``day`` seconds of a topic."""
    keys = ["topic"] if day is None else ["topic", "day"]
    rows = occ if day is None else occ.withColumn("day", F.col("t") - F.pmod(F.col("t"), F.lit(day).cast("bigint")))
    return covering_radius(rows.groupBy(*keys, "ci", "cj").agg(F.count(F.lit(1)).alias("n")), keys, size, shares)
