"""Sharding by Karmarkar-Karp differencing under the law of near-equal bytes.

Equal texts are an indivisible group.  Groups too large to be a small part of a
shard are items of their own; their number is bounded by their size.  All other
groups are gathered by digest into a fixed number of bundles.  The items, a few
thousand at any input size, are partitioned by differencing.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topotide.llm.tables import table, text_of
from topotide.plans.scratch import written

SHARDS = 16
#: Bundles of small groups, and the part of all bytes from which a group is an item of its own.
BUNDLES = 4096
LARGE_PART = 1 / 2048


def differencing(sizes: Sequence[int], k: int) -> list[int]:
    """The part, 0 to k-1, of each item.

    Each item starts as a partial partition with itself in one part.  The two
    partitions with the largest spread are combined again and again, the
    largest part of one with the smallest of the other, until one is left.
    """
    if not sizes:
        return []
    heap: list[tuple[int, int, list[tuple[int, list]]]] = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, [i])] + [(0, [])] * (k - 1)))  # parts in descending order
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x + y, [p, q] if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: -t[0])
        least = parts[-1][0]
        parts = [(x - least, p) for x, p in parts]
        heapq.heappush(heap, (-parts[0][0], number, parts))
        number += 1
    out = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2]):
        stack = [tree]
        while stack:
            for x in stack.pop():
                if isinstance(x, list):
                    stack.append(x)
                else:
                    out[x] = part
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row for each row of ``docs``.

    size is the text's UTF-8 bytes plus 1, null counts as empty.  A group's
    rows, repeated rows included, stay in one shard whatever its size, so one
    group with more than a shard's share makes that shard larger; differencing
    then leaves the other shards as equal as it can.  slot counts each shard's
    rows from 0 in the order of doc_id (null first), then digest; repeated rows get
    slots one after the other.  Very long texts are items of their own.  An empty
    table gives no rows.  Other columns are not read, whatever their names.
    """
    body = text_of()
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    whole = groups.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    name = F.when(F.col("bytes") > F.lit(whole * LARGE_PART), F.hex("digest")).otherwise(F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("string"))
    named = groups.withColumn("item", name)
    items = named.groupBy("item").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "item").collect()  # at most BUNDLES + 1 / LARGE_PART rows
    parts = differencing([r["bytes"] for r in items], shards)
    spark = docs.sparkSession
    placed = spark.createDataFrame([(r["item"], p) for r, p in zip(items, parts)], "item string, shard int")
    by_group = written(named.join(F.broadcast(placed), "item").select("digest", "shard"), "placed")
    return _numbered(rows.join(by_group, "digest"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The result rows with their slots: places within sorted ranges plus the rows of the shard before the range."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "shard", "doc_id", "digest").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    counts = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select(F.col("shard").alias("s"), F.col("range").alias("r"), before.alias("start")), "starts")
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "digest")) - 1
    placed = ranged.withColumn("within", within).join(starts, (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
