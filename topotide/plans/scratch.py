"""Tables written to the folder that driver and executors share.

Iterative operators cut their lineage here.  A written table survives the loss
of an executor, carries statistics for adaptive planning, and is read back
without any trace of the plan that made it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a single-machine session gets a folder of its
    own; a cluster session is refused, since executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_roots.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back; ``codec`` zstd makes tables of texts smaller."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that is no longer read."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder of any file system holds, in order; none where there is no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an order: rows are sorted in ranges, and only the ranges' sizes are added up in one task."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row for each shuffle partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before")).where(F.col("__before") < n)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(starts), "__range").withColumn("__place", place + F.col("__before")).where(F.col("__place") <= n).select(df.columns)
