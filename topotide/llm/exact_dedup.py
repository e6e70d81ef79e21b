"""Exact deduplication against a persistent digest index.

The index is a folder: its layout, a bucketed and sorted folder of digests for
each batch, and a commit marker for each batch that is whole.  Any session that
opens the folder finds the committed batches.  New data is reduced to one row
for each digest before it meets the index in a sort-merge anti-join, so that
the join sees each digest once, however many copies a text has, and the index
is not shuffled.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.llm.tables import table, text_of
from topotide.plans.scratch import children, new_path, written

#: The ASCII white space that normalisation deletes.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE_SPACE, "")


def text_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_points, digest): the SHA-256 of each normalised text."""
    body = text_of(text)
    return docs.select(F.col(key).alias("doc_id"), F.length(body).cast("long").alias("n_points"), F.unhex(F.sha2(normalised(body), 256)).alias("digest"))


class DigestIndex:
    """Digests of texts and the doc_id that stays for each, kept in a folder that batches extend.

    ``layout`` holds the number of buckets and the type of doc_id, fixed when
    the folder is new; ``batches`` a folder for each batch, bucketed and sorted
    by digest; ``commits`` a marker for each batch that was written whole.
    What has no marker is not read, and is written anew by the next batch of
    that number.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = "digest_index_" + sha256(self.path.encode()).hexdigest()[:24]

    def batches(self) -> list[str]:
        """The committed batches."""
        return children(self.spark, f"{self.path}/commits")

    def table(self) -> DataFrame | None:
        """(digest, keep_id, batch) of all committed batches, registered in this session with its buckets; null if there is none."""
        done = self.batches()
        if not done:
            return None
        layout = self.spark.read.parquet(f"{self.path}/layout").first()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # the table is external, so its files stay
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {layout['id_type']}, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {layout['buckets']} BUCKETS LOCATION '{self.path}/batches'"
        )
        places = " ".join(f"PARTITION (batch = '{b}') LOCATION '{self.path}/batches/{b}'" for b in done)
        self.spark.sql(f"ALTER TABLE {self.name} ADD {places}")
        return self.spark.table(self.name)

    def append(self, entries: DataFrame) -> None:
        """Add (digest, keep_id) rows, whose digests the index doesn't hold, as a batch of its own."""
        if not children(self.spark, f"{self.path}/layout"):
            kind = entries.schema["keep_id"].dataType.simpleString()
            self.spark.createDataFrame([(self.buckets, kind)], "buckets int, id_type string").coalesce(1).write.parquet(f"{self.path}/layout")
        buckets = self.spark.read.parquet(f"{self.path}/layout").first()["buckets"]
        batch, temporary = f"{len(self.batches()):06d}", f"digest_batch_{uuid.uuid4().hex}"
        rows = entries.select("digest", "keep_id").repartition(buckets, "digest").write.format("parquet")
        rows.bucketBy(buckets, "digest").sortBy("digest").mode("overwrite").option("path", f"{self.path}/batches/{batch}").saveAsTable(temporary)
        self.spark.sql(f"DROP TABLE {temporary}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.parquet(f"{self.path}/commits/{batch}")

    def add_digests(self, digests: DataFrame) -> DataFrame:
        """Deduplicate (doc_id, n_points, digest) rows against the index and within themselves, and append what is new.

        Returns (digest, keep_id, group_size), a row for each digest of the
        batch.
        """
        order = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
        groups = digests.groupBy("digest").agg(F.min(order).getField("c").alias("own_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.table()
        if known is None:
            decided = written(groups.select("digest", F.col("own_id").alias("keep_id"), "group_size"), "decided")
            self.append(decided)
            return decided
        groups = written(groups, "groups")
        fresh = groups.join(known.select("digest").hint("merge"), "digest", "left_anti").select("digest", F.col("own_id").alias("keep_id"), "group_size")
        fresh = written(fresh, "fresh")
        old = groups.join(known.select("digest", "keep_id").hint("merge"), "digest").select("digest", "keep_id", "group_size")
        decided = written(fresh.unionByName(old), "decided")
        self.append(fresh)
        return decided

    def add_batch(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """Deduplicate ``docs`` against the index and within themselves; append what is new.

        Returns (doc_id, keep_id, group_size, kept, text_sha256), a row for
        each row of ``docs``.  Within the batch, the row with the most code
        points stays, then the smallest doc_id.  A text that the index holds
        already keeps the row of the earlier batch.  group_size counts the
        batch's rows.  A null text counts as empty, and empty texts are equal.
        A null doc_id comes after every other in ties.  Repeated rows of one
        doc_id are all kept or all dropped, for they share the doc_id that
        stays.  Very long texts are hashed whole.  Other columns are not read.
        An empty batch adds a batch without digests.  Adding a batch again
        after a failure adds nothing twice, as its digests are found.
        """
        digests = written(text_digests(docs, text, key), "digests")
        return _by_row(digests, self.add_digests(digests))


def _by_row(digests: DataFrame, decided: DataFrame) -> DataFrame:
    return digests.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, path: str) -> DataFrame:
    """All of ``docs`` loaded into a new index at ``path``, in two batches; columns as of ``DigestIndex.add_batch``.

    Of equal texts the longest original stays, so the longer half of the texts
    comes first: a text's longest row is then in the first batch that has the
    text, and the anti-join drops what comes later.
    """
    index = DigestIndex(docs.sparkSession, path)
    digests = written(text_digests(docs), "digests")
    middle = digests.agg(F.percentile_approx("n_points", 0.5).alias("m")).first()["m"] or 0
    parts = [index.add_digests(digests.where(rows)) for rows in (F.col("n_points") >= middle, F.col("n_points") < middle)]
    whole = parts[0].unionByName(parts[1]).groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))  # both parts name one keep_id
    return _by_row(digests, written(whole, "decided"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), new_path(spark, "digest-index"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
g AS (
  SELECT h, count(*) AS group_size,
         first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
