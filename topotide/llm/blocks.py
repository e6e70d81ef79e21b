"""Blocks of documents whose places are looked up in a table made by shuffles.

A block is some megabytes of documents in one row: its keys, how many places
each document has, the distinct values of the block, and for each place the
code of its value, most frequent first.  Only the distinct values of a block
meet other tables, so a value that every document holds comes once a block; the
results go back to the block by code.  The blocks themselves are written once,
bucketed by their number, and aren't shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topotide.plans.scratch import new_path

#: Bytes of text after which a block ends; a longer text is a block of its own.
BLOCK_BYTES = 12 << 20
BLOCKS_A_TASK = 1 << 20


def numbered() -> Iterator[int]:
    """Numbers for the blocks of this task."""
    first = TaskContext.get().partitionId() * BLOCKS_A_TASK
    return iter(range(first, first + BLOCKS_A_TASK))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of the batches in slices that end once their texts have ``most`` bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = min(batch.num_rows, int(np.searchsorted(ends, before + most, "right")) or 1)
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def restored(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, codes): the ``size`` values by falling frequency, and the codes in that order."""
    order = np.argsort(-np.bincount(codes, minlength=size), kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    return order, rank[codes]


def spread(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, ends): where each item of each place lies in a flat table of lists, of which list i has ``lengths[i]`` items, and the places' ends."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[codes]
    ends = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1]), ends


def lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def single(value: pa.Array) -> pa.ListArray:
    """One row that holds all values."""
    return lists(value, np.array([0, len(value)]))


def stored(blocks: DataFrame, label: str) -> DataFrame:
    """Write the blocks once to the shared folder, bucketed by number, and read them back; a join on the number then leaves them in place."""
    spark = blocks.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "block").option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def with_parts(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """The blocks with the rows of ``parts`` that have their number as an array of structs, null where there are none.

    An array holds at most a row for each distinct value of its block.
    """
    columns = [c for c in parts.columns if c != "block"]
    grouped = parts.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("parts"))
    return blocks.join(grouped.hint("merge"), "block", "left")
