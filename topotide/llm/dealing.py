"""Entries of texts (key, row, more numbers) brought together by key, many in one row of a shuffle.

A task packs the entries of some megabytes of text into one blob for each
range of keys.  The ranges are dealt evenly to the shuffle's partitions and
read there one after the other, so a task holds the entries of one range, and
the rows that Spark sorts are few.  The rows of a key that many texts share
wait in a file.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topotide.llm.caches import tidied
from topotide.llm.shingling import mixed

#: Ranges of keys that a partition has, and that there are at most.
RANGES = 8
MOST_RANGES = 1 << 16
#: Bytes of a key inside its range.
KEY_BYTES = 6


def spread_numbers(n: int) -> np.ndarray:
    """A whole number for each of n partitions that Spark's hash of integers deals to it."""
    out, left = np.full(n, -1), n
    for at in range(0, 1 << 31, 1 << 16):
        x = np.arange(at, at + (1 << 16), dtype=np.uint32)
        turned = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
        h = turned(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
        h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
        parts, first = np.unique(h, return_index=True)
        new = out[parts] < 0
        out[parts[new]] = first[new] + at
        left -= int(new.sum())
        if not left:
            break
    return out


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values, or lines of values, of each stretch between two cuts as bytes."""
    width = values.nbytes // len(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).reshape(-1))])


def _packed(rows: np.ndarray, texts: np.ndarray, keys: np.ndarray, extra: list[np.ndarray], parts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A row for each range of keys: the entries in the order of their rows, of which the differences are kept."""
    place = np.empty(len(rows), np.uint64)
    place[np.argsort(rows)] = np.arange(len(rows), dtype=np.uint64)
    of = (keys >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16)
    order = np.argsort(of << np.uint64(32) | place[texts])
    of, own = of[order].astype(np.int64), rows[texts[order]]
    cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
    first = cuts[:-1]
    steps = np.diff(own, prepend=own[:1])
    steps[first] = 0
    steps = steps.astype(np.min_scalar_type(steps.max()))
    key = keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    columns = [pa.array(parts[of[first] * len(parts) // ranges].astype(np.int32)), pa.array(of[first].astype(np.int32)), pa.array(own[first]), _blobs(steps, cuts), _blobs(key, cuts)]
    names = ["part", "range", "first", "steps", "keys", *[f"extra{i}" for i in range(len(extra))]]
    return pa.RecordBatch.from_arrays([*columns, *[_blobs(x[order].astype("<u4"), cuts) for x in extra]], names)


def _scattered(rows: np.ndarray) -> np.ndarray:
    return mixed(rows.view(np.uint64) + np.uint64(1))


class _Hot:
    """The entries of one key, in a file until all are known."""

    def __init__(self):
        self.n, self.least, self.holders = 0, np.iinfo(np.int64).max, np.uint64(0)
        self.file = tempfile.TemporaryFile()

    def add(self, entries: list[np.ndarray]) -> None:
        rows = np.unique(entries[0])  # what a row has of a key comes at once
        self.n, self.least, self.holders = self.n + len(rows), min(self.least, int(rows[0])), self.holders ^ np.bitwise_xor.reduce(_scattered(rows))
        np.stack([x.astype(np.int64) for x in entries], axis=1).tofile(self.file)

    def read(self, width: int, most: int) -> Iterator[list[np.ndarray]]:
        self.file.seek(0)
        while len(some := np.fromfile(self.file, np.int64, most * width)):
            yield list(np.ascontiguousarray(some.reshape(-1, width).T))


class _Range:
    """The entries (key, row, more numbers) of one range of keys."""

    def __init__(self, number: int, most: int):
        self.number, self.most, self.limit = number, most, most
        self.held: list[list[np.ndarray]] = []
        self.size, self.hot = 0, {}

    def add(self, entries: list[np.ndarray]) -> None:
        self.held.append(entries)
        self.size += len(entries[0])
        if self.size > self.limit:
            keys, counts = np.unique(np.concatenate([x[0] for x in self.held]), return_counts=True)
            for key in keys[counts > max(1, self.most // 64)].tolist():
                self.hot.setdefault(key, _Hot())
            entries = self._cooled()
            self.held, self.size = [entries], len(entries[0])
            self.limit = max(self.most, 2 * self.size)  # what can't shrink isn't looked through each time

    def _cooled(self) -> list[np.ndarray]:
        """The entries in memory, after those of hot keys went to their files."""
        entries = [np.concatenate(x) for x in zip(*self.held)]
        for key, hot in self.hot.items():
            mine = entries[0] == np.uint64(key)
            if mine.any():
                hot.add([x[mine] for x in entries[1:]])
                entries = [x[~mine] for x in entries]
        return entries

    def groups(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(key, row, n, least, holders, more) as arrays of entries whose key several have."""
        above = np.uint64(self.number << 48)
        keys, *rest = self._cooled()
        for key, hot in self.hot.items():
            for some in hot.read(len(rest), self.most):
                one = np.ones(len(some[0]), np.int64)
                yield (np.full(len(one), np.uint64(key) | above).view(np.int64), some[0], one * hot.n, one * hot.least, np.full(len(one), hot.holders).view(np.int64), *some[1:])
        order = np.argsort(keys)
        ordered = keys[order]
        same = np.concatenate(([False], ordered[1:] == ordered[:-1], [False]))
        several = (same[1:] | same[:-1])[: len(order)]
        if not several.any():
            return
        order, keys = order[several], ordered[several]
        by_row = np.lexsort((rest[0][order], keys))
        order = order[by_row]
        rows, *more = (x[order] for x in rest)
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])))
        if not more:  # a row that has a key twice
            keys, rows, fresh = keys[fresh], rows[fresh], fresh[fresh]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.concatenate((begin, [len(keys)])))
        n = np.add.reduceat(fresh, begin, dtype=np.int64)
        holders = np.bitwise_xor.reduceat(np.where(fresh, _scattered(rows), np.uint64(0)), begin)
        yield ((keys | above).view(np.int64), rows, np.repeat(n, counts), np.repeat(rows[begin], counts), np.repeat(holders, counts).view(np.int64), *more)


def met(source: DataFrame, entries_of: Callable, emit: Callable, columns: str, extra: int = 0, most: int = 1 << 22) -> DataFrame:
    """What ``emit`` makes of the entries of ``source`` whose keys come more than once, with the columns ``columns``.

    ``entries_of`` gets a batch of ``source`` and yields, for some of its rows
    at a time, their numbers and arrays with the place among these, the 64-bit
    key and ``extra`` whole numbers below 2^32 of each entry.  ``emit`` gets
    arrays: key, row, how many rows the key has, its smallest row, a number
    for the set of its rows, and the extra numbers; it returns arrays, a row
    for each of their elements.  Keys are told apart by 48 bits inside their
    range.  Without extra numbers a row that has a key twice comes once, and
    may have the key to itself; with them all entries come, and what a row has of
    a key must be yielded at once.  When a range has more than ``most`` entries,
    those of its frequent keys are written to a file and come in parts.
    """
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, n * RANGES)
    names = [c.split()[0] for c in columns.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = spread_numbers(min(n, ranges))
        for batch in batches:
            for rows, texts, keys, *more in entries_of(batch):
                if len(keys):
                    yield _packed(rows, texts, keys, more, parts, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(x: _Range) -> Iterator[pa.RecordBatch]:
            for group in x.groups():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in emit(*group)], names)

        now = None
        for batch in batches:
            for number, first, steps, keys, *more in zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns))):
                if now is None or number != now.number:
                    if now:
                        yield from ended(now)
                    now = _Range(number, most)
                key = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
                key[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
                rows = first + np.cumsum(np.frombuffer(steps, f"<u{len(steps) // len(key)}").astype(np.int64))
                now.add([key.view("<u8").ravel(), rows, *[np.frombuffer(x, "<u4") for x in more]])
        if now:
            yield from ended(now)

    kinds = "part int, range int, first long, steps binary, keys binary" + "".join(f", extra{i} binary" for i in range(extra))
    dealt = source.mapInArrow(tidied(pack), kinds).repartition(n, "part").sortWithinPartitions("range")
    return dealt.mapInArrow(tidied(run), columns)
