"""Comparing the texts of given pairs of rows, in streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topotide.llm.caches import tidied
from topotide.llm.dealing import met
from topotide.llm.shingling import mixed, shingles_of, slices
from topotide.plans.scratch import written

#: Partners of a hub that one task compares together.
PARTNERS = 256
#: A shingle that fewer of some texts hold is a rare one.
RARE = 8


def compared(pairs: DataFrame, docs: DataFrame, prepare: Callable[[pa.Array], list[Any]], compare: Callable[[Any, Any], list[tuple]], columns: str) -> DataFrame:
    """(hub, row, *columns) of the pairs (hub, row): what ``compare`` returns for the texts of both, as ``prepare`` made them of some texts at a time, a row for each tuple.

    ``docs`` has unique rows (row, text), where text may be of any type and no
    row of a pair is missing.  A hub's text goes once to each task
    that compares up to PARTNERS of its partners, and the partners are read as
    a stream behind it, so neither a hot hub nor a long text is gathered.
    """
    names = ["hub", "row", *[c.split()[0] for c in columns.split(", ")]]
    kinds = [pa.int64(), pa.int64(), *[{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for h, kind, o, prepared in zip(*(part.column(i).to_pylist() for i in range(3)), prepare(part.column(3))):
                    if kind == 0:
                        hub, own = h, prepared
                    else:
                        assert h == hub
                        rows += [(h, o, *x) for x in compare(own, prepared)]
                found = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], names)

    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    dealt = pairs.select("hub", "row").join(sizes, "hub").select("hub", F.pmod(F.xxhash64("row"), "parts").alias("part"), F.lit(1).alias("kind"), "row")
    heads = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("row"))
    texts = docs.select(F.col("row").alias("r"), "text")
    both = dealt.unionByName(heads).join(texts, F.col("row") == F.col("r")).select("hub", "part", "kind", "row", "text")
    stream = both.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", "row").select("hub", "kind", "row", "text")
    return stream.mapInArrow(tidied(run), "hub long, row long, " + columns)


def shared_shingles(texts: DataFrame, k: int, holders: bool = False) -> DataFrame:
    """(s, row, at, times, n): the distinct shingles s of ``texts`` (row, text) that n > 1 of them hold, with their first place in the row's text and how often it holds them.

    Those with n below RARE are rare ones.  With ``holders`` a column of that
    name has a number for the set of rows that hold the shingle.
    """

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for part in slices(batch):
            hashes, starts = shingles_of(part.column(1), k)
            text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            own, times = np.unique(hashes ^ mixed(text.astype(np.uint64) << np.uint64(1)), return_index=True, return_counts=True)[1:]
            yield part.column(0).to_numpy(), text[own], hashes[own], own - starts[text[own]], times

    def emit(s: np.ndarray, rows: np.ndarray, n: np.ndarray, least: np.ndarray, sets: np.ndarray, at: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        return [s, rows, at.astype(np.int32), times.astype(np.int32), n, *([sets] if holders else [])]

    return written(met(texts.select("row", "text"), entries, emit, "s long, row long, at int, times int, n long" + ", holders long" * holders, extra=2), "shingles")


def held_places(texts: DataFrame, k: int) -> DataFrame:
    """(s, row, at, n, holders): the places of ``texts`` (row, text) whose shingle s n > 1 of them hold, with a number for the set of these."""

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for part in slices(batch):
            hashes, starts = shingles_of(part.column(1), k)
            text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            yield part.column(0).to_numpy(), text, hashes, np.arange(len(hashes)) - starts[text]

    def emit(s: np.ndarray, rows: np.ndarray, n: np.ndarray, least: np.ndarray, sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        held = n > 1  # not by one text alone, several times
        return [s[held], rows[held], at[held].astype(np.int32), n[held], sets[held]]

    return written(met(texts.select("row", "text"), entries, emit, "s long, row long, at int, n long, holders long", extra=1), "places")


def _marks(row: np.ndarray, at: np.ndarray, s: np.ndarray, n: np.ndarray, holders: np.ndarray, t: int, enough: int) -> tuple[np.ndarray, ...]:
    """Places of whole texts, in order, as columns of ``marked``."""
    new = np.concatenate(([True], row[1:] != row[:-1]))
    text = np.cumsum(new) - 1
    along = at.astype(np.int64) + text * (int(at.max()) + t + 1)
    count = np.searchsorted(along, along + t) - np.arange(len(along))
    rank = np.empty(len(row), np.int64)
    rank[np.lexsort((s, n))] = np.arange(len(row))
    pick = np.zeros(len(row), bool)
    starts = np.flatnonzero(count >= enough)
    for block in range(0, len(starts), 4096):
        some = starts[block : block + 4096]
        places = np.minimum(some[:, None] + np.arange(t), len(row) - 1)
        ranks = np.where(np.arange(t) < count[some][:, None], rank[places], len(row))
        most = np.sort(ranks, axis=1)[np.arange(len(some)), count[some] - enough]
        pick[places[ranks <= most[:, None]]] = True

    def sets(ids: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each set of equal ids in a text, and their number."""
        order = some[np.lexsort((ids[some], text[some]))]
        if not len(order):
            return order, order
        first = np.flatnonzero(np.concatenate(([True], (ids[order[1:]] != ids[order[:-1]]) | (text[order[1:]] != text[order[:-1]]))))
        return order[first], np.diff(np.concatenate((first, [len(order)])))

    held, times = sets(holders, np.arange(len(row)))
    picked, again = sets(s, np.flatnonzero(pick))
    return np.repeat([False, True], (len(held), len(picked))), *(np.concatenate(x) for x in ((row[held], row[picked]), (holders[held], s[picked]), (n[held], n[picked]), (times, again)))


def marked(places: DataFrame, t: int, enough: int) -> DataFrame:
    """(picked, row, id, n, times) of ``places`` (s, row, at, n, holders) of texts: their sets of holders, and the shingles that are picked.

    Sets of holders, with how many places of the row have shingles that they
    hold; and of each window of t places of which others hold c >= ``enough``,
    the c - ``enough`` + 1 shingles that fewest texts hold.  So a text that holds
    ``enough`` places of some window holds a picked shingle of the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _marks(*columns, t, enough)], ["picked", "row", "id", "n", "times"])

        held: list[list[np.ndarray]] = []  # the places of the last text
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            row = columns[0]
            if not len(row):
                continue
            last = int(np.searchsorted(row, row[-1])) if row[0] <= row[-1] else len(row) - int(np.argmax(row[::-1] != row[-1]))
            if last or (held and held[-1][0][-1] != row[0]):
                yield result([np.concatenate(x) for x in zip(*held, [c[:last] for c in columns])])
                held = []
            held.append([c[last:] for c in columns])
        if held:
            yield result([np.concatenate(x) for x in zip(*held)])

    dealt = places.select("row", "at", "s", "n", "holders").repartition("row").sortWithinPartitions("row", "at")
    return written(dealt.mapInArrow(tidied(run), "picked boolean, row long, id long, n long, times long"), "marked")


def with_common(pairs: DataFrame, sets: DataFrame, enough: int) -> DataFrame:
    """(hub, row, common) of the pairs (hub, row) of which the row has ``enough`` places or more whose shingles the hub holds too; common is their number.

    ``sets`` has (row, holders, times): how many places of a row have shingles
    that one set of rows holds.  Shingles with the same holders are in a text
    together or not at all, so a text is a short list, and pairs are sifted
    without any text.  Holders go as 32 bits; where two meet, a pair too many stays.
    """

    def lists(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        ids, times = column.flatten()
        bounds = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist() if len(ids) else [0]
        ids, times = ids.flatten().to_numpy(), times.flatten().to_numpy()
        return [(ids[i:j], times[i:j]) for i, j in zip(bounds, bounds[1:])]

    def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int]]:
        at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
        n = int(b[1][a[0][at] == b[0]].sum())
        return [(n,)] if n >= enough else []

    own = sets.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.hash("holders").alias("id"), F.col("times").cast("int").alias("times")))).alias("x"))
    own = own.select("row", F.struct(F.col("x.id").alias("ids"), F.col("x.times").alias("times")).alias("text"))
    return compared(pairs, own, lists, common, "common long")
