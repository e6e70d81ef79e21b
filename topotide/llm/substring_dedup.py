"""Near-duplicate passages by compact windows.

Texts are sequences of hashed word shingles.  For each of K hash functions, a
Cartesian tree over the hash values splits all subsequences of at least T
shingles into compact windows (l, c, r): every subsequence that starts in
[l, c] and ends in [c, r] has its smallest value at c.  The runs of T shingles
of a text fall into an interval of starts for each window; the intervals of
several functions are joined inside the text, and a key is made of each set of
signatures that enough functions have in common over some run.  Texts with a
key in common are set against the key's smallest row and verified.  Passages
repeated word for word don't depend on chance: keys of verbatim stretches
around the centres bring them together, and where a smallest row breaks such a
group, all runs of its texts are hashed whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topotide.llm.dealing import met
from topotide.llm.pairing import RARE, compared, held_places, marked, with_common
from topotide.llm.shingling import SHINGLE, mixed, shingle_lists, shingles_of, slices
from topotide.llm.tables import table, text_of
from topotide.operators.graphs import components
from topotide.plans.scratch import written

WORDS = 50
SIMILARITY = 0.8
FUNCTIONS = 4
ENOUGH = 2
#: Verbatim stretches start at every STEP-th place around a centre.
STEP = 16
#: Pairs whose rows are broadcast.
FEW = 100_000
#: Windows of a text that are compared at a time.
WINDOWS = 4096
#: WORDS words or more; no more of a text is read.
LONG = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{WORDS - 1}}}[^\x20\x09-\x0D]"


def run_hashes(v: np.ndarray, t: int) -> np.ndarray:
    """A hash of each run of t values, in order; none if there are fewer."""
    if len(v) < t:
        return np.zeros(0, np.uint64)
    out, width = mixed(v), 1
    while width * 2 <= t:
        out = mixed(mixed(out[:-width]) + out[width:])
        width *= 2
    return mixed(mixed(out[: len(v) - t + 1]) + out[t - width :])


def _run_minima(v: np.ndarray, t: int) -> np.ndarray:
    """The smallest value of each run of t values, in order."""
    n = len(v)
    blocks = -(-n // t)
    padded = np.full(blocks * t, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    grid = padded.reshape(blocks, t)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - t + 1], left[t - 1 : n])


def _run_maxima(v: np.ndarray, t: int) -> np.ndarray:
    """The largest value of each run of t values, in order."""
    return ~_run_minima(~v, t)


def _smaller(v: np.ndarray, owner: np.ndarray, side: int) -> np.ndarray:
    """For each value the next place to one side that ends its node of the Cartesian tree: with a smaller value, on the left also an equal one, or of another owner.

    Every place first points to its neighbour, and jumps to where the place it
    points to points, as long as that doesn't end its node; what it jumps over
    doesn't either.
    """
    n = len(v)
    to = np.arange(n) + side
    open_ = np.arange(n)
    while len(open_):
        open_ = open_[(to[open_] >= 0) & (to[open_] < n)]
        at = to[open_]
        inside = v[at] > v[open_] if side < 0 else v[at] >= v[open_]
        open_ = open_[inside & (owner[at] == owner[open_])]
        to[open_] = to[to[open_]]
    return to


def compact_windows(v: np.ndarray, t: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree nodes of ``v`` that are at least t wide; of equal values the leftmost is smallest.

    With ``starts``, where each text begins and at last the end, every text has
    a tree of its own.  A node at least t wide is the minimum of some run of t
    values, and so are all nodes above it; the tree is built over the places
    whose value is the minimum of a run that holds them.
    """
    n = len(v)
    starts = np.array([0, n]) if starts is None else starts
    if n < t:
        return (np.zeros(0, np.int64),) * 3
    ends = np.repeat(starts[1:], np.diff(starts))
    least = _run_minima(v, t)
    least[np.arange(n - t + 1) + t > ends[: n - t + 1]] = 0  # runs over the end of a text
    inside = np.concatenate((np.zeros(t - 1, np.uint64), least, np.zeros(t - 1, np.uint64)))
    centres = np.flatnonzero(v == _run_maxima(inside, t))
    owner = np.searchsorted(starts, centres, "right") - 1
    values = v[centres]
    before, after = _smaller(values, owner, -1), _smaller(values, owner, 1)
    same = (before >= 0) & (owner[before] == owner)
    l = np.where(same, centres[before] + 1, starts[owner])
    end = np.minimum(after, len(centres) - 1)
    same = (after < len(centres)) & (owner[end] == owner)
    r = np.where(same, centres[end] - 1, starts[owner + 1] - 1)
    wide = r - l + 1 >= t
    return l[wide], centres[wide], r[wide]


def run_keys(base: np.ndarray, starts: np.ndarray, t: int, functions: int, enough: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of all texts: what they may share.

    Every run of t shingles lies in one compact window of each function.  Each
    choice of ``enough`` functions gives a key for every joint interval of
    their windows, even numbers.  Odd keys are hashes of stretches of
    t - step + 1 shingles that begin a multiple of ``step`` from the centre of
    the first function's windows: two texts that hold a run of t shingles alike
    share such a stretch, as the run has the same centre in both.
    """
    n = len(base)
    runs = np.maximum(np.diff(starts) - t + 1, 0)  # of each text
    if not runs.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text_of_run = np.repeat(np.arange(len(runs)), runs)
    at = np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(len(text_of_run))
    texts, keys, signatures, places, changes = [], [], [], [], []
    one = np.uint64(1)
    for f in range(functions):
        seed = mixed(np.array([f + 1], np.uint64))
        v = mixed(base ^ seed)
        v[v == 0] = one
        l, c, r = compact_windows(v, t, starts)
        first, last = np.maximum(l, c - t + 1), np.minimum(c, r - t + 1)  # starts of the runs in each window
        centre = np.zeros(n, np.int64)
        width = last - first + 1
        centre[np.repeat(first - np.cumsum(width) + width, width) + np.arange(width.sum())] = np.repeat(c, width)
        place_of_run = centre[at]
        signatures.append(v[place_of_run])
        places.append(place_of_run)
        changes.append(np.concatenate(([True], place_of_run[1:] != place_of_run[:-1])))
        if f == 0:
            span = t - step + 1
            whole = run_hashes(base, span)
            low = first + (c - first) % step
            count = (np.minimum(last + step - 1, r - span + 1) - low) // step + 1
            count = np.maximum(count, 0)
            place = np.repeat(low - step * (np.cumsum(count) - count), count) + step * np.arange(count.sum())
            texts.append(np.searchsorted(starts, place, "right") - 1)
            keys.append(whole[place] | one)
    for number, chosen in enumerate(itertools.combinations(range(functions), enough)):
        # one shingle that is smallest under all of them shows too little
        change = np.logical_or.reduce([changes[f] for f in chosen]) & ~np.logical_and.reduce([places[f] == places[chosen[0]] for f in chosen[1:]] or [np.zeros(len(at), bool)])
        new = np.flatnonzero(change)
        key = np.full(len(new), number, np.uint64)
        for f in chosen:
            key = mixed(key + signatures[f][new])
        texts.append(text_of_run[new])
        keys.append(key & ~one)
    texts, keys = np.concatenate(texts), np.concatenate(keys)
    # a text with a repeated stretch has its keys once
    order = np.unique(keys ^ mixed(texts.astype(np.uint64) << np.uint64(1)), return_index=True)[1]
    return texts[order], keys[order]


class Shingled:
    """The shingles of a text with what comparisons need of them: distinct values in order, numbers of the shingles among them, places, run hashes."""

    def __init__(self, s: np.ndarray):
        self.s = s
        self._first_runs: tuple[int, tuple[np.ndarray, np.ndarray]] | None = None

    @cached_property
    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        """The places in the order of their values, and which of them are the first of a value."""
        order = np.argsort(self.s, kind="stable")
        ordered = self.s[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        return order, new

    @cached_property
    def values(self) -> np.ndarray:
        """The distinct values in order."""
        order, new = self._order
        return self.s[order[new]]

    @cached_property
    def first(self) -> np.ndarray:
        """The first place of each of ``values``."""
        order, new = self._order
        return order[new]

    @cached_property
    def numbers(self) -> np.ndarray:
        """For each place the number of its value."""
        order, new = self._order
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    @cached_property
    def before(self) -> np.ndarray:
        """For each place the last place before it with the same value, -1 if there is none."""
        order, new = self._order
        out = np.full(len(order), -1)
        out[order[1:]] = np.where(new[1:], -1, order[:-1])
        return out

    @cached_property
    def slots(self) -> np.ndarray:
        """Number of the value times the length, plus the place, in order."""
        order, new = self._order
        return (np.cumsum(new) - 1) * len(order) + order

    def found(self, other: np.ndarray) -> np.ndarray:
        """The number of each value of ``other`` in this text, -1 if it has none."""
        if not len(self.s):
            return np.full(len(other), -1)
        at = np.minimum(np.searchsorted(self.values, other), len(self.values) - 1)
        return np.where(self.values[at] == other, at, -1)

    def within(self, numbers: np.ndarray, lo: np.ndarray | int, hi: np.ndarray | int) -> np.ndarray:
        """Whether the values with these numbers have a place from lo to hi, the end exclusive; not for -1."""
        if len(self.values) == len(self.s):
            at = self.first[numbers]
            return (numbers >= 0) & (at >= lo) & (at < hi)
        n = len(self.s)
        at = np.minimum(np.searchsorted(self.slots, numbers * n + lo), n - 1)
        return (numbers >= 0) & (self.slots[at] >= numbers * n + lo) & (self.slots[at] < numbers * n + hi)

    def first_runs(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of the runs of t shingles in order, and their first places."""
        if self._first_runs is None or self._first_runs[0] != t:
            self._first_runs = t, np.unique(run_hashes(self.s, t), return_index=True)
        return self._first_runs[1]


def _sums(held: np.ndarray, t: int) -> np.ndarray:
    """How many of each t places in a row are held; none if there are fewer."""
    sums = np.concatenate(([0], np.cumsum(held)))
    return sums[t:] - sums[:-t] if len(held) >= t else sums[:0]


def passages(a: Shingled, b: Shingled, t: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Verified passages (start and end in a, start and end in b; ends exclusive) of at least t shingles that both hold.

    Near copies, and all places in either text of runs of t shingles that both
    hold alike and no near copy covers.
    """
    numbers = a.found(b.s)
    found = _sums(numbers >= 0, t)
    dense = np.flatnonzero(found >= np.ceil(similarity * t - 1e-9))
    if not len(dense):
        return []
    out = _near_passages(a, b, numbers, dense, t, similarity)
    full = np.flatnonzero(found == t)  # an equal run is full of shared shingles
    if not len(full):
        return out
    out += _equal_passages(a, b, t, [x[2:] for x in out], full)
    held = np.zeros(len(a.values), bool)
    held[numbers[numbers >= 0]] = True
    full = np.flatnonzero(_sums(held[a.numbers], t) == t)
    return out + [(lo, hi, s, e) for s, e, lo, hi in _equal_passages(b, a, t, [x[:2] for x in out], full)]


def _equal_passages(a: Shingled, b: Shingled, t: int, known: list[tuple[int, int]], full: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of b of t shingles or more outside the stretches ``known`` of b, each with its first place in a; their first t shingles and all others begin at places of ``full``."""
    if known and len(full):
        s, e = np.array(known).T
        steps = np.zeros(len(b.s) + 1, np.int64)
        np.add.at(steps, s, 1)
        np.add.at(steps, np.maximum(s, e - t + 1), -1)
        full = full[np.cumsum(steps)[full] == 0]
    if not len(full) or len(a.s) < t:
        return []
    mine = run_hashes(b.s, t)[full]
    runs, first = a.first_runs(t)
    at = np.minimum(np.searchsorted(runs, mine), len(runs) - 1)
    equal = runs[at] == mine
    new, place = full[equal], first[at[equal]]
    if not len(new):
        return []
    cut = np.flatnonzero((np.diff(new) > 1) | (np.diff(place) != 1))
    begin, end = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(new) - 1]))
    return [(int(place[i]), int(place[j]) + t, int(new[i]), int(new[j]) + t) for i, j in zip(begin, end)]


def _near_passages(a: Shingled, b: Shingled, numbers: np.ndarray, dense: np.ndarray, t: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Passages of a and b that are near copies.

    Runs of b whose every window of t shingles is found to the share
    ``similarity`` in a, narrowed to shared shingles at both ends, are set
    against the stretch of a that holds their shingles, and stay if the Jaccard
    similarity of both sets reaches ``similarity``.
    """
    cut = np.flatnonzero(np.diff(dense) > 1)
    out = []
    for s, e in zip(dense[np.concatenate(([0], cut + 1))], dense[np.concatenate((cut, [len(dense) - 1]))] + t):
        inside = np.flatnonzero(numbers[s:e] >= 0)
        s, e = s + inside[0], s + inside[-1] + 1
        own = numbers[s:e]
        first = a.first[own[own >= 0]]
        # the run of a near the alignment of most shingles
        shift = first - (inside - inside[0])
        mid = int(np.sort(shift)[len(shift) // 2])
        near = first[np.abs(shift - mid) <= max(t, (e - s) // 4)]
        if not len(near):
            continue
        lo, hi = int(near.min()), int(near.max()) + 1
        new = b.before[s:e] < s  # each value once
        one, two = np.count_nonzero(a.before[lo:hi] < lo), np.count_nonzero(new)
        common = np.count_nonzero(a.within(own[new], lo, hi))
        if e - s >= t * similarity and common >= similarity * (one + two - common) - 1e-9:
            out.append((lo, hi, int(s), int(e)))
        else:
            out += _similar_windows(a, b, numbers, dense[(dense >= s) & (dense + t <= e)], t, similarity)
    return out


def _similar_windows(a: Shingled, b: Shingled, numbers: np.ndarray, starts: np.ndarray, t: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Passages inside a run that is not similar as a whole: windows of t shingles at ``starts``, set against their aligned windows of a, joined where they overlap."""
    out: list[tuple[int, int, int, int]] = []
    done, places = -1, np.arange(t)
    for block in range(0, len(starts), WINDOWS):
        some = starts[block : block + WINDOWS]
        own = numbers[some[:, None] + places]
        shift = np.sort(np.where(own >= 0, a.first[own] - places, np.iinfo(np.int64).max), axis=1)
        shift = shift[np.arange(len(some)), np.count_nonzero(own >= 0, axis=1) // 2]
        lo, hi = np.maximum(0, shift), np.minimum(len(a.s), shift + t)
        theirs = lo[:, None] + places
        one = np.count_nonzero((a.before[np.minimum(theirs, len(a.s) - 1)] < lo[:, None]) & (theirs < hi[:, None]), axis=1)
        new = b.before[some[:, None] + places] < some[:, None]  # each value once
        two = np.count_nonzero(new, axis=1)
        common = np.count_nonzero(new & a.within(own, lo[:, None], hi[:, None]), axis=1)
        similar = common >= similarity * (one + two - common) - 1e-9
        for i, low, high in zip(some[similar].tolist(), lo[similar].tolist(), hi[similar].tolist()):
            if i < done:
                continue
            if out and i <= out[-1][3] and low <= out[-1][1] and high >= out[-1][0]:
                out[-1] = (min(low, out[-1][0]), max(high, out[-1][1]), out[-1][2], i + t)
            else:
                out.append((low, high, i, i + t))
            done = min(i + t // 4, int(starts[-1]))
    return out


def _stars_of(keys: np.ndarray, rows: np.ndarray, n: np.ndarray, least: np.ndarray, holders: np.ndarray) -> list[np.ndarray]:
    other = rows != least
    return [least[other], rows[other], keys[other] & 1, (n[other] > 2).astype(np.int64)]


def _of_texts(keys_of: Callable) -> Callable:
    """Entries of texts for ``met``; ``keys_of`` gets the shingles of some texts and where each begins."""

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for part in slices(batch):
            yield part.column(0).to_numpy(), *keys_of(*shingles_of(part.column(1)))

    return entries


def _of_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    keys, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    yield rows, np.arange(len(rows)), keys.view(np.uint64)


def stars(source: DataFrame, keys_of: Callable | None = None) -> DataFrame:
    """(hub, row, verbatim, more): rows that share a key, each with the key's smallest row.

    ``source`` has keys and rows, or with ``keys_of`` rows and texts.  verbatim
    tells that one of the shared keys was odd, more that one of them has a third
    row.
    """
    source = source.select("row", "text") if keys_of else source.select("key", "row")
    found = met(source, _of_texts(keys_of) if keys_of else _of_rows, _stars_of, "hub long, row long, odd long, more long")
    return found.groupBy("hub", "row").agg((F.max("odd") == 1).alias("verbatim"), (F.max("more") == 1).alias("more"))


def verified(pairs: DataFrame, docs: DataFrame, t: int, k: int, similarity: float) -> DataFrame:
    """(hub, row, hub_start, hub_end, start, end) of the passages of each pair; a pair without any has -1 in their place.

    ``pairs`` is a written table; of few pairs only their own texts are shuffled.
    """
    if pairs.count() <= FEW:
        ends = pairs.select(F.explode(F.array("hub", "row")).alias("row")).distinct()
        docs = docs.join(F.broadcast(ends), "row", "left_semi")

    def compare(a: Shingled, b: Shingled) -> list[tuple[int, int, int, int]]:
        return [(lo, hi + k - 1, s, e + k - 1) for lo, hi, s, e in passages(a, b, t, similarity)] or [(-1, -1, -1, -1)]

    return compared(pairs, docs, lambda texts: [Shingled(x) for x in shingle_lists(texts, k)], compare, "hub_start long, hub_end long, start long, end long")


def repeated_passages(docs: DataFrame, words: int = WORDS, k: int = SHINGLE, similarity: float = SIMILARITY, functions: int = FUNCTIONS, enough: int = ENOUGH, step: int = STEP) -> DataFrame:
    """Verified links (hub, row, hub_start, hub_end, start, end), in words, ends exclusive.

    ``docs`` has unique long rows and texts without nulls.  Rows that share a
    key are set against the key's smallest row, so pairs grow with the texts
    and not with the pairs in a group.  Texts that hold ``words`` words alike
    end up connected in any case: where a row shares a verbatim stretch with a
    hub but no passage, all runs of that hub's group are hashed whole, and
    rows with an equal run are linked.  Rows of hubs that failed on one of them
    meet by shingles in common (``_behind_hubs``).
    """
    t = words - k + 1

    def keys_of(base: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return run_keys(base, starts, t, functions, enough, step)

    pairs = written(stars(docs, keys_of), "pairs")
    found = written(verified(pairs, docs, t, k, similarity), "verified")
    broken = found.where("start < 0").join(pairs.where("verbatim"), ["hub", "row"], "left_semi").select("hub").distinct()
    group = pairs.where("verbatim").join(broken, "hub").select(F.explode(F.array("hub", "row")).alias("row")).distinct()
    group = written(group, "broken")
    if group.isEmpty():
        return _behind_hubs(docs, pairs, found, t, k, similarity)

    def whole(base: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = np.maximum(np.diff(starts) - t + 1, 0)
        text = np.repeat(np.arange(len(runs)), runs)
        at = np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(len(text))
        return text, run_hashes(base, t)[at] if len(at) else np.zeros(0, np.uint64)

    more = stars(docs.join(group, "row", "left_semi"), whole).join(pairs, ["hub", "row"], "left_anti")
    more = written(more, "pairs")
    found = written(verified(more, docs, t, k, similarity), "verified").unionByName(found)
    return _behind_hubs(docs, pairs.unionByName(more), found, t, k, similarity)


def _behind_hubs(docs: DataFrame, pairs: DataFrame, found: DataFrame, t: int, k: int, similarity: float) -> DataFrame:
    """The passages of ``found``, and those between rows of hubs that failed on one of their rows.

    A passage has a window of t shingles in the larger row of which the other
    text holds the share ``similarity`` at least.  So of each window that
    others hold that much of, the shingles that fewest hold are picked, enough
    that the other text must hold one of them, and the rows of a picked shingle
    meet: those that aren't connected yet, and of which the larger one picked
    it.  Before that, in rounds, every such row meets a middle row of its
    shingles' best linked label, which needn't hold the shingle itself: in turn
    the row with most links and that with most common shingles.  So one pair a
    row connects most of a large group.  When two rounds together link no more
    than a tenth of their pairs, labels meet: of each shingle one row of each
    label, and of these pairs the one of two labels with most in common, as long
    as that links more than a tenth.  Then the others meet pair by pair.
    """
    passed = found.where("start >= 0")
    failed = found.where("start < 0").select("hub").distinct()
    rows = written(pairs.join(failed, "hub").select(F.explode(F.array("hub", "row")).alias("row")).distinct(), "group")
    if rows.isEmpty():
        return passed
    enough = int(np.ceil(similarity * t - 1e-9))
    places = held_places(docs.join(rows, "row", "left_semi"), k)
    marks = marked(places, t, enough)
    sets = marks.where("not picked").select("row", F.col("id").alias("holders"), "n", "times")
    common = sets.where(F.col("n") >= RARE).groupBy("row").agg(F.sum("times").alias("all"))
    picked = marks.where("picked").select(F.col("id").alias("key"), "row", F.lit(True).alias("pick"))
    held = places.select(F.col("s").alias("key"), "row").join(picked.select("key").distinct(), "key", "left_semi").withColumn("pick", F.lit(False))
    open_ = written(held.unionByName(picked).groupBy("key", "row").agg(F.max("pick").alias("pick")), "open")
    several = Window.partitionBy("key")

    def apart(open_: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of shingles that rows of different labels hold."""
        open_ = open_.join(labels, "row", "left").select("key", "row", "pick", F.coalesce("component", "row").alias("label"))
        open_ = open_.withColumns({"low": F.min("label").over(several), "high": F.max("label").over(several)}).where("low < high")
        return written(open_.drop("low", "high"), "open")

    def sifted(more: DataFrame) -> DataFrame:
        """(hub, row, common) of the pairs that weren't tested; fewer common places have no passage."""
        more = more.select("hub", "row").distinct().join(tested, ["hub", "row"], "left_anti")
        return written(with_common(written(more, "pairs"), sets, enough), "pairs")

    tested = pairs.select("hub", "row")
    links = written(passed.select("hub", "row").distinct(), "links")
    labels = components(links.select(F.col("hub").alias("u"), F.col("row").alias("v"))).withColumnRenamed("node", "row")
    open_ = apart(open_, labels)
    rounds: list[tuple[int, int]] = []  # pairs and links
    while True:
        if len(rounds) < 2 or 10 * sum(x[1] for x in rounds[-2:]) > sum(x[0] for x in rounds[-2:]):
            degrees = links.select(F.explode(F.array("hub", "row")).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("links"))
            most = F.max(F.struct("all" if len(rounds) % 2 else "links", F.col("row").alias("hub"))).alias("x")
            ranked = labels.join(degrees, "row").join(common, "row", "left")
            middles = ranked.groupBy(F.col("component").alias("label")).agg(most, F.count(F.lit(1)).alias("links")).select("label", "links", "x.hub")
            first = F.max(F.struct("links", "hub", "label")).alias("h")
            hubs = open_.select("key", "label").distinct().join(middles, "label").groupBy("key").agg(first).select("key", "h.links", F.col("h.hub").alias("middle"), F.col("h.label").alias("label2"))
            told = open_.join(hubs, "key").where("label <> label2").select("links", F.col("row").alias("own"), F.least("row", "middle").alias("hub"), F.greatest("row", "middle").alias("row")).distinct()
            told = told.join(tested, ["hub", "row"], "left_anti").groupBy("own").agg(F.max(F.struct("links", "hub", "row")).alias("h"))
            numbers = rounds
        else:
            any_of = lambda rows: rows.groupBy("key", "label").agg(F.max(F.struct(F.xxhash64("key", "row"), "row")).getField("row").alias("row"))
            other = any_of(open_).select("key", F.col("label").alias("label2"), F.col("row").alias("hub"))
            told = any_of(open_.where("pick")).join(other, "key").where("label <> label2")
            told = sifted(told.select(F.least("row", "hub").alias("hub"), F.greatest("row", "hub").alias("row")))
            of = open_.select("row", "label").distinct()
            told = told.join(of, "row").join(of.select(F.col("row").alias("hub"), F.col("label").alias("label2")), "hub")
            told = told.groupBy(F.least("label", "label2"), F.greatest("label", "label2")).agg(F.max(F.struct("common", "hub", "row")).alias("h"))
            numbers = last = []
        more = written(told.select("h.hub", "h.row").distinct(), "pairs")
        met = written(verified(more, docs, t, k, similarity), "verified").where("start >= 0")
        tested, passed = tested.unionByName(more), passed.unionByName(met)
        new = written(met.select("hub", "row").distinct(), "links")
        numbers.append((more.count(), new.count()))
        if numbers[-1][1]:
            links, labels = links.unionByName(new), _joined(labels, new)
            open_ = apart(open_.drop("label"), labels)
        if numbers is not rounds and 10 * last[0][1] <= last[0][0]:
            break
    other = open_.select("key", F.col("row").alias("hub"), F.col("label").alias("label2"))
    more = sifted(open_.where("pick").join(other, "key").where("hub < row and label <> label2")).drop("common")
    return written(verified(more, docs, t, k, similarity), "verified").where("start >= 0").unionByName(passed)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (row, component) after more links (hub, row): only the labels at their ends are gone through."""
    known = labels.select(F.col("row").alias("node"), "component")
    ends = links.join(known, F.col("hub") == F.col("node"), "left").select("hub", "row", F.coalesce("component", "hub").alias("u"))
    ends = ends.join(known, F.col("row") == F.col("node"), "left").select("hub", "row", "u", F.coalesce("component", "row").alias("v"))
    ends = written(ends, "ends")
    over = components(ends).select(F.col("node").alias("component"), F.col("component").alias("lowest"))
    both = ends.select(F.col("hub").alias("row"), F.col("u").alias("component")).unionByName(ends.select("row", F.col("v").alias("component")))
    both = labels.select("row", "component").unionByName(both).distinct().join(over, "component", "left")
    return written(both.select("row", F.coalesce("lowest", "component").alias("component")), "labels")


def substring_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, spans: a row for each row of ``docs``.

    Texts that are equal are one node; nodes link when a passage of WORDS words
    or more in one is a near copy (five-word shingles, Jaccard 0.8) of one in
    the other.  class_id is the smallest doc_id reached over links and equal
    texts, null if there is none; n_links counts the links of the row's text
    that were found; spans lists the passages as start:end in words, joined by
    commas, empty if none.  Equal texts alone link if they have WORDS words.
    Null texts are empty; empty and short texts are alone in their class.
    Rows that repeat a doc_id with another text are nodes of their own.  Texts
    are whole however long.  Other columns are not read, whatever their names.
    An empty table gives no rows.
    """
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    digests = written(keyed.select("doc_id", "digest", F.col("text").rlike(LONG).alias("long")), "digests")
    nodes = digests.where("long").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = written(nodes.withColumn("row", F.monotonically_increasing_id()), "nodes")
    chosen = nodes.select(F.col("first"), F.col("digest").alias("d"), "row")
    chosen = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("d"))).select("row", "text")
    if not digests.where("long").groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        chosen = chosen.groupBy("row").agg(F.first("text").alias("text"))  # repeated rows hold one text
    found = written(repeated_passages(written(chosen, "chosen")), "passages")
    labels = components(found.select(F.col("hub").alias("u"), F.col("row").alias("v")))
    nodes = nodes.join(labels.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    nodes = written(nodes, "labelled")
    first = nodes.groupBy("component").agg(F.min("first").alias("class_id"))
    ends = found.select("row", "hub", "start", "end").unionByName(found.select(F.col("hub").alias("row"), F.col("row").alias("hub"), F.col("hub_start").alias("start"), F.col("hub_end").alias("end")))
    per = ends.groupBy("row", "start", "end").agg(F.count(F.lit(1)).alias("n")).groupBy("row").agg(F.sum("n").alias("n_links"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    per = per.select("row", F.col("n_links").cast("long").alias("n_links"), F.expr("array_join(transform(spans, x -> concat(x.start, ':', x.end)), ',')").alias("spans"))
    info = nodes.join(first, "component").join(per, "row", "left")
    info = written(info.select("digest", F.col("class_id").cast("long").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("spans", F.lit("")).alias("spans")), "classes")
    long = digests.where("long").join(info, "digest").select("doc_id", "class_id", "n_links", "spans")
    short = digests.where("not long").select("doc_id", F.col("doc_id").cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit("").alias("spans"))
    return long.unionByName(short)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(table(spark, sf_dir, "documents"))
