"""Influence between locations.

Before-and-after counts of the time sets of a topic's locations come from one
pass over its sorted times, never from their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topotide.functions.columns import bin_up
from topotide.plans.scratch import written
from topotide.plans.shipping import ship


#: Entries that a task holds of a table of pairs at once.
AREA = 1 << 21
_SEGMENTS = "u long, tile int, start long, i int, j int, x long"


def before_after(occ: DataFrame, loc: str = "loc") -> DataFrame:
    """(topic, l, r, before, after, nl, nr, first_l, first_r, mean_l, mean_r) for locations l < r that share a topic.

    before counts pairs of times with l's first, after those with r's first;
    equal times count for neither.  Occurrences are sorted by topic and time in
    ranges and travel once, whatever the number of locations.  A task counts
    inside its stretch of a topic, and stretches meet as one count a location.
    Times and counts are written to the shared folder, so that they are made once.
    """
    rows = occ.select("topic", F.col(loc).alias("loc"), F.col("t").cast("bigint").alias("t")).where("topic is not null and loc is not null")
    rows = written(rows, "times")  # read three times: for the locations, for the ranges and for the counts
    own = rows.groupBy("topic", "loc").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.try_divide(F.sum("t"), F.count("t")).alias("mean"))
    topic = Window.partitionBy("topic")
    numbered = own.withColumn("id", F.monotonically_increasing_id()).withColumns({"u": F.min("id").over(topic), "k": F.count("*").over(topic).cast("int"), "i": (F.row_number().over(topic.orderBy("loc")) - 1).cast("int")})
    own = written(numbered.drop("id"), "locations")
    pairs = _ends(own, "l").join(_ends(own, "r"), ["topic", "u"]).where("i_l < i_r")
    counts = written(_counts(rows.join(own.select("topic", "loc", "u", "k", "i"), ["topic", "loc"]).where("k > 1 and t is not null").select("u", "k", "i", "t")), "counts")
    zero = F.lit(0).cast("bigint")
    both = pairs.join(counts, ["u", "i_l", "i_r"], "left")
    return both.select("topic", "l", "r", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"), "nl", "nr", "first_l", "first_r", "mean_l", "mean_r")


def _ends(own: DataFrame, side: str) -> DataFrame:
    names = {"loc": side, "i": f"i_{side}", "n": f"n{side}", "first": f"first_{side}", "mean": f"mean_{side}"}
    return own.select("topic", "u", *[F.col(c).alias(a) for c, a in names.items()])


def _counts(times: DataFrame) -> DataFrame:
    """(u, i_l, i_r, before, after) of rows (u, k, i, t): place i of the k locations of topic u has an occurrence at t.

    The pairs of a topic with many locations are dealt into tiles of rows of
    at most ``AREA`` pairs, and its occurrences come once a tile.
    """
    high = F.greatest(F.lit(1), F.floor(F.lit(AREA) / F.col("k")).cast("int"))
    tiles = times.withColumn("high", high).withColumn("tile", F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / F.col("high")).cast("int"))))
    ship(times.sparkSession)
    ranged = tiles.select("u", "tile", "t", "i", "k", "high").repartitionByRange("u", "tile", "t").sortWithinPartitions("u", "tile", "t")
    found = written(ranged.mapInArrow(_segments, _SEGMENTS), "segments")
    inside = found.where("j >= 0").select("u", "i", "j", "x")
    own = found.where("j < 0").select("u", "tile", "start", "i", "x")
    earlier = F.sum("x").over(Window.partitionBy("u", "tile", "i").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    upto = own.withColumn("y", earlier).where("y > 0").select("u", "tile", "start", F.col("i").alias("j"), "y")
    across = found.where("j = -1 and x > 0").select("u", "tile", "start", "i", "x").join(upto, ["u", "tile", "start"]).where("i <> j").select("u", "i", "j", (F.col("x") * F.col("y")).alias("x"))
    after = F.when(F.col("i") < F.col("j"), F.col("x")).otherwise(0)
    before = F.when(F.col("i") > F.col("j"), F.col("x")).otherwise(0)
    return inside.unionByName(across).groupBy("u", F.least("i", "j").alias("i_l"), F.greatest("i", "j").alias("i_r")).agg(F.sum(before).alias("before"), F.sum(after).alias("after"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_counts``, sorted by u, tile and t: x pairs of occurrences of i and of j, j's first, inside a stretch.

    A stretch is what a task has of a topic's tile, named by its first time.
    With j = -1, x is the number of occurrences of place i of the tile in it,
    with j = -2 that of a place outside the tile, zeros included.
    """
    key, state = None, None
    for batch in batches:
        u, tile, t, i, k, high = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero((u[1:] != u[:-1]) | (tile[1:] != tile[:-1])) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(u)].tolist()):
            if a == b:
                continue
            if key != (u[a], tile[a]):
                if state is not None:
                    yield from state.rows()
                key, state = (u[a], tile[a]), _Stretch(int(u[a]), int(tile[a]), int(t[a]), int(k[a]), int(high[a]))
            step = max(1, AREA // int(k[a]))
            for c in range(a, b, step):
                state.add(t[c : min(c + step, b)], i[c : min(c + step, b)])
    if state is not None:
        yield from state.rows()


class _Stretch:
    """Counts of a stretch: ``seen`` by place so far, ``earlier`` those before the last time."""

    def __init__(self, u: int, tile: int, start: int, k: int, high: int):
        self.u, self.tile, self.start, self.k, self.low = u, tile, start, k, tile * high
        self.after = np.zeros((min(high, k - self.low), k), np.int64)
        self.seen, self.earlier, self.last = np.zeros(k, np.int64), np.zeros(k, np.int64), None

    def add(self, t: np.ndarray, i: np.ndarray) -> None:
        m = len(t)
        upto = np.zeros((m + 1, self.k), np.int64)
        upto[np.arange(1, m + 1), i] = 1
        upto[0] = self.seen
        np.cumsum(upto, axis=0, out=upto)
        new = np.r_[t[0] != self.last, t[1:] != t[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(m), -1))  # where a row's time begins; -1: in what came before
        before = np.where((first < 0)[:, None], self.earlier, upto[first]) if first[0] < 0 else upto[first]
        mine = np.flatnonzero((i >= self.low) & (i < self.low + len(self.after)))
        if len(mine):
            order = mine[np.argsort(i[mine], kind="stable")]
            starts = np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]])
            self.after[i[order][starts] - self.low] += np.add.reduceat(before[order], starts, axis=0)
        self.seen, self.earlier, self.last = upto[m].copy(), before[m - 1].copy(), t[m - 1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        inside = (np.arange(self.k) >= self.low) & (np.arange(self.k) < self.low + len(self.after))
        yield from self._batches(np.arange(self.k), np.where(inside, -1, -2), self.seen)
        step = max(1, (1 << 16) // self.k)
        for a in range(0, len(self.after), step):
            part = self.after[a : a + step]
            i, j = np.nonzero(part)
            other = i + a + self.low != j
            yield from self._batches((i + a + self.low)[other], j[other], part[i, j][other])

    def _batches(self, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(i), 1 << 16):
            b = min(a + (1 << 16), len(i))
            same = [pa.array(np.full(b - a, v), ty) for v, ty in ((self.u, pa.int64()), (self.tile, pa.int32()), (self.start, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, *[pa.array(c[a:b], ty) for c, ty in ((i, pa.int32()), (j, pa.int32()), (x, pa.int64()))]], ["u", "tile", "start", "i", "j", "x"])


def _models() -> dict[str, Column]:
    """Scores of l against r from a row of ``before_after``; the score of r against l is its negative."""
    both = F.col("nl") + F.col("nr")
    return {
        "first_occurrence": F.signum(F.col("first_r") - F.col("first_l")),
        "mean_occurrence": F.signum(F.col("mean_r") - F.col("mean_l")),
        "aggregate": (F.col("before") - F.col("after")) / (F.col("nl") * F.col("nr")),
        "weighted_aggregate": (F.col("nl") * F.col("before") - F.col("nr") * F.col("after")) / both / (F.col("nl") * F.col("nr")),
    }


def scores(pairs: DataFrame, model: str) -> DataFrame:
    """Directed (topic, loc, nbr, score)."""
    s = pairs.withColumn("score", _models()[model]).select("topic", "l", "r", "score")
    return s.select("topic", F.col("l").alias("loc"), F.col("r").alias("nbr"), "score").unionByName(s.select("topic", F.col("r").alias("loc"), F.col("l").alias("nbr"), (-F.col("score")).alias("score")))


def _topic_counts(occ: DataFrame, loc: str) -> DataFrame:
    rows = occ.groupBy(F.col(loc).alias("loc"), "topic").agg(F.count("*").alias("n"))
    w = Window.partitionBy("loc")
    return rows.select("loc", "topic", (F.col("n") / F.sum("n").over(w)).alias("weight"), F.count("*").over(w).alias("k"))


def pure_influence(occ: DataFrame, model: str = "aggregate", extra: bool = False, loc: str = "loc") -> DataFrame:
    """Directed (loc, nbr, n_common, score): mean score over common topics; with ``extra`` topics of one side add 1 or -1."""
    s = scores(before_after(occ, loc), model).groupBy("loc", "nbr").agg(F.count("*").alias("n_common"), F.sum("score").alias("s"))
    if not extra:
        return s.select("loc", "nbr", "n_common", (F.col("s") / F.col("n_common")).alias("score"))
    k = _topic_counts(occ, loc).groupBy("loc").agg(F.max("k").alias("k"))
    both = s.join(k.withColumnRenamed("k", "a"), "loc").join(k.select(F.col("loc").alias("nbr"), F.col("k").alias("b")), "nbr")
    return both.select("loc", "nbr", "n_common", ((F.col("s") + F.col("a") - F.col("b")) / (F.col("a") + F.col("b") - F.col("n_common"))).alias("score"))


def influence(occ: DataFrame, model: str = "aggregate", loc: str = "loc") -> DataFrame:
    """Directed (loc, nbr, n_common, score): mean of score times the topic's share at loc, times the share of common topics."""
    topics = _topic_counts(occ, loc)
    rows = scores(before_after(occ, loc), model).join(topics, ["loc", "topic"])
    got = rows.groupBy("loc", "nbr").agg(F.count("*").alias("n_common"), F.avg(F.col("score") * F.col("weight")).alias("m"), F.max("k").alias("k"))
    return got.select("loc", "nbr", "n_common", (F.col("m") * F.col("n_common") / F.col("k")).alias("score"))


def influencers(scored: DataFrame, kind: str, k: int | None = None) -> DataFrame:
    """(loc, influencer, score): the other side of negative (incoming) or positive (outgoing) links, strongest first k."""
    if kind == "incoming":
        rows = scored.where("score < 0").select("loc", F.col("nbr").alias("other"), F.abs("score").alias("score"))
    else:
        rows = scored.where("score > 0" if k else "score >= 0").select("loc", F.col("nbr").alias("other"), "score")
    if k:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("loc").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k).drop("rank")
    return rows


def boundary_influence(scored: DataFrame, n_locations: int) -> DataFrame:
    """(loc, score): the larger of incoming and outgoing sums over the locations of an area; incoming is negative."""
    s = scored.groupBy("loc").agg(F.sum(F.when(F.col("score") < 0, -F.col("score")).otherwise(0.0)).alias("i"), F.sum(F.when(F.col("score") > 0, F.col("score")).otherwise(0.0)).alias("o"))
    return s.select("loc", (F.when(F.col("i") > F.col("o"), -F.col("i")).otherwise(F.col("o")) / n_locations).alias("score"))


def influence_vectors(scored: DataFrame, top: int = 25) -> DataFrame:
    """(loc, nbr, x): the strongest links of each location as a vector of length one."""
    rank = F.row_number().over(Window.partitionBy("loc").orderBy(F.desc(F.abs("score")), "nbr"))
    rows = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    norm = F.sqrt(F.sum(F.col("score") * F.col("score")).over(Window.partitionBy("loc")))
    return rows.select("loc", "nbr", F.when(norm > 0, F.col("score") / norm).otherwise(0.0).alias("x"))


def influence_similarity(vectors: DataFrame) -> DataFrame:
    """(l, r, similarity): dot products of vectors that share a component."""
    a, b = vectors.select(F.col("loc").alias("l"), "nbr", F.col("x").alias("a")), vectors.select(F.col("loc").alias("r"), "nbr", F.col("x").alias("b"))
    return a.join(b, "nbr").where("l < r").groupBy("l", "r").agg(F.sum(F.col("a") * F.col("b")).alias("similarity"))


def topic_influence(occ: DataFrame, model: str = "aggregate", loc: str = "loc") -> DataFrame:
    """(topic, loc, score): mean score of a location against all others that saw the topic."""
    return mean_scores(before_after(occ, loc), model)


def mean_scores(pairs: DataFrame, model: str) -> DataFrame:
    """``topic_influence`` from rows of ``before_after``, which several models can share."""
    return scores(pairs, model).groupBy("topic", "loc").agg(F.avg("score").alias("score"))


def top_influencers(scored: DataFrame, n_locations: int, k: int) -> DataFrame:
    """(nbr, score): locations by the sum of what they send to others."""
    rows = scored.where("score < 0").groupBy("nbr").agg((F.sum(-F.col("score")) / n_locations).alias("score"))
    return rows.orderBy(F.desc(F.round("score", 9)), "nbr").limit(k)


def influence_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, share) of scores between -1 and 1."""
    b = F.least(F.floor((F.round("score", 9) + 1) / 2 * bins), F.lit(bins - 1))
    counts = scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def model_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(overlap): share of the k strongest locations (loc, score) of two models that agree."""
    top = lambda d: d.orderBy(F.desc(F.round("score", 9)), "loc").limit(k).select("loc")
    return top(a).join(top(b), "loc").agg((F.count("*") / k).alias("overlap"))


def misranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, wrong): of the n rows (keys, pos, rank) of a key, the pairs that pos and rank order differently.

    Ranks are whole numbers from 0; equal ones are in no order.  Two ranks
    differ first in one bit: rows are dealt by the bits above it, and a running
    sum over pos counts the ones before each zero.  So a row comes once a bit,
    and no two rows of a key are set against each other.
    """
    keys = list(keys)
    top = rows.agg(F.max("rank").alias("m")).first()["m"] or 0
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(int(top).bit_length(), 1) - 1)))
    bits = rows.select(*keys, "pos", "rank", levels.alias("level")).withColumns({"above": F.expr("shiftright(rank, level + 1)"), "one": F.expr("shiftright(rank, level) & 1")})
    before = F.sum("one").over(Window.partitionBy(*keys, "level", "above").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wrong = bits.withColumn("before", before).groupBy(*keys).agg(F.sum(F.when(F.col("one") == 0, F.col("before")).otherwise(0)).alias("wrong"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(wrong, keys)


def rank_accuracy(order: DataFrame, occ: DataFrame, loc: str = "loc", seed: int | None = None) -> DataFrame:
    """(topic, accuracy): mean over locations of 1 - misranked/(n - 1), for the order in which locations first saw a topic.

    ``order`` has (loc, rank); locations of one rank, as those of one zone,
    are in no order.  A location is misranked against those that the model and
    the topic order differently.  With a seed the topic's order is shuffled
    first, by hashes, which gives the accuracy of chance.
    """
    dense = order.select("loc", (F.dense_rank().over(Window.orderBy("rank")) - 1).cast("bigint").alias("rank"))  # a row a location
    first = occ.groupBy("topic", F.col(loc).alias("loc")).agg(F.min("t").alias("t")).join(dense, "loc")
    by = ["t", "loc"] if seed is None else [F.xxhash64(F.lit(seed), "topic", "loc"), "loc"]
    rows = first.select("topic", "rank", F.row_number().over(Window.partitionBy("topic").orderBy(*by)).alias("pos"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return misranked(rows, ["topic"]).where("n > 1").select("topic", (1 - F.col("wrong") / pairs).alias("accuracy"))


def rank_accuracy_by_bin(order: DataFrame, occ: DataFrame, loc: str = "loc", width: int = 20, seed: int | None = None) -> DataFrame:
    """(bin, n_topics, accuracy) by the occurrences of topics, and with a seed shuffled, the accuracy of chance."""
    bins = occ.groupBy("topic").agg(bin_up(F.count("*"), width).alias("bin"))
    rows = rank_accuracy(order, occ, loc).join(bins, "topic")
    means = [F.count("*").alias("n_topics"), F.avg("accuracy").alias("accuracy")]
    if seed is not None:
        rows = rows.join(rank_accuracy(order, occ, loc, seed).withColumnRenamed("accuracy", "chance"), "topic")
        means.append(F.avg("chance").alias("shuffled"))
    return rows.groupBy("bin").agg(*means)


def directed_vectors(scored: DataFrame, kind: str, top: int = 25) -> DataFrame:
    """``influence_vectors`` of all links, or of the outgoing (positive) or incoming (negative) ones alone."""
    rows = {"complete": scored, "outgoing": scored.where("score > 0"), "incoming": scored.where("score < 0")}[kind]
    return influence_vectors(rows, top)


def similarity_with_jaccard(vectors: DataFrame, topics: DataFrame) -> DataFrame:
    """(l, r, similarity, jaccard): vector similarity of locations and the Jaccard index of their topics (loc, topic)."""
    rows = topics.select("loc", "topic").distinct()
    sizes = rows.groupBy("loc").agg(F.count("*").alias("k"))
    common = rows.select(F.col("loc").alias("l"), "topic").join(rows.select(F.col("loc").alias("r"), "topic"), "topic").where("l < r").groupBy("l", "r").agg(F.count("*").alias("c"))
    both = common.join(sizes.select(F.col("loc").alias("l"), F.col("k").alias("a")), "l").join(sizes.select(F.col("loc").alias("r"), F.col("k").alias("b")), "r")
    index = both.select("l", "r", (F.col("c") / (F.col("a") + F.col("b") - F.col("c"))).alias("jaccard"))
    return influence_similarity(vectors).join(index, ["l", "r"])


def similarity_by(pairs: DataFrame, by: Column) -> DataFrame:
    """(bin, n, similarity): mean vector similarity by a binned column of the pairs."""
    return pairs.groupBy(by.alias("bin")).agg(F.count("*").alias("n"), F.avg("similarity").alias("similarity"))


def transmission_by_class(occ: DataFrame, labels: DataFrame, loc: str = "loc") -> DataFrame:
    """(class, loc, nbr, n_common, score): ``influence`` with the topics of one label class (topic, class) at a time; class 0 is unlabelled."""
    labelled = occ.join(labels.where("class <> 0"), "topic")
    place = F.struct(F.col("class"), F.col(loc).alias("loc"))
    rows = influence(labelled.withColumn("__place", place), loc="__place")
    same = rows.where(F.col("loc.class") == F.col("nbr.class"))
    return same.select(F.col("loc.class").alias("class"), F.col("loc.loc").alias("loc"), F.col("nbr.loc").alias("nbr"), "n_common", "score")


def zone_spans(zones: DataFrame) -> DataFrame:
    """(zone, n, low, high) of the scores in each zone."""
    return zones.groupBy("zone").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
