"""SimHash near-deduplication with a pigeonring filter.

A pair within the Hamming budget must have, on the ring of fingerprint
segments, a chain of consecutive segments whose cumulative differences stay
within proportional budgets for every length.  The part of the chain that must
agree exactly is the join key; the rest is checked on the joined pair before
the full distance.  ``near_duplicates`` links 64-bit fingerprints within a few
bits; ``drop_near_duplicates`` finds texts by the similarity of their shingle
sets, over rings of some hundred bits and with a verification of each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topotide.llm.caches import tidied
from topotide.llm.pairing import RARE, compared, shared_shingles
from topotide.llm.shingling import mixed, shingle_lists, shingles_of, slices
from topotide.llm.tables import plainly_named, table, text_of
from topotide.operators.graphs import components
from topotide.plans.scratch import written

SHINGLE = 3
SEED = 42
BITS = 64
#: Largest bucket whose members are compared pair by pair.
PAIR_BUCKET = 32
#: What near-duplicate documents are: words of a shingle, Jaccard similarity, and the least chance to find a pair just as similar.
WORDS_A_SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.95


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The SimHash of the k-word shingles of a text, an unsigned 64-bit number.

    Bytes are split at ASCII white space and lower-cased in A-Z only.  A text
    with fewer than k words has one shingle, its whole sequence; a text without
    words has fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - k + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        upto = min(n, at + 65536)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at:upto], ends[at + k - 1 : upto + k - 1])), np.uint64, upto - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): a row for each row of ``docs``; fp is the fingerprint as a signed long.  The columns ``more`` follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), k) for t in batch.column(1)]
            rest = [batch.column(i + 2) for i in range(len(more))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), *rest], ["doc_id", "fp", *more])

    slim = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"), *more)
    types = [f"{c} {slim.schema[c].dataType.simpleString()}" for c in more]
    return slim.mapInArrow(tidied(run), ", ".join([f"doc_id {slim.schema['doc_id'].dataType.simpleString()}", "fp long", *types]))


def _rotated(fp: Column | str, bits: int) -> Column:
    """``fp`` with its first ``bits`` bits moved to the end."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, BITS - bits))


def _chain(x: Column, m: int, budget: int) -> Column:
    """All prefixes of the ring chain that starts at the top of ``x`` keep to their share of the budget."""
    width = BITS // m
    ok = F.lit(True)
    for length in range(1, m + 1):
        share = length * budget // m
        if length == m or (length + 1) * budget // m > share:  # the longest chain with this share holds the shorter ones
            ok = ok & (F.bit_count(F.shiftrightunsigned(x, BITS - width * length)) <= share)
    return ok


def near_links(fps: DataFrame, budget: int = 2, m: int = 8, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints, complete up to connection.

    ``fps`` has one column, fp, without repeats.  Fingerprints that differ in
    1 to ``budget`` bits get a path of such links.  A bucket of chain keys with
    at most ``pair_bucket`` members is compared pair by pair.  Members of a
    larger one meet at values within half the budget of both: each emits the
    values that differ from it in at most one bit, and all that emit a value
    link to the smallest of them, which loses no link and makes no pairs; the
    way holds for budgets up to 2, so a larger budget compares all pairs.
    A chain has an exact part only if there are more segments than ``budget``,
    so ``m`` is doubled until there are.
    """
    if not 0 <= budget < BITS:
        raise ValueError(f"the budget is 0 to {BITS - 1} bits")
    while m <= budget:
        m *= 2
    exact = max(1, (m - 1) // budget if budget else m)
    while exact * budget // m > 0:
        exact -= 1
    width = BITS // m
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), _rotated("fp", i * width).alias("r")) for i in range(m)])).alias("x"))
    keyed = keyed.select("fp", "x.s", "x.r", F.shiftrightunsigned("x.r", BITS - exact * width).alias("key"))
    shared = keyed.groupBy("s", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keyed.join(shared, ["s", "key"]), "chains")
    few = members if budget > 2 else members.where(F.col("n") <= pair_bucket)
    right = few.select("s", "key", F.col("fp").alias("v"), F.col("r").alias("r2"))
    x = F.col("r").bitwiseXOR(F.col("r2"))
    pairs = few.join(right, ["s", "key"]).where(F.col("fp") < F.col("v")).where(_chain(x, m, budget)).where(F.bit_count(x) <= budget)
    links = pairs.select(F.col("fp").alias("u"), "v").distinct()
    if budget > 2:
        return links
    many = members.where(F.col("n") > pair_bucket).select("fp").distinct()
    flips = [F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)]] if budget == 2 else [F.lit(0).cast("long")]
    values = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(f) for f in flips])).alias("value"))
    hubs = values.groupBy("value").agg(F.min("fp").alias("u"), F.max("fp").alias("last")).where("u < last")
    stars = values.join(hubs.select("value", "u"), "value").where("u < fp").select("u", F.col("fp").alias("v")).distinct()
    return links.unionByName(stars)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of ``docs``.

    Equal fingerprints are one node of the graph, so copies make no links.
    component_id is the smallest doc_id that links reach, and null where all
    doc_ids of the component are null.  Texts that are null or hold no words
    have fingerprint zero and link like any other.  Repeated rows come as often
    as they are; very long texts are hashed whole, in parts; an empty table
    gives no rows; other columns are not read, whatever their names.
    """
    fps = written(fingerprints(docs, key, text), "fingerprints")
    nodes = _labelled(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), budget)
    first = nodes.groupBy("c").agg(F.min("first").alias("component_id"))
    of_fp = written(nodes.join(first, "c").select("fp", "component_id"), "components")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(nodes: DataFrame, budget: int) -> DataFrame:
    """(fp, first, c): distinct fingerprints with the label of their component."""
    nodes = written(nodes, "nodes")
    # more segments make longer keys, so that buckets stay small in larger tables
    n = nodes.count()
    labels = components(near_links(nodes.select("fp"), budget, 8 if n < 1 << 27 else 16 if n < 1 << 31 else 32))
    nodes = nodes.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    return written(nodes, "labelled")


def rings_of(hashes: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """The SimHash rings of ``words`` 64-bit words of all texts, whose shingle hashes begin at ``starts``; one row a text.

    Bits are counted in byte lanes of up to 255 shingles.  Texts without
    shingles have rings of zeros.
    """
    out = np.zeros((len(starts) - 1, words), np.uint64)
    counts = np.diff(starts)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    blocks = -(-counts[own] // 255)
    first = np.cumsum(blocks) - blocks
    begin = np.repeat(starts[own], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    lanes, one = np.uint64(0x0101010101010101), np.uint64(1)
    for j in range(words):
        h = mixed(hashes + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for bit in range(8):
            sums = np.add.reduceat((h >> np.uint64(bit)) & lanes, begin).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
            high = (ones * 2 > counts[own, None]).astype(np.uint64)
            for byte in range(8):
                out[own, j] |= high[:, byte] << (np.uint64(8 * byte + bit) * one)
    return out


def ring_plan(n: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(width, segments) of a ring for n texts.

    Segments have the bits it takes to number the texts, so a text meets less
    than one other in a segment by chance at any n; there are as many as let a
    pair of that Jaccard similarity agree in one with probability ``recall``.
    """
    width = max(16, min(48, int(np.ceil(np.log2(max(2, n))))))
    same = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** width
    return width, int(np.ceil(np.log(1 - recall) / np.log(1 - same)))


def _segments(rings: np.ndarray, width: int, segments: int) -> np.ndarray:
    """The segments of each ring as numbers, a column each."""
    bits = np.unpackbits(rings.view(np.uint8).reshape(len(rings), -1), axis=1, bitorder="little")[:, : width * segments]
    return bits.reshape(len(rings), segments, width).astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))


def ring_budget(similarity: float) -> float:
    """The share of a ring's bits in which pairs of that similarity may differ: the mean and some five deviations in a ring of 512 bits."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return share + 5 * (share * (1 - share) / 512) ** 0.5


def _members(nodes: DataFrame, similarity: float, width: int, segments: int) -> DataFrame:
    """(bucket, row, size, f, n) of ``nodes`` (row, size, ring): the n rows that have one segment and near sizes are a bucket; rows alone in theirs are left out.

    Sizes are numbers of distinct shingles; pairs whose sizes alone rule out the
    similarity don't meet.  f is one word of the ring.
    """
    words = -(-width * segments // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, sizes = part.column(0).to_numpy(), part.column(1).to_numpy()
                ring = part.column(2).flatten().to_numpy().view(np.uint64).reshape(len(rows), words)
                keys = _segments(ring, width, segments).astype(np.uint64)
                low = np.floor(np.log2(sizes)).astype(np.int64)
                high = np.floor(np.log2(sizes / similarity + 1e-9)).astype(np.int64)  # a partner may be in the next band
                for band, some in ((low, np.arange(len(rows))), (high, np.flatnonzero(high > low))):
                    salt = mixed(np.arange(segments, dtype=np.uint64)[None, :] * np.uint64(64) + band[some, None].astype(np.uint64))
                    bucket = mixed(keys[some] + salt).view(np.int64).ravel()
                    each = [np.repeat(x[some], segments) for x in (rows, sizes, ring[:, 0].view(np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, *each)], ["bucket", "row", "size", "f"])

    members = nodes.select("row", "size", "ring").mapInArrow(tidied(run), "bucket long, row long, size long, f long")
    return written(members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1"), "members")


def _differing() -> Column:
    return F.bit_count(F.col("f").bitwiseXOR(F.col("f2")))


def _near(similarity: float) -> Column:
    """Whether sizes and one word of the rings, which may differ in six deviations more bits than the mean, allow the similarity."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    most = int(64 * share + 6 * (64 * share * (1 - share)) ** 0.5)
    return (F.least("size", "size2") >= F.lit(similarity) * F.greatest("size", "size2") - 1e-9) & (_differing() <= most)


def _pairs_within(members: DataFrame, near: Column, *more: str) -> DataFrame:
    """(hub, row): near pairs of each bucket, one by one, each pair once; ``near`` may use the columns ``more`` of both."""
    a = members.select("bucket", F.col("row").alias("hub"), *[F.col(c).alias(f"{c}2") for c in ("size", "f", *more)])
    return members.select("bucket", "row", "size", "f", *more).join(a, "bucket").where(F.col("hub") < F.col("row")).where(near).select("hub", "row").distinct()


def _on_rings(pairs: DataFrame, nodes: DataFrame, similarity: float, width: int, segments: int) -> DataFrame:
    """The pairs (hub, row) whose rings keep to the budget all along a chain: some chain of words keeps to its share at every length."""
    words = -(-width * segments // 64)
    rings = nodes.select(F.col("row").alias("r"), "ring")
    both = pairs.join(rings.select(F.col("r").alias("hub"), F.col("ring").alias("a")), "hub").join(rings.select(F.col("r").alias("row"), F.col("ring").alias("b")), "row")
    differ = F.expr("zip_with(a, b, (x, y) -> bit_count(x ^ y))")
    quota = f"{ring_budget(similarity) * 64}D"
    chain = f"exists(sequence(0, {words - 1}), s -> aggregate(sequence(0, {words - 1}), struct(0 AS sum, true AS ok), (c, i) -> struct(c.sum + d[(s + i) % {words}] AS sum, c.ok AND c.sum + d[(s + i) % {words}] <= (i + 1) * {quota} AS ok), c -> c.ok))"
    return both.select("hub", "row", F.explode(F.array(differ)).alias("d")).where(F.expr(chain)).select("hub", "row")


def crowded_links(members: DataFrame, texts: DataFrame, k: int, similarity: float, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (hub, row) among rows of large buckets, whose buckets of any size are ``members`` (bucket, row, size, f), complete up to connection.

    ``texts`` (row, text) has the rows' texts, and ``verified`` gets pairs (hub, row) and
    returns those that link.  A shingle that one row alone has is in no
    intersection, which bounds the similarity of every pair from above; pairs
    whose bound is too low don't meet.  Linked rows have a common label, and a
    bucket with one label is done.  In a round every bucket has a hub, and every
    row is set against one hub of its buckets that it hasn't met: so a row makes
    one pair, however many buckets it shares with others of its group.  At
    first hubs are the rows with the largest share of shingles that others have
    too; then, in turn, any rows, of which the nearest is met, and the rows with most links
    of the labels in the bucket, which needn't be in it themselves: so the
    middle of a group meets all that share a bucket with any of the group.  A
    row that fails on its hub stays.  When two rounds together link no more
    than a tenth of their pairs, rows with different labels meet pair by pair,
    so none is left out: those that have a rare shingle in common, and those of
    one bucket whose bound is high enough without the rare ones.
    """
    shingles = shared_shingles(texts, k)
    counts = shingles.groupBy("row").agg(F.count(F.lit(1)).alias("shared"), F.count(F.when(F.col("n") >= RARE, 1)).alias("common"))
    open_ = members.select("bucket", "row", "size", "f").join(written(counts, "counts"), "row")  # a row without shared shingles is near none
    open_ = open_.where(F.col("shared") >= F.lit(similarity) * F.col("size") - 1e-9).withColumn("label", F.col("row"))
    apart = _near(similarity) & (F.col("label") != F.col("label2"))

    def bounded(c: str) -> Column:
        both = F.least(c, f"{c}2")
        return both >= F.lit(similarity) * (F.col("size") + F.col("size2") - both) - 1e-9

    near = apart & bounded("shared")
    links = tested = open_.select(F.col("row").alias("hub"), "row").limit(0)
    middles, shares, number = None, [], 0
    while True:
        bucket = Window.partitionBy("bucket")
        several = open_.withColumns({"low": F.min("label").over(bucket), "high": F.max("label").over(bucket)}).where("low < high").drop("low", "high")
        open_ = written(several, "open")
        if open_.isEmpty():
            return links
        last = len(shares) > 1 and sum(x for x, _ in shares[-2:]) * 10 <= sum(y for _, y in shares[-2:])
        if last:
            rare = shingles.where(F.col("n") < RARE).select(F.col("s").alias("bucket"), "row")
            alike = _pairs_within(rare.join(open_.drop("bucket").distinct(), "row"), near, "shared", "label")
            pairs = _pairs_within(open_, apart & bounded("common"), "common", "label").unionByName(alike).distinct().join(tested, ["hub", "row"], "left_anti")
        else:
            pairs = _round(open_, near, middles, number, tested)
        pairs = written(pairs, "candidates")
        found = written(verified(pairs), "crowded")
        links = links.unionByName(found)
        if last:
            return links
        tested = tested.unionByName(pairs)
        labels = components(links.select(F.col("hub").alias("u"), F.col("row").alias("v"))).withColumnRenamed("node", "row")
        if not number:
            rows = written(open_.select("row", "size", "f", "shared").distinct(), "crowd")
        degrees = links.select(F.explode(F.array("hub", "row")).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("links"))
        most = F.max(F.struct("links", F.col("row").alias("hub"), *[F.col(c).alias(f"{c}2") for c in ("size", "f", "shared")])).alias("x")
        middles = written(labels.join(degrees, "row").join(rows, "row").groupBy(F.col("component").alias("label")).agg(most).select("label", "x.*"), "middles")
        open_ = open_.drop("label").join(labels, "row", "left").withColumn("label", F.coalesce("component", "row")).drop("component")
        shares.append((found.count(), pairs.count()))
        number += 1


def _round(open_: DataFrame, near: Column, middles: DataFrame | None, number: int, tested: DataFrame) -> DataFrame:
    """Pairs (hub, row) of a round of ``crowded_links``: one for each row that has a near hub it wasn't set against."""
    hubs = open_.select("bucket", F.col("row").alias("hub"), *[F.col(c).alias(f"{c}2") for c in ("size", "f", "shared", "label")])
    order = [F.xxhash64(F.lit(number), "hub")]
    if number == 0:
        order = [-F.col("shared2") / F.col("size2"), *order]
    ranked = number % 2 == 0
    if ranked and number:
        hubs = open_.select("bucket", "label").distinct().join(middles, "label").withColumn("label2", F.col("label"))
        order = [-F.col("links"), *order]
    first = F.min(F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), "hub", "size2", "f2", "shared2", "label2")).alias("h")
    told = open_.join(hubs.groupBy("bucket").agg(first).select("bucket", "h.*"), "bucket").where(near)
    told = told.select(F.col("row").alias("own"), "o", _differing().alias("d"), F.least("row", "hub").alias("hub"), F.greatest("row", "hub").alias("row"))
    best = F.min(F.struct("o", "hub", "row") if ranked else F.struct("d", "hub", "row")).alias("h")
    return told.join(tested, ["hub", "row"], "left_anti").groupBy("own").agg(best).select("h.hub", "h.row").distinct()


def _jaccard(a: np.ndarray, b: np.ndarray) -> list[tuple[float]]:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return [(common / max(1, len(a) + len(b) - common),)]


def similar_components(docs: DataFrame, similarity: float = SIMILARITY, k: int = WORDS_A_SHINGLE) -> DataFrame:
    """(key columns, component): ``docs`` (key columns, text) by near-duplicate texts.

    Texts with the same words, apart from case in A-Z, are one node.  Nodes of
    k words or more link where the Jaccard similarity of their sets of k-word
    shingles reaches ``similarity``; every link is verified on whole texts.
    Candidates come from rings of SimHash bits; a pair just at ``similarity``
    is among them with probability RECALL, nearer ones with a higher one.
    """
    keys = [c for c in docs.columns if c != "text"]
    width, segments = ring_plan(docs.count(), similarity)
    words = -(-width * segments // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                texts = part.column(part.num_columns - 1)
                names = [b" ".join(t.as_py().encode("utf-8", "surrogatepass").lower().split()) for t in texts]
                digests = [xxhash.xxh3_128_digest(x) for x in names]
                hashes, starts = shingles_of(texts, k)
                owner = np.repeat(np.arange(len(names)), np.diff(starts))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.concatenate((np.ones(min(1, len(hashes)), bool), (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
                hashes, owner = hashes[new], owner[new]
                sizes = np.bincount(owner, minlength=len(names))
                rings = rings_of(hashes, np.concatenate(([0], np.cumsum(sizes))), words)
                lists = pa.ListArray.from_arrays(np.arange(0, rings.size + 1, words, dtype=np.int32), pa.array(rings.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(digests, pa.binary()), pa.array(sizes), lists], [*keys, "digest", "size", "ring"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    rows = written(docs.select(*keys, "text").mapInArrow(tidied(run), f"{kinds}, digest binary, size long, ring array<long>"), "rings")
    first = F.min(F.struct(*keys)).alias("first")  # any row of the node has its words
    nodes = rows.groupBy("digest", "size").agg(first, F.first("ring").alias("ring"))
    nodes = written(nodes.withColumn("row", F.monotonically_increasing_id()), "nodes")
    members = _members(nodes.where("size > 0"), similarity, width, segments)
    large = written(members.where(F.col("n") > PAIR_BUCKET).select("row").distinct(), "large")
    members = members.join(large.withColumn("crowded", F.lit(True)), "row", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    few = members.where(F.col("n") <= PAIR_BUCKET)
    pairs = written(_pairs_within(few, _near(similarity) & ~(F.col("crowded") & F.col("crowded2")), "crowded"), "candidates")
    pairs = written(_on_rings(pairs, nodes, similarity, width, segments), "pairs")  # texts are read for these alone
    ends = pairs.select(F.col("hub").alias("r")).unionByName(pairs.select(F.col("row").alias("r"))).unionByName(large.select(F.col("row").alias("r"))).distinct()
    named = nodes.join(ends, F.col("row") == F.col("r")).select("row", *[F.col(f"first.{c}").alias(f"__f_{c}") for c in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__f_{c}"))
    texts = written(docs.join(named, same).groupBy("row").agg(F.first("text").alias("text")), "texts")  # rows with equal keys hold equal texts

    def verified(pairs: DataFrame) -> DataFrame:
        checked = compared(pairs, texts, lambda t: [np.unique(x) for x in shingle_lists(t, k)], _jaccard, "jaccard double")
        return checked.where(F.col("jaccard") >= similarity - 1e-9).select("hub", "row")

    links = written(verified(pairs), "checked")
    if not large.isEmpty():
        links = links.unionByName(crowded_links(members.where("crowded"), texts.join(large, "row", "left_semi"), k, similarity, lambda pairs: verified(written(_on_rings(pairs, nodes, similarity, width, segments), "pairs"))))
    labels = components(written(_thinned(links.select(F.col("hub").alias("u"), F.col("row").alias("v"))), "links"))
    nodes = nodes.select("digest", "size", "row").join(labels.select(F.col("node").alias("row"), "component"), "row", "left")
    nodes = written(nodes.select("digest", "size", F.coalesce("component", "row").alias("component")), "labelled")
    return rows.drop("ring").join(nodes, ["digest", "size"]).select(*keys, "component")


def _thinned(links: DataFrame) -> DataFrame:
    """Links (u, v) with the same components: each v keeps its smallest u, to which its other u are linked instead.

    A text of a large group has verified links to many hubs, which others of
    the group share; between hubs one link each is enough.
    """
    least = links.select("u", "v", F.min("u").over(Window.partitionBy("v")).alias("least"))
    return least.select(F.col("least").alias("u"), "v").unionByName(least.where("u <> least").select(F.col("least").alias("u"), F.col("u").alias("v"))).distinct()


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = WORDS_A_SHINGLE) -> DataFrame:
    """``docs`` with one row of each component of near-duplicate texts: that of its smallest doc_id.

    Near-duplicates have a Jaccard similarity of ``similarity`` of their sets
    of k-word shingles (``similar_components``); shorter texts only have equal
    ones.  Null texts are empty, and all empty texts are equal.  Rows are told
    apart by their doc_id and a digest of all columns, so rows with a null or
    repeated doc_id count one by one.  A null doc_id comes last; of rows with
    one doc_id that of the smallest digest stays, and of rows alike in all
    columns one.  Very long texts are compared whole.  The columns return
    unchanged, whatever their names.  An empty table gives none.
    """
    names, docs = docs.columns, plainly_named(docs, "doc_id", "text")
    columns = [F.col(c) for c in docs.columns]
    content = [*columns, *[c.isNull() for c in columns]]
    keyed = docs.withColumns({"__k1": F.xxhash64(*content), "__k2": F.hash(*content)})
    rows = similar_components(keyed.select(F.col("doc_id").alias("__id"), "__k1", "__k2", text_of().alias("text")), similarity, k)
    rows = rows.groupBy("component", "__id", "__k1", "__k2").agg(F.count(F.lit(1)).alias("__n"))
    one = F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__k1", "__k2", "__n")).alias("x")
    stay = rows.groupBy("component").agg(one).select(F.col("x.__id").alias("__id"), F.col("x.__k1").alias("__a"), F.col("x.__k2").alias("__b"), F.col("x.__n").alias("__n"))
    stay = written(stay, "stay")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__a")) & (F.col("__k2") == F.col("__b"))
    kept = keyed.join(stay.where("__n = 1"), same, "left_semi").select(columns)
    often = stay.where("__n > 1")
    if often.isEmpty():
        return kept.toDF(*names)
    return kept.unionByName(keyed.join(often, same, "left_semi").select(columns).dropDuplicates()).toDF(*names)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
