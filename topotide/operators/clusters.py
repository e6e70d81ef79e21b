"""Clusters of location graphs, and tests of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topotide.functions.statistics import bound, coin_heads, dealt_p, random_pattern_p, sampled_pattern_p
from topotide.operators.graphs import components
from topotide.plans.scratch import first_rows, new_path, remove, written


def markov_clusters(edges: DataFrame, inflation: float = 2.0, rounds: int = 20, prune: float = 1e-4) -> DataFrame:
    """(node, cluster) by Markov clustering of weighted undirected edges (u, v, w).

    The flow matrix is a table (row, column, p).  Expansion is a self-join,
    inflation a power and a normalising window; entries below ``prune`` go, so
    columns stay short.  Rounds end early when flows stop moving.  A cluster is
    a component of the remaining flows, named after its smallest node.
    """
    spark = edges.sparkSession
    both = edges.select("u", "v", F.col("w").cast("double").alias("w")).unionAll(edges.select(F.col("v"), F.col("u"), F.col("w").cast("double")))
    loops = both.groupBy("u").agg(F.max("w").alias("w")).select("u", F.col("u").alias("v"), "w")
    raw = both.unionByName(loops).groupBy(F.col("u").alias("r"), F.col("v").alias("c")).agg(F.sum("w").alias("w"))
    column = Window.partitionBy("c")
    path = new_path(spark, "flow")
    flow = written(raw.select("r", "c", (F.col("w") / F.sum("w").over(column)).alias("p")), "flow", path)
    for _ in range(rounds):
        a = flow.select("r", F.col("c").alias("k"), F.col("p").alias("a"))
        b = flow.select(F.col("r").alias("k"), "c", F.col("p").alias("b"))
        grown = a.join(b, "k").groupBy("r", "c").agg(F.pow(F.sum(F.col("a") * F.col("b")), F.lit(inflation)).alias("w"))
        kept = grown.withColumn("p", F.col("w") / F.sum("w").over(column)).where(F.col("p") >= prune)
        kept = kept.select("r", "c", (F.col("p") / F.sum("p").over(column)).alias("p"))
        next_path = new_path(spark, "flow")
        new = written(kept, "flow", next_path)
        moved = new.join(flow.withColumnRenamed("p", "q"), ["r", "c"], "full").where(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))) > 1e-3)
        done = moved.isEmpty()
        remove(spark, path)
        path, flow = next_path, new
        if done:
            break
    labels = components(flow.where("p > 0.01").select(F.col("r").alias("u"), F.col("c").alias("v")))
    return labels.select("node", F.col("component").alias("cluster"))


def affinity_clusters(edges: DataFrame, damping: float = 0.5, rounds: int = 1000, preference: float | None = None, settled: int = 10) -> DataFrame:
    """(node, cluster) by affinity propagation with messages along the edges (u, v, w) only.

    Responsibilities need the best and second best of each node's sums, so two
    window ranks; availabilities need sums by receiver.  Messages are a table
    that is written each round.  Rounds end when no node has changed its choice
    for ``settled`` rounds; without that after ``rounds`` there is no result.
    """
    spark = edges.sparkSession
    both = edges.select("u", "v", F.col("w").cast("double").alias("s")).unionAll(edges.select(F.col("v"), F.col("u"), F.col("w").cast("double"))).groupBy("u", "v").agg(F.max("s").alias("s"))
    own = F.lit(float(preference)) if preference is not None else F.lit(float(both.agg(F.percentile("s", F.lit(0.5)).alias("m")).first()["m"] or 0.0))
    start = both.unionByName(both.select("u").distinct().select("u", F.col("u").alias("v"), own.alias("s")))
    path = new_path(spark, "messages")
    state = written(start.select("u", "v", "s", F.lit(0.0).alias("r"), F.lit(0.0).alias("a")), "messages", path)
    by_u, by_v = Window.partitionBy("u"), Window.partitionBy("v")
    order = by_u.orderBy(F.desc(F.round(F.col("a") + F.col("r"), 9)), "v")
    last, same = None, 0
    for _ in range(rounds):
        ranked = state.withColumn("as", F.col("a") + F.col("s")).withColumn("rank", F.row_number().over(by_u.orderBy(F.desc("as"), "v")))
        best, second = F.max(F.when(F.col("rank") == 1, F.col("as"))).over(by_u), F.max(F.when(F.col("rank") == 2, F.col("as"))).over(by_u)
        new_r = F.col("s") - F.when(F.col("rank") == 1, F.coalesce(second, F.col("as"))).otherwise(best)
        ranked = ranked.withColumn("r", damping * F.col("r") + (1 - damping) * new_r)
        plus = F.when(F.col("u") == F.col("v"), F.col("r")).otherwise(F.greatest("r", F.lit(0.0)))
        total = F.sum(plus).over(by_v)
        self_sum = F.sum(F.when(F.col("u") != F.col("v"), F.greatest("r", F.lit(0.0))).otherwise(0.0)).over(by_v)
        new_a = F.when(F.col("u") == F.col("v"), self_sum).otherwise(F.least(F.lit(0.0), total - plus))
        step = ranked.select("u", "v", "s", "r", (damping * F.col("a") + (1 - damping) * new_a).alias("a"))
        next_path = new_path(spark, "messages")
        new = written(step, "messages", next_path)
        remove(spark, path)
        path, state = next_path, new
        chosen = state.withColumn("rank", F.row_number().over(order)).where("rank = 1")
        digest = tuple(chosen.agg(F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        same = same + 1 if digest == last else 0
        last = digest
        if same >= settled:
            break
    else:
        raise RuntimeError(f"the choices have not settled in {rounds} rounds")
    labels = components(chosen.select("u", "v"))
    return labels.select("node", F.col("component").alias("cluster"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, w): a heaviest spanning forest of undirected edges (u, v, w), the tree of single-link clustering.

    In each round every part of the graph takes its heaviest edge to another
    part, the smallest ends of ties, and parts that share an edge become one;
    of the edges between two parts only the heaviest goes on.  The parts at
    least halve in a round.
    """
    spark = edges.sparkSession
    path = new_path(spark, "open")
    open_ = edges.where("u is not null and v is not null and u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    open_ = written(_heaviest(open_), "open", path)
    found = None
    while not open_.isEmpty():
        ends = open_.select(F.col("a").alias("part"), "*").unionByName(open_.select(F.col("b").alias("part"), "*"))
        picked = ends.groupBy("part").agg(F.min(F.struct((-F.col("w")).alias("m"), "u", "v", "a", "b", "w")).alias("x")).select("x.*").drop("m").distinct()
        picked = written(picked, "picked")
        found = picked.select("u", "v", "w") if found is None else found.unionByName(picked.select("u", "v", "w"))
        labels = components(picked.select(F.col("a").alias("u"), F.col("b").alias("v")))
        to = [labels.select(F.col("node").alias(c), F.col("component").alias(f"to_{c}")) for c in ("a", "b")]
        moved = open_.join(to[0], "a", "left").join(to[1], "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "u", "v", "w").where("a <> b")
        next_path = new_path(spark, "open")
        open_ = written(_heaviest(moved), "open", next_path)
        remove(spark, path)
        path = next_path
    return open_.select("u", "v", "w") if found is None else found


def _heaviest(edges: DataFrame) -> DataFrame:
    """Of the edges between two parts a, b the heaviest."""
    rows = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "u", "v", "w")
    return rows.groupBy("a", "b").agg(F.min(F.struct((-F.col("w")).alias("m"), "u", "v", "w")).alias("x")).select("a", "b", "x.u", "x.v", "x.w")


def cut_forest(forest: DataFrame, nodes: DataFrame, height: float | None = None, clusters: int | None = None) -> DataFrame:
    """(node, cluster) of all ``nodes`` (node): the trees left after the forest's edges below ``height`` go, or its lightest edges until there are ``clusters``.

    A cluster is named by its smallest node.  Trees that no edge joins stay
    apart, so there may be more clusters than asked for.
    """
    nodes = nodes.select("node").distinct()
    kept = forest.select("u", "v", "w")
    if height is not None:
        kept = kept.where(F.col("w") >= height)
    if clusters is not None:
        joins = max(nodes.count() - clusters, 0)  # each edge of a forest joins two trees
        kept = first_rows(kept.withColumn("light", -F.col("w")), joins, "light", "u", "v").select("u", "v", "w") if joins else kept.where(F.lit(False))
    labels = components(kept)
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def influence_zones(scored: DataFrame, width: float = 0.02, links: DataFrame | None = None) -> DataFrame:
    """(loc, score, zone): locations (loc, score) in zones of near scores, by single-link clustering.

    Two locations have a similarity of 1 / (1 + the difference of their
    scores); the clustering is cut where scores differ by more than ``width``,
    which leaves the components of the edges within it.  Similar are those of
    ``links`` (loc, nbr), or without it any two: components are then runs in
    the order of scores, a row a location.  Zones of one location are merged
    into one; zones are numbered by their smallest score.
    """
    if links is None:
        order = Window.orderBy("score", "loc")
        new = F.when(F.col("score") - F.lag("score").over(order) > width, 1).otherwise(0)
        rows = scored.select("loc", "score", new.alias("new")).withColumn("z", F.sum("new").over(order)).drop("new")
    else:
        own, other = scored.select("loc", "score"), scored.select(F.col("loc").alias("nbr"), F.col("score").alias("other"))
        edges = links.select("loc", "nbr").where("loc <> nbr").join(own, "loc").join(other, "nbr").where(F.abs(F.col("score") - F.col("other")) <= width)
        zones = cut_forest(edges.select(F.col("loc").alias("u"), F.col("nbr").alias("v"), F.lit(1.0).alias("w")), scored.select(F.col("loc").alias("node")))
        rows = scored.select("loc", "score").join(zones.select(F.col("node").alias("loc"), F.col("cluster").alias("z")), "loc")
    alone = F.count("*").over(Window.partitionBy("z")) == 1
    rows = rows.withColumn("single", alone).withColumn("z", F.when(~F.col("single"), F.col("z")))
    low = rows.withColumn("low", F.min("score").over(Window.partitionBy("single", "z")))
    return low.select("loc", "score", F.dense_rank().over(Window.orderBy("low", F.col("single").desc(), "z")).cast("bigint").alias("zone"))  # a row a location


def binomial_p(patterns: DataFrame) -> DataFrame:
    """Add p: two-sided chance that n fair coins are at least as one-sided as (n, mean_status) shows.

    Each term of the tail comes from the one before, in logarithms, so n may
    be in the thousands.
    """
    tail = """aggregate(sequence(cast(0 as bigint), n - cast(ceil(round(n * (1 + abs(mean_status)) / 2, 6)) as bigint)),
        named_struct('t', 0.0D, 'l', -n * ln(2.0D)),
        (s, i) -> named_struct('t', s.t + exp(s.l), 'l', s.l + coalesce(ln(n - i), 0.0D) - ln(i + 1)), s -> s.t)"""
    return patterns.withColumn("p", F.least(F.lit(1.0), 2 * F.expr(tail)))


def permutation_p(patterns: DataFrame, draws: int | None = None, seed: int = 7, replicates: int | None = None) -> DataFrame:
    """Add p to patterns (n, mean_status) of signs: how well chance explains them, by a permutation test against fair coins.

    A pattern and a random one are pooled and dealt out anew; p is the share of
    deals whose difference is at least the one seen, meaned over random
    patterns.  Without ``draws`` all patterns count by their weight; with it
    that many are drawn by hashes of the row; with ``replicates`` the deals are
    drawn too instead of counted exactly.
    """
    ones = F.round(F.col("n") * (1 + F.col("mean_status")) / 2).cast("bigint")
    if draws is None:
        return patterns.withColumn("p", random_pattern_p(F.col("n"), ones))
    row = [F.lit(seed), F.xxhash64(*[F.col(f"`{c}`") for c in patterns.columns])]
    if replicates is None:
        return patterns.withColumn("p", sampled_pattern_p(F.col("n"), ones, draws, *row))
    each = lambda d: bound(lambda heads: dealt_p(F.col("n"), ones, heads, replicates, *row, d), coin_heads(F.col("n"), *row, d))
    return patterns.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0.0), lambda s, d: s + each(d)) / draws)


def p_value_cdf(tested: DataFrame, digits: int = 2) -> DataFrame:
    """(min_common, p, n, cdf, ccdf): how many pairs have a p-value, rounded, and the share of pairs at most and above it."""
    counts = tested.groupBy("min_common", F.round("p", digits).alias("p")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("min_common")
    cdf = F.sum("n").over(own.orderBy("p")) / F.sum("n").over(own)
    return counts.select("min_common", "p", "n", cdf.alias("cdf"), (1 - cdf).alias("ccdf"))


def p_value_examples(tested: DataFrame, alpha: float = 0.05, k: int = 5) -> DataFrame:
    """(min_common, is_random, rank, l, r, p): the k pairs farthest below ``alpha`` and the k farthest above it."""
    is_random = F.col("p") > alpha
    order = [F.when(is_random, -F.round("p", 9)).otherwise(F.round("p", 9)), "l", "r"]
    rank = F.row_number().over(Window.partitionBy("min_common", "is_random").orderBy(*order))
    return tested.withColumn("is_random", is_random).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("min_common", "is_random", "rank", "l", "r", "p")


def non_random_share(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(min_common, n, share): share of pairs whose pattern is unlikely to be random."""
    return tested.groupBy("min_common").agg(F.count("*").alias("n"), F.avg((F.col("p") <= alpha).cast("double")).alias("share"))
