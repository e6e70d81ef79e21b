"""Mixing sources to target weights by entropy balancing.

Rates r = 2 * logistic(c_s * size / mean size of s) have the largest binary
entropy among all rates between 0 and 2 that meet the token targets, one
multiplier c_s a source.  Newton steps on the convex dual find the multipliers;
every step is an aggregate over (source, size) counts.  The rates are then
rounded to whole copies so that each source's words end near its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topotide.llm.tables import plainly_named, table, text_of
from topotide.plans.scratch import new_path, remove, written

MAX_COPIES = 2
#: Bins of one level of the search for the rounding threshold.
BINS = 1024
#: Rounds of the rounding; each leaves at most half of a row that is no larger than the error before.
PASSES = 3


def word_count(text: Column) -> Column:
    """The number of words between ASCII white space."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def targets(hist: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from counts n of (source, size).

    Sources in code-point order, null last, get the weights in turn.  Together
    they share ``share`` times all words by weight; a target above ``most``
    times its source's words stops there and the excess is shared anew by
    weight.  The end of that resharing is known: with sources ordered by
    words/weight, those before some point are full and the rest share what is
    left, so one pass over the sources in that order gives every target: the
    common level is the largest that a source which isn't full sees.
    """
    by_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    full_before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (budget - full_before) / open_weight)
    is_open = F.col("full") > F.col("level") * F.col("weight")
    ranked = ranked.withColumn("common", F.max(F.when(is_open, F.col("level"))).over(everything))
    fair = F.col("common") * F.col("weight")
    target = F.when(F.col("common").isNull() | (F.col("full") <= fair), F.col("full")).otherwise(fair)
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def _same_source(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def multipliers(hist: DataFrame, wanted: DataFrame, rounds: int = 40, close: float = 1e-6) -> DataFrame:
    """(source, source_size, target, scale, c): the multiplier of each source.

    ``hist`` counts rows by (source, size).  A Newton step that leaves the
    interval known to hold the solution is replaced by its middle, so the steps
    can't diverge.  A source whose target is its limit gets c = null: every
    rate is the limit.
    """
    spark = hist.sparkSession
    scale = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n_docs")).otherwise(F.lit(1.0))
    at_limit = F.col("target") >= F.col("source_size") * F.lit(float(MAX_COPIES)) * (1 - 1e-12)
    path = new_path(spark, "multipliers")
    state = wanted.select("source", "source_size", "target", scale.alias("scale"), F.when(~at_limit, F.lit(0.0)).alias("c"), F.lit(-4096.0).alias("lo"), F.lit(4096.0).alias("hi"), F.lit(False).alias("done"))
    state = written(state, "multipliers", path)
    for _ in range(rounds):
        counted = hist.join(state.where("c is not null and not done").select(F.col("source").alias("s"), "c", "scale"), _same_source("source", "s"))
        z = F.col("size") / F.col("scale")
        rate = F.lit(float(MAX_COPIES)) / (1 + F.exp(-F.col("c") * z))
        sums = counted.groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("value"), F.sum(F.col("n") * F.col("size") * z * rate * (1 - rate / MAX_COPIES)).alias("slope")
        )
        both = state.join(sums, _same_source("source", "s"), "left")
        off = F.col("value") - F.col("target")
        lo, hi = F.when(off < 0, F.col("c")).otherwise(F.col("lo")), F.when(off > 0, F.col("c")).otherwise(F.col("hi"))
        both = both.withColumn("off", off).withColumn("lo", F.when(F.col("s").isNull() & F.col("value").isNull(), F.col("lo")).otherwise(lo)).withColumn("hi", F.when(F.col("value").isNull(), F.col("hi")).otherwise(hi))
        newton = F.col("c") - F.col("off") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        done = F.col("done") | F.col("c").isNull() | F.col("value").isNull() | (F.abs("off") <= F.lit(close) * F.greatest("target", F.lit(1.0)))
        step = F.when(done, F.col("c")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        next_path = new_path(spark, "multipliers")
        state = written(both.select("source", "source_size", "target", "scale", step.alias("c"), "lo", "hi", done.alias("done")), "multipliers", next_path)
        remove(spark, path)
        path = next_path
        if state.where("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"the multipliers have not settled in {rounds} rounds")
    return state.select("source", "source_size", "target", "scale", "c")


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, seed: int = 7) -> DataFrame:
    """(doc_id, source, n, size, source_size, target, copies), grouped by equal keys.

    A row stands for the n rows of ``docs`` with the same doc_id, source and
    size, which all get the same copies.  Rounding is by a hash of doc_id, so
    reruns agree: a row keeps the whole part of its rate, and one copy more if
    its place, hash minus fraction, is below a threshold of its source.  The
    threshold is found by binned sums, two levels deep, where the words come
    nearest to the target.  What then is off by the size of a large row is made
    up by another pass over the rows that are no larger than that.
    """
    slim = docs.select("doc_id", "source", word_count(text_of()).alias("size"))
    slim = written(slim.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    hist = written(slim.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    wanted = written(targets(hist, weights, share), "targets")
    tuned = multipliers(hist, wanted)
    tuned = written(tuned.select(F.col("source").alias("s"), "source_size", "target", "scale", "c"), "tuned")
    limit = F.lit(float(MAX_COPIES))
    rate = F.when(F.col("c").isNull(), limit).otherwise(limit / (1 + F.exp(-F.col("c") * F.col("size") / F.col("scale"))))
    rated = slim.join(tuned, _same_source("source", "s")).withColumn("rate", rate)
    whole = F.least(F.floor("rate"), F.lit(MAX_COPIES)).cast("long")
    u = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    place = F.when((whole < MAX_COPIES) & (F.col("size") > 0), u - (F.col("rate") - whole))
    row = ["doc_id", "source", "n", "size", "source_size", "target"]
    rated = written(rated.select(*row, whole.alias("base"), place.alias("place")), "rated")
    for left in reversed(range(PASSES)):
        cut = written(_thresholds(rated), "thresholds")
        copies = F.col("base") + F.when(F.col("place") < F.col("threshold"), 1).otherwise(0)
        out = rated.join(cut, _same_source("source", "s"), "left").select(*row, copies.alias("copies"), "base", "place")
        if not left:
            break
        off = out.groupBy(F.col("source").alias("s"), "target").agg(F.sum(F.col("copies") * F.col("size") * F.col("n")).alias("got"))
        off = written(off.select("s", F.abs(F.col("got") - F.col("target")).alias("off")), "errors")
        small = F.col("size") * F.col("n") <= F.col("off")
        again = out.join(off, _same_source("source", "s"))
        rated = written(again.select(*row, F.when(small, F.col("base")).otherwise(F.col("copies")).alias("base"), F.when(small, F.col("place")).alias("place")), "rated")
    return out.select(*row, "copies")


def _thresholds(rated: DataFrame) -> DataFrame:
    """(s, threshold): with one more copy of the rows below it, a source's words come nearest to its target."""
    fixed = rated.groupBy("source", "target").agg(F.sum(F.col("base") * F.col("size") * F.col("n")).alias("fixed"))
    state = fixed.select(F.col("source").alias("s"), F.lit(-1.0).alias("bottom"), (F.col("target") - F.col("fixed")).alias("missing"))
    placed = rated.where("place is not null").select("source", "place", (F.col("size") * F.col("n")).alias("words"))
    step = 2.0 / BINS
    state = written(_crossing(placed, state, step), "coarse")
    inside = (F.col("place") >= F.col("bottom")) & (F.col("place") < F.col("bottom") + step)
    fine = _crossing(placed, state.drop("edge"), step / BINS, inside).select(F.col("s").alias("f"), F.col("edge").alias("fine"))
    # where all rows together stay below what is missing, no bin is crossed, and the coarse edge lies above them
    return state.join(fine, _same_source("s", "f"), "left").select("s", F.coalesce("fine", "edge").alias("threshold"))


def _crossing(placed: DataFrame, state: DataFrame, step: float, inside: Column | None = None) -> DataFrame:
    """(s, bottom, missing, edge): the bin of width ``step`` in which the running words of a source pass what is missing.

    edge is that side of the bin where the words are nearer to what is missing.
    """
    rows = placed.join(state, _same_source("source", "s"))
    rows = rows if inside is None else rows.where(inside)
    sums = rows.groupBy("s", "bottom", "missing", F.floor((F.col("place") - F.col("bottom")) / step).alias("bin")).agg(F.sum("words").alias("words"))
    run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("bin")))
    at = F.struct("bin", "upto")
    ends = run.groupBy("s", "bottom", "missing").agg(F.max(F.when(F.col("upto") <= F.col("missing"), at)).alias("below"), F.min(F.when(F.col("upto") > F.col("missing"), at)).alias("above"))
    bin_ = F.coalesce(F.col("above.bin"), F.col("below.bin") + 1)
    short = F.col("missing") - F.coalesce(F.col("below.upto"), F.lit(0))
    over = F.col("above.upto") - F.col("missing")
    low = F.col("bottom") + bin_ * step
    return ends.select("s", low.alias("bottom"), short.alias("missing"), F.when(over < short, low + step).otherwise(low).alias("edge"))


def mixture(docs: DataFrame) -> DataFrame:
    """Query rows: doc_id, size, source_size, target, taken, for each row of ``docs``.

    A null source is a source of its own, the last; a null or empty text has
    size 0; a null doc_id is hashed like any other; repeated rows come as often
    as they are, with the same copies; very long texts count whole; ties in
    the rounding fall alike, so reruns agree.  An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    each = mixed(docs)
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("__i")).drop("__i")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as its copies say.

    Rows of no words are taken once, as their copies change no count.  Nulls,
    ties, repeated rows, long texts and empty tables are as in ``mixture``.  The
    columns of ``docs`` return unchanged, whatever their names.
    """
    names, docs = docs.columns, plainly_named(docs, "doc_id", "source", "text")
    copies = mixed(docs).select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int").alias("__c"))
    sized = docs.withColumn("__size", word_count(text_of()))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    taken = sized.join(copies.where("__c > 0"), same)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__c"))).alias("__i")).drop("__i").toDF(*names)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
