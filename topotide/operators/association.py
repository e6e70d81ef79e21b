"""Words and topics: contingency, tests and groups; statistics of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topotide.operators.graphs import components

#: The 0.99 quantile of chi-square with one degree of freedom.
CHI_SQUARE_99 = 6.6349


def topic_words(posts: DataFrame, least_letters: int = 3) -> DataFrame:
    """(topic, word): words of posts (topics, text) that carry a topic, topics themselves left out."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![#\p{L}])\p{L}{%d,}" % least_letters), F.lit(0))
    rows = posts.select("topics", words.alias("w")).select(F.explode("topics").alias("topic"), "w")
    return rows.select(F.lower("topic").alias("topic"), F.explode("w").alias("word"))


def frequent_words(words: DataFrame, min_n: int = 10, max_words: int = 75) -> DataFrame:
    """(topic, word, n) seen more than ``min_n`` times, for topics with fewer than ``max_words`` of them."""
    counts = words.groupBy("topic", "word").agg(F.count("*").alias("n")).where(F.col("n") > min_n)
    return counts.withColumn("k", F.count("*").over(Window.partitionBy("topic"))).where(F.col("k") < max_words).drop("k")


def contingency(counts: DataFrame, max_topics: int = 10) -> DataFrame:
    """(word, topic, n00, n01, n10, n11): both, the word elsewhere, the topic's other words, and the rest."""
    w = counts.withColumn("wt", F.sum("n").over(Window.partitionBy("word"))).withColumn("k", F.count("*").over(Window.partitionBy("word"))).where(F.col("k") <= max_topics)
    t = counts.groupBy("topic").agg(F.sum("n").alias("tt"))
    whole = counts.agg(F.sum("n").alias("all"))
    rows = w.join(t, "topic").crossJoin(F.broadcast(whole))
    return rows.select("word", "topic", F.col("n").alias("n00"), (F.col("wt") - F.col("n")).alias("n01"), (F.col("tt") - F.col("n")).alias("n10"), (F.col("all") - F.col("wt") - F.col("tt") + F.col("n")).alias("n11"))


def chi_square(table: DataFrame) -> DataFrame:
    """Add chi2 with continuity correction, and is_significant at one percent."""
    a, b, c, d = (F.col(x).cast("double") for x in ("n00", "n01", "n10", "n11"))
    n = a + b + c + d
    off = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    chi = F.when(margins > 0, n * off * off / margins).otherwise(0.0)
    return table.withColumn("chi2", chi).withColumn("is_significant", F.col("chi2") > CHI_SQUARE_99)


def fisher_exact(table: DataFrame) -> DataFrame:
    """Add p: two-sided exact test, from log factorials by the gamma function's series."""
    def lf(x: str) -> str:  # ln(x!) by Stirling's series of ln gamma at x + 8, brought down by a product
        z = f"({x} + 8.0D)"
        low = " + ".join(f"ln({x} + {i}.0D)" for i in range(1, 8))
        return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - ({low}))"

    def lp(x: str) -> str:
        return f"(__base - {lf(x)} - {lf(f'(__r - {x})')} - {lf(f'(__c - {x})')} - {lf(f'(__n - __r - __c + {x})')})"

    rows = table.withColumn("__r", F.expr("n00 + n01")).withColumn("__c", F.expr("n00 + n10")).withColumn("__n", F.expr("n00 + n01 + n10 + n11"))
    rows = rows.withColumn("__base", F.expr(f"{lf('__r')} + {lf('(__n - __r)')} + {lf('__c')} + {lf('(__n - __c)')} - {lf('__n')}"))
    rows = rows.withColumn("__own", F.expr(lp("n00")))
    support = "sequence(greatest(0, __r + __c - __n), least(__r, __c))"
    p = f"aggregate({support}, 0.0D, (s, x) -> s + CASE WHEN {lp('x')} <= __own + 1e-7 THEN exp({lp('x')}) ELSE 0.0D END)"
    return rows.withColumn("p", F.least(F.expr(p), F.lit(1.0))).drop("__r", "__c", "__n", "__base", "__own")


def topic_groups(significant: DataFrame) -> DataFrame:
    """(group_id, node, n_topics): the nodes of each component of word-topic links, and how many of them are topics; words and topics are apart by a prefix."""
    edges = significant.select(F.concat(F.lit("t:"), "topic").alias("u"), F.concat(F.lit("w:"), "word").alias("v"))
    labels = components(edges)
    sizes = labels.groupBy("component").agg(F.sum(F.col("node").startswith("t:").cast("bigint")).alias("n_topics"))
    return labels.join(sizes, "component").select(F.col("component").alias("group_id"), "node", "n_topics")


def lead_lag_status(majority: DataFrame, thresholds: tuple[int, ...] = (5, 25)) -> DataFrame:
    """(min_common, l, r, n, mean_status): which of two cells reaches its majority bucket first, over topics; ties are left out."""
    a = majority.select("topic", F.col("cell").alias("l"), F.col("bucket").alias("x"))
    b = majority.select("topic", F.col("cell").alias("r"), F.col("bucket").alias("y"))
    pairs = a.join(b, "topic").where("l < r and x <> y").groupBy("l", "r").agg(F.count("*").alias("n"), F.avg(F.signum(F.col("x") - F.col("y"))).alias("mean_status"))
    return pairs.withColumn("min_common", F.explode(F.array(*[F.lit(int(x)) for x in thresholds]))).where("n >= min_common")


def kde(values: DataFrame, column: str, points: int = 100, low: float = -1.0, high: float = 1.0, factor: float = 0.25) -> DataFrame:
    """(x, density): Gaussian density on a fixed grid, from values counted after rounding to four digits."""
    counts = values.groupBy(F.round(column, 4).alias("v")).agg(F.count("*").alias("c"))
    stats = values.agg(F.stddev_samp(column).alias("sd"), F.count("*").alias("n"))
    grid = counts.crossJoin(F.broadcast(stats)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.lit(low) + F.col("i") * ((high - low) / (points - 1))
    h = F.col("sd") * factor
    z = (x - F.col("v")) / h
    return grid.groupBy("i").agg(F.first(x).alias("x"), F.sum(F.col("c") * F.exp(-z * z / 2) / (F.col("n") * h * 2.5066282746310002)).alias("density")).select("x", "density")


def all_pairs(table: DataFrame) -> DataFrame:
    """Every pair of ``contingency`` as significant, with p = 0."""
    return table.withColumn("p", F.lit(0.0)).withColumn("is_significant", F.lit(True))
