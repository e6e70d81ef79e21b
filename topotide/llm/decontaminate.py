"""Benchmark decontamination with a broadcast hash set of n-grams.

Every window of a training text is hashed and looked up in a broadcast set of
the benchmark's window hashes; a set too large to be sent at once goes in parts
of bounded size, one after the other.  What is found is set against its
document again, where the words themselves are compared with the benchmark's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.llm.tables import ascii_lower, plainly_named, table, text_of
from topotide.plans.scratch import written

#: Characters of words: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Most hashes of benchmark windows that are broadcast at a time; a map of so many long numbers has some 200 MB.
MAX_SET = 4_000_000
#: Most found windows that are broadcast back to the documents; more are joined by a shuffle.
MAX_FOUND = 200_000
#: Words of a document whose windows are made at a time.
CHUNK = 4096


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), NOT_WORD + "+"), lambda w: w != "")


def _windows(words: str, n: int) -> str:
    """SQL: structs (pos, gram) of all windows of n words of the array ``words``."""
    return f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), i -> struct(i AS pos, slice({words}, i + 1, {n}) AS gram)) END"


def test_grams(items: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, n_gram, gram): windows of n words; a shorter item is one window."""
    words = items.select(F.col(item).alias("item_id"), words_of(text_of(text)).alias("w")).where("size(w) > 0")
    long = words.where(f"size(w) >= {n}").select("item_id", F.explode(F.expr(_windows("w", n))).alias("x")).select("item_id", "x.gram")
    short = words.where(f"size(w) < {n}").select("item_id", F.col("w").alias("gram"))
    return long.unionByName(short).select("item_id", F.size("gram").alias("n_gram"), F.concat_ws(" ", "gram").alias("gram")).distinct()


def _word_hashes(words: str) -> str:
    return f"transform({words}, w -> xxhash64(w))"


def found_windows(docs: DataFrame, grams: DataFrame, keys: list[str], text: str, max_set: int) -> DataFrame:
    """Distinct (*keys, pos, n, gram): windows of the documents whose hashes are those of benchmark windows."""
    hashed = written(grams.select("n_gram", "gram", F.expr(f"xxhash64({_word_hashes("split(gram, ' ')")})").alias("h")).distinct(), "hashes")
    sizes = sorted(r[0] for r in hashed.select("n_gram").distinct().collect())  # at most as many as a window has words
    if not sizes:
        return docs.select(*keys, F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit("").alias("gram")).where("false")
    parts = -(-hashed.select("h").distinct().count() // max_set)
    words = docs.select(*keys, words_of(text_of(text)).alias("__w"))
    words = _once(words, "__h", F.expr(_word_hashes("__w"))).where(F.size("__h") >= sizes[0])
    chunk = f"transform(sequence(0, size(__h) - 1, {CHUNK}), s -> struct(s, slice(__h, s + 1, {CHUNK + sizes[-1] - 1}) AS w))"
    chunks = words.select(*keys, F.explode(F.expr(chunk)).alias("c"))
    none = "CAST(array() AS array<struct<pos:int,n:int,h:bigint>>)"
    each = [f"CASE WHEN size(c.w) >= {n} THEN transform(sequence(0, least(size(c.w) - {n}, {CHUNK - 1})), i -> struct(c.s + i AS pos, {n} AS n, xxhash64(slice(c.w, i + 1, {n})) AS h)) ELSE {none} END" for n in sizes]
    windows = chunks.select(*keys, F.explode(F.expr(f"concat({', '.join(each)})")).alias("x")).select(*keys, "x.pos", "x.n", "x.h")
    found = None
    for part in range(parts):  # each set has about max_set hashes, for the parts are dealt by hash
        some = hashed.select("h").distinct().where(F.pmod("h", F.lit(parts)) == part)
        hit = windows.join(F.broadcast(some), "h")
        found = hit if found is None else found.unionByName(hit)
    same = hashed.select(F.col("n_gram").alias("n"), "h", "gram")
    return written(found, "found").join(same, ["n", "h"]).select(*keys, "pos", "n", "gram").distinct()


def scan(docs: DataFrame, grams: DataFrame, text: str = "text", max_set: int = MAX_SET, max_found: int = MAX_FOUND) -> DataFrame:
    """``docs`` with the array columns __words and __hits (pos, n, gram) of verified windows.

    Documents are told apart by two hashes of their text, as equal texts have
    equal windows.  A hit counts if its words are those of the benchmark.
    """
    keyed = docs.withColumns({"__k1": F.xxhash64(text_of(text)), "__k2": F.hash(text_of(text))})
    hits = found_windows(keyed, grams, ["__k1", "__k2"], text, max_set)
    hits = written(hits.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("pos", "n", "gram")).alias("__found")), "hits")
    few = (hits.agg(F.sum(F.size("__found")).alias("n")).first()["n"] or 0) <= max_found
    joined = keyed.join(F.broadcast(hits) if few else hits, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    out = _once(joined, "__words", words_of(text_of(text)))
    real = "filter(coalesce(__found, CAST(array() AS array<struct<pos:int,n:int,gram:string>>)), x -> array_join(slice(__words, x.pos + 1, x.n), ' ') = x.gram)"
    return _once(out, "__hits", F.expr(real)).drop("__found")


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column that is computed once for each row.

    A plain alias may be put in place of its uses, here inside a function that
    runs for every word; the optimizer doesn't look through a generator.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def _covered(hits: str) -> str:
    """SQL: the sorted distinct word positions inside the windows."""
    return f"array_sort(array_distinct(flatten(transform({hits}, x -> sequence(x.pos, x.pos + x.n - 1)))))"


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, action: str = "documents", text: str = "text", max_set: int = MAX_SET, max_found: int = MAX_FOUND) -> DataFrame:
    """``docs`` without the documents that hold a test window, or without the words inside such windows.

    action "documents" drops contaminated rows; "spans" cuts the hit words,
    each with the characters that follow it up to the next word.  The columns
    of ``docs`` return unchanged, whatever their names.  Null and empty texts
    have no words and stay as they are; repeated rows fare alike; very long
    texts are scanned whole, in chunks.  An empty benchmark changes nothing, an
    empty table gives none.  Equal hashes alone do nothing.
    """
    names, docs = docs.columns, plainly_named(docs, text)
    grams = written(test_grams(items, n), "grams")
    seen = scan(docs.withColumn("__text", F.col(text)), grams, "__text", max_set, max_found)
    if action == "documents":
        return seen.where("size(__hits) = 0").select(docs.columns).toDF(*names)
    if action != "spans":
        raise ValueError("action is 'documents' or 'spans'")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    cut = seen.withColumn("__pieces", F.regexp_extract_all("__text", F.lit(f"({word}+{gap}*)"), F.lit(1)))
    cut = cut.withColumn("__lead", F.regexp_extract("__text", f"^({gap}*)", 1)).withColumn("__gone", F.expr(_covered("__hits")))
    kept = F.expr("array_join(filter(__pieces, (p, i) -> NOT array_contains(__gone, i)), '')")
    return cut.withColumn(text, F.when(F.expr("size(__hits) = 0"), F.col("__text")).otherwise(F.concat("__lead", kept))).select(docs.columns).toDF(*names)


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, max_set: int = MAX_SET, max_found: int = MAX_FOUND) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; with no hits, items_sha256 is that of
    the empty string.  Rows with the same doc_id keep apart, as each result row
    is keyed by the doc_id and a digest of the text; repeated rows come as
    often as they are.  Windows that several items hold count for each.  Very
    long texts are scanned whole.  Other columns are not read.
    """
    grams = written(test_grams(items, n), "grams")
    slim = docs.select("doc_id", "text")
    seen = scan(slim, grams, max_set=max_set, max_found=max_found).select(
        "doc_id",
        F.xxhash64(text_of()).alias("k1"),
        F.hash(text_of()).alias("k2"),
        F.size("__words").cast("long").alias("n_words"),
        F.size(F.expr(_covered("__hits"))).cast("long").alias("n_hit"),
        F.array_distinct(F.col("__hits.gram")).alias("grams"),
    )
    seen = written(seen, "scanned")
    by_doc = seen.where("n_hit > 0").select("doc_id", "k1", "k2", F.explode("grams").alias("gram")).distinct()
    by_doc = by_doc.join(grams.select("gram", F.col("item_id").cast("string").alias("item")), "gram").groupBy("doc_id", "k1", "k2")
    by_doc = by_doc.agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("k1").alias("a"), F.col("k2").alias("b"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))
    joined = seen.drop("grams").join(by_doc, same, "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_hit", F.size(items_of).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, len(w2) AS n, array_to_string(w2, ' ') AS gram
  FROM (SELECT item_id, unnest(CASE WHEN len(w) >= 10
               THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i+9]) ELSE [w] END) AS w2
        FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
win AS (
  SELECT rid, n, p, array_to_string(w[p:p+n-1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, win.n, p, item_id FROM win JOIN g ON win.gram = g.gram AND win.n = g.n),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items,
               sha256(array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',')) AS s
        FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
