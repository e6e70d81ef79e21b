"""Operators of the training-data package against brute force on small tables."""

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from topotide.llm import dealing
from topotide.llm import decontaminate as dc
from topotide.llm import exact_dedup as ed
from topotide.llm import mixing as mx
from topotide.llm import pii_crf as pii
from topotide.llm import pairing
from topotide.llm import sharding as sh
from topotide.llm import shingling
from topotide.llm import simhash as sim
from topotide.llm import site_style_tree as sst
from topotide.llm import substring_dedup as sub
from topotide.llm import token_output as tok
from topotide.llm import toxicity as tox
from topotide.llm.shingling import shingle_lists
from topotide.llm.tables import unique_rows
from topotide.plans.scratch import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def some_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, and repeated rows."""
    rng = random.Random(5)
    long = some_text(rng, 30000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, long, "en", "b", len(long))]
    rows += [(5, "Ein Text hier", "de", "b", 13), (6, "ein text\nhier", "de", None, 13), (7, "Ein  Text hier", "de", "c", 14), (7, "Ein  Text hier", "de", "c", 14)]
    rows += [(None, "no id here", "en", "c", 10), (8, long, "en", "a", len(long)), (9, "é ñ\x0bü +1 (017) 555-7713 a@b.co", None, "a", 30)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    extra = "component_id string, fingerprint int, row int, size string, keep_id string, score string, key string, k string, h string, digest string, words string, shard string"
    names = [x.split()[0] for x in extra.split(",")]
    df = spark.createDataFrame(odd_rows(), DOCS)
    return df.withColumns({n: F.lit(None).cast(x.split()[1]) for n, x in zip(names, extra.split(","))})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 1 -----------------------------------------------------------------------


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@+-9 5(é_%)0\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("1" * 100_000 + " " + "a@" * 50_000) == []


def test_crf_finds_private_words_in_held_out_rows():
    rows = pii.labelled_rows(copies=12)
    crf = pii.train(rows)
    right = wrong = missed = 0
    for text, spans in pii.labelled_rows(copies=3, seed=99):
        found = pii.crf_spans(text, crf)
        right += sum(s in found for s in spans)
        missed += sum(s not in found for s in spans)
        wrong += sum(f not in spans for f in found)
    assert right / (right + missed) > 0.95 and wrong / max(1, right + wrong) < 0.05
    assert pii.crf_spans("call 0445617099674829 now", crf) == [("card", 5, 21)]
    assert pii.crf_spans("in 2019 of 300 items at 12:30", crf) == []


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(26)
    move = np.where(pii._allowed(), rng.normal(size=(pii.T + 1, pii.T)), -1e4)
    crf = pii.Crf({}, np.zeros((0, pii.T)), move)
    chains = [rng.normal(size=(n, pii.T)) * 2 for n in (1, 2, 3, 4, 3, 1)]
    for scores, path in zip(chains, crf.decode(chains)):
        def value(p, s=scores):
            return sum(s[i, t] + move[p[i - 1] if i else pii.T, t] for i, t in enumerate(p))

        best = max(itertools.product(range(pii.T), repeat=len(scores)), key=value)
        assert value(path) == pytest.approx(value(best)) and tuple(path) == best


def test_neighbouring_numbers_are_two_spans():
    crf = pii.train(pii.labelled_rows())
    assert pii.crf_spans("see 7536784127813050 4845168114407329 there", crf) == [("card", 4, 20), ("card", 21, 37)]


def test_find_private(spark, odd, empty):
    got = pii.find_private(odd, pii.labelled_table(spark)).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[9]["n_phone"] == by[9]["n_email"] == 1 and by[9]["spans"] == "email:24:30,phone:6:23"
    assert by[1]["spans"] == "" and by[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    for r, (_, text, *_) in zip(sorted(got, key=str), sorted(got, key=str)):
        assert r["base_sha256"]
    assert pii.find_private(empty, pii.labelled_table(spark)).count() == 0


# 2 -----------------------------------------------------------------------


def brute_dedup(rows):
    groups = {}
    for i, t, *_ in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0, i))
    return sorted(
        ((i, min(g)[3], len(g), i == min(g)[3], hashlib.sha256(n.encode()).hexdigest()) for i, n, g in ((i, n, groups[n]) for i, t, *_ in rows for n in [re.sub(r"[\x20\x09-\x0D]", "", t or "")])), key=repr
    )


def test_exact_dedup(spark, odd, empty):
    index = ed.DigestIndex(spark, new_path(spark, "a"), 4)
    assert sorted(rows_of(index.add_batch(odd)), key=repr) == brute_dedup(odd_rows())
    # a second batch meets the index; a third run of the same batch appends nothing
    more = spark.createDataFrame([(50, "EinTexthier", None, None, None), (51, "brand new", None, None, None)], DOCS)
    got = {r["doc_id"]: r["keep_id"] for r in index.add_batch(more).collect()}
    assert got == {50: 7, 51: 51}
    n = index.table().count()
    index.add_batch(more).collect()
    assert index.table().count() == n and len(index.batches()) == 3
    assert ed.DigestIndex(spark, new_path(spark, "b"), 4).add_batch(empty).count() == 0
    assert ed.deduplicated(empty, new_path(spark, "c")).count() == 0


def test_two_batches_decide_as_one(spark, odd):
    rng = random.Random(18)
    rows = odd_rows() + [(100 + i, " " * rng.randrange(4) + f"t{rng.randrange(40)}" + "\t" * rng.randrange(3), "en", "s", 0) for i in range(400)]
    clash = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("x")).withColumn("keep_id", F.lit(1)).withColumn("group_size", F.lit(1))
    assert sorted(rows_of(ed.deduplicated(clash, new_path(spark, "d"))), key=repr) == brute_dedup(rows)


def test_the_index_outlives_its_session(spark, tmp_path):
    path = str(tmp_path / "index")
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / "warehouse")!r}).getOrCreate()
from topotide.llm.exact_dedup import DigestIndex
rows = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
DigestIndex(spark, {path!r}, 4).add_batch(rows).collect()
"""
    root = ed.__file__.rpartition("/topotide/")[0]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, timeout=300)
    index = ed.DigestIndex(spark, path, 99)
    rows = spark.createDataFrame([(3, "t w o"), (4, "four")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in index.add_batch(rows).collect()} == {3: 2, 4: 4}
    assert index.table().count() == 3 and index.batches() == ["000000", "000001"]
    # what has no marker isn't read
    spark.createDataFrame([(b"x", 9)], "digest binary, keep_id long").write.parquet(f"{path}/batches/000002")
    assert index.table().count() == 3
    plan = index.table().select("digest").join(index.table().select(F.col("digest").alias("d")).hint("merge"), F.col("digest") == F.col("d"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


# 3 -----------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_contamination(docs, items):
    out = []
    for i, t, *_ in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for item, text in items:
            b = WORD.findall(lower(text))
            n = min(10, len(b))
            grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1) if n else ():
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contamination_case():
    rng = random.Random(2)
    items = [(i, some_text(rng, n, 50)) for i, n in enumerate((30, 12, 10, 4, 1, 0))] + [(20, None), (21, "it's a \\ 'test' ÄÖÜ")]
    items[4] = (4, "solitaire")
    docs = [(200 + i, some_text(rng, 60, 50), "en", "a", 0) for i in range(40)]
    for j in range(0, 40, 3):
        item = items[j % 5][1]
        docs[j] = (200 + j, docs[j][1] + ". " + item.upper().replace(" ", "--") + "! " + docs[j][1], "en", "a", 0)
    docs.append((77, "well IT S a, test ÄÖÜ it's A 'test' ÄÖÜ", "en", "a", 0))
    return docs + odd_rows(), items


def test_contamination(spark, empty):
    docs, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit("x"))
    df = spark.createDataFrame(docs, DOCS).withColumns({"gram": F.lit(1), "n_words": F.lit("x"), "item_id": F.lit(0)})
    assert sorted(rows_of(dc.contamination(df, bench)), key=repr) == brute_contamination(docs, items)
    long = some_text(random.Random(21), 4090) + " " + " ".join(items[0][1].split()) * 2 + " " + some_text(random.Random(22), 5000)
    more = [(500, long, "en", "a", 0)] * 2
    assert sorted(rows_of(dc.contamination(spark.createDataFrame(more, DOCS), bench)), key=repr) == brute_contamination(more, items)
    assert sorted(rows_of(dc.contamination(df, bench, max_found=0)), key=repr) == brute_contamination(docs, items)
    assert dc.contamination(empty, bench).count() == 0 and dc.decontaminate(empty, bench).count() == 0
    none = dc.contamination(df, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


def test_decontaminate_removes_documents_or_spans(spark):
    docs, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    bad = {r[0] for r in brute_contamination(docs, items) if r[5]}
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d[0] for d in docs if d[0] not in bad), key=repr)
    cut = dc.decontaminate(df, bench, action="spans").collect()
    left = {r["doc_id"]: WORD.findall(lower(r["text"])) for r in cut}
    for i, t, *_ in docs:
        if i not in bad:
            assert [r["text"] for r in cut if r["doc_id"] == i][0] == t
    expected = {r[0]: r[1] - r[2] for r in brute_contamination(docs, items)}
    assert {i: len(w) for i, w in left.items()} == expected


def test_benchmark_beyond_the_set_is_joined(spark):
    docs, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    assert sorted(rows_of(dc.contamination(df, bench, max_set=20)), key=repr) == brute_contamination(docs, items)
    for action in ("documents", "spans"):
        sent, joined = dc.decontaminate(df, bench, action=action), dc.decontaminate(df, bench, action=action, max_set=20)
        assert joined.columns == df.columns and sorted(rows_of(joined), key=repr) == sorted(rows_of(sent), key=repr)


# 4 -----------------------------------------------------------------------


def test_compact_windows_split_all_subsequences():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, t = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        v = rng.integers(0, 12 if rng.random() < 0.5 else 1 << 60, n).astype(np.uint64)
        if n < t:
            continue
        seen = {}
        for l, c, r in zip(*sub.compact_windows(v, t)):
            for i in range(l, c + 1):
                for j in range(c, r + 1):
                    assert (i, j) not in seen
                    seen[i, j] = c
        for i in range(n):
            for j in range(i + t - 1, n):
                assert seen[i, j] == i + int(np.argmin(v[i : j + 1]))


def test_substring_duplicates(spark, empty, odd):
    rng = random.Random(4)
    docs = [(i, some_text(rng, rng.randint(60, 400), 5000)) for i in range(60)]
    a, b = some_text(rng, 60, 5000), some_text(rng, 90, 5000)
    near = b.split()
    near[45] = "changed"
    for i in (3, 9, 20, 33):
        docs[i] = (i, docs[i][1] + " " + a + " " + docs[i + 1][1])
    docs[40] = (40, b + " " + docs[40][1])
    docs[50] = (50, docs[50][1] + "\n" + " ".join(near))
    docs[55] = (55, docs[12][1])
    short = " ".join(a.split()[:30])
    docs[58] = (58, short + " " + docs[58][1])
    shared = {3, 4, 9, 10, 20, 21, 33, 34}  # the tails are other documents, so these link too
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    got = {r["doc_id"]: r for r in sub.substring_duplicates(df).collect()}
    assert len(got) == 60
    classes = {}
    for i, r in got.items():
        classes.setdefault(r["class_id"], set()).add(i)
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == {frozenset(shared), frozenset({40, 50}), frozenset({12, 55})}
    for i in (3, 9, 20, 33):
        w = docs[i][1].split()
        at = len(w) - 60 - len(docs[i + 1][1].split())
        assert any(int(s) <= at + 6 and int(e) >= len(w[: at + 54]) for s, e in (x.split(":") for x in got[i]["spans"].split(",")))
    assert sub.substring_duplicates(empty).count() == 0
    strange = {r["doc_id"]: r["class_id"] for r in sub.substring_duplicates(odd).collect()}
    assert strange[8] == strange[4] == 4 and strange[5] == 5 and strange[None] is None


def test_equal_passages_are_found_behind_fragments_of_smaller_rows(spark):
    rng = random.Random(14)
    docs, same = [], []
    for j in range(24):
        fill = lambda n=80: [f"f{rng.randrange(10**6)}" for _ in range(n)]
        p = fill(50)
        # smaller rows hold parts of the passage, too short to be similar, and one text holds it twice
        texts = [fill() + p[:30] + fill(), fill() + p[20:] + fill(), fill() + p + fill(), fill() + p + fill() + p + fill()]
        docs += [(i * 1000 + j, " ".join(w)) for i, w in enumerate(texts)]
        same.append((2000 + j, 3000 + j))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in sub.substring_duplicates(df).collect()}
    words_of = {i: t.split() for i, t in docs}
    shared = {}
    for i, w in words_of.items():
        for at in range(len(w) - 49):
            shared.setdefault(tuple(w[at : at + 50]), []).append((i, at))
    assert sorted({tuple(sorted({i for i, _ in x})) for x in shared.values() if len(x) > 1}) == same
    assert {(a, b) for a, b in same if got[a]["class_id"] == got[b]["class_id"] == a} == set(same)
    for x in shared.values():
        for i, at in x if len(x) > 1 else ():
            assert any(int(s) <= at and at + 50 <= int(e) for s, e in (y.split(":") for y in got[i]["spans"].split(",")))
    assert all(got[i]["class_id"] == i and got[i]["spans"] == "" for i in got if i < 2000)


def test_passages_of_equal_runs_and_near_copies_link(spark):
    """Against brute force over all pairs: every pair with an equal run of 50 words is connected, and no texts that share a line alone."""
    rng = random.Random(15)
    fill = lambda n: [f"g{rng.randrange(10**6)}" for _ in range(n)]
    line = fill(20)
    docs = []
    for family in range(12):
        p = fill(rng.randint(50, 70)) + [f"family{family}"]
        docs += [fill(rng.randint(0, 90)) + p[: rng.choice((30, 45, 48, 49))] + fill(40) for _ in range(2)]  # pieces, too short by up to one word
        docs += [fill(rng.randint(0, 90)) + p[at : at + 50] + fill(rng.randint(0, 60)) for at in (0, len(p) - 51)]
        docs += [p + fill(30), fill(30) + line + p + line + fill(5)]
        docs[-6:] = [(family, w) for w in docs[-6:]]
    docs += [(100 + i, fill(60) + line + fill(60)) for i in range(40)]
    rng.shuffle(docs)
    families, docs = zip(*docs)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in sub.substring_duplicates(df).collect()}
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        one, two = ({tuple(w[a : a + 50]) for a in range(len(w) - 49)} for w in (docs[i], docs[j]))
        if one & two:
            parent[max(top(i), top(j))] = min(top(i), top(j))
    for i in range(len(docs)):
        assert got[i] == got[top(i)]  # long pieces are near copies and may join their passage's class
    assert all(families[i] == families[got[i]] for i in range(len(docs)))


def test_stars_tell_keys_with_a_third_row(spark):
    keyed = spark.createDataFrame([(2, 1), (2, 5), (4, 1), (4, 6), (4, 7), *[(k, 9) for k in range(6, 2000, 2)]], "key long, row long")
    assert sorted(map(tuple, sub.stars(keyed).select("hub", "row", "more").collect())) == [(1, 5, False), (1, 6, True), (1, 7, True)]


def test_pairs_are_sifted_by_what_they_hold_in_common(spark):
    """The exact number of a row's places with shingles of the hub, repeats included, without texts."""
    rng = random.Random(21)
    lines = [some_text(rng, rng.randint(5, 30), 10**6) for _ in range(12)]
    docs = [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    texts = spark.createDataFrame(docs, "row long, text string")
    sets = pairing.shared_shingles(texts, 5, holders=True).groupBy("row", "holders").agg(F.sum("times").alias("times"))
    lists = {i: x.tolist() for i, x in zip(range(40), shingle_lists(pa.array([t for _, t in docs])))}
    held = {r["row"] for r in sets.select("row").distinct().collect()}
    every = [(i, j) for i in held for j in held if i < j]
    pairs = spark.createDataFrame(every, "hub long, row long")
    for enough in (1, 20, 37):
        want = {(i, j) for i, j in every if sum(s in set(lists[i]) for s in lists[j]) >= enough}
        assert want and {(r["hub"], r["row"]) for r in pairing.with_common(pairs, sets, enough).collect()} == want


def test_words_are_hashed_together():
    rng = random.Random(22)
    pieces = ["a", "B", "Z", "é", "漢字", " ", "\t", "\n", "\x0b", "\x1c", "  ", "x" * 31, "Y" * 32, "q" * 90, ""]
    texts = ["", " ", *["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(300)]]
    want = [[xxhash.xxh64_intdigest(w.lower()) for w in t.encode().split()] for t in texts]
    for part, low, high in ((pa.array(texts), 0, 302), (pa.array(texts)[7:200], 7, 200), (pa.array(texts, pa.large_string()), 0, 302), (pa.array([], pa.string()), 0, 0)):
        hashes, at = shingling.word_hashes(part)
        assert [hashes[i:j].tolist() for i, j in zip(at, at[1:])] == want[low:high]


def test_entries_meet_by_key_in_blobs(spark):
    """Against a dictionary, with a key that most rows have, in memory and by way of a file."""
    rng = np.random.default_rng(23)
    keys, rows, at = rng.integers(0, 900, 6000), rng.integers(-5, 1 << 40, 6000), rng.integers(0, 1 << 32, 6000)
    rows[::2] %= 300
    keys[:2500] = 77
    keys = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    order = np.argsort(rows, kind="stable")  # what a row has of a key comes at once
    source = spark.createDataFrame(list(zip(rows[order].tolist(), keys[order].tolist(), at[order].tolist())), "row long, key long, at long").coalesce(1)
    held = {}
    for k, r, a in zip(keys.tolist(), rows.tolist(), at.tolist()):
        held.setdefault(k, []).append((r, a))

    def entries(batch):
        row, key, place = (c.to_numpy() for c in batch.columns)
        distinct, text = np.unique(row, return_inverse=True)
        yield distinct, text, key.view(np.uint64), place

    for most in (1 << 22, 40):
        for extra in (0, 1):
            found = dealing.met(source, (lambda b: (x[: 3 + extra] for x in entries(b))), (lambda k, r, n, least, holders, *a: [k, r, n, least, holders, *[x.astype(np.int64) for x in a]]), "k long, r long, n long, least long, holders long" + ", at long" * extra, extra, most).collect()  # noqa: B023
            groups = {}
            for x in found:
                groups.setdefault(x["k"], []).append(x)
            several = {k: v for k, v in held.items() if len(v) > 1}
            assert sorted(sorted({tuple(x)[1::4] if extra else x["r"] for x in v}) for v in groups.values()) == sorted(sorted(set(v) if extra else {r for r, _ in v}) for v in several.values())
            assert all({(x["n"], x["least"]) for x in v} == {(len({y["r"] for y in v}), min(y["r"] for y in v))} for v in groups.values())
            sets = {}
            for v in groups.values():
                sets.setdefault(frozenset(x["r"] for x in v), set()).update(x["holders"] for x in v)
            assert all(len(x) == 1 for x in sets.values()) and len(set.union(*sets.values())) == len(sets)


def test_parts_are_dealt_evenly(spark):
    for n in (1, 7, 211):
        numbers = spark.createDataFrame([(int(x),) for x in dealing.spread_numbers(n)], "x int")
        assert [r["p"] for r in numbers.select(F.pmod(F.hash("x"), F.lit(n)).alias("p")).collect()] == list(range(n))


def test_texts_with_a_common_window_hold_a_picked_shingle(spark):
    """Every text that holds enough places of a window of the larger row, lines repeated, holds a shingle that is picked for it."""
    rng = random.Random(24)
    lines = [some_text(rng, rng.randint(3, 14), 10**6) for _ in range(40)]
    docs = [(i, " ".join(rng.choice(lines[: rng.choice((8, 40))]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    lists = {i: x.tolist() for (i, _), x in zip(docs, shingle_lists(pa.array([t for _, t in docs])))}
    t, enough = 20, 16
    marks = pairing.marked(pairing.held_places(spark.createDataFrame(docs, "row long, text string"), 5), t, enough).collect()
    places = pairing.held_places(spark.createDataFrame(docs, "row long, text string"), 5).collect()
    holders = {}
    for x in places:
        holders.setdefault(x["s"], set()).add(x["row"])
    assert all(len(v) == x["n"] for x in places for v in [holders[x["s"]]]) and len(places) == sum(sum(any(s in set(lists[j]) for j in lists if j != i) for s in lists[i]) for i in lists)
    picked = {}
    for x in marks:
        if x["picked"]:
            picked.setdefault(x["row"], set()).update(holders[x["id"]])
    near = {(i, j) for i in lists for j in lists if i < j and any(sum(s in set(lists[i]) for s in lists[j][a : a + t]) >= enough for a in range(max(1, len(lists[j]) - t + 1)))}
    assert len(near) > 50 and all(i in picked[j] for i, j in near)


def test_rows_behind_a_hub_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Texts that share a line too short to be a passage, and have windows of lines that others hold, hardly two the same."""
    rng = random.Random(25)
    head = some_text(rng, 40, 10**6)
    lines = [some_text(rng, 17, 10**6) for _ in range(120)]
    docs = [(i, " ".join([head, *some_text(rng, 60, 10**6).split(), *rng.sample(lines, 9)])) for i in range(120)]
    docs += [(500, some_text(rng, 70, 10**6)), (501, docs[7][1].split(" ", 80)[-1] + " " + some_text(rng, 9, 10**6))]
    sent, real = [], sub.with_common

    def counted(pairs, *rest):
        sent.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(sub, "with_common", counted)
    got = {r["doc_id"]: r["class_id"] for r in sub.substring_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[501] == got[7] == 7 and got[500] == 500
    assert sent and sum(sent) < 120 * 119 // 4


def test_labels_are_joined_by_later_links(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (5, 2), (3, 3), (6, 3)], "row long, component long")
    links = spark.createDataFrame([(5, 6), (4, 9), (7, 8)], "hub long, row long")
    got = sorted(map(tuple, sub._joined(labels, links).select("row", "component").collect()))
    assert got == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 2), (6, 2), (7, 7), (8, 7), (9, 1)]


def test_long_texts_are_told_by_their_first_words(spark):
    words = ["\x85w\u00a0\u2028"] * 50  # no white space in ASCII
    rows = [(0, ""), (1, " \t\n"), (2, " ".join(words[1:])), (3, "\x0b" + " \r\n".join(words)), (4, " ".join(words) + " end "), (5, " ".join(words[1:]) + "\n")]
    got = {r["i"]: r["long"] for r in spark.createDataFrame(rows, "i long, text string").select("i", F.col("text").rlike(sub.LONG).alias("long")).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False}


def test_near_copies_are_found(spark):
    """Recall of copies with one word in fifty changed, the farthest that reach 0.8."""
    rng = random.Random(16)
    docs = []
    for i in range(150):
        p = some_text(rng, 50 * rng.randint(1, 6), 10**6).split()
        q = list(p)
        for at in range(25, len(q), 50):
            q[at] = "changed"
        docs += [(2 * i, " ".join(p)), (2 * i + 1, some_text(rng, 30, 10**6) + " " + " ".join(q))]
    got = {r["doc_id"]: r["class_id"] for r in sub.substring_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(150)) >= 135
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_near_copies_behind_smaller_rows_are_found(spark):
    """Smaller rows hold halves of the passages apart, share keys with both copies and fail on them."""
    rng = random.Random(19)
    docs, parts = [], [[] for _ in range(6)]
    for i in range(60):
        p = some_text(rng, 60, 10**6).split()
        q = list(p)
        q[30] = "changed"
        docs += [(100 + 2 * i, " ".join(p)), (101 + 2 * i, " ".join(q))]
        for j, part in enumerate(parts):
            part.append(" ".join([*p[j : 30 + j], *some_text(rng, 20, 10**6).split(), *p[30 + j - 6 :]]))
    docs += [(j, " ".join(part)) for j, part in enumerate(parts)]
    got = {r["doc_id"]: r["class_id"] for r in sub.substring_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[101 + 2 * i] == got[100 + 2 * i] for i in range(60))


def test_passages_with_repeated_ids_and_white_space(spark):
    rng = random.Random(17)
    a, b, c = (some_text(rng, 49, 10**6) for _ in range(3))
    rows = [(1, a + " x"), (1, b + " y"), (2, "pre " + a + " x"), (3, b + " y post"), (4, "\t" + c + "\n"), (5, c), (None, "q " + a + " x"), (6, b + " y"), (6, b + " y")]
    got = sorted(rows_of(sub.substring_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("hub", F.lit("h"))).select("doc_id", "class_id")), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, 1), (6, 1), (6, 1)], key=repr)


# 5 -----------------------------------------------------------------------


def brute_fingerprint(text):
    w = [x.encode() for x in SPACE.split(lower(text)) if x]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, budget=2):
    fps = list(fps)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= budget:
            parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def brute_near(texts, similarity=0.8):
    """Components of texts by the Jaccard similarity of their sets of five-word shingles; shorter texts by their words."""
    sequences = [tuple(w.encode() for w in SPACE.split(lower(t)) if w) for t in texts]
    sets = [{s[i : i + 5] for i in range(len(s) - 4)} for s in sequences]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if sequences[i] == sequences[j] or common and common >= similarity * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def brute_kept(rows):
    """The doc_ids that stay: the smallest of each component, null last; repeated rows are one."""
    rows = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    roots = brute_near([t for _, t in rows])
    return sorted((i for (i, _), n, root in zip(rows, range(len(rows)), roots) if n == root), key=repr)


def test_simhash(spark, odd, empty):
    rows = odd_rows()
    rng = random.Random(6)
    base = some_text(rng, 300)
    for i in range(100, 160):
        w = base.split()
        if i % 4:
            w[rng.randrange(300)] = "x"
        rows.append((i, " ".join(w) if i % 3 else some_text(rng, 50), "en", "a", 0))
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash"))
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    roots = brute_components({f for _, f in fps})
    smallest = {}
    for i, f in fps:
        if i is not None:
            smallest[roots[f]] = min(i, smallest.get(roots[f], i))
    expected = sorted(((i, f"{f:016x}", smallest.get(roots[f])) for i, f in fps), key=repr)
    assert sorted(rows_of(sim.near_duplicates(df)), key=repr) == expected
    assert sim.near_duplicates(empty).count() == 0
    kept = sim.drop_near_duplicates(df.withColumns({"row": F.lit(1), "hub": F.lit("x"), "ring": F.lit(2), "size": F.lit(3), "component": F.lit("c")}))
    assert kept.columns == [*df.columns, "row", "hub", "ring", "size", "component"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == brute_kept(rows)
    assert sim.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("pair_bucket", "m"), [(0, 8), (3, 8), (1000, 8), (3, 16), (3, 32)])
def test_pigeonring_links_join_what_brute_force_joins(spark, pair_bucket, m):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    for f in list(fps)[:20]:
        for _ in range(6):
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = {tuple(r) for r in sim.near_links(signed, 2, m, pair_bucket).collect()}
    roots = brute_components(fps)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        u, v = u % (1 << 64), v % (1 << 64)
        parent[find(u)] = find(v)
    a, b = {}, {}
    for f in fps:
        a.setdefault(roots[f], set()).add(f)
        b.setdefault(find(f), set()).add(f)
    assert {frozenset(x) for x in a.values()} == {frozenset(x) for x in b.values()}


def test_rows_with_null_or_repeated_ids_stay_one_by_one(spark):
    rng = random.Random(15)
    texts = [some_text(rng, 100, 5000) for _ in range(6)]
    rows = [(None, texts[0], "en", None, 0), (None, texts[1], None, "en", 0), (None, texts[1], "en", None, 0), (5, texts[2], "en", "a", 0), (5, texts[3], "en", "a", 0)]
    rows += [(6, texts[4], "en", "a", 0), (6, texts[4], "en", "a", 0), (None, texts[4], "en", "a", 0), (7, texts[5], "en", "a", 0), (8, texts[5], "en", "a", 0)]
    kept = rows_of(sim.drop_near_duplicates(spark.createDataFrame(rows, DOCS)))
    assert sorted(((r[0], texts.index(r[1])) for r in kept), key=repr) == [(5, 2), (5, 3), (6, 4), (7, 5), (None, 0), (None, 1)]


@pytest.mark.parametrize("pair_bucket", [0, 4, 32])
def test_similar_texts_meet_in_crowded_buckets(spark, monkeypatch, pair_bucket):
    monkeypatch.setattr(sim, "PAIR_BUCKET", pair_bucket)
    rng = random.Random(23)
    rows, base = [], some_text(rng, 200, 10**5)
    for i in range(300):
        w = base.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, some_text(rng, rng.randint(1, 200), 10**5)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in sim.drop_near_duplicates(df).collect()) == brute_kept(rows)


@pytest.mark.parametrize("pair_bucket", [4, 32])
def test_near_copies_in_a_template_family_meet(spark, monkeypatch, pair_bucket):
    """Texts of one template, about 0.7 alike, fail on each other as hubs; the near copies among them are found all the same."""
    monkeypatch.setattr(sim, "PAIR_BUCKET", pair_bucket)
    rng = random.Random(29)
    template, rows = some_text(rng, 166, 10**6), []
    for i in range(240):
        own = some_text(rng, 34, 10**6)
        rows += [(i, f"{template} {own}"), (1000 + i, f"{template} {own} end{i}")][: 1 + i % 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(brute_kept(rows))
    assert len(expected) == 240
    assert sorted(r["doc_id"] for r in sim.drop_near_duplicates(df).collect()) == expected


def test_a_large_family_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Texts near one middle text, which miss each other's similarity, meet that text."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        words = list(base)
        for at in (rng.randrange(150) for _ in range(3)):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    seen = []
    compared = sim.compared

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(sim, "compared", counted)
    monkeypatch.setattr(sim, "PAIR_BUCKET", 4)
    kept = rows_of(sim.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id"))
    assert len(kept) < 5
    assert sum(seen) < 4 * len(rows), seen


def test_recall_of_near_copies(spark):
    """Pairs at Jaccard similarities from 0.8 upward, by words changed and by words added; and none below."""
    rng = random.Random(24)
    rows = []
    for i in range(400):
        w = some_text(rng, rng.randint(50, 400), 10**6).split()
        rows.append((2 * i, " ".join(w)))
        if i % 2:
            for at in rng.sample(range(len(w)), max(1, len(w) // rng.choice((45, 60, 100)))):
                w[at] = "changed"
        else:
            w += some_text(rng, int(len(w) * rng.choice((0.05, 0.15, 0.24, 0.3))), 10**6).split()
        rows.append((2 * i + 1, " ".join(w)))
    roots = brute_near([t for _, t in rows])
    near = {i for i, root in enumerate(roots) if i != root}
    kept = {r["doc_id"] for r in sim.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = set(range(800)) - kept
    assert len(near) > 200 and gone <= near and len(gone) >= 0.95 * len(near)


def test_rings_equal_plain_sums():
    rng = np.random.default_rng(25)
    counts = [0, 3, 300, 1, 0, 700]
    starts = np.concatenate(([0], np.cumsum(counts)))
    hashes = rng.integers(0, 1 << 63, starts[-1], dtype=np.int64).astype(np.uint64)
    got = sim.rings_of(hashes, starts, 3)
    for i, n in enumerate(counts):
        for j in range(3):
            h = sim.mixed(hashes[starts[i] : starts[i + 1]] + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).tolist()
            assert int(got[i, j]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


@pytest.mark.parametrize("budget", [0, 1, 3, 7, 8, 12, 20])
def test_near_links_of_any_budget(spark, budget):
    rng = random.Random(16)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for f in fps[:20]:
        for _ in range(3):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 22))))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = {tuple(sorted((u % (1 << 64), v % (1 << 64)))) for u, v in sim.near_links(df, budget).collect()}
    assert links == {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= budget}
    with pytest.raises(ValueError):
        sim.near_links(df, 64)


# 6 -----------------------------------------------------------------------


def page(body, tail="</body></html>"):
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}{tail}'


def text_of_page(html):
    return " ".join(t for _, t, role in sst.blocks_of(html) if role == 2)


def test_blocks():
    body = '<nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">buy</div><article><h1>A &lt; B</h1><p><b>One\n two<br><p>Th<i>ree</i> &am &eacute;</p><aside>side</aside><form>f</form><section class="comments"><p>nice</p></section><ul><li>a<li>b</ul></article><footer>&copy;</footer>'
    assert text_of_page(page(body)) == text_of_page(page(body, "")) == "A < B One two Three &am é a b"
    assert text_of_page("") == "" and sst.host_of("https://u@Www.Ex.org:80/a") == "www.ex.org" and sst.host_of(None) == ""
    assert text_of_page(page("<article><p>a < b > c</p><script>x</script><p>d</p></article>")) == "a < b > c d"


def test_words_of_a_wrapper_do_not_hide_the_only_article():
    article = "<article class='tags'><h1>Title</h1><p>one</p><div class='social'>share</div><aside>side</aside></article>"
    assert text_of_page(page(f"<nav>menu</nav><div class='layout has sidebar'><div>{article}</div><p>more</p></div>")) == "Title one"
    assert text_of_page(page(f"<main><p>own</p></main><div class='sidebar'>{article}</div>")) == "own"
    assert text_of_page(page(f"<aside>{article}</aside><p>rest</p>")) == ""


def test_main_text_uses_the_style_tree_where_markup_is_silent(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<div class='x'>Same line here</div><div class='y'><p>own text {i}</p></div>")) for i in range(6)]
    rows += [(10, "http://g.example/1", page("<article><p>only</p></article><div>rest</div>")), (11, None, None), (12, "", ""), (10, "http://g.example/1", page("<article><p>only</p></article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "path": F.lit("x"), "text": F.lit("y")})
    got = sst.main_text(df).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted([(i, f"own text {i}", 10) for i in range(6)] + [(10, "only", 4)] * 2 + [(11, "", 0), (12, "", 0)])
    assert sst.main_text(df.limit(0)).count() == 0


def test_hyphenated_names_and_titles_stay():
    assert text_of_page(page("<article><header class='entry-header'><h1>Title</h1></header><div class='article-header'><p>one</p></div><div class='side-note'>two</div><div class='share-buttons'>x</div></article>")) == "Title one two"
    assert [sst.names_noise(x) for x in ("sidebar", "cookie-banner", "site_header", "side-note", "article-header", "has-sidebar", "ad-slot", "box")] == [True, True, True, False, False, False, True, False]


def test_a_story_beside_a_teaser_is_kept(spark):
    story = " ".join(["word"] * 80)
    rows = [(1, "http://a.example/1", page(f"<nav>m</nav><div id='content'><p>{story}</p></div><article><p>teaser text</p></article>"))]
    rows += [(2, "http://a.example/2", page(f"<article><p>{story}</p></article><div><p>more to read</p></div>"))]
    got = {r["page_id"]: r["text"] for r in sst.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"{story} teaser text", 2: story}


def test_the_tree_removes_what_repeats_inside_articles(spark):
    rng = random.Random(20)
    rows = []
    for i in range(30):
        paragraphs = "".join(f"<p>{some_text(rng, 9)}</p>" for _ in range(rng.randint(1, 6)))
        rows.append((i, f"http://b.example/{i}", page(f"<article>{paragraphs}<p class='end'>Read on at our site</p></article>")))
    rows += [(100 + i, "http://b.example/0", rows[0][2]) for i in range(30)]  # copies say nothing about the design
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    plain = {r["page_id"]: r["text"] for r in sst.main_text(df).collect()}
    assert plain == {r["page_id"]: r["text"] for r in sst.main_text(df, max_nodes=0).collect()}
    assert all(t and "Read on" not in t for t in plain.values()) and plain[0] == plain[100]
    # entropies against a plain count
    tree = {(r["host"], r["path"]): r for r in sst.style_tree(sst.parsed(df)).collect()}
    blocks = [sst.blocks_of(h) for _, _, h in rows[:30]]

    def entropy(values):
        n = len(values)
        return -sum(c / n * np.log(c / n) for c in (values.count(x) for x in set(values))) / np.log(n)

    for path in {p for b in blocks for p, _, _ in b}:
        texts = [x for b in blocks for x in {t for p, t, _ in b if p == path}]
        children = [dict(sst.child_sequences([p for p, _, _ in b]))[path.rpartition("/")[0]] for b in blocks]
        r = tree["b.example", path]
        assert (r["content"], r["presentation"], r["pages"]) == pytest.approx((entropy(texts), entropy(children), 30))


def entropy_of(values):
    n = len(values)
    return -sum(c / n * np.log(c / n) for c in (values.count(x) for x in set(values))) / np.log(n) if n > 1 else 1.0


def brute_main_text(pages):
    """page_id to text: every node's entropies and every block's log odds counted out on lists."""
    parsed = [(i, sst.host_of(u), sst.blocks_of(h or "")) for i, u, h in pages]
    evidence = {}
    for host in {h for _, h, _ in parsed}:
        unique = {tuple((p, t) for p, t, _ in b) for _, h, b in parsed if h == host and b}
        trees = [dict(sst.child_sequences([p for p, _ in b])) for b in unique]
        for path in {p for b in unique for p, _ in b}:
            texts = [t for b in unique for t in {t for p, t in b if p == path}]
            children = [x[path.rpartition("/")[0]] for x in trees if path.rpartition("/")[0] in x]
            if len(children) >= sst.LEAST_PAGES:
                evidence[host, path] = 2.5 * (2 * entropy_of(texts) - 1) + 2 * entropy_of(children) - 1
    out = {}
    for i, host, blocks in parsed:
        main = sum(len(t) for _, t, role in blocks if role == 2)
        kept = []
        for path, text, role in blocks:
            prior = {0: -4.0, 1: 0.0, 2: 1.4, 3: -1.5}[role]
            if role == 1 and main:
                own = sum(len(t) for p, t, r in blocks if r == 1 and p.rpartition("/")[0] == path.rpartition("/")[0])
                prior = min(1.4, max(-4.0, np.log(own / main) - 0.5))
            if prior + evidence.get((host, path), 0) >= 0:
                kept.append(text)
        out[i] = " ".join(kept)
    return out


def test_the_host_decides_on_teasers_quotes_and_repeated_blocks(spark):
    rng = random.Random(33)
    rows = []
    for i in range(12):  # a story beside a teaser that is as long, a quote and a notice with names of noise, a rail that repeats
        story = "".join(f"<p>{some_text(rng, 12)}</p>" for _ in range(rng.randint(2, 5)))
        quote = f"<blockquote class='notice'>quoted {some_text(rng, 8)}</blockquote>" if i % 3 else ""
        kind = f"<main><p>teaser {some_text(rng, 40)}</p>{quote}<div class='promo'>Half price now</div><div class='comments'>said {i}</div></main>"
        rows.append((i, f"http://t.example/{i}", page(f"<nav>menu</nav>{kind}<div class='body'>{story}</div><div class='again'><p>{'The same words on every page ' * 20}</p></div>")))
    rows += [(50, "http://lone.example/1", page(f"<article><p>{'short teaser of fifteen words ' * 3}</p></article><div><p>{'a story of some length here ' * 9}</p></div>"))]
    rows += [(51, "http://lone.example/2", page(f"<article><p>{'the long story itself ' * 400}</p></article><div class='latest'>other headline</div>"))]
    rows += [(52, "http://long.example/2", page(f"<article>{'<p>one more part</p>' * 20000}</article>")), (53, "http://long.example/3", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in sst.main_text(df).collect()}
    assert got == brute_main_text(rows)
    for i in range(12):
        assert "w" in got[i] and "The same words" not in got[i] and "Half price" not in got[i] and "said" not in got[i]
        assert all(t in got[i] for _, t, role in sst.blocks_of(rows[i][2]) if role == 1 and "The same" not in t)  # the whole story
        assert ("quoted" in got[i]) == bool(i % 3)
    assert "story of some length" in got[50] and "teaser" in got[50] and "headline" not in got[51] and len(got[52]) == 20000 * 14 - 1 and got[53] == ""


# 7 -----------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark, odd, empty):
    rng = random.Random(8)
    rows = odd_rows()[:3] + odd_rows()[4:9]
    rows += [(i, some_text(rng, rng.choice((5, 20, 80, 300))), "en", rng.choice(["a", "b", "c", "d", None, "Z", "é"]) if i % 3 else "a", 0) for i in range(100, 1500)]
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash"))
    got = mx.mixture(df).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in rows), key=repr)
    sizes, taken, targets, where = {}, {}, {}, {}
    for i, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
        where[i] = s
    for r in got:
        s = where[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        targets[s] = r["target"]
        assert r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    for s, t in brute_targets(sizes).items():
        assert targets[s] == pytest.approx(t) and abs(taken[s] - t) <= 0.02 * t + 20, (s, taken[s], t)
    assert sorted(map(tuple, got), key=repr) == sorted(rows_of(mx.mixture(df.repartition(7))), key=repr)
    assert mx.mixture(empty).count() == 0
    mixed = mx.mix_documents(df)
    assert mixed.columns == df.columns
    copies = {r["doc_id"]: (r["taken"] // r["size"] if r["size"] else 1) for r in got}
    assert mixed.where("doc_id = 200").count() == copies[200] and mixed.where("doc_id = 7").count() == 2 * copies[7]


# 8 -----------------------------------------------------------------------


def test_toxicity_learns_from_positives_and_unlabelled(spark, odd, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(2000):
        bad = rng.random() < 0.2
        text = some_text(rng, rng.randint(5, 80), 3000)
        if bad:
            text += " " + " ".join(rng.choice(["vile", "nasty", "awful"]) for _ in range(2)) + "!"
        rows.append((i, text, "en", "a", 0))
        if rng.random() < 0.5:
            labels.append((i, 1, int(bad)))
    truth = {i: any(w in t for w in ("vile", "nasty", "awful")) for i, t, *_ in rows}
    df, lab = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(9)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tox.toxicity(df, lab).collect()
    assert len(got) == 2000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert tox.drop_toxic(df, lab).columns == df.columns
    assert {r["doc_id"] for r in tox.drop_toxic(df, lab).collect()} == {r["doc_id"] for r in got if not r["predicted"]}
    strange = tox.toxicity(odd, lab).collect()
    assert len(strange) == odd.count() and len({r["score"] for r in strange if r["doc_id"] in (1, 2, 3)}) == 1
    assert tox.toxicity(empty, lab.limit(0)).count() == 0
    assert tox.toxicity(df.limit(3), lab.limit(0)).first()["score"] == pytest.approx(tox.DEFAULT_PRIOR)


def plain_risk(positives, unlabelled, prior, w, bias):
    def margin(row):
        return bias + sum(w[i] for i in row)

    def loss(z):
        return np.log1p(np.exp(-z))

    r_pos = prior * np.mean([loss(margin(x)) for x in positives])
    r_neg = np.mean([loss(-margin(x)) for x in unlabelled]) - prior * np.mean([loss(-margin(x)) for x in positives])
    return r_pos, r_neg


def test_risk_and_gradient_equal_the_plain_ones():
    rng = random.Random(12)
    for prior in (0.05, 0.9):  # with the large prior the negatives' risk falls below zero
        rows = [[np.array(sorted(rng.sample(range(6), rng.randint(0, 4))), np.int32) for _ in range(n)] for n in (7, 11)]
        w, bias = np.array([rng.uniform(0.5, 2) for _ in range(6)]), -0.3
        own = tuple(np.repeat(np.arange(len(x)), [len(r) for r in x]) for x in rows)
        flat = tuple(np.concatenate(x) for x in rows)
        r_pos, r_neg, grad, grad_b = tox.risk(own, flat, (7, 11), prior, w, bias)
        assert (r_pos, r_neg) == pytest.approx(plain_risk(*rows, prior, w, bias)) and (r_neg < 0) == (prior == 0.9)

        def followed(w, bias, rows=rows, prior=prior, below=r_neg < 0):
            a, b = plain_risk(*rows, prior, w, bias)
            return -b if below else a + b

        step = 1e-6
        for i in range(7):
            dw, db = (np.eye(6)[i] * step, 0) if i < 6 else (np.zeros(6), step)
            slope = (followed(w + dw, bias + db) - followed(w - dw, bias - db)) / (2 * step)
            assert slope == pytest.approx(grad_b if i == 6 else grad[i], abs=1e-6)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = [(i, f"some words {'bad' if i % 4 == 0 else 'good'} {i}", "en", "a", 0) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    two = [(i, 1, 1 - t if held(i) else t) for i, _, t in one]
    a, b = (sorted(rows_of(tox.toxicity(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")))) for x in (one, two))
    assert a == b


# 9 -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_encode_like_whole_texts(tokenizer):
    import public_tokenizers

    coder = tok.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(10)
    texts = ["", " ", "  a", "a ", "don't  stop\n now", "x<|endoftext|>y z", "é  ñ ​ b 　c \x85 d \x1c e"]
    texts += ["".join(rng.choice("ab 1.'s\n\té  ​  ,") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [" ".join(rng.choice(("ab", "don't", "x.\nAb", "q,", "1.5", "\n", "", "é!")) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in coder.encode(texts)] == want
    coder.by_piece = False
    assert [x.tolist() for x in coder.encode(texts)] == want


def test_only_a_known_rule_is_coded_by_pieces(tokenizer):
    import json

    rule = json.loads(tokenizer.to_str())
    assert tok.splits_at_spaces(rule)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": rule["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": {"type": "Unigram"}}):
        assert not tok.splits_at_spaces(rule | change)


def test_token_files(spark, odd, empty, tokenizer):
    import public_tokenizers

    got = rows_of(tok.tokenised(odd))
    ordered = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, t, *_ in ordered:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    path = new_path(spark, "t")
    tok.write_tokens(spark.createDataFrame([(1, "hello world")], "doc_id int, text string"), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.read_tokens(spark, path).first()["ids"] == [*tokenizer.encode("hello world").ids, 0]
    assert tok.tokenised(empty).count() == 0


# 10 ----------------------------------------------------------------------


def test_differencing_is_tighter_than_greedy():
    rng = random.Random(11)
    sizes = [rng.randint(1, 10**6) for _ in range(800)]
    parts = sh.differencing(sizes, 16)
    loads, greedy = [0] * 16, [0] * 16
    for s, p in zip(sizes, parts):
        loads[p] += s
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert max(loads) - min(loads) < max(greedy) - min(greedy)
    assert sh.differencing([], 4) == [] and sorted(sh.differencing([5, 5], 2)) == [0, 1]


def test_sharding(spark, odd, empty):
    rng = random.Random(12)
    rows = odd_rows() + [(i, some_text(rng, rng.randint(1, 200)) if i % 5 else "copy of a text", "en", "a", 0) for i in range(100, 3000)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("clash"), "shard": F.lit(0)})
    got = sh.shard_documents(df).collect()
    sizes = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sizes
    loads, slots, shard_of = [0] * 16, {}, {}
    for r in got:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert shard_of.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    others = sorted(loads)[:-2]  # one text is repeated and long, so its shard is larger
    assert max(others) - min(others) < 0.01 * sum(loads)
    assert sorted(map(tuple, got), key=repr) == sorted(rows_of(sh.shard_documents(df.repartition(5))), key=repr)
    assert sh.shard_documents(empty).count() == 0


# pipeline ----------------------------------------------------------------


def test_unique_rows(spark, odd):
    assert sorted((r["doc_id"] for r in unique_rows(odd).collect()), key=repr) == sorted({r[0] for r in odd_rows()}, key=repr)


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    clash = odd.withColumns({c: F.lit("x") for c in ("row", "hub", "score", "size", "copies", "digest", "range", "h")})
    for docs in (odd, empty, clash):
        kept = docs
        for name, stage in cp.STAGES[:-1]:
            got = stage(spark, kept, sf)
            assert got.columns == docs.columns, name
            path = new_path(spark, name)
            got.write.parquet(path)
            kept = spark.read.parquet(path)
        last = cp.STAGES[-1][1](spark, kept, sf)
        assert last.count() == kept.count()
    # of the odd rows: empty texts are one, the two long texts are one, the texts of three words that differ in case and space are one
    near = sorted((r["doc_id"] for r in cp.near_duplicates(spark, odd, sf).collect()), key=repr)
    assert near == sorted([1, 4, 5, 9, None], key=repr)


def test_pipeline_stages_equal_brute_force(spark, tokenizer):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.collect()]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = new_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
    ids = [sorted(r["doc_id"] for r in rows) for rows in kept]
    toxic = {r["doc_id"] for r in tox.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert ids[1] == [i for i in ids[0] if i not in toxic]
    assert ids[2] == sorted(brute_kept([(r["doc_id"], r["text"]) for r in kept[1]]))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute_contamination([tuple(r) for r in kept[2]], items) if r[5]}
    assert ids[3] == [i for i in ids[2] if i not in hit] and len(ids[3]) > 100
    sizes, taken = {}, {}
    for r in kept[3]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for r in kept[4]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    assert max(ids[4].count(i) for i in ids[4]) <= 2 and set(ids[4]) <= set(ids[3])
    for source, target in brute_targets(sizes).items():
        biggest = max(len(words(r["text"])) for r in kept[3] if r["source"] == source)
        assert abs(taken.get(source, 0) - target) <= biggest
    got = sorted(rows_of(cp.STAGES[-1][1](spark, docs, sf)), key=lambda r: r[1])
    codes = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in kept[4]}
    start = 0
    for i, (doc, at, n, crc) in zip(ids[4], got, strict=True):
        assert (doc, at, n, crc) == (i, start, len(codes[i]), zlib.crc32(np.array(codes[i], "<u4").tobytes()))
        start += n


def test_remembered_words_are_coded_as_the_library_does(monkeypatch):
    """Words with marks and line ends inside, at the beginning of texts too, while the memory for words overflows; as often as a word comes, it is coded once."""
    import public_tokenizers

    from topotide.llm import token_output

    monkeypatch.setattr(token_output, "CACHE_WORDS", 40)
    rng = random.Random(41)
    words = ["the", "Stop!", "don't", "a.b", "x\ny", "end.\nNew", "\u00fcber,", "\u6771\u4eac", "12,5", "'s", "\u00e9!?", "word\n'll", "\u0391\u03b2.", "a\nb\nc"] + [f"{some_text(rng, 1, 500)}{m}" for m in ("", ".", ",", "...", "\n?") for _ in range(20)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(200)] + ["", "x", "two  spaces", "a\n\nb", " lead", "<|endoftext|> as text"]
    coder = token_output.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for at in range(0, len(texts), 50):
        assert [x.tolist() for x in coder.encode(texts[at : at + 50])] == expected[at : at + 50]
    coded = []
    monkeypatch.setattr(coder, "whole", lambda some, whole=coder.whole: coded.extend(some) or whole(some))
    monkeypatch.setattr(coder, "chained", lambda some, spaced=True, chained=coder.chained: coded.extend((x, spaced) for x in some) or chained(some, spaced))
    coder.encode(["one two. three\nthree two one"] * 50)
    assert len(coded) == len(set(coded)) and ("two", True) in coded and "two." not in coded and not any("\n" in x[0] for x in coded)
