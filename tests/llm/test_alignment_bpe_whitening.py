"""Token alignment, word BPE and whitening against brute force on small tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from topotide.llm import alignment as al
from topotide.llm import blocks
from topotide.llm import whitening as wh
from topotide.llm import word_bpe as bpe
from topotide.llm.decontaminate import decontaminate
from topotide.llm.mixing import mix_documents
from topotide.llm.simhash import drop_near_duplicates
from topotide.llm.toxicity import drop_toxic

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD, PIECE = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "a  b<|endoftext|>c <|startoftext|><|endoftext|>x<|endoftext|", "J̌ İ ΑΣ don't I'LL it's 'S !!'s 12 ½ ² x y\u0085z​q　r", "é ́x\ńy", None, "", " \n\t", "\x00\x1c\x1fa", "漢字かな 🙂🙂 àÀÿÞ×÷ª",
    "été.'s été'S", "<|ENDOFTEXT|>", "x" * 3000, "ß ẞ ﬁ Ω Å", "'re're'", " lead", "trail ", "a▁b", "▁", "</s> <s> <unk> <0x41>", "a\n b\n\nc", "a \n b", "a b", "plain words, here. And There!!",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [("".join(rng.choice("abcdeéñß") for _ in range(rng.randrange(1, 9)))) + rng.choice(["", "", ".", ",", "!!"]) for _ in range(300)]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(60)] + [" ".join(rng.choice(words) for _ in range(20000))]
    out = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return out + [out[30], out[30], (None, "no id here", "en", "a", 1), (None, "no id here", "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    names = ["block", "keys", "words", "n_a", "ids", "code", "groups", "a.b", "place"]
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("x") for n in names}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def counted(df):
    return Counter(tuple(r) for r in df.collect())


# 11 ----------------------------------------------------------------------


def brute_alignment(rows):
    a_side, b_side = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_side.encode_special_tokens = True
    letter = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    found, counts = [], Counter()
    for doc_id, text, *_ in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        spell = ([bytes(letter[c] for c in a_side.id_to_token(i)) for i in a], [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b])
        if not text or any(b"".join(s) != (" " + text).encode() for s in spell):
            found.append((doc_id, None))
            continue
        spans = []
        for s in spell:
            ends = np.cumsum([len(x) for x in s])
            spans.append(list(zip([0, *ends[:-1].tolist()], ends.tolist())))
        links, first = [], 0
        for i, (x, y) in enumerate(spans[0]):
            while spans[1][first][1] <= x:
                first += 1
            j = first
            while j < len(b) and spans[1][j][0] < y:
                links.append((a[i], b[j]))
                j += 1
        counts.update(links)
        ends = [{y: k + 1 for k, (_, y) in enumerate(s)} for s in spans]
        groups, at = [], (0, 0)
        for e in sorted(ends[0].keys() & ends[1].keys()):
            upto = (ends[0][e], ends[1][e])
            groups.append(",".join(map(str, a[at[0] : upto[0]])) + "|" + ",".join(map(str, b[at[1] : upto[1]])))
            at = upto
        found.append((doc_id, (len(a), len(b), len(groups), links, ";".join(groups))))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return Counter(
        (i, 0, 0, 0, 0, 0, 0, "") if x is None else (i, x[0], x[1], x[2], len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for i, x in found
    )


def test_alignment_equals_brute_force(docs, rows, monkeypatch):
    want = brute_alignment(rows)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    assert counted(al.align(docs.select("doc_id", "text"), BYTE, PIECE).select(*columns, "groups")) == want
    digested = Counter({(*k[:-1], sha(k[-1]) if k[-1] else ""): n for k, n in want.items()})
    assert counted(al.alignments(docs).select(*columns, "groups_sha256")) == digested


def test_alignment_keeps_columns_and_empty_tables(docs, empty):
    out = al.align(docs.drop("n_a", "groups"), BYTE, PIECE)
    assert out.columns[: len(docs.columns) - 3] == [c for c in docs.columns if c not in ("text", "n_a", "groups")]
    assert {r["block"] for r in out.collect()} == {"x"} and {r["a.b"] for r in out.collect()} == {"x"}
    assert al.alignments(empty).count() == 0


def test_units_are_cut_only_at_safe_spaces():
    units, codes, counts = al.units_of(pa.array(["a b a", "", "a  b", " c", "b"]), True)
    assert [units[c] for c in codes] == ["a", "b", "a", "a  b", " c", "b"] and counts.tolist() == [3, 0, 1, 1, 1]
    units, codes, counts = al.units_of(pa.array(["a b", ""]), False)
    assert units == ["a b"] and counts.tolist() == [1, 0]


# 12 ----------------------------------------------------------------------


def test_word_bpe_equals_the_library(docs, rows, empty):
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.no_padding(), tokenizer.no_truncation()
    ids = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    coded = bpe.encode(docs.select("doc_id", "text"), WORD)
    assert counted(coded.select("doc_id", F.col("ids").cast("string"))) == Counter((i, "[" + ", ".join(map(str, x)) + "]") for i, x in ids)
    want = Counter((i, len(x), sha(" ".join(map(str, x))), sha(tokenizer.decode(x, skip_special_tokens=False))) for i, x in ids)
    assert counted(bpe.recoded(docs)) == want
    assert bpe.recoded(empty).count() == 0


def test_small_blocks_give_the_same_ids(docs, monkeypatch):
    whole = counted(bpe.encode(docs.select("doc_id", "text"), WORD).select("doc_id", F.col("ids").cast("string")))
    monkeypatch.setattr(blocks.slices, "__defaults__", (500,))
    assert [len(p) for p in blocks.slices(iter([pa.RecordBatch.from_pydict({"k": [1, 2, 3], "t": ["a" * 400, "b" * 200, "c" * 900]})]), 1)] == [1, 1, 1]
    assert counted(bpe.encode(docs.select("doc_id", "text"), WORD).select("doc_id", F.col("ids").cast("string"))) == whole


def test_decode_of_any_ids(spark):
    tokenizer = Tokenizer.from_file(WORD)
    lists = [(1, [1, 49407, 320, 1]), (2, []), (3, None), (4, [60000, 320]), (5, list(range(0, 49408, 7)))]
    got = {r["k.x"]: r["text"] for r in bpe.decode(spark.createDataFrame(lists, "k long, ids array<int>").withColumnRenamed("k", "k.x"), WORD, into="text").collect()}
    assert got == {k: tokenizer.decode(x or [], skip_special_tokens=False) for k, x in lists}
    byte = Tokenizer.from_file(BYTE)
    some = byte.encode("Ein Text, é und 漢字\n").ids
    assert bpe.decode(spark.createDataFrame([(1, some)], "k long, ids array<int>"), BYTE).first()["decoded"] == byte.decode(some, skip_special_tokens=False)


def test_words_of_single_letters_and_alphabet():
    rules = bpe.Words(WORD)
    whole = Tokenizer.from_file(WORD)
    pieces = [f"{a}{chr(c)}{b}" for c in range(1, 0x500) if chr(c) not in " " + bpe.CUTS for a, b in (("", ""), ("a", ""), ("a", "!"), ("é", "e"))]
    words, counts = rules.of_all(pa.array(pieces))
    at = 0
    for piece, n in zip(pieces, counts):
        assert [i for w in words[at : at + n] for i in rules.ids(w)] == whole.encode(piece, add_special_tokens=False).ids, piece
        at += n
    assert sorted(bpe.byte_alphabet()) == sorted(pre_tokenizers.ByteLevel.alphabet())
    with pytest.raises(ValueError, match="independently"):
        bpe.Words(BYTE)


# 13 ----------------------------------------------------------------------


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(3)
    for top in (1, 2, 1000, 1 << 45):
        y = rng.integers(0, top, size=(131, 5))
        sums, products = wh.scatter_of(y)
        exact = y.astype(object)
        assert (sums == exact.sum(axis=0)).all() and (np.triu(products) == np.triu(exact.T @ exact)).all()


def brute_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = (x - s / n)
    v = centred.T @ centred / n
    e, basis = np.linalg.eigh(v)
    order = np.argsort(-e)[:8]
    return n, (((n * x.astype(object) - s) ** 2).sum(axis=1)), centred @ basis[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.1).astype(np.float32)
    good = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(7, vectors[7].tolist()), (None, vectors[8].tolist())]
    bad = [(900, None), (901, [float("nan")] * 12), (902, [None] + [0.1] * 11), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "key": F.lit(2), "a.b": F.lit(3)}).repartition(5)
    out = wh.whitening(df).collect()
    n, deviation, want, explained = brute_whitening([v for _, v in good])
    assert len(out) == 8 * len(good) and {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-9
    signs = {}
    by_id = {i: k for k, (i, _) in enumerate(good)}
    for c in range(8):
        pairs = [(r.whitened, want[by_id[r.vec_id], c]) for r in out if r.component == c + 1]
        signs[c] = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a * signs[c] - b) for a, b in pairs) < 1e-9
    for r in out:
        assert r.deviation == r.deviation_exact == deviation[by_id[r.vec_id]] and abs(r.explained - explained[r.component - 1]) < 1e-9


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert wh.whitening(spark.createDataFrame([], kind)).count() == 0
    assert wh.whitening(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = wh.whitening(spark.createDataFrame([(1, [0.5, 0.25])], kind)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    flat = wh.whitening(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], kind)).collect()
    assert {r.component for r in flat if r.whitened is None} == {2, 3} and max(r.identity_error for r in flat) < 1e-9
    wide = wh.whitening(spark.createDataFrame([(i, [1e9 * i, -3e8 * i * i]) for i in range(8)], kind)).collect()
    assert max(r.identity_error for r in wide) < 1e-4 and any(r.deviation is None for r in wide)
    with pytest.raises(Exception, match="largest"):
        wh.whitening(spark.createDataFrame([(1, [1e30])], kind)).collect()


# columns of the pipeline's stages ----------------------------------------


def test_stages_return_clashing_columns_unchanged(spark):
    names = ["__k1", "__k2", "__text", "__s", "__z", "__words", "__hits", "__size", "a.b", "Text", "DOC_ID", "column_0"]
    rows = [(i, f"some words of document {i} that are its own, {i * 7} and {i * 13}", "en", "ab"[i % 2], 10, *["keep"] * len(names)) for i in range(6)]
    df = spark.createDataFrame(rows, [*DOCS.replace(" long", "").replace(" string", "").split(", "), *names])
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("i", "nothing of this kind")], "item_id string, text string")
    for out in (drop_toxic(df, labels), drop_near_duplicates(df), decontaminate(df, items), decontaminate(df, items, action="spans"), mix_documents(df)):
        assert out.columns == df.columns
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= set(rows)


def test_thinned_links_keep_components(spark):
    from topotide.llm.simhash import _thinned
    from topotide.operators.graphs import components

    rng = random.Random(9)
    links = {(rng.randrange(0, 40), rng.randrange(40, 120)) for _ in range(150)} | {(a, b) for a, b in ((0, 1), (1, 2), (3, 39))}
    df = spark.createDataFrame(sorted(links), "u long, v long")
    thin = _thinned(df)
    assert thin.count() <= len(links)
    assert sorted(map(tuple, components(thin).collect())) == sorted(map(tuple, components(df).collect()))
