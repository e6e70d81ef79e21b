"""Token alignment between two tokenizers, by bytes.

Both tokenizers encode a space and the text.  The tokens of some documents are
two tables (document, start); ``merge_asof`` by document finds for each start
of one side the token of the other that covers it, and both directions together
give every pair that overlaps.  Ends that both sides have cut the tokens into
groups.  How often two ids are linked is counted over all documents: each block
of documents sends its distinct id pairs, which meet the counts of the whole
corpus and return to the block.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.llm.blocks import lists, numbered, restored, single, slices, spread, squeezed, stored, with_parts
from topotide.llm.caches import hold, tidied
from topotide.llm.tables import plainly_named, table, text_of
from topotide.llm.token_output import _NOT_PLAIN, splits_at_spaces
from topotide.llm.word_bpe import byte_alphabet

#: Bytes of text of a block, and of the documents that are merged at a time.
BLOCK_BYTES, BATCH_BYTES = 3 << 20, 1 << 20
#: Words that are coded in one call.
CALL_WORDS = 2000

_sides: dict[tuple[str, str], tuple[ByteLevelSide, PieceSide]] = {}


class ByteLevelSide:
    """A byte-level BPE of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding(), self.tokenizer.no_truncation()
        #: Whether words that single spaces part are encoded independently.
        self.by_word = splits_at_spaces(json.loads(self.tokenizer.to_str()))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # an entry with letters outside the byte alphabet is an added token, which is never made
        self.bytes = pa.array([bytes(byte[c] for c in e) if all(c in byte for c in e) else b"" for e in entries], pa.binary())
        self.names = pa.array([str(i) for i in range(size)])

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text with a space before it."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide:
    """A sentencepiece model that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.binary())
        self.names = pa.array([str(i) for i in range(size)])
        # merges can't cross a space if no piece has one behind another letter
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def sides(a_path: str, b_path: str) -> tuple[ByteLevelSide, PieceSide]:
    hold("alignment", _sides.clear)
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = ByteLevelSide(a_path), PieceSide(b_path)
    return _sides[a_path, b_path]


def coded(side: ByteLevelSide | PieceSide, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of texts, flat."""
    ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(texts), CALL_WORDS):
        found = side.ids(texts[at : at + CALL_WORDS])
        lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter((i for x in found for i in x), np.int32, int(lengths[-1].sum())))
    return np.concatenate(ids), np.concatenate(lengths)


def units_of(texts: pa.Array, by_word: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(units, codes, counts): distinct parts of texts that are encoded independently, the parts of all texts in turn, and how many each text has.

    A text whose spaces all stand alone between visible characters is cut at
    them; another is one part, and an empty one has none.
    """
    plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN)) if by_word else pa.array(np.zeros(len(texts), bool))
    plain = pc.and_(plain, pc.greater(pc.binary_length(texts), 0))
    easy = plain.to_numpy(zero_copy_only=False)
    words = pc.split_pattern(texts.filter(plain), " ")
    table = words.flatten().dictionary_encode()
    counts = (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
    counts[easy] = np.diff(words.offsets.to_numpy())
    whole = texts.filter(pa.array(~easy & (counts > 0))).to_pylist()
    codes, of_words = np.empty(counts.sum(), np.int64), np.repeat(easy, counts)
    codes[of_words] = table.indices.to_numpy()
    codes[~of_words] = len(table.dictionary) + np.arange(len(whole))
    return table.dictionary.to_pylist() + whole, codes, counts


def covering(doc: np.ndarray, start: np.ndarray, other_doc: np.ndarray, other_start: np.ndarray) -> np.ndarray:
    """For each token, the index of the other side's token of the same document that covers its start."""
    left = pd.DataFrame({"doc": doc, "at": start})
    right = pd.DataFrame({"doc": other_doc, "at": other_start, "j": np.arange(len(other_doc))})
    return pd.merge_asof(left, right, on="at", by="doc")["j"].to_numpy(np.int64)


def links_of(doc_a: np.ndarray, ends_a: np.ndarray, doc_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): all pairs of tokens that overlap, given the ends of both sides' tokens in one row of bytes for all documents."""
    start_a, start_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    to_b = covering(doc_a, start_a, doc_b, start_b)
    to_a = covering(doc_b, start_b, doc_a, start_a)
    new = start_a[to_a] != start_b  # pairs that start together are found in both directions
    return np.concatenate((np.arange(len(ends_a)), to_a[new])), np.concatenate((to_b, np.flatnonzero(new)))


def _joined(names: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pc.binary_join(lists(names.take(pa.array(ids)), bounds), ",")


def aligned_batch(texts: pa.Array, a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray, side_a: ByteLevelSide, side_b: PieceSide) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """(keys, counts, groups) of some documents: the id pair of each link as one number, in the order of documents; n_a, n_b, n_groups and n_links; the groups as text.

    Documents whose tokens don't spell a space and the text have none.
    """
    n = len(texts)
    bytes_a, bytes_b = side_a.bytes.take(pa.array(a)), side_b.bytes.take(pa.array(b))
    spelt = []
    for found, counts in ((bytes_a, a_counts), (bytes_b, b_counts)):
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(found).to_numpy(), dtype=np.int64)))
        spelt.append((pc.binary_join(single(found), b"")[0].as_py() if len(found) else b"", ends[np.concatenate(([0], np.cumsum(counts)))].tolist()))
    (data_a, at_a), (data_b, at_b) = spelt
    right = np.zeros(n, bool)
    for i, text in enumerate(texts.to_pylist()):
        want = (" " + text).encode()
        right[i] = bool(text) and data_a[at_a[i] : at_a[i + 1]] == want and data_b[at_b[i] : at_b[i + 1]] == want
    del spelt, data_a, data_b
    keep_a, keep_b = np.repeat(right, a_counts), np.repeat(right, b_counts)
    a, b = a[keep_a], b[keep_b]
    doc_a, doc_b = np.repeat(np.arange(n), a_counts)[keep_a], np.repeat(np.arange(n), b_counts)[keep_b]
    if not len(a):
        none = np.zeros(n, np.int64)
        return np.zeros(0, np.int64), [none] * 4, pa.array([""] * n)
    ends_a = np.cumsum(pc.binary_length(bytes_a).to_numpy()[keep_a], dtype=np.int64)
    ends_b = np.cumsum(pc.binary_length(bytes_b).to_numpy()[keep_b], dtype=np.int64)
    i, j = links_of(doc_a, ends_a, doc_b, ends_b)
    order = np.argsort(doc_a[i], kind="stable")
    keys = a[i[order]].astype(np.int64) << 32 | b[j[order]]
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    cut_a, cut_b = (np.concatenate(([0], np.searchsorted(e, both) + 1)) for e in (ends_a, ends_b))
    each = pc.binary_join_element_wise(_joined(side_a.names, a, cut_a), _joined(side_b.names, b, cut_b), "|")
    n_groups = np.bincount(doc_a[cut_a[1:] - 1], minlength=n)
    groups = pc.binary_join(lists(each, np.concatenate(([0], np.cumsum(n_groups)))), ";")
    counts = [np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n), n_groups, np.bincount(doc_a[i], minlength=n)]
    return keys, counts, groups


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """(block, keys, n_a, n_b, n_groups, n_links, groups, a, b, n, links): blocks of documents, their distinct id pairs with counts, and the code of the pair of each link.

    keys holds the columns of ``docs`` other than the text as structs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(a_path, b_path)
        numbers = numbered()
        for part in slices(batches, 1, BLOCK_BYTES):
            texts = part.column(1)
            units, codes, counts = units_of(texts, side_a.by_word and side_b.by_word)
            ids_a, lengths_a = coded(side_a, units)
            ids_b, lengths_b = coded(side_b, units)
            del units
            at = np.concatenate(([0], np.cumsum(counts)))
            keys, numbers_of, groups = [np.zeros(0, np.int64)], [], []
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + BATCH_BYTES, "right")))
                some, own = codes[at[low] : at[high]], at[low : high + 1] - at[low]
                index_a, ends_a = spread(some, lengths_a)
                index_b, ends_b = spread(some, lengths_b)
                k, n, g = aligned_batch(texts.slice(low, high - low), ids_a[index_a], np.diff(ends_a[own]), ids_b[index_b], np.diff(ends_b[own]), side_a, side_b)
                keys.append(k), numbers_of.append(n), groups.append(g)
                low = high
            links, pairs = pd.factorize(np.concatenate(keys))
            del keys
            columns = [pa.array([next(numbers)], pa.int64()), single(part.column(0))]
            columns += [single(pa.array(np.concatenate([n[i] for n in numbers_of]), pa.int64())) for i in range(4)]
            columns += [single(pa.concat_arrays(groups)), single(pa.array(pairs >> 32, pa.int32())), single(pa.array(pairs & 0xFFFFFFFF, pa.int32()))]
            columns += [single(pa.array(np.bincount(links, minlength=len(pairs)), pa.int64())), pa.array([squeezed(links)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "keys", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "n", "links"])

    slim = docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c != text]).alias("key"), text_of(f"`{text}`").alias("text"))
    longs = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    return slim.mapInArrow(tidied(run), f"block long, keys array<{slim.schema['key'].dataType.simpleString()}>, {longs}, groups array<string>, a array<int>, b array<int>, n array<long>, links binary")


def id_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best) of all id pairs that are linked somewhere; best where no other a is linked with b more often."""
    each = blocks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("count"))
    highest = each.groupBy(F.col("b").alias("of")).agg(F.max("count").alias("most"))
    return each.join(highest, F.col("b") == F.col("of")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", groups: Callable[[Column], Column] = lambda g: g) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups in place of the text.

    groups is the text `a1,a2|b1;a3|b2,b3`, or what ``groups`` makes of it.
    n_best counts links whose id pair has the highest count of its b in the
    corpus, ties included, and count_sum adds up the counts of the links'
    pairs.  A text that is null, empty, or isn't spelt by both sides' tokens
    has zeros and no groups.  Very long texts are aligned whole; repeated rows
    count as often as they come; an empty table gives no rows.  Other columns
    return unchanged, whatever their names.
    """
    names = [c for c in docs.columns if c != text]
    made = aligned_blocks(plainly_named(docs, text), a_path, b_path, text)
    blocks = stored(made.withColumn("groups", F.transform("groups", groups)), "aligned_blocks")
    zipped = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("code", "x")).select("block", "code", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    scored = zipped.join(id_pairs(blocks), ["a", "b"]).select("block", "code", (F.col("count") * 2 + F.col("best").cast("long")).alias("score"))
    both = with_parts(blocks.drop("a", "b", "n"), scored)
    key = blocks.schema["keys"].dataType.elementType.simpleString()
    kind = blocks.schema["groups"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, *numbers, made_groups = (batch.column(i)[row].values for i in range(6))
                links = restored(batch.column(6)[row].as_py())
                parts = batch.column(7)[row].values
                score = np.full(int(links.max()) + 1 if len(links) else 0, -1, np.int64)
                if parts is not None:
                    score[parts.field(0).to_numpy()] = parts.field(1).to_numpy()
                if (score < 0).any():
                    raise ValueError("a block's id pairs have not all come back")
                ends = np.concatenate(([0], np.cumsum(numbers[3].to_numpy())))
                each = score[links]
                sums = [np.concatenate(([0], np.cumsum(x)))[ends] for x in (each & 1, each >> 1)]
                columns = [keys, *numbers, *[pa.array(np.diff(s), pa.int64()) for s in sums], made_groups]
                whole = pa.RecordBatch.from_arrays(columns, ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
                yield from (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096))

    longs = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    ordered = both.select("keys", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "parts")
    numbers = [c.split()[0] for c in longs.split(", ")]
    return ordered.mapInArrow(tidied(run), f"key {key}, {longs}, groups {kind}").select("key.*", *numbers, "groups").toDF(*names, *numbers, "groups")


def alignments(docs: DataFrame) -> DataFrame:
    """Query rows: doc_id, the numbers of ``align``, and groups_sha256, the empty text where there are no tokens.

    Nulls, empty and long texts, repeated rows and empty tables are as in
    ``align``; a null doc_id stays null.  Other columns are not read, whatever
    their names.
    """
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = align(docs.select("doc_id", "text"), *paths, groups=lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)))
    return out.withColumnRenamed("groups", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
