"""BPE encoding and decoding through tables of distinct words and ids.

Encoding: documents are split into normalised words in blocks.  The distinct
words of each block are dealt and sorted by word, which makes them one table of
distinct words, and each is encoded once; the ids go back to the places of the
words.  Decoding: the distinct ids of some documents are joined with the table
of ids and pieces, and the pieces are set at their places.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.llm.blocks import lists, numbered, ranked, restored, single, slices, spread, squeezed, stored, with_parts
from topotide.llm.caches import hold, tidied
from topotide.llm.tables import plainly_named, table, text_of

#: Bytes of text that are split at a time.
SPLIT_BYTES = 2 << 20
#: Words that a task encodes before it sends their ids on, and ids that are decoded at a time.
ENCODE_ROWS, DECODE_IDS = 1 << 18, 1 << 20
#: White space at which texts are cut before the tokenizer's own rules see them; any other is left to those rules.
CUTS = "\t\n\x0b\x0c\r"
#: ASCII marks, and words of unaccented and Latin-1 letters with marks behind them, which every rule treats alike.
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
PLAIN = r"\A[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+[!-/:-@\[-`{-~]*\z"

_loaded: dict[str, Words] = {}


def byte_alphabet() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in printable}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


def splits_into_words(description: dict) -> bool:
    """Whether a tokenizer's file says that white space, wherever it stands, parts a text into pieces that are normalised and encoded independently."""
    normal = (description.get("normalizer") or {}).get("normalizers") or []
    before = (description.get("pre_tokenizer") or {}).get("pretokenizers") or []
    added = description.get("added_tokens") or []
    return (
        [x.get("type") for x in normal] == ["NFC", "Replace", "Lowercase"]
        and normal[1].get("pattern") == {"Regex": r"\s+"}
        and normal[1].get("content") == " "
        and [x.get("type") for x in before] == ["Split", "ByteLevel"]
        and before[0].get("behavior") == "Removed"
        and before[0].get("invert") is True
        and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in before[0].get("pattern", {}).get("Regex", "")
        and before[1].get("add_prefix_space") is False
        and before[1].get("use_regex") is False
        and (description.get("model") or {}).get("type") == "BPE"
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added)
    )


class Words:
    """A tokenizer file's rules for words, and its model for their ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if not splits_into_words(json.loads(tokenizer.to_str())):
            raise ValueError(f"{path} doesn't describe a tokenizer that encodes words independently")
        self.normal, self.before, self.model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.letters = dict(enumerate(byte_alphabet()))

    def of(self, piece: str) -> list[str]:
        """The words of a piece of text by the tokenizer's own rules, in its byte alphabet; an added token is a word of its own."""
        out: list[str] = []
        for part in self.cut.split(piece) if self.cut else [piece]:
            out += [part] if part in self.special else [w for w, _ in self.before.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def of_all(self, pieces: pa.Array) -> tuple[list[str], np.ndarray]:
        """(words, counts): the words of all pieces in turn, and how many each has."""
        plain = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False).tolist()
        cores = pc.utf8_lower(pc.utf8_rtrim(pieces, MARKS)).to_pylist()
        words: list[str] = []
        counts = np.empty(len(pieces), np.int64)
        for i, (piece, easy, core) in enumerate(zip(pieces.to_pylist(), plain, cores)):
            at = len(words)
            if easy:
                words.append(core if core.isascii() else core.encode().decode("latin-1").translate(self.letters))
                if len(core) < len(piece):
                    words.append(piece[len(core) :])
            elif piece:
                words += self.of(piece)
            counts[i] = len(words) - at
        return words, counts

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.model.tokenize(word)]


def words_of(path: str) -> Words:
    hold("words", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def split(texts: pa.Array, rules: Words) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, codes, lengths): distinct words of some texts, the word of each place, and how many places each text has."""
    for c in CUTS:
        texts = pc.replace_substring(texts, c, " ")
    pieces = pc.split_pattern(texts, " ")
    coded = pieces.flatten().dictionary_encode()
    words, counts = rules.of_all(coded.dictionary)
    table = pa.array(words, pa.string()).dictionary_encode()
    index, ends = spread(coded.indices.to_numpy(), counts)
    offsets = pieces.offsets.to_numpy()
    return table.dictionary, table.indices.to_numpy()[index], np.diff(ends[offsets - offsets[0]])


def word_blocks(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """(block, keys, lengths, words, places): blocks of documents as distinct words and the codes of their places.

    keys holds the columns of ``docs`` other than the text as structs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, numbers = words_of(tokenizer_path), numbered()
        for part in slices(batches, 1):
            tables, codes, lengths = [], [], []
            for some in slices(iter([part]), 1, SPLIT_BYTES):
                own, found, n = split(some.column(1), rules)
                codes.append(found + sum(map(len, tables))), tables.append(own), lengths.append(n)
            table = pa.concat_arrays(tables).dictionary_encode()
            del tables
            order, places = ranked(table.indices.to_numpy()[np.concatenate(codes)], len(table.dictionary))
            columns = [pa.array([next(numbers)], pa.int64()), single(part.column(0)), single(pa.array(np.concatenate(lengths), pa.int32())), single(table.dictionary.take(pa.array(order)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([squeezed(places)], pa.binary())], ["block", "keys", "lengths", "words", "places"])

    slim = docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c != text]).alias("key"), text_of(f"`{text}`").alias("text"))
    return slim.mapInArrow(tidied(run), f"block long, keys array<{slim.schema['key'].dataType.simpleString()}>, lengths array<int>, words array<string>, places binary")


def encoded_words(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """(block, codes, counts, ids): the ids of the words (block, code, word), gathered by block as far as they meet in a task.

    Rows are dealt and sorted by word, so that each distinct word is one run
    and is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = words_of(tokenizer_path)
        last, last_ids = None, np.zeros(0, "<u4")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            block, code, counts = (np.concatenate([h[i] for h in held]) for i in range(3))
            ids = np.concatenate([h[3] for h in held])
            order = np.lexsort((code, block))
            index, _ = spread(order, counts)
            block, code, counts, ids = block[order], code[order], counts[order], ids[index]
            firsts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            bounds, at = [*firsts.tolist(), len(block)], np.concatenate(([0], np.cumsum(counts)))
            cut = list(zip(bounds, bounds[1:]))
            columns = [[squeezed(np.diff(code[a:b], prepend=0)) for a, b in cut], [squeezed(counts[a:b]) for a, b in cut], [squeezed(ids[at[a] : at[b]]) for a, b in cut]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(block[firsts], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["block", "codes", "counts", "ids"])

        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            found = [last_ids if w == last else np.array(rules.ids(w), "<u4") for w in distinct]
            if distinct:
                last, last_ids = distinct[-1], found[-1]
                lengths = np.array(list(map(len, found)), np.int64)
                codes = coded.indices.to_numpy()
                index, _ = spread(codes, lengths)
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), lengths[codes], np.concatenate(found)[index]))
            if sum(len(h[0]) for h in held) >= ENCODE_ROWS:
                yield sent()
        if held:
            yield sent()

    dealt = words.select("block", "code", "word").repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(tidied(run), "block long, codes binary, counts binary, ids binary")


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of int) in place of the text.

    A null text counts as empty and has no ids; very long texts are coded
    whole, as a block of their own; rows that repeat are documents like others;
    an empty table gives no rows.  Other columns, ids aside, return unchanged,
    whatever their names.
    """
    names = [c for c in docs.columns if c != text]
    blocks = stored(word_blocks(plainly_named(docs, text), tokenizer_path, text), "word_blocks")
    words = blocks.select("block", F.posexplode("words").alias("code", "word"))
    both = with_parts(blocks.drop("words"), encoded_words(words, tokenizer_path))
    key = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys = batch.column(0)[row].values
                ends = np.concatenate(([0], np.cumsum(batch.column(1)[row].values.to_numpy())))
                places = restored(batch.column(2)[row].as_py())
                parts = batch.column(3)[row].as_py() or []
                code, counts, ids = (np.concatenate([np.zeros(0, "<u4"), *x]).astype(np.int64) for x in ([np.cumsum(restored(p["codes"])) for p in parts], [restored(p["counts"]) for p in parts], [restored(p["ids"]) for p in parts]))
                del parts
                order = np.argsort(code)
                if len(code) and (code[order] != np.arange(len(code))).any():
                    raise ValueError("a block's words have not all come back")
                index, _ = spread(order, counts)
                table, lengths = ids[index].astype(np.int32), counts[order]
                step = 0
                while step < len(keys):  # documents of up to a million places at a time, or one
                    upto = max(step + 1, int(np.searchsorted(ends, ends[step] + DECODE_IDS, "right")) - 1)
                    index, bounds = spread(places[ends[step] : ends[upto]], lengths)
                    yield pa.RecordBatch.from_arrays([keys[step:upto], lists(pa.array(table[index]), bounds[ends[step : upto + 1] - ends[step]])], ["key", "ids"])
                    step = upto

    made = both.select("keys", "lengths", "places", "parts").mapInArrow(tidied(run), f"key {key}, ids array<int>")
    return made.select("key.*", "ids").toDF(*names, "ids")


def vocabulary(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """(id, piece) of every id of the tokenizer, added tokens included: as many rows as its vocabulary has, whatever the documents."""
    from tokenizers import Tokenizer

    entries = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in entries.items()], "id int, piece string")


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the decoded text in place of the ids, special tokens included.

    Some documents at a time become one row with their distinct ids, which is
    exploded, joined with the broadcast vocabulary and put together again.
    Neither step moves rows between tasks; that they came in order is checked.
    A null array counts as empty, an empty one decodes to the empty text, and an
    id that the vocabulary doesn't have adds nothing, as in the library.  Other
    columns, the text's name aside, return unchanged, whatever their names.
    """
    names, rows = [c for c in rows.columns if c != ids], plainly_named(rows, ids)
    slim = rows.select(F.struct(*[f"`{c}`" for c in rows.columns if c != ids]).alias("key"), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    key = slim.schema["key"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + DECODE_IDS, "right")) - 1)
                part = batch.slice(at, upto - at)
                codes, distinct = pd.factorize(part.column(1).flatten().to_numpy(zero_copy_only=False))
                lengths = np.diff(offsets[at : upto + 1])
                columns = [single(part.column(0)), single(pa.array(lengths, pa.int32())), pa.array([codes.astype("<i4").tobytes()], pa.binary()), single(pa.array(distinct, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["keys", "lengths", "codes", "found"])
                at = upto

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        decoder = Tokenizer.from_file(tokenizer_path).decoder
        head, pieces = None, []

        def texts() -> pa.RecordBatch:
            keys, lengths, codes, size = head
            if len(pieces) != size:
                raise ValueError("the pieces of some documents are not together")
            codes = np.frombuffer(codes, "<i4")
            known = np.array([p is not None for p in pieces], bool)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            if not known.all():
                stays = known[codes]
                ends = np.concatenate(([0], np.cumsum(stays)))[ends]
                codes = codes[stays]
            each = lists(pa.array(pieces, pa.string()).take(pa.array(codes)), ends)
            joined = pc.binary_join(each, " ") if decoder is None else pa.array([decoder.decode(x) for x in each.to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([keys, joined], ["key", "text"])

        for batch in batches:
            places, sizes, found = batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(6).to_pylist()
            for i, place in enumerate(places):
                if place == 0:
                    if head:
                        yield texts()
                    head, pieces = (batch.column(1)[i].values, batch.column(2)[i].values.to_numpy(), batch.column(3)[i].as_py(), sizes[i]), []
                else:
                    if head is None or place != len(pieces) + 1:
                        raise ValueError("the pieces of some documents are not in order")
                    pieces.append(found[i])
        if head:
            yield texts()

    packed = slim.mapInArrow(tidied(pack), f"keys array<{key}>, lengths array<int>, codes binary, found array<int>")
    first = F.struct("keys", "lengths", "codes", F.size("found").alias("size"), F.lit(None).cast("int").alias("id"))
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("keys", f"array<{key}>"), ("lengths", "array<int>"), ("codes", "binary"), ("size", "int"))]
    entries = packed.select(F.posexplode(F.concat(F.array(first), F.transform("found", lambda x: F.struct(*nulls, x.alias("id"))))).alias("place", "x"))
    flat = entries.select("place", "x.*")
    pieces = F.broadcast(vocabulary(rows.sparkSession, tokenizer_path))  # as many rows as the vocabulary
    joined = flat.join(pieces, "id", "left").select("place", "keys", "lengths", "codes", "size", "id", "piece")
    return joined.mapInArrow(tidied(unpack), f"key {key}, text string").select("key.*", "text").toDF(*names, into)


def recoded(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``.

    Nulls, empty and long texts, repeated rows and empty tables are as in
    ``encode`` and ``decode``; a null doc_id stays null.  Other columns are not
    read, whatever their names.
    """
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = encode(docs.select("doc_id", "text"), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    read = decode(coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"), path)
    return read.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recoded(table(spark, sf_dir, "documents"))
