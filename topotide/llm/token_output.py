"""Token-id output with a shared zstandard dictionary.

File format: a folder with three Parquet tables.  ``dictionary`` has one row
(hash, bytes).  ``ranges`` has a row for each range of doc_ids: its number and
the number of ids before it.  ``blocks`` has rows of a few megabytes: the
dictionary's hash, the range, the number of ids of the range before the block,
the doc_ids, and for each document the offset of its frame in ``payload`` and
its count of ids.  A frame is one
document's ids as little-endian unsigned 16-bit numbers (32-bit if one is
larger), compressed by itself with the dictionary; the frame of a document can
so be cut out and read without its neighbours.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topotide.llm.blocks import lists, single, spread
from topotide.llm.caches import hold, tidied
from topotide.llm.tables import table, text_of
from topotide.plans.scratch import new_path, written

END_ID = 0
DICTIONARY_BYTES = 65536
#: Documents that train the dictionary, at most, and the bytes of their ids after which no further document is taken.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20
#: Ranges of doc_ids for each shuffle partition; many small ones fall evenly to the partitions.
RANGES = 4
#: Pieces that a worker remembers.
CACHE_WORDS = 100_000
#: Rows and bytes of texts that are coded at a time.
SLICE_ROWS = 8192
SLICE_BYTES = 4 << 20
#: ASCII marks that may follow a word.
MARKS = "!#$%&*+,-./:;=?@|~"

#: A space before anything that may count as white space somewhere: no cut there.
_NO_CUT = re.compile(r" (?=[\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]|$)")
#: White space, in any library's sense, other than single spaces and line ends between visible characters.
_NOT_PLAIN = r"[\x{9}\x{b}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: A word of letters with marks behind it, which are pieces of their own in the usual pattern.
_MARKED = r"\A(?P<core>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<tail>[" + re.escape(MARKS) + r"]+)\z"
_NO_IDS = np.zeros(0, "<u4")
_coders: dict[str, Coder] = {}


def splits_at_spaces(description: dict) -> bool:
    """Whether a tokenizer's file describes a byte-level BPE with the usual pattern and nothing before it.

    Only such a tokenizer is known to cut a text before each single space and
    around each single line end between visible characters.
    """
    before = description.get("pre_tokenizer") or {}
    added = description.get("added_tokens") or []
    return (
        description.get("normalizer") is None
        and (description.get("model") or {}).get("type") == "BPE"
        and before.get("type") == "ByteLevel"
        and before.get("use_regex") is True
        and before.get("add_prefix_space") is False
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or t.get("single_word") for t in added)
    )


class Coder:
    """Encodes texts with a tokenizer of the tokenizers library.

    Where the tokenizer's file says that it codes the pieces between single
    spaces and line ends independently of each other (``splits_at_spaces``),
    the ids of pieces are kept and looked up, and new pieces of a batch are
    coded together.  Other tokenizers, and texts in which a cut isn't certain,
    are coded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = splits_at_spaces(json.loads(self.tokenizer.to_str()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of pieces as they stand.
        self.known: dict[str, bytes] = {}
        #: Words often seen, their ids as one array and each word's count of ids: words that follow a space, and others.
        self.often = {spaced: (pa.array([], pa.string()), _NO_IDS, np.zeros(0, np.int64)) for spaced in (True, False)}
        self.newline = np.frombuffer(self.whole(["\n"])[0], "<u4")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # in a byte-level vocabulary this letter stands for the space
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        """The pieces of any text, cut before single spaces that a visible character follows."""
        cut = text.split(" ")
        out = [cut[0]]
        for x in cut[1:]:
            if x and _NO_CUT.match(" " + x[0]) is None:
                out.append(" " + x)
            else:
                out[-1] += " " + x
        return out

    def chained(self, words: list[str], spaced: bool = True) -> list[bytes]:
        """The ids of words with a space before each, or without.

        They are coded as one text, and cut where an id starts with a space or
        is a line end.
        """
        if not words:
            return []
        if not spaced and len(self.newline) != 1:
            return self.whole(words)
        text = " " + " ".join(words) if spaced else "\n" + "\n".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.spaced[ids] if spaced else ids == self.newline[0]).tolist()
        if len(cuts) != len(words) or cuts[0]:
            return self.whole([" " + x for x in words] if spaced else words)
        data, skip = ids.tobytes(), 0 if spaced else 1
        return [data[4 * (a + skip) : 4 * b] for a, b in zip(cuts, [*cuts[1:], len(ids)])]

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces)
        self.known.update(zip(new, self.whole(new)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text.

        A text whose spaces and line ends all stand alone between visible
        characters is cut at its spaces, all such texts of the call at once;
        each distinct word is looked up once and its ids are spread to its
        places.
        """
        if not self.by_piece:
            return [np.frombuffer(x, "<u4") for x in self.whole(texts)]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        column = pa.array(texts, pa.string())
        plain = pc.invert(pc.match_substring_regex(column, _NOT_PLAIN))
        for mark in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(column, mark)))
        mask = plain.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [_NO_IDS] * len(texts)
        for i, ids in zip(np.flatnonzero(mask).tolist(), self._plain(column.filter(plain))):
            out[i] = ids
        rest = np.flatnonzero(~mask).tolist()
        cuts = [None if any(m in texts[i] for m in self.special) else self.pieces(texts[i]) for i in rest]
        self._learn({p for c in cuts if c for p in c}.difference(self.known))
        for i, cut in zip(rest, cuts):
            out[i] = np.frombuffer(self.whole([texts[i]])[0] if cut is None else b"".join(map(self.known.__getitem__, cut)), "<u4")
        return out

    def _plain(self, column: pa.Array) -> list[np.ndarray]:
        if not len(column):
            return []
        words = pc.split_pattern(column, " ")
        offsets = words.offsets.to_numpy()
        flat = words.flatten()
        coded = flat.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy().copy()
        times = np.bincount(codes, minlength=len(distinct))
        lines = pc.match_substring(distinct, "\n").to_numpy(zero_copy_only=False)
        whole, broken = int((~lines).sum()), int(lines.sum())
        # words with line ends inside, and the first words of the texts, which follow no space, are cut at line ends
        cut = pc.split_pattern(pa.concat_arrays([distinct.filter(pa.array(lines)), flat.take(pa.array(offsets[:-1]))]), "\n")
        at, inner = cut.offsets.to_numpy(), cut.flatten()
        head = np.zeros(len(inner), bool)
        head[at[:broken]] = True
        spaced = pa.concat_arrays([distinct.filter(pa.array(~lines)), inner.filter(pa.array(head))])
        ids, counts = self._words(spaced, np.concatenate((times[~lines], times[lines])), True)
        more_ids, more_counts = self._words(inner.filter(pa.array(~head)), np.ones(len(inner) - broken, np.int64), False)
        counts, newline = np.concatenate((counts, more_counts, [len(self.newline)])), len(spaced) + len(more_counts)
        piece = np.empty(len(inner), np.int64)
        piece[head], piece[~head] = whole + np.arange(broken), len(spaced) + np.arange(len(more_counts))
        joined = np.delete(np.stack((np.full(len(inner), newline), piece), axis=1).ravel(), 2 * at[:-1])
        pieces = np.concatenate((np.arange(whole), joined))
        index, ends = spread(pieces, counts)
        ids = np.concatenate((ids, more_ids, self.newline))[index]
        lengths = np.diff(ends[np.concatenate((np.arange(whole), whole + 2 * at - np.arange(len(at))))])
        # whole words come first, then those with line ends inside, then the first words of the texts
        place = np.empty(len(distinct), np.int64)
        place[~lines], place[lines] = np.arange(whole), whole + np.arange(broken)
        codes = place[codes]
        codes[offsets[:-1]] = len(distinct) + np.arange(len(column))
        index, ends = spread(codes, lengths)
        all_ids, bounds = ids[index], ends[offsets].tolist()
        return [all_ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def _words(self, words: pa.Array, times: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without white space in one array, and how many each has; ``spaced`` words follow a space, ``times`` tells how often each comes.

        Marks behind letters are coded apart.  Words that come more than once
        are remembered, up to CACHE_WORDS.
        """
        often, often_ids, often_counts = self.often[spaced]
        parts = pc.extract_regex(words, _MARKED)
        marked = parts.is_valid()
        coded = pc.if_else(marked, pc.struct_field(parts, "core"), words).dictionary_encode()
        tails = pc.if_else(marked, pc.struct_field(parts, "tail"), pa.scalar("")).dictionary_encode()
        cores, which = coded.dictionary, coded.indices.to_numpy()
        found = pc.fill_null(pc.index_in(cores, value_set=often), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(found < 0)
        texts, learnt = cores.take(pa.array(new)).to_pylist(), []
        for at in range(0, len(texts), 1000):
            learnt += self.chained(texts[at : at + 1000], spaced)
        ends = tails.dictionary.to_pylist()
        self._learn(set(ends).difference(self.known))
        kept = len(often)
        found[new] = kept + np.arange(len(new))
        pieces = [*learnt, *map(self.known.__getitem__, ends)]
        counts = np.concatenate((often_counts, np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4))
        table = np.concatenate((often_ids, np.frombuffer(b"".join(pieces), "<u4")))
        both = np.stack((found[which], kept + len(new) + tails.indices.to_numpy()), axis=1).ravel()
        seen = np.bincount(which, weights=times, minlength=len(cores)) > 1
        stay = new[seen[new]]
        if kept + len(stay) > CACHE_WORDS:  # begin again with those of this call
            stay, often, kept = np.flatnonzero(seen)[:CACHE_WORDS], often.slice(0, 0), 0
        at = np.concatenate((np.arange(kept), found[stay]))
        self.often[spaced] = pa.concat_arrays([often, cores.take(pa.array(stay))]), table[spread(at, counts)[0]], counts[at]
        return table[spread(both, counts)[0]], counts[both].reshape(-1, 2).sum(axis=1)


def coder(path: str) -> Coder:
    """The worker's coder of a tokenizer file."""
    hold("tokens", _coders.clear)
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def packed(ids: np.ndarray) -> bytes:
    """Little-endian ids with the end id, in 16 bits where they fit, else in 32."""
    wide = np.append(ids, np.uint32(END_ID))
    return b"\x02" + wide.astype("<u2").tobytes() if int(wide.max()) < 65536 else b"\x04" + wide.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of some rows at a time; a slice ends after SLICE_ROWS rows or SLICE_BYTES bytes of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_pylist()
        at = total = 0
        for i, size in enumerate(sizes):
            total += size
            if total >= SLICE_BYTES or i + 1 - at >= SLICE_ROWS or i + 1 == len(sizes):
                part = batch.slice(at, i + 1 - at)
                yield part.column(0), part.column(1).to_pylist()
                at, total = i + 1, 0


def train_dictionary(docs: DataFrame, tokenizer_path: str, sample: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A zstandard dictionary from the id arrays of up to ``sample`` whole documents, those with the smallest hash of doc_id.

    Documents are taken in the order of the hash until their ids have
    ``sample_bytes`` bytes; none is cut.  The dictionary serves compression
    only: with any sample the files give back the same ids.  Too few or too
    short documents make no dictionary: the bytes are then empty and frames
    are compressed without one.
    """
    ids = docs.select("doc_id").where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    ids = written(ids.select(F.col("doc_id").alias("k")).distinct(), "sample")  # at most `sample` long numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _slices(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array([packed(x) for x in coder(tokenizer_path).encode(texts)], pa.binary())], ["doc_id", "ids"])

    picked = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("k"), "left_semi")
    coded = written(picked.mapInArrow(tidied(run), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, ids binary"), "coded")
    first = coded.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("ids").alias("tie"), F.length("ids").alias("n"), "ids").orderBy("h", "tie").limit(sample)
    upto = F.sum("n").over(Window.orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over at most `sample` rows
    rows = first.withColumn("before", upto - F.col("n")).where(F.col("before") < sample_bytes).select("ids").collect()
    samples = [bytes(r["ids"]) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encode the whole texts of ``docs`` and write them to ``path`` in ascending doc_id order.

    doc_id is a whole number.  A null doc_id comes first; null texts count as
    empty and hold the end id alone; rows that repeat a doc_id are documents of
    their own, ordered by their frames' digest.  Ranges of doc_ids are cut by
    quantiles of that column alone, so the frames are made once and go straight
    to the sorted blocks; very long texts make long frames and blocks.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES * parts
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, F.lit(25 * ranges)).alias("q")).first()["q"]  # RANGES numbers a shuffle partition
    bounds = np.unique(np.array(found or [], np.int64))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_dict_id=False)
        for keys, texts in _slices(batches):
            arrays = [packed(x) for x in coder(tokenizer_path).encode(texts)]
            del texts
            counts = [(len(a) - 1) // a[0] for a in arrays]
            place = np.searchsorted(bounds, pc.fill_null(keys.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)).astype(np.int32)
            frames = pa.array([press.compress(a) for a in arrays], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), frames, pa.array(place)], ["doc_id", "n_tokens", "frame", "range"])

    slim = docs.select("doc_id", text_of().alias("text"))
    key = slim.schema["doc_id"].dataType.simpleString()
    frames = slim.mapInArrow(tidied(compress), f"doc_id {key}, n_tokens long, frame binary, range int")
    ranged = frames.withColumn("tie", F.xxhash64("frame")).repartition(parts, "range").sortWithinPartitions("range", "doc_id", "tie")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = before = size = 0

        def block() -> tuple[pa.RecordBatch, int]:
            keys, counts, frames = (pa.concat_arrays([h.column(i) for h in held]) for i in range(3))
            offsets = np.concatenate(([0], np.cumsum(pc.binary_length(frames).to_numpy(), dtype=np.int64)))
            total = pc.sum(counts).as_py()
            columns = [pa.array([digest]), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64())]
            columns += [single(keys), single(pa.array(offsets)), single(counts), pc.binary_join(single(frames), pa.scalar(b"", frames.type))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["dictionary", "range", "before", "n_ids", "doc_ids", "offsets", "counts", "payload"]), total

        for batch in batches:
            at = 0
            for i, (bytes_, r) in enumerate(zip(pc.binary_length(batch.column(2)).to_pylist(), batch.column(3).to_pylist())):
                if (held or i > at) and (r != number or size >= BLOCK_BYTES):
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    made, total = block()
                    yield made
                    before, size, at = before + total, 0, i
                if r != number:
                    number, before = r, 0
                size += bytes_
            if batch.num_rows > at:
                held.append(batch.slice(at))
        if held:
            yield block()[0]

    schema = f"dictionary string, range int, before long, n_ids long, doc_ids array<{key}>, offsets array<long>, counts array<long>, payload binary"
    ranged.select("doc_id", "n_tokens", "frame", "range").mapInArrow(tidied(pack), schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("range").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("range", before.cast("long").alias("range_start")).coalesce(1).write.parquet(f"{path}/ranges")  # a row for each shuffle partition


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files.

    ids is the array of ids, the end id included.
    """
    found = spark.read.parquet(f"{path}/dictionary").collect()  # one row of at most DICTIONARY_BYTES
    dictionary, digest = bytes(found[0]["bytes"]), found[0]["hash"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary doesn't have its hash")
    blocks = spark.read.parquet(f"{path}/blocks")
    if not blocks.where(F.col("dictionary") != digest).isEmpty():
        raise ValueError("a block was written with another dictionary")
    key = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in range(batch.num_rows):
                keys, offsets, counts = batch.column(1)[row].values, batch.column(2)[row].values.to_numpy(), batch.column(3)[row].values.to_numpy()
                view = memoryview(batch.column(4)[row].as_buffer())
                starts = batch.column(0)[row].as_py() + np.concatenate(([0], np.cumsum(counts)[:-1]))
                for at in range(0, len(keys), 256):
                    ids = [unpacked(press.decompress(view[offsets[i] : offsets[i + 1]])) for i in range(at, min(len(keys), at + 256))]
                    upto = at + len(ids)
                    each = lists(pa.array(np.concatenate(ids).view(np.int32)), np.cumsum([0, *map(len, ids)]))
                    columns = [keys[at:upto], pa.array(starts[at:upto], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), each]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    ranges = spark.read.parquet(f"{path}/ranges")  # at most a row for each shuffle partition of the writer
    placed = blocks.join(F.broadcast(ranges), "range").withColumn("start", F.col("range_start") + F.col("before"))
    return placed.select("start", "doc_ids", "offsets", "counts", "payload").mapInArrow(tidied(run), f"doc_id {key}, start long, n_tokens long, ids_crc32 long, ids array<int>")


def tokenised(docs: DataFrame) -> DataFrame:
    """Write ``docs`` in the file format below the shared folder and read the files back.

    (doc_id, start, n_tokens, ids_crc32), a row for each row of ``docs``; nulls,
    repeated rows and long texts are as in ``write_tokens``.  An empty table
    gives no rows.  Other columns are not read, whatever their names.
    """
    import public_tokenizers

    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).drop("ids")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))
