"""Word shingles as arrays of hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from topotide.llm.caches import hold

SHINGLE = 5
#: Bytes of text that are cut into shingles at a time.
SLICE_BYTES = 1 << 20
#: Bytes of the longest word that is hashed together with others.
LONGEST = 31


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Small letters for A-Z, and ASCII white space.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _xxh64(words: np.ndarray) -> np.ndarray:
    """xxHash64 of each line of bytes; lines have at most LONGEST."""
    one, two, three, four, five = _PRIMES
    n, width = words.shape
    h, at = np.full(n, five + np.uint64(width)), 0
    while width - at >= 8:
        lane = np.ascontiguousarray(words[:, at : at + 8]).view("<u8").ravel()
        h = _turned(h ^ _turned(lane * two, 31) * one, 27) * one + four
        at += 8
    if width - at >= 4:
        lane = np.ascontiguousarray(words[:, at : at + 4]).view("<u4").ravel()
        h = _turned(h ^ lane * one, 23) * two + three
        at += 4
    for i in range(at, width):
        h = _turned(h ^ words[:, i] * five, 11) * one
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each text's begin."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, A-Z in lower case, of all texts in one array, and where each text's begin.

    Words of one length are hashed together, those above LONGEST bytes one by
    one.
    """
    hold("shingles", lambda: None)  # of other operators nothing stays
    data, bounds = _bytes_of(texts)
    inside = ~_WHITE[data]
    cut = np.ones(len(data) + 1, bool)  # before a byte: white space or another text
    cut[1:-1] = ~inside[:-1]
    cut[bounds] = True
    starts = np.flatnonzero(inside & cut[:-1])
    cut[:-1] |= ~inside
    ends = np.flatnonzero(inside & cut[1:]) + 1
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    data = _LOWER[data]
    by_length = np.argsort(np.minimum(lengths, LONGEST + 1).astype(np.uint8), kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(lengths.clip(max=LONGEST + 1), minlength=LONGEST + 2))))
    for length in range(1, LONGEST + 1):
        some = by_length[cuts[length] : cuts[length + 1]]
        if len(some):
            out[some] = _xxh64(data[starts[some][:, None] + np.arange(length)])
    for i in by_length[cuts[LONGEST + 1] :].tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out, np.searchsorted(starts, bounds)


def shingles_of(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts in one array, and where each text's begin."""
    words, at = word_hashes(texts)
    counts = np.maximum(np.diff(at) - k + 1, 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    if len(words) < k:
        return np.zeros(0, np.uint64), starts
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = mixed(out + words[j : len(words) - k + 1 + j])
    first = np.repeat(at[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    return out[first], starts


def shingle_lists(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The shingles of each text in order; none if it has fewer words."""
    hashes, starts = shingles_of(texts, k)
    bounds = starts.tolist()
    return [hashes[i:j] for i, j in zip(bounds, bounds[1:])]


def slices(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch cut where SLICE_BYTES bytes of its column ``text`` are passed."""
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    at = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= SLICE_BYTES or i + 1 == len(sizes):
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
