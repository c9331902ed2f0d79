"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts hashed at a time, in bytes.
SLICE = 1 << 19
#: A text of more bytes is hashed in parts.
LONG = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


@lru_cache(1)
def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, A-Z as a-z; and which bytes are blanks."""
    code = np.arange(256)
    lower = np.where((code >= 65) & (code <= 90), code + 32, code)
    return mix(lower.astype(np.uint64) * ODD + np.uint64(1)), (code == 32) | ((code >= 9) & (code <= 13))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return np.concatenate([one, np.cumprod(np.full(n, ODD))]), np.concatenate([one, np.cumprod(np.full(n, INVERSE))])


def word_hashes(texts: pa.Array, cut_long: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the words of text i are hashes[bounds[i]:bounds[i + 1]]."""
    texts = texts if pa.types.is_large_binary(texts.type) else pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)
    if cut_long and n == 1 and size > LONG:  # a long text: in parts, cut at blanks
        data, parts, at = texts.buffers()[2].to_pybytes()[int(offsets[0]) : int(offsets[-1])], [], 0
        while at < size:
            cut = max(data.rfind(b" ", at, at + LONG), data.rfind(b"\n", at, at + LONG)) if at + LONG < size else size
            cut = cut if cut > at else next((i for i in (data.find(b" ", at + 1), data.find(b"\n", at + 1)) if i > 0), size)
            parts.append(word_hashes(pa.array([data[at:cut]], pa.large_binary()), False)[1])
            at = cut
        words = np.concatenate(parts)
        return np.array([0, len(words)]), words
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0]))
    offsets = offsets - offsets[0]
    table, blanks = _byte_table()
    power, inverse = _powers(max(SLICE * 2, 1 << int(size).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * power[:size])])
    inside = ~blanks[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True  # a text's start and end cut words
    before = np.concatenate([[False], inside])  # before[i]: byte i - 1 is in a word
    after = np.concatenate([inside, [False]])
    starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return np.searchsorted(starts, offsets), hashes


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its shingles of ``width`` words; of the whole
    sequence if it has fewer words; none if it has no word."""
    bounds, words = word_hashes(texts)
    count = np.diff(bounds)
    if not len(words):
        return [words] * len(count)
    padded = np.concatenate([words, np.zeros(width - 1, np.uint64)])
    rolled = np.zeros(len(words), np.uint64)
    for k in range(width):
        rolled = rolled * ODD + padded[k : k + len(words)]
    rolled = mix(rolled + np.uint64(width))
    out = []
    for a, n in zip(bounds, count, strict=False):
        if n >= width:
            held = np.sort(rolled[a : a + n - width + 1])
            out.append(held[np.concatenate([[True], held[1:] != held[:-1]])])
        elif n:
            h = np.zeros(1, np.uint64)  # an array: its products wrap
            for w in words[a : a + n]:
                h = h * ODD + w
            out.append(mix(mix(h) + np.uint64(n)))
        else:
            out.append(words[:0])
    return out


def fingerprint(held: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(np.ascontiguousarray(held, "<u8").tobytes(), digest_size=8).digest(), "little", signed=True)
