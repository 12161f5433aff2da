"""Words and word hashes of a batch of texts, computed with numpy over the UTF-8 bytes.

A word is a maximal run of ASCII letters and digits and of characters beyond ASCII, without those of the
blocks General Punctuation, the Latin-1 signs (U+0080 to U+00BF but for ª µ º) and CJK Symbols and
Punctuation. Texts are put in lower case first. A null text has no words, as an empty one.

Nothing here loops over words in Python: a batch is one byte buffer, its words are offsets into it, and a
word's 64-bit hash is a random linear form of its bytes followed by a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_POSITIONS = 1 << 12  # how many keys of positions are kept in a table

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
POSITION_KEYS = _rng.integers(1, 1 << 63, _POSITIONS, dtype=np.uint64) * U64(2) + U64(1)
SHINGLE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

_WORD = np.zeros(256, bool)
for _r in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_r[0] : _r[1]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and n + 1 offsets into them."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def _word_mask(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    for first, seconds, size in ((0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3), (0xC2, None, 2)):
        at = np.flatnonzero(data == first)
        at = at[at + size <= len(data)]
        if not len(at):
            continue
        at = at[np.isin(data[at + 1], seconds)] if seconds else at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]
        for k in range(size):
            mask[at + k] = False
    return mask


@dataclass
class Words:
    """Words of a batch: byte ranges in data, and for each text the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1 word indexes: text i has words first[i] to first[i + 1]

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges are in order, not empty and don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    total = int(size.sum())
    begin = np.cumsum(size) - size
    place = np.arange(total) - np.repeat(begin, size)
    byte = data[place + np.repeat(start, size)]
    if int(size.max()) <= _POSITIONS:
        key = POSITION_KEYS[place]
    else:  # the table's keys, and beyond it those of a generator
        key = np.where(place < _POSITIONS, POSITION_KEYS[np.minimum(place, _POSITIONS - 1)], mix(place.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1))
    terms = BYTE_KEYS[byte] * key
    h = np.add.reduceat(terms, begin) + size.astype(np.uint64) * U64(0x9E3779B97F4A7C15)
    return mix(h)


def words(texts: pa.Array) -> Words:
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    data, off = byte_buffer(lower)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(off), np.int64))
    mask = _word_mask(data)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    inner = off[(off > 0) & (off < n)]
    before[inner] = False
    start = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[inner - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, off, side="left"))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, and n + 1 indexes of each text's runs.

    A text of 1 to k - 1 words has one run, that of all its words; one without words has none.
    """
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(runs)))
    out = np.zeros(int(to[-1]), np.uint64)
    if not len(out):
        return out, to
    at = np.arange(len(out)) - np.repeat(to[:-1], runs) + np.repeat(first[:-1], runs)
    last = np.repeat(first[1:], runs)
    for j in range(k):
        p = at + j
        inside = p < last
        if inside.all():
            out += h[p] * SHINGLE_KEYS[j]
        else:
            out[inside] += h[p[inside]] * SHINGLE_KEYS[j]
    return mix(out), to


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about size bytes of text, so that temporaries stay in the cache."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // size
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut], [*cut, n]):
        yield batch.slice(int(a), int(b - a))
