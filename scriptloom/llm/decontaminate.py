"""Benchmark decontamination by SimHash of item-sized windows.

For each benchmark item of L words, every run of L words of a document (the whole document, if shorter) is a
window. A fingerprint has 64 bits, each the sign of a weighted vote of the window's words. Two fingerprints
within RADIUS bits agree on at least one of RADIUS + 1 blocks, so looking up each block in a table of the
items' blocks finds every fingerprint within the radius. Each one found is verified by the exact weighted
similarity of its runs of SHINGLE words: the sum of least counts over that of greatest counts, each run
weighing its number of bytes in words (so that runs of short, common words weigh little).

Windows that can't reach THRESHOLD are skipped before they are hashed: the similarity is at most the weight
of the window's runs that occur in some item, over the weight of the lightest item of that size. This bound
drops no match. Documents are read once, whole, at every offset; nothing is shuffled.

The items are sent to all executors in parts of ITEM_BYTES at most, one pass over the documents for each.

Defined results: items of fewer than MIN_WORDS words (null and empty ones too) are ignored, since chance
agrees with them. Null and empty texts match nothing. Repeated items each match; repeated rows each give
their rows. A window's place counts words from 0; among equal similarities the first place is given.
Columns of other names are ignored by leaks() and kept by keep_clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import ending_freed, id_and_text, picked, shared
from scriptloom.llm.textbatch import U64, chunks, shingles, words

SHINGLE = 3
RADIUS = 14
THRESHOLD = 0.6
MIN_WORDS = 5
ITEM_BYTES = 32 << 20
_SCHEMA = "doc_id long, item_id long, similarity double, place int"
_BITS = 64
_FLAGS = 20
SLAB = 1 << 15


def votes(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each bit the running sum of the words' votes, a row for each word and one before them."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    out = np.zeros((len(h) + 1, _BITS), np.int32)
    np.cumsum((2 * bits - 1) * weight.astype(np.int32)[:, None], axis=0, out=out[1:])
    return out


def fingerprints(vote: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of size words from each place in at."""
    end = np.minimum(at + size, len(vote) - 1)
    return np.packbits(vote[end] > vote[at], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each of radius + 1 blocks that make up a fingerprint."""
    cut = [b * _BITS // (radius + 1) for b in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


class HammingIndex:
    """Fingerprints by block: finds all within RADIUS of another one, and no more than share a block."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        cut = blocks(radius)
        self.prints, self.radius = prints, radius
        self.first = np.array([a for a, _ in cut], np.uint64)
        self.mask = np.array([(1 << bits) - 1 for _, bits in cut], np.uint64)
        self.base = np.cumsum([0, *(1 << bits for _, bits in cut)])[:-1]  # one table for all blocks, end to end
        key = self._keys(prints)
        self.order = np.argsort(key, kind="stable")
        self.start = np.searchsorted(key[self.order], np.arange(sum(1 << bits for _, bits in cut) + 1))
        self.order //= len(cut)

    def _keys(self, prints: np.ndarray) -> np.ndarray:
        """The place of each block of each fingerprint in the table."""
        return ((prints[:, None] >> self.first & self.mask).astype(np.int64) + self.base).ravel()

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in prints, place in the index) at a distance of radius at most."""
        key = self._keys(prints)
        begin = self.start[key]
        count = self.start[key + 1] - begin
        who = np.repeat(np.arange(len(key)), count)
        item = self.order[np.arange(len(who)) - np.repeat(np.cumsum(count) - count - begin, count)]
        who //= len(self.first)
        near = np.bitwise_count(prints[who] ^ self.prints[item]) <= self.radius
        m = max(1, len(self.prints))
        pair = np.unique(who[near] * m + item[near])
        return pair // m, pair % m


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum of least over that of greatest weights of two multisets of (run, weight)."""
    key, which = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    x, y = np.bincount(which[: len(a[0])], a[1], len(key)), np.bincount(which[len(a[0]) :], b[1], len(key))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1e-12))


def _runs(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of words of one window, with their weights."""
    run, _ = shingles(h, np.array([0, len(h)]), SHINGLE)
    total = np.append(0, np.cumsum(size))
    at = np.arange(len(run))
    return run, (total[np.minimum(at + SHINGLE, len(h))] - total[at]).astype(np.float64)


class ItemIndex:
    """The benchmark's items by size: fingerprints, runs and weights."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        w = words(pa.array(texts, pa.string()))
        h, size = w.hashes(), (w.end - w.start).astype(np.float64)
        self.ids, self.runs, self.by_size = ids, {}, {}
        keys = [np.zeros(0, np.uint64)]
        by_size: dict[int, list[int]] = {}
        for i in range(len(ids)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= MIN_WORDS:
                self.runs[i] = _runs(h[a:b], size[a:b])
                keys.append(self.runs[i][0])
                by_size.setdefault(b - a, []).append(i)
        for n, items in sorted(by_size.items()):
            prints = [fingerprints(votes(h[w.first[i] : w.first[i + 1]], size[w.first[i] : w.first[i + 1]]), np.zeros(1, np.int64), n)[0] for i in items]
            least = min(self.runs[i][1].sum() for i in items)
            self.by_size[n] = (np.array(items), HammingIndex(np.array(prints, np.uint64)), THRESHOLD * least)
        self.keys = np.unique(np.concatenate(keys))
        self.flags = np.zeros(1 << _FLAGS, bool)
        self.flags[(self.keys >> U64(64 - _FLAGS)).astype(np.int64)] = True
        self.least = min((x[2] for x in self.by_size.values()), default=np.inf)

    def known(self, run: np.ndarray) -> np.ndarray:
        """Whether each run occurs in some item."""
        maybe = np.flatnonzero(self.flags[(run >> U64(64 - _FLAGS)).astype(np.int64)])
        out = np.zeros(len(run), bool)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, run[maybe]), len(self.keys) - 1)
            out[maybe] = self.keys[at] == run[maybe]
        return out

    def search(self, h: np.ndarray, size: np.ndarray, gain: np.ndarray) -> dict[int, tuple[float, int]]:
        """For each item that one document's windows match: the best similarity and its place.

        gain: for each word, the weight of the run from it if some item has that run, else 0.
        """
        found: dict[int, tuple[float, int]] = {}
        total = np.append(0, np.cumsum(gain))
        n, longest = len(h), max(self.by_size, default=0)
        for lo in range(0, n, SLAB):  # votes take 256 bytes a word, so long texts go piece by piece
            hi, vote = min(n, lo + SLAB + longest), None
            runs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for length, (items, index, need) in self.by_size.items():
                if total[hi] - total[lo] < need - 1e-9:
                    continue
                start = np.arange(lo, min(lo + SLAB, max(0, n - length) + 1))
                ends = np.minimum(start + max(1, length - SHINGLE + 1), n)
                at = start[total[ends] - total[start] >= need - 1e-9]
                if not len(at):
                    continue
                vote = votes(h[lo:hi], size[lo:hi]) if vote is None else vote
                for window, j in zip(*index.within(fingerprints(vote, at - lo, length))):
                    item, place = int(items[j]), int(at[window])
                    if (place, length) not in runs:
                        runs[place, length] = _runs(h[place : place + length], size[place : place + length])
                    s = weighted_similarity(runs[place, length], self.runs[item])
                    if s >= THRESHOLD and s > found.get(item, (0.0, 0))[0]:
                        found[item] = (s, place)
        return found

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, dict[int, tuple[float, int]]]]:
        """(row, matches) of the texts that have any."""
        w = words(texts)
        if not len(w.start) or not len(self.keys):
            return
        h = w.hashes()
        run, to = shingles(h, w.first, SHINGLE)
        known = self.known(run)
        hit = np.flatnonzero(known)
        if not len(hit):
            return
        size = (w.end - w.start).astype(np.float64)
        total = np.append(0, np.cumsum(size))
        rows = np.searchsorted(to, hit, "right") - 1
        first = w.first[rows] + hit - to[rows]
        weight = total[np.minimum(first + SHINGLE, w.first[rows + 1])] - total[first]
        per_row = np.bincount(rows, weight, len(to) - 1)
        for row in np.flatnonzero(per_row >= self.least - 1e-9).tolist():
            a, b = int(w.first[row]), int(w.first[row + 1])
            gain = np.zeros(b - a)
            own = rows == row
            gain[first[own] - a] = weight[own]
            if found := self.search(h[a:b], size[a:b], gain):
                yield row, found


def _indexes(benchmark: DataFrame) -> Iterator[ItemIndex]:
    b = picked(benchmark, item_id="long", text="string")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // ITEM_BYTES)
    for k in range(parts):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow() if parts > 1 else b.toArrow()
        rows = rows.sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield ItemIndex(rows["item_id"].to_pylist(), rows["text"].to_pylist())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, place) for each document and item of which some window matches."""
    d = id_and_text(docs)
    spark = docs.sparkSession

    def one(index: ItemIndex) -> DataFrame:
        items = shared(spark, index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in ending_freed(batches):
                for part in chunks(batch, size=1 << 19):
                    rows, out = [], []
                    for row, found in items().matches(part.column("text")):
                        for item, (s, place) in sorted(found.items()):
                            rows.append(row)
                            out.append((items().ids[item], s, place))
                    if rows:
                        ids = part.column("doc_id").take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int32())], ["doc_id", "item_id", "similarity", "place"])

        return d.mapInArrow(run, _SCHEMA)

    found = [one(i) for i in _indexes(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that match no item: a filter without a join, a pass for each part of the items."""
    for index in _indexes(benchmark):
        items = shared(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in ending_freed(batches):
                for part in chunks(batch, size=1 << 19):
                    keep = np.ones(part.num_rows, bool)
                    keep[[row for row, _ in items().matches(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
