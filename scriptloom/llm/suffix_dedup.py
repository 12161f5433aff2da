"""Dedup of repeated passages by longest-previous-factor arrays in suffix order.

A word is removed if some run of MIN_WORDS words that holds it occurs at an earlier place too; places are
ordered by doc_id (nulls last), then by text, then inside the text. So the first occurrence stays whole.

The suffix order of a corpus is cut into independent parts: each run of MIN_WORDS words holds an anchor, the
run of ANCHOR words of least hash among those inside it, which depends on the words alone. Suffixes that agree
in MIN_WORDS words therefore have the same anchor at the same distance d, and meet in the part of that anchor.

1. Equal texts become one document first; their later copies are removed whole.
2. Anchors of all documents are counted; only those that occur twice go on, with the words around them.
3. In an anchor's part the suffixes that start d words before it are brought in suffix order, for each d:
   by the d words, then by the words after it. Neighbours' common prefixes make the LCP array; the previous
   and the next smaller position in suffix order, reached over the least LCP between, give each suffix its
   longest previous factor. Factors of MIN_WORDS words or more are later copies.
4. A document's factors are joined to spans.

Only hashes of anchors are shuffled for all texts; words are shuffled around repeated anchors, texts for
repeated texts. Parts are independent, so a corpus of any size is spread by anchor.

Defined results: null and empty texts, and texts of fewer words than MIN_WORDS, have no spans. Rows that repeat
another row are later copies of it. Words are those of textbatch (case and punctuation don't count). Overlapping
repeats inside one text count: of a phrase said again and again the first MIN_WORDS words and the rest of the
first occurrence stay. Further columns are ignored by repeats() and kept by remove_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptloom.llm.binary_fuse import screening, split_by_keys
from scriptloom.llm.common import ending_freed, id_and_text, packed, unpacked, written
from scriptloom.llm.textbatch import U64, Words, chunks, mix, words

MIN_WORDS = 50
ANCHOR = 26
BEFORE = MIN_WORDS - ANCHOR
_WIDTH = BEFORE + MIN_WORDS
_M = (U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))
_BATCH_ROWS = 1 << 13
_CHUNK = 1 << 19
_CONTEXT = "anchor long, doc_id long, text_hash long, place int, low int, high int, around binary"
_SPANS = "doc_id long, text_hash long, start int, stop int, source_id long"


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each place; the last size - 1 are dropped."""
    parts, have, power, done = [], h, 1, 0
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            parts.append((done, have))
            done += power
        if power * 2 <= size:
            have = mix(have[: len(have) - power] * _M[0] + have[power:] * _M[1])
            power *= 2
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for at, x in parts:
        out = mix(out * _M[2] + x[at : at + n])
    return out


def _sliding(x: np.ndarray, size: int, least) -> np.ndarray:
    """least of the size values from each place on; the result is shorter by size - 1."""
    have, power = x, 1
    while power * 2 <= size:
        have = least(have[: len(have) - power], have[power:])
        power *= 2
    n = len(x) - size + 1
    return least(have[:n], have[size - power : size - power + n])


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of texts whose word hashes lie end to end."""
    if len(h) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = _runs(h, ANCHOR)
    windows = MIN_WORDS - ANCHOR + 1
    least = _sliding(g, windows, np.minimum)
    ends = np.repeat(first[1:], np.diff(first))[: len(least)]
    least[np.arange(len(least)) + MIN_WORDS > ends] = 0  # runs that leave their text
    padded = np.concatenate((np.zeros(windows - 1, np.uint64), least, np.zeros(windows - 1, np.uint64)))
    at = np.flatnonzero(_sliding(padded, windows, np.maximum) == g)
    at = at[g[at] != 0]
    return at, g[at]


def nearest_smaller(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the previous place of a smaller position (or -1), and the least LCP up to it.

    lcp[i] belongs to places i - 1 and i; lcp[0] is 0. Found by doubling: minima of 1, 2, 4, ... places.
    """
    n = len(position)
    block = np.diff(np.append(np.flatnonzero(lcp == 0), n)).max() if n else 0
    lows, links, step = [position], [lcp], 1
    while step * 2 <= block:
        p, q = lows[-1].copy(), links[-1].copy()
        p[step:] = np.minimum(p[step:], lows[-1][:-step])
        q[step:] = np.minimum(q[step:], links[-1][:-step])
        p[:step] = np.iinfo(p.dtype).min  # such a jump would leave the array
        lows.append(p)
        links.append(q)
        step *= 2
    at, reach = np.arange(n) - 1, lcp.copy()
    for level in [len(lows) - 1, *range(len(lows) - 1, -1, -1)]:
        go = np.flatnonzero((reach > 0) & (at >= 0))
        go = go[lows[level][at[go]] >= position[go]]
        reach[go] = np.minimum(reach[go], links[level][at[go]])
        at[go] -= 1 << level
    at[(reach == 0) | (at < 0)] = -1
    reach[at < 0] = 0
    return at, reach


def previous_factors(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, place in suffix order of the earlier match or -1) of each suffix's longest previous factor."""
    before, reach = nearest_smaller(position, lcp)
    turned = np.append(0, lcp[:0:-1])
    after, reach2 = nearest_smaller(position[::-1], turned)
    after, reach2 = after[::-1], reach2[::-1]
    after = np.where(after >= 0, len(position) - 1 - after, -1)
    better = reach2 > reach
    return np.where(better, reach2, reach), np.where(better, after, before)


def longest_previous_factors(symbols: np.ndarray) -> np.ndarray:
    """The LPF array of one sequence, by its whole suffix array (prefix doubling); for tests and small use."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while step < n:
        second = np.append(rank[step:], np.zeros(min(step, n), np.int64))[:n]
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    for i in range(1, n):
        a, b = int(order[i - 1]), int(order[i])
        while max(a, b) + lcp[i] < n and symbols[a + lcp[i]] == symbols[b + lcp[i]]:
            lcp[i] += 1
    out = np.zeros(n, np.int64)
    out[order] = previous_factors(order, lcp)[0]
    return out


def part_factors(bucket: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of whole parts: (words before the anchor, words from it on, row of the earlier match) of the factors; -1 before where there is none.

    rank orders the rows' places; around holds the words from BEFORE places before the anchor on, of which
    those from low to high are there.
    """
    n = len(bucket)
    after = around[:, BEFORE + ANCHOR :]
    pairs = after[:, 0::2].astype(np.uint64) << U64(32) | after[:, 1::2]
    order = np.lexsort((*pairs.T[::-1], bucket))
    bucket, rank, low, high, around, after = bucket[order], rank[order], low[order], high[order], around[order], after[order]
    group = np.unique(bucket, return_inverse=True)[1].astype(np.int64)
    best, left, right, source = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for d in range(BEFORE + 1):
        if d:
            group = np.unique(group << 32 | around[:, BEFORE - d].astype(np.int64), return_inverse=True)[1].astype(np.int64)
        live = np.flatnonzero((low <= BEFORE - d) & (high >= BEFORE - d + MIN_WORDS))
        live = live[np.argsort(group[live], kind="stable")]
        if len(live) < 2:
            continue
        a, b = live[:-1], live[1:]
        same = group[a] == group[b]
        differ = after[a] != after[b]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), after.shape[1]) + ANCHOR
        common = np.minimum(common, np.minimum(high[a], high[b]) - BEFORE) + d
        lcp = np.append(0, np.where(same & (common >= MIN_WORDS), common, 0))
        shared = np.flatnonzero((lcp > 0) | np.append(lcp[1:] > 0, False))
        if not len(shared):
            continue
        size, match = previous_factors(rank[live[shared]], lcp[shared])
        hit = np.flatnonzero(match >= 0)
        rows = live[shared[hit]]
        left[rows] = np.maximum(left[rows], d)
        right[rows] = np.maximum(right[rows], size[hit] - d)
        more = size[hit] > best[rows]
        best[rows[more]] = size[hit][more]
        source[rows[more]] = live[shared[match[hit]]][more]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    found = source[back]
    return left[back], right[back], np.where(found >= 0, order[found], -1)


def _equal_rows(bucket: np.ndarray, rank: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each row the row of least rank with the same part and the same words."""
    key = mix(bucket.astype(np.int64).view(np.uint64))
    for k in range(around.shape[1]):
        key = mix(key + around[:, k])
    order = np.lexsort((rank, key))
    new = np.append(True, key[order][1:] != key[order][:-1])
    out = np.empty(len(bucket), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def row_factors(bucket: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part_factors() of all rows. A row whose words an earlier row has throughout is a factor as a whole; only
    the first of such rows has to be ordered among others."""
    first = _equal_rows(bucket, rank, around)
    one = np.flatnonzero(first == np.arange(len(first)))
    left, right, source = (low.astype(np.int64) * 0 - 1, high.astype(np.int64) * 0, np.full(len(first), -1, np.int64))
    a, b, c = part_factors(bucket[one], rank[one], low[one], high[one], around[one])
    left[one], right[one], source[one] = a, b, np.where(c >= 0, one[c], -1)
    rest = np.flatnonzero((first != np.arange(len(first))) & (high - low >= MIN_WORDS))
    left[rest], right[rest], source[rest] = BEFORE - low[rest], high[rest] - BEFORE, first[rest]
    return left, right, source


def _keyed(docs: DataFrame) -> DataFrame:
    d = id_and_text(docs).where("text is not null")
    return d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.md5(F.col("text").cast("binary")).alias("text_key"), "text")


def _anchor_hashes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ending_freed(batches):
            for part in chunks(batch, size=_CHUNK):
                w = words(part.column("text"))
                _, g = anchors(w.hashes(), w.first)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long")


def _contexts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The repeated anchors with the words around them. Where repeated anchors are too many for a filter, all anchors."""
    known = screening(repeated, "anchor")
    span = np.arange(-BEFORE, MIN_WORDS)

    def rows(w: Words, part: pa.RecordBatch) -> pa.RecordBatch | None:
        h = w.hashes()
        at, g = anchors(h, w.first)
        if known and len(at):
            keep = known().contains(g.view(np.int64))
            at, g = at[keep], g[keep]
        if not len(at):
            return None
        doc = np.searchsorted(w.first, at, "right") - 1
        start, end = w.first[doc], w.first[doc + 1]
        cell = at[:, None] + span[None, :]
        inside = (cell >= start[:, None]) & (cell < end[:, None])
        around = np.where(inside, (h[np.clip(cell, 0, len(h) - 1)] >> U64(32)).astype(np.uint32), np.uint32(0))
        low, high = np.maximum(0, BEFORE - (at - start)), np.minimum(_WIDTH, BEFORE + end - at)
        binary = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * 4 * _WIDTH).astype(np.int32)), pa.py_buffer(around.tobytes())])
        of = pa.array(doc)
        arrays = [pa.array(g.view(np.int64)), part.column("doc_id").take(of), part.column("text_hash").take(of), pa.array((at - start).astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), binary]
        return pa.RecordBatch.from_arrays(arrays, ["anchor", "doc_id", "text_hash", "place", "low", "high", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ending_freed(batches):
            for part in chunks(batch, size=_CHUNK):
                if (out := rows(words(part.column("text")), part)) is not None:
                    yield out

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, _CONTEXT)


def _factor_spans(contexts: DataFrame) -> DataFrame:
    def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        kept, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("anchor").to_numpy()
            if rows >= _BATCH_ROWS:
                last = kept[-1].column("anchor")[-1].as_py()
                cut = int(np.searchsorted(key != last, True)) if key[0] == last else 0
                if cut < len(key):
                    kept.append(batch.slice(0, cut))
                    yield pa.Table.from_batches(kept)
                    kept, rows, batch = [], 0, batch.slice(cut)
            kept.append(batch)
            rows += batch.num_rows
        if kept:
            yield pa.Table.from_batches(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in ending_freed(whole_parts(batches)):
            t = table.combine_chunks()
            bucket = t["anchor"].to_numpy()
            doc, text, place = t["doc_id"].fill_null(0).to_numpy(), t["text_hash"].to_numpy(), t["place"].to_numpy().astype(np.int64)
            null = t["doc_id"].is_null().to_numpy()
            rank = np.empty(len(bucket), np.int64)
            rank[np.lexsort((place, text, doc, null))] = np.arange(len(bucket))
            around = t["around"].combine_chunks()
            around = around.chunk(0) if isinstance(around, pa.ChunkedArray) else around
            _, offsets, data = around.buffers()
            begin = int(np.frombuffer(offsets, np.int32)[around.offset])
            around = np.frombuffer(data, np.uint32, len(bucket) * _WIDTH, begin).reshape(len(bucket), _WIDTH)
            left, right, source = row_factors(bucket, rank, t["low"].to_numpy(), t["high"].to_numpy(), around)
            hit = np.flatnonzero(source >= 0)
            if len(hit):
                of = pa.array(hit)
                ids = t["doc_id"].combine_chunks() if isinstance(t["doc_id"], pa.ChunkedArray) else t["doc_id"]
                yield pa.RecordBatch.from_arrays([ids.take(of), pa.array(text[hit]), pa.array((place - left)[hit].astype(np.int32)), pa.array((place + right)[hit].astype(np.int32)), ids.take(pa.array(source[hit]))], ["doc_id", "text_hash", "start", "stop", "source_id"])

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _SPANS)


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document become one, with the least source."""
    own = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("__new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    s = s.withColumn("__span", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "text_hash", "__span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("source_id").alias("source_id")).drop("__span")


@F.pandas_udf(T.IntegerType())
def _word_count(texts: pd.Series) -> pd.Series:
    return pd.Series(words(pa.array(texts, pa.large_string())).count.astype(np.int32))


def _spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, stop, source_id, times): the spans of distinct texts, and the later copies of whole texts."""
    d = _keyed(docs)
    again = written(d.groupBy("text_hash").count().where("count > 1").select("text_hash"), "repeated-texts")
    single, maybe = split_by_keys(d, "text_hash", again)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    one = maybe.groupBy("text_key").agg(F.min(order).alias("m"), F.first("text_hash").alias("text_hash"), F.first("text").alias("text"), F.count("*").alias("n"))
    one = written(one.select("text_key", F.col("m.doc_id").alias("doc_id"), "text_hash", "text", "n"), "first-texts")
    distinct = single.select("doc_id", "text_hash", "text").unionByName(one.select("doc_id", "text_hash", "text"))
    repeated = written(_anchor_hashes(distinct).groupBy("anchor").count().where("count > 1").select("anchor"), "repeated-anchors")
    spans = _merged(_factor_spans(_contexts(distinct, repeated))).withColumn("times", F.lit(1))
    whole = one.where("n > 1").select("text_key", F.col("doc_id").alias("source_id"), _word_count("text").alias("stop")).where(F.col("stop") >= MIN_WORDS)
    rows = maybe.groupBy("doc_id", "text_key", "text_hash").agg(F.count("*").cast("int").alias("n"))
    copies = rows.join(whole, "text_key").withColumn("times", F.col("n") - F.col("doc_id").eqNullSafe(F.col("source_id")).cast("int")).where("times > 0")
    return spans.unionByName(copies.select("doc_id", "text_hash", F.lit(0).alias("start"), "stop", "source_id", "times"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, source_id) of each span of words to be removed; source_id has an earlier occurrence."""
    s = _spans(docs)
    return s.select("doc_id", "start", "stop", "source_id", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("col")


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    w = words(pa.array([text], pa.large_string()))
    raw = text.encode()
    move = int
    if not text.isascii():  # lower case may change a character's size: words are found by characters' places instead
        own, low = np.array([len(c.encode()) for c in text]), pc.binary_length(pc.utf8_lower(pa.array(list(text), pa.string()))).to_numpy()
        if (own != low).any():
            a, b = np.append(0, np.cumsum(low)), np.append(0, np.cumsum(own))
            move = lambda x: int(b[np.searchsorted(a, x)])
    out, done = [], 0
    for start, stop in sorted(spans):
        begin, end = move(w.start[start]), move(w.end[stop - 1])
        out.append(raw[done:begin])
        done = end
    return b"".join([*out, raw[done:]]).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with the spans of later copies cut out of text; a row that repeats another row keeps the text of one."""
    found = _spans(docs).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    found = written(found, "spans").alias("found")
    keyed = packed(docs).withColumn("text_hash", F.xxhash64("text"))
    sure, maybe = split_by_keys(keyed, "text_hash", found.select("text_hash").distinct())
    maybe = maybe.alias("maybe")
    joined = maybe.join(found, (F.col("maybe.text_hash") == F.col("found.text_hash")) & F.col("maybe.doc_id").eqNullSafe(F.col("found.doc_id")), "left").select("row", "text", "spans")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else _cut(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(texts, spans)], dtype=object)

    done = joined.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans")))
    return unpacked(sure.select("row", "text").unionByName(done.select("row", "text")), docs, "text")
