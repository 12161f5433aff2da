"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of hashed runs of SHINGLE words; two are near copies if the Jaccard similarity of
their sets is THRESHOLD at least. Groups are the connected components of that relation.

1. One pass over the texts gives each document's set identity, its signature and BANDS hashes of ROWS minhashes each.
   Documents with the same set are one node from here on.
2. Nodes that share a band hash, a bucket, are candidates. Band hashes that occur twice are found by 4 bytes of each, sorted
   by parts; entries that pass are grouped by the whole hash. Each bucket's least node, its leader, is compared with the
   bucket's others: signatures, a byte of each minhash, by batches of BATCH, given up as soon as the posterior probability
   of a similarity of THRESHOLD or more (uniform prior) is under MISS; texts are sent for the survivors alone, whose sets
   are compared exactly. (Bytes that agree by chance only let more pairs survive.) Pairs are rows, one for each node and
   leader; a leader's pairs are spread by a salt over tasks of LEADER_ROWS rows.
3. Verified pairs are edges; components of edges are groups so far. A leader has met its whole bucket and leaves it. A
   bucket whose nodes are all in one group has nothing left to find. In the others the next leaders, MORE_LEADERS times as
   many each round and of the rarest groups first, meet the nodes of other groups that they haven't met, until no bucket is
   left. So a bucket of any number of copies of one text is done after one round, no task holds more than one leader's
   set and a batch of others, and no pair of candidates of different groups stays uncompared.

A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.92 at 0.5, 0.997 at 0.6, 0.99999 at 0.7.

Defined results: texts without a word, null or empty ones, are in no group. A text of fewer than SHINGLE
words has one run, all of them. Repeated rows are in one group. A group's name is its least doc_id; with
nulls only, it is null. keep_one() keeps of each group the row of least doc_id (nulls last; repeated rows
of that document count as copies too), all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.binary_fuse import split_by_keys
from scriptloom.llm.common import drop_written, ending_freed, id_and_text, packed, unpacked, written
from scriptloom.llm.components import components
from scriptloom.llm.textbatch import U64, chunks, mix, shingles, words

SHINGLE = 3
THRESHOLD = 0.5
ROWS = 4
BANDS = 40
BATCH = 16
MISS = 0.001
LEADER_ROWS = 2048
MORE_LEADERS = 16
PART_BANDS = 1 << 20
_HASHES = ROWS * BANDS
_rng = np.random.Generator(np.random.PCG64(42))
_MULTIPLY = _rng.integers(1, 1 << 63, _HASHES, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _rng.integers(1, 1 << 63, _HASHES, dtype=np.uint64)
_SET_SCHEMA = "doc_id long, text_hash long, set_id long, set_check long, bands array<long>"


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of words of each text, with n + 1 offsets; repeats inside a text aren't dropped."""
    w = words(texts)
    return shingles(w.hashes(), w.first, SHINGLE)


def signatures(run: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Minhashes, a row for each text; a text without words has the greatest value throughout."""
    n = len(to) - 1
    out = np.full((n, _HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(to))
    if not len(full):
        return out
    starts = to[full]
    for k in range(_HASHES):
        h = ((run * _MULTIPLY[k] + _ADD[k]) >> U64(32)).astype(np.uint32)
        out[full, k] = np.minimum.reduceat(h, starts)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """The hash of each band of each signature, with the band's number in it."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    s = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    for r in range(ROWS):
        out = mix(out + s[:, :, r] + U64(r + 1))
    return mix(out + np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def least_matches(threshold: float = THRESHOLD, miss: float = MISS, hashes: int = _HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on): with fewer, P(similarity >= threshold | matches) < miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the chance that
    a Binomial(n + 1, t) is m at most.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


_NEEDED = least_matches()


def may_be_similar(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Indexes of the signatures that no batch of comparisons rules out."""
    left, done = np.arange(len(others)), 0
    matches = np.zeros(len(others), np.int64)
    for n, needed in _NEEDED:
        matches = matches + (others[left, done:n] == one[done:n]).sum(axis=1)
        keep = matches >= needed
        left, matches, done = left[keep], matches[keep], n
        if not len(left):
            break
    return left


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def document_sets(docs: DataFrame) -> DataFrame:
    """One row for each document with a word: keys, the identity of its set, and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ending_freed(batches):
            for part in chunks(batch, size=1 << 18):
                h, to = sets_of(part.column("text"))
                full = np.flatnonzero(np.diff(to))
                if not len(full):
                    continue
                ids = np.zeros((len(full), 2), np.int64)
                for j, t in enumerate(full.tolist()):
                    ids[j] = _identity(np.unique(h[to[t] : to[t + 1]]))
                bands = band_hashes(signatures(h, to)[full]).view(np.int64)
                rows = part.take(pa.array(full))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(ids[:, 0]), pa.array(ids[:, 1]), lists], ["doc_id", "text_hash", "set_id", "set_check", "bands"])

    return _keyed(docs).mapInArrow(run, _SET_SCHEMA)


def _identity(unique: np.ndarray) -> tuple[int, int]:
    sums = np.array([mix(unique).sum(dtype=np.uint64), mix(unique ^ U64(0x5DEECE66D)).sum(dtype=np.uint64)])
    return tuple((mix(sums) >> U64(1)).astype(np.int64).tolist())


def _keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a table of numbers."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * rows.strides[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _signed(texts: DataFrame) -> DataFrame:
    """(id, signature, text) of (id, text); a signature has the low byte of each minhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ending_freed(batches):
            for part in chunks(batch, size=1 << 18):
                low = signatures(*sets_of(part.column("text"))).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("id"), _binary(low), part.column("text")], ["id", "signature", "text"])

    return texts.mapInArrow(run, "id long, signature binary, text string")


def _signatures(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(len(values), _HASHES)


def _head_signature(value: pa.Array) -> np.ndarray:
    return _signatures(value)[0]


def _passing(head: np.ndarray, values: pa.Array) -> np.ndarray:
    out = np.zeros(len(values), bool)
    out[may_be_similar(head, _signatures(values))] = True
    return out


def _head_set(value: pa.Array) -> np.ndarray:
    return np.unique(sets_of(value)[0])


def _similar(head: np.ndarray, values: pa.Array) -> np.ndarray:
    h, to = sets_of(values)
    return np.array([jaccard(head, np.unique(h[a:b])) >= THRESHOLD for a, b in zip(to[:-1].tolist(), to[1:].tolist())], bool)


def _meeting(pairs: DataFrame, values: DataFrame, head_of: Callable[[pa.Array], np.ndarray], test: Callable[[np.ndarray, pa.Array], np.ndarray]) -> DataFrame:
    """The pairs (a, b) that pass the test of a's head and b's value. values: (id, value)."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_ROWS).cast("int").alias("salts"))
    head = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"))
    other = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
    rows = head.unionByName(other).join(values, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in ending_freed(batches):
            for part in chunks(batch, column="value", size=1 << 19):
                first = part.column("role").to_numpy() == 0
                a, b = part.column("a").to_numpy(), part.column("id").to_numpy()
                cut = np.unique(np.append(np.flatnonzero(first), 0)).tolist()
                keep = np.zeros(part.num_rows, bool)
                for i, j in zip(cut, [*cut[1:], part.num_rows]):
                    if first[i]:
                        head = head_of(part.column("value").slice(i, 1))
                        i += 1
                    if i < j:
                        keep[i:j] = test(head, part.column("value").slice(i, j - i))
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return rows.select("a", "role", "id", "value").mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar. nodes: (id, signature, text). Texts are sent for pairs whose signatures pass alone."""
    maybe = written(_meeting(pairs, nodes.select("id", F.col("signature").alias("value")), _head_signature, _passing), "passing")
    ids = maybe.select(F.col("a").alias("id")).unionByName(maybe.select(F.col("b").alias("id"))).distinct()
    _, texts = split_by_keys(nodes.select("id", F.col("text").alias("value")), "id", written(ids, "passing-ids"))
    return _meeting(maybe, texts, _head_set, _similar)


def band_key(band: Column, parts: int) -> Column:
    """A long of the number of a band's part and the hash's low 32 bits: bands that are equal have one key, others seldom."""
    return F.pmod(F.shiftright(band, 32), F.lit(parts).cast("long")) * F.lit(1 << 32) + band.bitwiseAND(F.lit(0xFFFFFFFF))


def repeated_keys(bands: DataFrame, parts: int) -> DataFrame:
    """(key) of each band_key() that occurs twice or more in the lists of the column bands.

    Only keys travel, 4 bytes each, sorted and packed by batch and part; of a key's repeats in a batch two are sent.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ending_freed(batches):
            band = batch.column(0).flatten().to_numpy()
            keys = np.sort((band >> 32) % parts << 32 | band & 0xFFFFFFFF)
            if len(keys) > 2:
                keys = keys[np.append([True, True], keys[2:] != keys[:-2])]
            part, low = keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32)
            cut = np.append(0, np.flatnonzero(np.diff(part)) + 1).tolist() if len(keys) else []
            packs = [low[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(keys)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32) if cut else [], pa.int32()), pa.array(packs, pa.binary())], ["part", "packs"])

    def repeats(part: int, packs: list[bytes]) -> pa.RecordBatch:
        low = np.sort(np.frombuffer(b"".join(packs), np.uint32))
        twice = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(twice | part << 32)], ["key"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in ending_freed(batches):
            for part, packs in zip(batch.column("part").to_pylist(), batch.column("packs").to_pylist()):
                if part != now:
                    if held:
                        yield repeats(now, held)
                    now, held = part, []
                held.append(packs)
        if held:
            yield repeats(now, held)

    return bands.select("bands").mapInArrow(pack, "part int, packs binary").repartition("part").sortWithinPartitions("part").mapInArrow(unpack, "key long")


def set_nodes(sets: DataFrame) -> DataFrame:
    """(id, doc_id, text_hash, bands) of one row for each set, the least. Rows of sets that occur once aren't shuffled."""
    copied = written(sets.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select("set_id"), "copied-sets")
    single, maybe = split_by_keys(sets, "set_id", copied)
    first = maybe.groupBy("set_id", "set_check").agg(F.min_by("bands", F.struct("doc_id", "text_hash")).alias("bands"), F.min(F.struct("doc_id", "text_hash")).alias("d"))
    first = written(first.select(F.col("set_id").alias("id"), "d.doc_id", "d.text_hash", "bands"), "nodes-of-copies")
    return single.select(F.col("set_id").alias("id"), "doc_id", "text_hash", "bands").unionByName(first)


def _candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that share a band: (band, id, lead) of each, and (id, doc_id, text_hash), both written."""
    node, parts = set_nodes(sets), max(1, -(-sets.count() * BANDS // PART_BANDS))
    entry = node.select(F.explode("bands").alias("band"), "id")
    _, maybe = split_by_keys(entry.withColumn("key", band_key(F.col("band"), parts)), "key", written(repeated_keys(node, parts), "band-keys"))
    maybe = written(maybe.select("band", "id"), "entries")
    bucket = maybe.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1").select("band", "lead")
    open_ = written(maybe.join(bucket, "band").select("band", "id", "lead"), "entries")
    drop_written(maybe)
    member = open_.select("id").distinct().join(node.select("id", "doc_id", "text_hash"), "id")
    return open_, written(member, "candidates")


def _candidate_texts(member: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, signature, text) of each candidate, written. Texts are shuffled once."""
    of = lambda df: df.withColumns({"key": F.xxhash64("doc_id", "text_hash"), "none": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    of_one = ["text_hash", "doc_id", "none"]
    _, texts = split_by_keys(of(_keyed(docs)), "key", of(member).select("key").distinct())
    nodes = texts.select(*of_one, "text").dropDuplicates(of_one).join(of(member).select(*of_one, "id"), of_one)
    return written(_signed(nodes.select("id", "text")), "candidate-texts")


def _edges(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of similar nodes, enough to connect each group. open_: (band, id, lead) of candidates; nodes: (id, signature, text)."""
    pairs = written(open_.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    open_ = open_.where("id <> lead").select("band", "id")
    met, edges, leaders = pairs, None, MORE_LEADERS
    while True:
        found = written(compared(pairs, nodes), "edges")
        edges = found if edges is None else edges.unionByName(found)
        group = written(components(edges), "node-groups")
        labelled = open_.join(group, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
        several = labelled.groupBy("band").agg((F.min("root") != F.max("root")).alias("x")).where("x").select("band")
        open_ = written(labelled.join(several, "band"), "entries")
        sizes = open_.groupBy("band", "root").agg(F.count("*").alias("n"))
        if open_.isEmpty():
            return edges
        rare = Window.partitionBy("band").orderBy("n", "root", "id")
        lead = written(open_.join(sizes, ["band", "root"]).withColumn("k", F.row_number().over(rare)).where(F.col("k") <= leaders).select("band", F.col("id").alias("a"), F.col("root").alias("own")), "leaders")
        new = lead.join(open_.withColumnRenamed("id", "b"), "band").where("own <> root").select("a", "b").distinct()
        turned = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Of two leaders of one bucket each would meet the other.
        pairs = written(new.join(turned, ["a", "b"], "left_anti").select(F.least("a", "b").alias("l"), "a", "b", F.greatest("a", "b").alias("g")).groupBy("l", "g").agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("l"), F.col("g")).otherwise(F.col("l")).alias("b")), "pairs")
        met = met.unionByName(pairs)
        open_ = open_.join(lead.select("band", F.col("a").alias("id")), ["band", "id"], "left_anti").select("band", "id")
        leaders *= MORE_LEADERS


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, group_id, group_size) of every row that is in a group of two rows or more."""
    banded = written(document_sets(docs), "document-sets")
    open_, member = _candidates(banded)
    sets = written(banded.select("doc_id", "text_hash", "set_id"), "document-sets")
    drop_written(banded)
    group = components(_edges(open_, _candidate_texts(member, docs))).select(F.col("id").alias("set_id"), "root")
    named = sets.join(group, "set_id", "left").withColumn("of", F.coalesce("root", "set_id"))
    size = named.groupBy("of").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return named.join(size, "of").select("doc_id", "text_hash", "group_id", "group_size")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, group_size) of every row that has a near copy."""
    return groups(docs).select("doc_id", "group_id", "group_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near copies of a kept one."""
    found = written(groups(docs).select("doc_id", "text_hash", "group_id").distinct(), "near-groups")
    first = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("s")).select("s.doc_id", "s.text_hash")
    surely, maybe = split_by_keys(packed(docs).select("row", "doc_id", F.xxhash64("text").alias("text_hash")), "text_hash", found.select("text_hash").distinct())
    same = lambda other: (maybe["text_hash"] == other["text_hash"]) & maybe["doc_id"].eqNullSafe(other["doc_id"])
    seen = found.select("doc_id", "text_hash")
    single = maybe.join(seen, same(seen), "left_anti")
    one = maybe.join(first, same(first), "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.to_json("row")))).where("n = 1")
    return unpacked(surely.select("row").unionByName(single.select("row")).unionByName(one.select("row")), docs)
