"""Exact dedup with static binary-fuse filters of immutable snapshots.

Documents arrive in batches; each batch, once in, is a snapshot that doesn't change. A snapshot keeps its
digests (64 bits of xxHash) and, for each bucket of the digest space, a binary-fuse filter of them. Digests
of a later batch are screened by the filters of all earlier snapshots in their bucket; positives are joined
with the snapshots' digests exactly, which drops the filters' false positives; new documents that repeat
inside their batch are grouped apart. Documents of a digest that occurs twice are then compared byte for
byte, so that two texts of the same digest stay two.

The first document is the one of least doc_id (nulls last). Only digests are shuffled for all documents;
texts are shuffled for those of repeated digests, and equal ones are merged before the shuffle.

Defined results: a null text is no copy of anything; empty texts are copies of each other. Repeated rows
are copies of the first of them. With no documents the result is empty. keep_first() keeps all columns,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.binary_fuse import BUCKET_KEYS, BinaryFuse8, bucket_of, split_by_keys
from scriptloom.llm.common import packed, picked, unpacked, written

BATCHES = 4
_FILTERS = "bucket int, batch int, seed long, segment int, segments int, slots binary"
_HITS = "digest long, batch int"


def digests(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, digest, batch, n) of each distinct document that has a text; batches are equal ranges of doc_id."""
    d = _keyed(docs).where("digest is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    ends = picked(docs, doc_id="long").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if ends["lo"] is None:
        return d.withColumn("batch", F.lit(0))
    width = max(1, -(-(ends["hi"] - ends["lo"] + 1) // batches))
    # Doubles: the ids may span all longs, and rounding keeps their order.
    batch = F.floor((F.col("doc_id").cast("double") - F.lit(float(ends["lo"]))) / F.lit(float(width))).cast("int")
    return d.withColumn("batch", F.coalesce(F.greatest(F.lit(0), F.least(F.lit(batches - 1), batch)), F.lit(batches - 1)))


def snapshot_filters(d: DataFrame) -> DataFrame:
    """One filter for each batch and bucket."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse8.of(rows["digest"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([(int(key[0]), int(key[1]), *f.to_row())], columns=["bucket", "batch", "seed", "segment", "segments", "slots"])

    return d.groupBy("bucket", "batch").applyInPandas(build, _FILTERS)


def screen(d: DataFrame, filters: DataFrame) -> DataFrame:
    """(digest, batch) of the documents that the filter of some earlier batch may hold."""

    def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        digest, batch = new["digest"].to_numpy(np.int64), new["batch"].to_numpy()
        hit = np.zeros(len(new), bool)
        for f in old.itertuples():
            later = np.flatnonzero((batch > f.batch) & ~hit)
            if len(later):
                hit[later] = BinaryFuse8.from_row(f.seed, f.segment, f.segments, f.slots).contains(digest[later].view(np.uint64))
        return pd.DataFrame({"digest": digest[hit], "batch": batch[hit]})

    return d.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(run, _HITS)


def repeated_digests(docs: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """The digest table, and the digests that occur in two batches or twice in one."""
    d = written(digests(docs, batches), "digests")
    buckets = max(1, -(-d.count() // (BUCKET_KEYS * batches)))
    d = d.withColumn("bucket", bucket_of(F.col("digest"), buckets))
    hits = screen(d, snapshot_filters(d)).distinct().alias("new")
    old = d.select("digest", F.col("batch").alias("old_batch")).distinct()
    across = hits.join(old, "digest").where("old_batch < batch").select("digest").distinct()
    inside = d.groupBy("batch", "digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    return d, written(across.unionByName(inside).distinct(), "repeated-digests")


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, digest); the digest of a null text is null."""
    return packed(docs).withColumn("digest", F.when(F.col("text").isNotNull(), F.xxhash64("text")))


def _texts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(digest, text, doc_id) of the documents of repeated digests."""
    _, maybe = split_by_keys(_keyed(docs).select("digest", "text", "doc_id"), "digest", repeated)
    return maybe.join(repeated, "digest", "left_semi")


def _groups(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row for each distinct text of a repeated digest: its first document and number of variants of the digest."""
    firsts = _texts(docs, repeated).groupBy("digest", "text").agg(F.min("doc_id").alias("first"))
    return firsts.withColumn("variants", F.count("*").over(Window.partitionBy("digest")))


def later_copies(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, duplicate_of) for each row that is a later copy."""
    d, repeated = repeated_digests(docs, batches)
    groups = written(_groups(docs, repeated), "exact-groups")
    one = groups.where("variants = 1").select("digest", "first")
    plain = d.join(one, "digest").select("doc_id", "first", "n")
    many = groups.where("variants > 1").select("digest", "text", "first")
    clash = _texts(docs, many.select("digest").distinct()).join(many, ["digest", "text"])
    clash = clash.groupBy("doc_id", "first", "digest", "text").agg(F.count("*").alias("n")).select("doc_id", "first", "n")
    times = F.col("n") - F.col("doc_id").eqNullSafe(F.col("first")).cast("int")
    every = plain.unionByName(clash).withColumn("times", times.cast("int")).where("times > 0")
    return every.select("doc_id", F.col("first").alias("duplicate_of"), F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("col")


def keep_first(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents, all columns, without later copies. Those of unrepeated digests pass without a shuffle."""
    _, repeated = repeated_digests(docs, batches)
    surely, maybe = split_by_keys(_keyed(docs), "digest", repeated)
    single = maybe.join(repeated, "digest", "left_anti")
    twice = maybe.join(repeated, "digest", "left_semi")
    first = written(_groups(docs, repeated), "exact-groups").select("digest", "text", F.col("first").alias("doc_id"))
    same = (twice["digest"] == first["digest"]) & twice["doc_id"].eqNullSafe(first["doc_id"]) & (twice["text"] == first["text"])
    w = Window.partitionBy("digest", "doc_id", "text").orderBy(F.to_json("row"))
    one = twice.join(first, same, "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1")
    return unpacked(surely.select("row").unionByName(single.select("row")).unionByName(one.select("row")), docs)


#: DuckDB.
ORACLE_SQL = """
SELECT doc_id, duplicate_of FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS duplicate_of, row_number() OVER w AS rn
  FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)) WHERE rn > 1
"""
