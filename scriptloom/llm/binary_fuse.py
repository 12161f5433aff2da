"""Static binary-fuse filters of 64-bit keys, and joins that they screen.

A filter of n keys takes about 9 bits a key; a key in it is always reported, another one about once in 256
(8-bit fingerprints). Each key has one slot in each of three neighbouring segments, and its fingerprint is
the exclusive or of the three slots. Construction peels keys that are alone in a slot, a whole layer at
a time with numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import shared
from scriptloom.llm.textbatch import U64, mix

#: Filters of so many keys (72 MB) are the largest that are sent whole to executors. Beyond it rows are joined unscreened: slower, with the same result.
BROADCAST_KEYS = 64_000_000
BUCKET_KEYS = 1 << 16
FILTER_SCHEMA = "bucket int, seed long, segment int, segments int, slots binary"


@dataclass
class BinaryFuse8:
    seed: int
    segment: int
    segments: int  # without the last two, which keys of the last segments reach into
    slots: np.ndarray  # uint8

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + U64(seed))
        start = ((h >> U64(32)) * U64(segments) >> U64(32)).astype(np.int64) * segment
        inner = mix(h ^ U64(0xA5A5A5A5A5A5A5A5))
        mask = U64(segment - 1)
        at = np.stack([start + k * segment + ((inner >> U64(20 * k)) & mask).astype(np.int64) for k in range(3)])
        return at, (h & U64(255)).astype(np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray) -> BinaryFuse8:
        """The filter of a set of keys (repeats are dropped)."""
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = 1 << min(18, max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3))) if n > 1 else 2
        segments = max(1, math.ceil(n * factor / segment) - 2)
        for attempt in range(100):
            seed = int(mix(np.array([attempt + 1], np.uint64))[0])
            if attempt and attempt % 20 == 0:
                segments = math.ceil(segments * 1.1) + 1
            slots = cls._peel(keys, seed, segment, segments)
            if slots is not None:
                return cls(seed, segment, segments, slots)
        raise RuntimeError("no binary-fuse filter was found")

    @classmethod
    def _peel(cls, keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray | None:
        at, mark = cls._places(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        which = np.zeros(size, np.int64)  # exclusive or of the indexes of the keys in a slot
        for k in range(3):
            np.bitwise_xor.at(which, at[k], np.arange(len(keys)))
        layers, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, first = np.unique(which[alone], return_index=True)
            slot = alone[first]
            layers.append((key, slot))
            left -= len(key)
            touched = at[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            for k in range(3):
                np.bitwise_xor.at(which, touched[k], key)
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if left:
            return None
        slots = np.zeros(size, np.uint8)
        for key, slot in reversed(layers):
            three = at[:, key]
            value = mark[key] ^ slots[three[0]] ^ slots[three[1]] ^ slots[three[2]]
            slots[slot] ^= value
        return slots

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, mark = self._places(np.asarray(keys, np.uint64), self.seed, self.segment, self.segments)
        return self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]] == mark

    def to_row(self) -> tuple[int, int, int, bytes]:
        return self.seed - (1 << 64) if self.seed >= 1 << 63 else self.seed, self.segment, self.segments, self.slots.tobytes()

    @classmethod
    def from_row(cls, seed: int, segment: int, segments: int, slots: bytes) -> BinaryFuse8:
        return cls(int(seed) & (2**64 - 1), int(segment), int(segments), np.frombuffer(slots, np.uint8))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.shiftright(key, 20), F.lit(buckets)).cast("int")


class BucketFilters:
    """The filters of all buckets, end to end: a key is looked for in its bucket's."""

    def __init__(self, rows: list[tuple], buckets: int):
        size = np.array([len(r[4]) for r in rows], np.int64)
        self.buckets, self.slots = buckets, np.frombuffer(b"".join(bytes(r[4]) for r in rows), np.uint8)
        self.seed, self.segment, self.segments, self.at = np.zeros(buckets, np.uint64), np.zeros(buckets, np.int64), np.zeros(buckets, np.uint64), np.full(buckets, -1, np.int64)
        b = np.array([r[0] for r in rows], np.int64)
        self.seed[b] = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        self.segment[b], self.segments[b], self.at[b] = [r[2] for r in rows], [r[3] for r in rows], np.cumsum(size) - size

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each long may be in its bucket; surely not where False."""
        b = (keys >> 20) % self.buckets
        out = self.at[b] >= 0
        keys, b = keys[out].view(np.uint64), b[out]
        segment, h = self.segment[b], mix(keys + self.seed[b])
        start = self.at[b] + ((h >> U64(32)) * self.segments[b] >> U64(32)).astype(np.int64) * segment
        inner, mask = mix(h ^ U64(0xA5A5A5A5A5A5A5A5)), (segment - 1).astype(np.uint64)
        found = np.zeros(len(keys), np.uint8)
        for k in range(3):
            found ^= self.slots[start + k * segment + ((inner >> U64(20 * k)) & mask).astype(np.int64)]
        out[out] = found == (h & U64(255)).astype(np.uint8)
        return out


def screening(keys: DataFrame, key: str) -> Callable[[], BucketFilters] | None:
    """Filters of a long column for the executors, or None beyond BROADCAST_KEYS.

    Executors build a filter for each bucket of some BUCKET_KEYS keys; the driver gathers the filters, 9 bits a key, never the keys.
    """
    spark, n = keys.sparkSession, keys.count()
    if n > BROADCAST_KEYS:
        return None
    buckets = max(1, -(-n // BUCKET_KEYS))

    def build(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse8.of(rows["k"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([(int(group[0]), *f.to_row())], columns=["bucket", "seed", "segment", "segments", "slots"])

    k = keys.select(F.col(key).cast("long").alias("k")).where("k is not null").withColumn("bucket", bucket_of(F.col("k"), buckets))
    rows = k.groupBy("bucket").applyInPandas(build, FILTER_SCHEMA).collect() if n else []
    return shared(spark, BucketFilters([tuple(r) for r in rows], buckets))


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key (a long column) surely isn't in the column key of keys, and those where it may be.

    Where keys number up to BROADCAST_KEYS, the rows are screened by filters in each executor, so that rows
    which are surely absent are never shuffled. Beyond that the first part is empty. A null key is surely absent.
    The caller joins the second part exactly.
    """
    found = screening(keys, key)
    if found is None:
        return df.where(F.col(key).isNull()), df.where(F.col(key).isNotNull())

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        return pd.Series(found().contains(k.to_numpy(np.int64)))

    test = F.col(key).isNotNull() & maybe(F.coalesce(F.col(key), F.lit(0).cast("long")))
    return df.where(~test), df.where(test)
