"""Sharding by jump consistent hashing.

A key's shard among n is found without a ring table: the key seeds a generator, and the shard jumps forward
while the next jump is below n. Going from n to n + m shards moves a key only to one of the new shards,
and m / (n + m) of the keys in expectation, the least possible.

Keys are the first 64 bits of the MD5 of the key column's string form, so they don't depend on the engine
or on where a row lies. A null key is hashed as the empty string. Repeated rows go to the same shard;
every row gets a shard; further columns are kept, and a column named as a new one, in
any case, is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
SHARDS_NEXT = 80
_LCG = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    key = keys.astype(np.uint64).copy()
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * _LCG + np.uint64(1)
        step = 2147483648.0 / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        j[live] = ((b[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[j[live] < shards]
    return b


def key_of(c: Column) -> Column:
    """64 bits as a signed long."""
    digest = F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    high, low = (F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def shard_of(c: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def udf(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return udf(key_of(c))


def _must_be_new(df: DataFrame, *names: str) -> None:
    there = {c.lower() for c in df.columns}
    if taken := [n for n in names if n.lower() in there]:
        raise ValueError(f"there is a column {taken[0]} already")


def assign(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, out: str = "shard") -> DataFrame:
    """The table with each row's shard. No shuffle; only the key goes through Python."""
    _must_be_new(df, out)
    return df.withColumn(out, shard_of(F.col(f"`{key}`"), shards))


def write(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, file_rows: int = 1_000_000) -> None:
    """Writes the rows to a folder shard=k for each shard, in files of some file_rows rows: one shuffle, by shard and a salt
    that spreads a shard's rows, those of a hot key too, over its files."""
    files = max(1, -(-df.count() // (shards * file_rows)))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) + F.spark_partition_id(), F.lit(files))
    placed = assign(df, key, shards)
    placed.repartition(min(shards * files, 100_000), "shard", salt).write.partitionBy("shard").parquet(path)


def plan_growth(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, to: int = SHARDS_NEXT) -> DataFrame:
    """The table with each row's shard now and after shards are appended, and whether it moves."""
    if to < shards:
        raise ValueError("shards can only be appended")
    _must_be_new(df, "shard", "next_shard", "moves")
    now = assign(df, key, shards)
    return assign(now, key, to, "next_shard").withColumn("moves", F.col("shard") != F.col("next_shard"))


#: DuckDB: the same walk as a recursive query; 128-bit arithmetic stands for wrapping 64-bit products.
ORACLE_SQL = """
WITH RECURSIVE keyed AS (
  SELECT row_number() OVER () AS rn, documents.*,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16))::UBIGINT)::UHUGEINT AS key FROM documents),
walk(rn, n, key, b, j) AS (
  SELECT rn, n, key, -1::BIGINT, 0::BIGINT FROM keyed, (VALUES ({now}), ({to})) t(n)
  UNION ALL
  SELECT rn, n, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT rn, n, j, (key * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k2 FROM walk WHERE j < n)),
done AS (SELECT rn, n, b FROM walk WHERE j >= n)
SELECT k.* EXCLUDE (rn, key), a.b::INT AS shard, c.b::INT AS next_shard, a.b <> c.b AS moves
FROM keyed k JOIN done a ON a.rn = k.rn AND a.n = {now} JOIN done c ON c.rn = k.rn AND c.n = {to}
""".replace("{now}", str(SHARDS)).replace("{to}", str(SHARDS_NEXT))
