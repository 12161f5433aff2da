"""Corpora: folders of one dataset or of several, their splits, and the sinks of cleaned and rejected rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {"parquet": "parquet", "json": "json", "jsonl": "json", "txt": "text"}


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    df = spark.read.format(READERS[kind]).load(path)
    return df.withColumnRenamed("value", "text") if READERS[kind] == "text" else df


def _entries(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return sorted((s.getPath().toString(), s.isDirectory()) for s in found if not s.getPath().getName().startswith(("_", ".")))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One table of a folder: its own files, or else those of each folder in it, put together by name.

    Files are told apart by their ending (parquet, json, jsonl, txt). A folder in which nothing can be read is an error.
    """
    entries = _entries(spark, path)
    kinds = sorted({p.rpartition(".")[2] for p, _ in entries} & set(READERS))
    if kinds:
        return concatenated([_read(spark, f"{path}/*.{k}" if any(not d for p, d in entries if p.endswith(k)) else path, k) for k in kinds])
    below = [read_corpus(spark, p) for p, is_dir in entries if is_dir]
    if not below:
        raise ValueError(f"no dataset in {path}")
    return concatenated(below)


def concatenated(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns; nothing is dropped."""
    return reduce(DataFrame.unionByName, parts)


def of_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """One table of named splits, with their name as the column split."""
    return concatenated(df.withColumn("split", F.lit(name)) for name, df in splits.items())


def texts(df: DataFrame) -> DataFrame:
    """The column text alone; of conversations the contents of their messages, one row for each."""
    return df.select(F.explode("messages.content").alias("text")) if is_conversational(df) else df.select("text")


def is_conversational(df: DataFrame) -> bool:
    return "messages" in df.columns and "text" not in df.columns


def clean_messages(df: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) rows of a table with messages, an array of (role, content): rejected if any message has such a character."""
    hit = F.coalesce(F.exists("messages", lambda m: F.coalesce(m["content"].rlike(pattern), F.lit(False))), F.lit(False))
    return df.where(~hit), df.where(hit)


def write_cleaned(kept: DataFrame, path: str) -> None:
    """Cleaned rows, a folder for each split where there is one."""
    w = kept.write.mode("overwrite")
    (w.partitionBy("split") if "split" in kept.columns else w).parquet(path)


def reject_entry(split: Column, index: Column, groups: Column, text: Column) -> Column:
    """A rejected text with the groups found in it, as an entry of a log."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")))
    return F.concat_ws("\n", line("Split", split), line("Index", index), line("Detected Languages", F.array_join(F.sort_array(groups), ", ")), line("Text", text), F.lit("-" * 80))
