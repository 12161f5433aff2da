"""What the operators share: tables, the shared folder, and state that a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own where it isn't set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set, and a cluster has no folder that all executors share without it")
        found = getattr(shared_dir, "own", None)
        if not found:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The table, written to the shared folder and read again: its lineage is cut and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def worker_state() -> dict:
    """A dict that lives as long as the Python process: models and caches outlast a task in it."""
    return sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__


def freed() -> None:
    """Gives memory that this process doesn't use any more back to the system: workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def ending_freed(batches: Iterable) -> Iterator:
    """What is given; at its end, unused memory goes back."""
    yield from batches
    freed()


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives the value on the executors. It is broadcast with its classes' code, so that they need no package of ours."""
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def get() -> object:
        kept = worker_state().setdefault("shared", {})
        if key not in kept:
            while len(kept) >= 4:
                kept.pop(next(iter(kept)))
            kept[key] = pickle.loads(sent.value)
            sent.__dict__.pop("_value", None)  # the bytes aren't needed any more
        return kept[key]

    return get


def _place(df: DataFrame, name: str) -> int:
    """The place of the column of just this name; names that differ in case only count where there is no such column."""
    names = df.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name)


def picked(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast, whatever other columns there are."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{_place(df, name)}").cast(kind).alias(name) for name, kind in kinds.items()])


def id_and_text(docs: DataFrame) -> DataFrame:
    return picked(docs, doc_id="long", text="string")


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): all columns in one struct, so that no name of theirs meets one of ours."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.select(F.struct(*plain.columns).alias("row"), *[F.col(f"c{_place(docs, n)}").cast(k).alias(n) for n, k in (("doc_id", "long"), ("text", "string"))])


def unpacked(df: DataFrame, like: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of like from df's column row; text: the column that takes the place of the one of that name."""
    row = F.col("row") if text is None else F.col("row").withField(f"c{_place(like, 'text')}", F.col(text))
    return df.select(row.alias("row")).select("row.*").toDF(*like.columns)
