"""A deterministic sharded WARC writer, and a reader.

1. Records are ordered by (url, page_id, MD5 of html, html); nulls first. The keys alone are sorted by ranges, and the
   bytes of the pages before each are summed up; a shard starts wherever that sum passes a multiple of SHARD_BYTES. So
   the same table has the same shards however it is partitioned, and a hot host or url is cut like any other. The driver
   gets the first key of each shard, MAX_SHARDS at most: larger tables have larger shards.
2. Each shard is one partition, sorted. Its writer compresses each record as a gzip member of its own and rolls
   to the next file once a file has ROLL_BYTES of compressed records.
3. Headers are made anew from the row: the HTTP block, Content-Length, SHA-1 digests of block and payload in
   base 32, and a record id that is derived from key and digest. The date is a parameter. So a run's bytes are a
   function of the table and the parameters.
4. A file is written under a temporary name of its own attempt and renamed when complete. An attempt that is
   lost leaves only a temporary file; one that is repeated writes the same bytes to the same name. When the
   index, which lists every record with file, offset and length, is complete, the driver writes the manifest of
   files under a temporary name, renames it and removes temporary files. Readers trust the manifest alone.

Defined results: a null url is written as urn:page:<page_id> (urn:page:null without one); blanks and control
characters in a url are percent-encoded. A null html is an empty payload. Repeated rows are repeated records
with the same record id. An empty table has an empty manifest. Further columns aren't written.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import drop_written, picked, shared, written

SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
MAX_SHARDS = 1 << 17
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
MANIFEST = "MANIFEST.json"
_INDEX = "page_id long, url string, file string, offset long, length long, record_id string, payload_digest string, block_digest string, payload_bytes long"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _target(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{'null' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), url)


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[bytes, str, str, str, int]:
    """(WARC record, record id, payload digest, block digest, payload size)."""
    payload = (html or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    of_payload, of_block = _digest(payload), _digest(block)
    target = _target(url, page_id)
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{target} {page_id} {of_block}')}>"
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {target}\r\nWARC-Date: {date}\r\nWARC-Record-ID: {record_id}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: {of_payload}\r\nWARC-Block-Digest: {of_block}\r\n"
        f"X-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n", record_id, of_payload, of_block, len(payload)


def _info(name: str, date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    record_id = uuid.uuid5(uuid.NAMESPACE_URL, name)
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:{record_id}>\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nWARC-Block-Digest: {_digest(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _File:
    """One file under a temporary name, renamed by close()."""

    def __init__(self, fs: pafs.FileSystem, folder: str, name: str, date: str):
        self.fs, self.name, self.final = fs, name, f"{folder}/{name}"
        self.temporary = f"{folder}/_temporary-{uuid.uuid4().hex}-{name}"
        self.out = fs.open_output_stream(self.temporary, compression=None)
        self.size = 0
        self.add(_member(_info(name, date)))

    def add(self, member: bytes) -> tuple[int, int]:
        at = self.size
        self.out.write(member)
        self.size += len(member)
        return at, len(member)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)


def _keys(pages: DataFrame) -> DataFrame:
    return picked(pages, page_id="long", url="string", html="string").withColumn("digest", F.md5(F.col("html").cast("binary")))


def shard_bounds(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """The first key (url, page_id, digest) of each shard but the first."""
    size = (F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 512).alias("size")
    keys = ["url", "page_id", "digest"]
    k = pages.select(*keys, size)
    total = k.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if total <= shard_bytes:
        return []
    shard_bytes = max(shard_bytes, -(-total // MAX_SHARDS))
    placed = written(k.orderBy(*keys).withColumn("place", F.monotonically_increasing_id()), "warc-keys").withColumn("part", F.shiftright("place", 33))
    begin, at = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("size").alias("n")).collect()):  # a row for each partition
        begin.append((part, at))
        at += n
    starts = pages.sparkSession.createDataFrame(begin, "part long, begin long")
    before = F.sum("size").over(Window.partitionBy("part").orderBy("place")) - F.col("size")
    start = placed.withColumn("before", before).join(F.broadcast(starts), "part").withColumn("shard", F.floor((F.col("begin") + F.col("before")) / F.lit(shard_bytes)))
    first = start.groupBy("shard").agg(F.min(F.struct(*keys)).alias("k")).select("shard", "k.*").where("shard > 0").collect()
    found = sorted({_comparable(r["url"], r["page_id"], r["digest"]) for r in first})
    drop_written(placed)
    return found


def _comparable(url: str | None, page_id: int | None, digest: str | None) -> tuple:
    return url is not None, url or "", page_id is not None, page_id or 0, digest is not None, digest or ""


def write(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files to path; returns the index of records."""
    spark = pages.sparkSession
    pages = _keys(pages)
    bounds = shard_bounds(pages, shard_bytes)
    fs, folder = _filesystem(path)
    fs.create_dir(folder, recursive=True)
    # MAX_SHARDS keys at most, some 20 MB; sent once to each executor.
    sent = shared(spark, bounds)

    @F.arrow_udf("int")
    def shard(url: pa.Array, page_id: pa.Array, digest: pa.Array) -> pa.Array:
        at = sent()
        return pa.array([bisect.bisect_right(at, _comparable(*k)) for k in zip(url.to_pylist(), page_id.to_pylist(), digest.to_pylist())], pa.int32())

    order = ["shard", "url", "page_id", "digest", "html"]
    placed = pages.withColumn("shard", shard("url", "page_id", "digest") if bounds else F.lit(0))
    placed = placed.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(path)
        file, number, at_shard = None, 0, None
        for batch in batches:
            rows = []
            for page_id, url, html, shard in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "shard"))):
                if file and (shard != at_shard or file.size >= roll_bytes):
                    file.close()
                    file, number = None, number + 1 if shard == at_shard else 0
                if not file:
                    at_shard = shard
                    file = _File(fs, folder, f"part-{shard:07d}-{number:05d}.warc.gz", date)
                data, record_id, payload, block, size = record(page_id, url, html, date)
                rows.append((page_id, url, file.name, *file.add(_member(data)), record_id, payload, block, size))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "url", "file", "offset", "length", "record_id", "payload_digest", "block_digest", "payload_bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if file:
            file.close()

    index = f"{path}/_index"
    placed.mapInArrow(run, _INDEX).write.mode("overwrite").parquet(index)
    out = spark.read.schema(_INDEX).parquet(index)
    _commit(out, fs, folder)
    return out


def _commit(index: DataFrame, fs: pafs.FileSystem, folder: str) -> None:
    # A row for each file, 16 MB of records or more: 6 million at most at 100 TB.
    files = index.groupBy("file").agg(F.count("*").alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes")).orderBy("file").toLocalIterator()
    temporary = f"{folder}/_temporary-{uuid.uuid4().hex}-{MANIFEST}"
    with fs.open_output_stream(temporary) as f:
        for r in files:
            f.write((json.dumps(r.asDict(), sort_keys=True) + "\n").encode())
    fs.move(temporary, f"{folder}/{MANIFEST}")
    for left in fs.get_file_info(pafs.FileSelector(folder)):
        if left.base_name.startswith("_temporary-"):
            fs.delete_file(left.path)


def parse(data: bytes) -> dict:
    """Header fields, block and payload of one record; its digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if _digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"the block of {fields['WARC-Record-ID']} has another digest")
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else block
    return {"fields": fields, "block": block, "payload": payload}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of the records of the manifest's files, read by file; null html comes back as an empty one."""
    fs, folder = _filesystem(path)
    names = [json.loads(x)["file"] for x in fs.open_input_stream(f"{folder}/{MANIFEST}").read().splitlines()]
    schema = "page_id long, url string, html string"
    if not names:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                for data in members(fs.open_input_stream(f"{folder}/{name}", compression=None).read()):
                    r = parse(data)
                    if r["fields"]["WARC-Type"] == "response":
                        page, target = r["fields"]["X-Page-Id"], r["fields"]["WARC-Target-URI"]
                        rows.append((int(page) if page else None, None if target.startswith("urn:page:") else target, r["payload"].decode("utf-8", "replace")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "html"])

    return files.mapInArrow(run, schema)


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, each inflated."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise gzip.BadGzipFile("a member is cut off")
            piece = view[at : at + (1 << 16)]
            out.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(out)
