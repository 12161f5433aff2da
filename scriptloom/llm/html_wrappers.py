"""HTML extraction by inference of union-free regular expressions (wrappers), one for each host.

A page is a stream of tags and texts. A wrapper is a sequence of tags, fixed texts, text slots #, optional
groups (...)? and repeated groups (...)+; it has no alternatives.

1. On each page, a group of tokens that follows itself becomes a repeated group, inner groups first, until
   none is left. Pages of a host with the same folded stream are one sample from here on: a text that is the
   same in all of them stays fixed, others become slots. This merging is associative, so most of it happens
   before the shuffle, and a host of any number of pages sends a row for each folded stream and batch.
2. A host's wrapper starts as its most frequent stream; the others are aligned with it one after another. The
   alignment has the most tokens in common; a repeated group may stand against one or more plain copies of
   its body. At a mismatch, tokens that only one side has become an optional group; texts that differ become
   a slot.
3. The wrapper's texts keep through all alignments which texts of which stream they stand for, so every text of
   a stream goes to a slot or equals a fixed text. Pages look their stream up and give the texts of their slots.

Only folded streams are shuffled, never pages, as long as the table of streams is LOOKUP_BYTES at most; beyond
that pages are joined with it by host and stream.

Defined results: tags are compared by name, without attributes; comments, doctype and what is inside script,
style, noscript and template are left out; entities are resolved and white space is collapsed. A null or empty
page has no slots and an empty text. A text that only one page of a host has
at its place is a slot, as nothing says that it is fixed.
Pages without a url, or without a host in it, are one host named "". Repeated rows give repeated rows and count as
pages. Further columns are ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import written

GROUP_TOKENS = 48
LOOKUP_BYTES = 64 << 20
_STREAMS = "host string, stream string, texts array<long>, pages long"
_MAPS = "host string, stream_id long, slots array<int>, wrapper string"
_OUT = "page_id long, host string, text string, n_slots int, slots array<struct<slot:int,text:string>>"
_LEFT_OUT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>")
_SQUARE = re.compile(r"(.{1,%d}?)\1+" % GROUP_TOKENS, re.S)
_TEXT = ""
_VARIES = 0


def tokens(page: str | None) -> list[tuple[str, str]]:
    """("tag", name) and ("text", words) of a page; a < that begins no tag is text."""
    out: list[tuple[str, str]] = []
    parts = _TAG.split(_LEFT_OUT.sub("", page or ""))
    for k, part in enumerate(parts):
        if k & 1:
            out.append(("tag", part.lower()))
        elif part and (text := " ".join((html_entities.unescape(part) if "&" in part else part).split())):
            out.append(("text", text))
    return out


def fold(stream: list[tuple[str, str]]) -> tuple[str, list[list[str]]]:
    """(folded stream as a string, the texts that each of its # stands for)."""
    codes: dict[str, str] = {}
    names: dict[str, str] = {_TEXT: "#"}
    coded, items = [], []
    for kind, value in stream:
        if kind == "text":
            coded.append(_TEXT)
            items.append([[value]])
        else:
            c = codes.get(value)
            if c is None:
                c = codes[value] = chr(0x100000 + len(codes))
                names[c] = f"<{value}>"
            coded.append(c)
            items.append([])
    s = "".join(coded)
    bodies: dict[str, str] = {}
    while True:
        out, kept, at = [], [], 0
        for m in _SQUARE.finditer(s):
            body, n = m[1], len(m[1])
            rep = bodies.get(body)
            if rep is None:
                inner = "".join(names[c] for c in body)
                # A repeat whose whole body is a repeat is that repeat.
                rep = bodies[body] = body if n == 1 and inner.endswith("}") else chr(0xF0000 + len(bodies))
                names.setdefault(rep, "{" + inner + "}")
            out += [s[at : m.start()], rep]
            kept += items[at : m.start()]
            copies = [[x for item in items[k : k + n] for x in item] for k in range(m.start(), m.end(), n)]
            kept.append([[t for c in same for t in c] for same in zip(*copies)])
            at = m.end()
        if not at:
            break
        s, items = "".join(out) + s[at:], kept + items[at:]
    return "".join(names[c] for c in s), [x for item in items for x in item]


def _parse(stream: str) -> list:
    """Nodes of a folded stream: "<tag>", "#" or ("rep", nodes)."""
    stack: list[list] = [[]]
    for m in re.finditer(r"<[^>]*>|[#{}]", stream):
        if m[0] == "{":
            stack.append([])
        elif m[0] == "}":
            body = stack.pop()
            stack[-1].append(("rep", body))
        else:
            stack[-1].append(m[0])
    return stack[0]


def _text_hash(texts: list[str]) -> int:
    """A hash of a text that is the same wherever it stands, or 0."""
    if any(t != texts[0] for t in texts):
        return _VARIES
    return (xxhash.xxh3_64_intdigest(texts[0].encode()) >> 1) or 1


class Node:
    """kind: tag, text or rep. A text's value is its hash, or 0 for a slot; seen has the numbers of the samples' texts it stands for."""

    __slots__ = ("kind", "name", "value", "body", "pages", "optional", "slot", "seen")

    def __init__(self, kind: str, name: str = "", value: int = 0, body: list[Node] | None = None, pages: int = 1):
        self.kind, self.name, self.value, self.body, self.pages = kind, name, value, body or [], pages
        self.optional, self.slot = False, -1
        self.seen: list[int] = []

    def copy(self) -> Node:
        n = Node(self.kind, self.name, self.value, [x.copy() for x in self.body], self.pages)
        n.optional, n.seen = self.optional, self.seen
        return n


def nodes_of(stream: str, texts: list[int], pages: int = 1, start: int = 0) -> list[Node]:
    """The nodes of a folded stream; its texts have the numbers from start on."""
    left = enumerate(texts, start)

    def text() -> Node:
        k, value = next(left)
        n = Node("text", value=value, pages=pages)
        n.seen = [k]
        return n

    def make(parsed: list) -> list[Node]:
        return [text() if x == "#" else Node("rep", body=make(x[1])) if isinstance(x, tuple) else Node("tag", x) for x in parsed]

    return make(_parse(stream))


def _alike(a: Node, b: Node) -> int:
    """The number of tokens that two nodes have in common, if they can stand against each other."""
    if a.kind != b.kind:
        return 0
    if a.kind == "tag":
        return 2 * (a.name == b.name)
    if a.kind == "text":
        return 1
    first = lambda x: x[0].name if x and x[0].kind == "tag" else x[0].kind if x else ""
    return sum(s for *_, s in align(a.body, b.body)) if first(a.body) == first(b.body) else 0


def align(a: list[Node], b: list[Node]) -> list[tuple[list[Node], list[Node], int]]:
    """Steps of the best alignment: (nodes of a, nodes of b, common tokens); one node of each, or one side is
    empty, or a repeated group stands against a copy of its body."""
    head = 0
    while head < min(len(a), len(b)) and (a[head].kind == b[head].kind == "tag" and a[head].name == b[head].name):
        head += 1
    if head:
        return [([x], [y], 2) for x, y in zip(a[:head], b[:head])] + align(a[head:], b[head:])
    tail = 0
    while tail < min(len(a), len(b)) and (a[-1 - tail].kind == b[-1 - tail].kind == "tag" and a[-1 - tail].name == b[-1 - tail].name):
        tail += 1
    if tail:
        return align(a[:-tail], b[:-tail]) + [([x], [y], 2) for x, y in zip(a[-tail:], b[-tail:])]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    step: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if i == n and j == m:
                continue
            value, how = -1, (0, 0, 0)
            if i < n and j < m:
                s = _alike(a[i], b[j])
                if s:
                    value, how = best[i + 1][j + 1] + s, (1, 1, s)
                for x, y, p, q, side in ((a, b, i, j, 0), (b, a, j, i, 1)):
                    if x[p].kind == "rep" and (k := len(x[p].body)) <= len(y) - q:
                        s = sum(s if (s := _alike(u, v)) else -99 for u, v in zip(x[p].body, y[q : q + k]))
                        to = (i + 1, j + k) if side == 0 else (i + k, j + 1)
                        if s > 0 and best[to[0]][to[1]] + s > value:
                            value, how = best[to[0]][to[1]] + s, (to[0] - i, to[1] - j, s)
            if i < n and best[i + 1][j] > value:
                value, how = best[i + 1][j], (1, 0, 0)
            if j < m and best[i][j + 1] > value:
                value, how = best[i][j + 1], (0, 1, 0)
            best[i][j], step[i, j] = value, how
    out, i, j = [], 0, 0
    while (i, j) != (n, m):
        p, q, s = step[i, j]
        out.append((a[i : i + p], b[j : j + q], s))
        i, j = i + p, j + q
    return out


def _generalised(a: Node, b: Node) -> Node:
    out = a.copy()
    out.optional, out.pages = a.optional or b.optional, a.pages + b.pages
    # The longer list grows, so that a wrapper's isn't copied for each sample; a and b aren't used any more.
    more, less = (a.seen, b.seen) if len(a.seen) >= len(b.seen) else (b.seen, a.seen)
    more += less
    out.seen = more
    if a.kind == "text" and a.value != b.value:
        out.value = _VARIES
    if a.kind == "rep":
        out.body = merge(a.body, b.body)
    return out


def merge(wrapper: list[Node], sample: list[Node]) -> list[Node]:
    """The wrapper that also matches the sample."""
    out = []
    for x, y, _ in align(wrapper, sample):
        if len(x) == len(y) == 1 and x[0].kind == y[0].kind:
            out.append(_generalised(x[0], y[0]))
        elif not x or not y:
            for node in x or y:
                new = node.copy()
                new.optional = True
                out.append(new)
        else:
            rep, plain = (x[0], y) if x[0].kind == "rep" and len(x) == 1 else (y[0], x)
            new = Node("rep", body=[_generalised(u, v) for u, v in zip(rep.body, plain)])
            new.optional = rep.optional or all(v.optional for v in plain)
            out.append(new)
    return out


def number(wrapper: list[Node], start: int = 0) -> int:
    """Numbers the slots, a text that only one page has among them; returns the next number."""
    for x in wrapper:
        if x.kind == "text" and (x.value == _VARIES or x.pages < 2):
            x.value, x.slot, start = _VARIES, start, start + 1
        start = number(x.body, start) if x.body else start
    return start


def shown(wrapper: list[Node]) -> str:
    out, inside = [], False
    for x in wrapper:
        if x.optional != inside:
            out.append("(" if x.optional else ")?")
            inside = x.optional
        out.append(x.name if x.kind == "tag" else "(" + shown(x.body) + ")+" if x.kind == "rep" else "#" if x.value == _VARIES else "=")
    return "".join(out) + (")?" if inside else "")


def placed(wrapper: list[Node], slots: list[int]) -> None:
    """Sets the slots of the texts that the wrapper's texts stand for."""
    for x in wrapper:
        for k in x.seen:
            slots[k] = x.slot
        placed(x.body, slots)


def infer(samples: list[tuple[str, list[int], int]]) -> tuple[list[Node], list[list[int]]]:
    """The wrapper of samples (folded stream, hashes of texts, pages), most frequent first; for each sample's texts, in
    order, the slot they belong to, or -1 for a fixed text."""
    starts = [0, *accumulate(len(texts) for _, texts, _ in samples)]
    wrapper: list[Node] = nodes_of(*samples[0])
    for s, start in zip(samples[1:], starts[1:]):
        wrapper = merge(wrapper, nodes_of(*s, start))
    number(wrapper)
    slots = [-1] * starts[-1]
    placed(wrapper, slots)
    return wrapper, [slots[a:b] for a, b in pairwise(starts)]


def host_of(url: str | None) -> str:
    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "", re.I)
    return m[1].lower() if m else ""


def _stream_id(stream: str) -> int:
    return xxhash.xxh3_64_intdigest(stream.encode()) - (1 << 63)


class _Merger:
    """Samples of (host, stream): hashes of texts that are the same on all pages so far."""

    def __init__(self) -> None:
        self.of: dict[tuple[str, str], list] = {}

    def add(self, key: tuple[str, str], texts: np.ndarray, pages: int) -> None:
        own = self.of.get(key)
        if own is None:
            self.of[key] = [texts, pages]
        else:
            own[0] = np.where(own[0] == texts, own[0], _VARIES)
            own[1] += pages

    def batch(self) -> pa.RecordBatch:
        rows = [(h, s, t.tolist(), n) for (h, s), (t, n) in self.of.items()]
        kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host", "stream", "texts", "pages"])


def _source(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def streams(pages: DataFrame) -> DataFrame:
    """(host, stream, texts, pages): a row for each host, stream and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _Merger()
        for batch in batches:
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                stream, texts = fold(tokens(page))
                merger.add((host_of(url), stream), np.array([_text_hash(t) for t in texts], np.int64), 1)
            if len(merger.of) > 20_000:
                yield merger.batch()
                merger = _Merger()
        if merger.of:
            yield merger.batch()

    return _source(pages).select("url", "html").mapInArrow(run, _STREAMS)


def wrappers(found: DataFrame) -> DataFrame:
    """(host, stream_id, slots, wrapper) of every folded stream; the wrapper is its host's."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        merger = _Merger()
        for host, stream, texts, pages in zip(rows["host"], rows["stream"], rows["texts"], rows["pages"]):
            merger.add((host, stream), np.asarray(texts, np.int64), int(pages))
        every = sorted(((-n, stream, t) for (_, stream), (t, n) in merger.of.items()), key=lambda x: x[:2])
        host = rows["host"].iloc[0]
        samples = [(stream, t.tolist(), -n) for n, stream, t in every]
        wrapper, where = infer(samples)
        text = shown(wrapper)
        return pd.DataFrame({"host": host, "stream_id": [_stream_id(s) for s, *_ in samples], "slots": where, "wrapper": text})

    return found.groupBy("host").applyInPandas(run, _MAPS)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, text, n_slots, slots): the texts of each page's slots, in the page's order of slots."""
    spark = pages.sparkSession
    maps = written(wrappers(streams(pages)), "wrappers").select("host", "stream_id", "slots")
    size = maps.agg(F.coalesce(F.sum(F.octet_length("host") + 4 * F.size("slots") + 64), F.lit(0))).first()[0]
    source = _source(pages)

    def row(page_id, host: str, texts: list[list[str]], slots) -> tuple:
        out = [{"slot": int(s), "text": t} for s, own in zip(slots, texts) if s >= 0 for t in own]
        return page_id, host, "\n".join(x["text"] for x in out), len({x["slot"] for x in out}), out

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))]
    names = ["page_id", "host", "text", "n_slots", "slots"]

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    if size <= LOOKUP_BYTES:
        table = maps.toArrow()
        lookup = dict(zip(zip(table["host"].to_pylist(), table["stream_id"].to_pylist()), table["slots"].to_pylist()))
        shared = spark.sparkContext.broadcast(lookup)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    host, (stream, texts) = host_of(url), fold(tokens(page))
                    rows.append(row(page_id, host, texts, shared.value[host, _stream_id(stream)]))
                if rows:
                    yield arrow(rows)

        return source.mapInArrow(run, _OUT)

    @F.pandas_udf("struct<host:string,stream_id:long>")
    def key(url: pd.Series, page: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"host": [host_of(u) for u in url], "stream_id": [_stream_id(fold(tokens(p))[0]) for p in page]})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(i, h, fold(tokens(p))[1], s) for i, p, h, s in zip(*(batch.column(c).to_pylist() for c in ("page_id", "html", "host", "slots")))]
            if rows:
                yield arrow(rows)

    keyed = source.withColumn("k", key("url", "html")).select("page_id", "html", "k.host", "k.stream_id")
    return keyed.join(maps, ["host", "stream_id"]).select("page_id", "html", "host", "slots").mapInArrow(joined, _OUT)
