"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has a node before and after each character and an edge for each vocabulary piece. A
path's score is the sum of its pieces' scores in the model file. Forward Viterbi gives the best score from
the start to each node; that is the exact remaining cost of a search that runs backward from the end, so
A* pops complete segmentations in order of score.

A node is a cut of the lattice where no piece holds the two bytes around it next to each other, such as before
a space (the mark U+2581 in pieces). No edge crosses a cut, so forward scores are computed once for each distinct
unit between cuts, by one array program for many units at once, together with the gap to the unit's second best
path. The N best paths of the whole text change only the N - 1 units of least gap, so A* runs on those alone and
a heap joins them. This is the search over the whole text's lattice without its repeated parts.

A character in no piece is an edge of the score (least piece score - 10) and is written as the byte pieces
of its UTF-8 form.

Defined results: a null text gives a null list; an empty one the single empty segmentation of score 0.
Segmentations of equal score come in an order that the text and the model determine; rank 1 prefers longer
last pieces. Where fewer than N exist, all are given. U+2581 in a text is a space. Columns besides doc_id
and text are ignored, repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import ending_freed, id_and_text, worker_state
from scriptloom.llm.textbatch import U64, byte_buffer, chunks, span_hashes

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
SPACE = "▁"
#: Units of more bytes go one by one: a level of the array program would hold too few. The result is the same.
LONGEST_AT_ONCE = 64
BLOCK_BYTES = 1 << 17
CACHED_UNITS = 300_000
SCHEMA = "doc_id long, n_tokens int, round_trip boolean, segmentations array<struct<score:double,ids:array<int>>>"

_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, rule = True, "identity"
        for field, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif field == 3:
                for f, v in _fields(value):
                    if f == 1:
                        rule = v.decode()
                    elif f == 3:
                        self.dummy_prefix = bool(v)
        if rule != "identity":
            raise ValueError(f"the model normalizes texts by {rule}; only identity is known here")
        self.usable = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (_NORMAL, _USER)}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.unknown_id = self.kinds.index(_UNKNOWN)
        self.unknown_score = min(s for s, k in zip(self.scores, self.kinds) if k == _NORMAL) - 10
        self.longest = max(map(len, self.usable))
        self._trie()
        blobs = [bytes([int(p[1:-1], 16)]) if k == _BYTE else b"" if k == _CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.blob_size = np.array([len(b) for b in blobs], np.int64)
        self.blob_at = np.cumsum(self.blob_size) - self.blob_size
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)

    def _trie(self) -> None:
        """A double array of the pieces' bytes, a space for the mark: the child of a state by a byte is child[base[state] + byte], if check has the state there."""
        children: dict[int, int] = {}
        piece = [-1]
        self.beside = np.zeros((256, 256), bool)  # pairs of bytes that some piece has side by side
        for p, i in self.usable.items():
            state, data = 0, p.replace(SPACE, " ").encode()
            for b in data:
                key = state << 8 | b
                state = children.get(key, 0)
                if not state:
                    state = children[key] = len(piece)
                    piece.append(-1)
            piece[state] = i
            for x, y in zip(data, data[1:]):
                self.beside[x, y] = True
        self.piece = np.array(piece, np.int32)
        key = np.sort(np.fromiter(children, np.int64))
        parent, byte, to = key >> 8, key & 255, np.array([children[k] for k in key.tolist()], np.int32)
        size = 1 << (3 * len(key) + 512).bit_length()
        self.base = np.zeros(len(piece), np.int32)
        self.check, self.child = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        nodes, first, count = np.unique(parent, return_index=True, return_counts=True)
        rng = np.random.default_rng(1)
        for n in np.unique(count)[::-1].tolist():  # states of most children first, at places drawn until they are free
            left = np.flatnonzero(count == n)
            while len(left):
                base = rng.integers(0, size - 256, len(left))
                edge = first[left][:, None] + np.arange(n)
                slot = base[:, None] + byte[edge]
                _, one = np.unique(slot, return_index=True)
                free = np.zeros(slot.size, bool)
                free[one] = True
                good = (free.reshape(slot.shape) & (self.check[slot] < 0)).all(axis=1)
                self.base[nodes[left[good]]] = base[good]
                self.check[slot[good]] = nodes[left[good]][:, None]
                self.child[slot[good]] = to[edge[good]]
                left = left[~good]
        self.score = np.array([*self.scores, self.unknown_score])  # at -1 that of an unknown character
        self.byte_id = np.array([self.byte_ids.get(b, self.unknown_id) for b in range(256)], np.int32)

    def escape(self, text: str) -> str:
        return ((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)) if text else ""

    def unknown(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "replace")] if self.byte_ids else [self.unknown_id]

    def edges(self, unit: str) -> list[list[tuple[int, float, int]]]:
        """For each end: (start, score, piece id or -1 for an unknown character), longest piece first."""
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(unit) + 1)]
        for e in range(1, len(unit) + 1):
            for s in range(max(0, e - self.longest), e):
                if (i := self.usable.get(unit[s:e])) is not None:
                    out[e].append((s, self.scores[i], i))
            if not out[e] or out[e][-1][0] != e - 1:
                out[e].append((e - 1, self.unknown_score, -1))
        return out

    def forward(self, edges: list[list[tuple[int, float, int]]]) -> list[float]:
        best = [0.0] * len(edges)
        for e in range(1, len(edges)):
            best[e] = max(best[s] + x for s, x, _ in edges[e])
        return best

    def n_best(self, unit: str, n: int, edges: list | None = None) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a unit: A* from its end, with the forward scores as heuristic."""
        edges = edges or self.edges(unit)
        ahead = self.forward(edges)
        heap = [(-ahead[-1], len(unit), 0, 0.0, None)]
        made, out = 0, []
        while heap and len(out) < n:
            _, at, _, behind, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    (s, e, i), path = path
                    ids += [i] if i >= 0 else self.unknown(unit[s:e])
                out.append((behind, ids))
                continue
            for s, x, i in edges[at]:
                made += 1
                heapq.heappush(heap, (-(ahead[s] + x + behind), s, made, x + behind, ((s, at, i), path)))
        return out

    def best_and_gap(self, unit: str) -> tuple[float, float, list[int]]:
        found = self.n_best(unit, 2)
        return found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf, found[0][1]

    def _edges_of(self, data: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, bytes, piece id or -1) of all edges of units that lie end to end, shorter ones first; to: each byte's end of unit."""
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        live, state, k = begins, np.zeros(len(begins), np.int32), 0
        width = _WIDTHS[data[begins]]
        known = np.zeros(len(data), bool)
        found = []
        while len(live):
            slot = self.base[state] + data[live + k]
            ok = self.check[slot] == state
            live, state, k = live[ok], self.child[slot[ok]], k + 1
            i = self.piece[state]
            hit = i >= 0
            found.append((live[hit], np.full(int(hit.sum()), k), i[hit]))
            if k <= 4:
                known[found[-1][0][_WIDTHS[data[found[-1][0]]] == k]] = True
            inside = live + k < to[live]
            live, state = live[inside], state[inside]
        lone = ~known[begins]
        found.insert(0, (begins[lone], width[lone], np.full(int(lone.sum()), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def many(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of units of so many bytes end to end: best score, gap to the second best score, and the best paths' ids, with their sizes."""
        w = len(size)
        stop = np.cumsum(size)
        first = stop - size
        who = np.repeat(np.arange(w), size)
        start, width, piece = self._edges_of(data, stop[who])
        owner, score = who[start], self.score[piece]
        a = start + owner  # a unit of n bytes has n + 1 nodes
        b = a + width
        inside = start - first[owner]
        begin, end = first + np.arange(w), stop + np.arange(w)
        ahead, back = np.full(len(data) + w, -np.inf), np.zeros(len(data) + w, np.int64)
        ahead[begin] = 0
        for edges in _levels(inside + width):
            x, at = ahead[a[edges]] + score[edges], b[edges]
            np.maximum.at(ahead, at, x)
            best = x >= ahead[at]
            back[at[best]] = edges[best]  # of equal ones the last, which is the longest
        behind = np.full(len(ahead), -np.inf)
        behind[end] = 0
        for edges in reversed(_levels(inside)):
            np.maximum.at(behind, a[edges], behind[b[edges]] + score[edges])
        on, at, path = np.zeros(len(a), bool), end, []
        while len(at):
            path.append(back[at])
            at = a[path[-1]]
            at = at[at != begin[owner[path[-1]]]]
        path = np.concatenate(path)
        path = path[np.argsort(a[path])]
        on[path] = True
        second = np.full(w, -np.inf)
        np.maximum.at(second, owner, np.where(on, -np.inf, ahead[a] + score + behind[b]))
        ids, times = piece[path], np.ones(len(path), np.int64)
        if (ids < 0).any():
            if self.byte_ids:
                times = np.where(ids < 0, width[path], 1)
            place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            ids = np.repeat(ids, times)
            ids = np.where(ids < 0, self.byte_id[data[np.repeat(start[path], times) + place]] if self.byte_ids else self.unknown_id, ids).astype(np.int32)
        return ahead[end], np.maximum(ahead[end] - second, 0), ids, np.bincount(owner[path], times, w).astype(np.int64)

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """The N best segmentations of one whole text, by A* over its whole lattice; for tests and small use."""
        return self.n_best(self.escape(text), n)

    def decode(self, ids: list[int]) -> str:
        out = b"".join(self.blob[self.blob_at[i] : self.blob_at[i] + self.blob_size[i]].tobytes() for i in ids).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out

    def decode_many(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces end to end."""
        size = self.blob_size[ids]
        total = int(size.sum())
        return self.blob[np.arange(total) - np.repeat(np.cumsum(size) - size - self.blob_at[ids], size)]


#: Bytes of a character by its first byte.
_WIDTHS = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)


def _levels(x: np.ndarray) -> list[np.ndarray]:
    """The places of each value of x, by rising value."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    return np.split(order, np.flatnonzero(np.diff(x[order])) + 1)


class _Grown:
    """An array that is appended to, with room to spare."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        need = self.size + len(x)
        if need > len(self.data):
            self.data = np.concatenate((self.data[: self.size], np.zeros(max(need, len(self.data)), self.data.dtype)))
        self.data[self.size : need] = x
        self.size = need


class UnitCache:
    """Best paths of the units met so far, by hash: flat arrays, emptied when they hold too many."""

    def __init__(self, model: PieceModel, most: int = CACHED_UNITS):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes and their rows
        self._score, self._gap, self._at, self._size, self._ids = (_Grown(k) for k in (np.float64, np.float64, np.int64, np.int32, np.int32))
        self.alternatives: dict[tuple[int, int], list] = {}

    score = property(lambda self: self._score.data)
    gap = property(lambda self: self._gap.data)
    at = property(lambda self: self._at.data)
    size = property(lambda self: self._size.data)
    ids = property(lambda self: self._ids.data)

    def _add(self, score, gap, ids, size) -> None:
        self._at.add(self._ids.size + np.cumsum(size) - size)
        for to, x in ((self._score, score), (self._gap, gap), (self._ids, ids), (self._size, size)):
            to.add(x)

    def rows(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows of distinct units, given by rising hashes and their bytes."""
        if len(self.known) > self.most:
            self.clear()
        place = np.searchsorted(self.known, h)
        hit = place < len(self.known)
        hit[hit] = self.known[place[hit]] == h[hit]
        out = np.zeros(len(h), np.int64)
        out[hit] = self.row[place[hit]]
        new = np.flatnonzero(~hit)
        if not len(new):
            return out
        size = (end - start)[new]
        order = np.argsort(size, kind="stable")
        base, total = self._score.size, np.cumsum(size[order])
        many = int(np.searchsorted(size[order], LONGEST_AT_ONCE, "right"))
        done = 0
        while done < many:
            to = max(done + 1, int(np.searchsorted(total[:many], (total[done - 1] if done else 0) + BLOCK_BYTES)))
            some = new[order[done:to]]
            n = end[some] - start[some]
            own = data[np.arange(int(n.sum())) + np.repeat(start[some] - np.cumsum(n) + n, n)]
            self._add(*self.model.many(own, n))
            done = to
        for j in new[order[many:]].tolist():
            score, gap, ids = self.model.best_and_gap(data[start[j] : end[j]].tobytes().decode().replace(" ", SPACE))
            self._add(np.array([score]), np.array([gap]), np.array(ids, np.int32), np.array([len(ids)]))
        out[new[order]] = base + np.arange(len(new))
        self.known = np.insert(self.known, place[new], h[new])
        self.row = np.insert(self.row, place[new], out[new])
        return out

    def others(self, row: int, unit: str, n: int) -> list[tuple[float, np.ndarray]]:
        """(loss against the best path, ids) of the unit's next n best paths."""
        if (row, n) not in self.alternatives:
            own = self.ids[self.at[row] : self.at[row] + self.size[row]].tolist()
            found = self.model.n_best(unit, n + 1)
            rest = [x for x in found if x[1] != own][:n]
            self.alternatives[row, n] = [(self.score[row] - s, np.array(i, np.int32)) for s, i in rest]
        return self.alternatives[row, n]


def _combinations(choices: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums of one loss from each list (0 is the first of each), with the places chosen."""
    start = (0,) * len(choices)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        loss, at = heapq.heappop(heap)
        out.append((loss, at))
        for j, x in enumerate(choices):
            if at[j] + 1 < len(x):
                to = (*at[:j], at[j] + 1, *at[j + 1 :])
                if to not in seen:
                    seen.add(to)
                    heapq.heappush(heap, (loss - x[at[j]] + x[at[j] + 1], to))
    return out


def encode_chunk(model: PieceModel, cache: UnitCache, texts: pa.Array, n: int) -> list[list[tuple[float, np.ndarray]]]:
    """For each text its n best (score, ids)."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    if model.dummy_prefix:
        texts = pc.if_else(pa.array(full), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
    data, off = byte_buffer(texts)
    out: list[list[tuple[float, np.ndarray]]] = [[(0.0, np.zeros(0, np.int32))] for _ in full]
    if not len(data):
        return out
    begins = np.ones(len(data), bool)
    begins[1:] = ~model.beside[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
    begins[off[:-1][full]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data))
    distinct, sample, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)

    def unit(j: int) -> str:
        i = sample[j]
        return data[start[i] : end[i]].tobytes().decode().replace(" ", SPACE)

    row = cache.rows(distinct, data, start[sample], end[sample])[inverse]
    size = cache.size[row].astype(np.int64)
    to = np.cumsum(size)
    ids = cache.ids[np.arange(int(to[-1])) - np.repeat(to - size - cache.at[row], size)]
    first = np.searchsorted(start, off)
    gap, score = cache.gap[row], cache.score[row]
    for t in np.flatnonzero(full).tolist():
        a, b = int(first[t]), int(first[t + 1])
        i0 = int(to[a] - size[a])
        best = ids[i0 : int(to[b - 1])]
        total = float(score[a:b].sum())
        own = gap[a:b]
        k = min(n - 1, b - a)
        if k < b - a:
            least = np.partition(own, k - 1)[k - 1] if k else -np.inf
            sure = np.flatnonzero(own < least)
            near = np.concatenate((sure, np.flatnonzero(own == least)[: k - len(sure)])) if k else sure
        else:
            near = np.arange(b - a)
        near = np.sort(near[np.isfinite(own[near])])
        others = [cache.others(int(row[a + j]), unit(int(inverse[a + j])), n - 1) for j in near.tolist()]
        result = []
        for loss, at in _combinations([[0.0, *(x for x, _ in o)] for o in others], n):
            parts, done = [], i0
            for j, p, o in zip(near.tolist(), at, others):
                if p:
                    z = int(to[a + j])
                    parts += [ids[done : z - int(size[a + j])], o[p - 1][1]]
                    done = z
            result.append((total - loss, np.concatenate((*parts, ids[done : int(to[b - 1])])) if parts else best))
        out[t] = result
    return out


def _lists(results: list[list[tuple[float, np.ndarray]]], null: np.ndarray) -> pa.Array:
    count = np.array([0 if x else len(r) for r, x in zip(results, null)])
    kept = [s for r, x in zip(results, null) if not x for s in r]
    sizes = np.array([len(i) for _, i in kept], np.int64)
    ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(i for _, i in kept)]), pa.int32()))
    items = pa.StructArray.from_arrays([pa.array([s for s, _ in kept], pa.float64()), ids], ["score", "ids"])
    offsets = pa.array(np.append(0, np.cumsum(count)), pa.int32(), mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, items)


def _round_trips(model: PieceModel, texts: pa.Array, best: list[np.ndarray]) -> list[bool]:
    """Whether each best path decodes to the text: its pieces' bytes are compared with the text's."""
    data, off = byte_buffer(texts)
    ids = np.concatenate([np.zeros(0, np.int32), *best])
    decoded = model.decode_many(ids)
    per_id = np.append(0, np.cumsum(model.blob_size[ids]))
    to = per_id[np.append(0, np.cumsum([len(i) for i in best]))]
    out = []
    for t in range(len(best)):
        own = decoded[to[t] : to[t + 1]]
        if model.dummy_prefix and len(own) and own[0] == 32:
            own = own[1:]
        out.append(bool(np.array_equal(own, data[off[t] : off[t + 1]])))
    return out


def encode(docs: DataFrame, model_path: str = MODEL_PATH, n: int = N_BEST) -> DataFrame:
    """doc_id, and the n best segmentations of text with scores; n_tokens and round_trip are of the best.

    The model file is read on the driver and sent once to each executor (half a megabyte). Rows aren't
    shuffled; the plan is a scan of two columns and one Arrow pass.
    """
    if n < 1:
        raise ValueError("n must be 1 at least")
    with open(model_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        key = hash(blob.value)
        if ("pieces", key) not in state:
            model = PieceModel(blob.value)
            state["pieces", key] = (model, UnitCache(model))
        model, cache = state["pieces", key]
        for batch in ending_freed(batches):
            for part in chunks(batch, size=1 << 19):
                texts = part.column("text")
                found = encode_chunk(model, cache, texts, n)
                null = np.asarray(texts.is_null())
                best = [r[0][1] for r in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([None if x else len(i) for i, x in zip(best, null)], pa.int32()),
                        pa.array([None if x else r for r, x in zip(_round_trips(model, texts, best), null)], pa.bool_()),
                        _lists(found, null),
                    ],
                    ["doc_id", "n_tokens", "round_trip", "segmentations"],
                )

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", model_path: str = MODEL_PATH) -> DataFrame:
    """The table with the text of each list of piece ids added; null for a null list."""
    with open(model_path, "rb") as f:
        blob = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text(lists):
        import pandas as pd

        state = worker_state()
        key = hash(blob.value)
        if ("pieces", key) not in state:
            model = PieceModel(blob.value)
            state["pieces", key] = (model, UnitCache(model))
        model = state["pieces", key][0]
        full = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in lists]
        blob_end = np.append(0, np.cumsum(model.blob_size[np.concatenate([np.zeros(0, np.int64), *full])]))
        text, to = model.decode_many(np.concatenate([np.zeros(0, np.int64), *full])).tobytes(), blob_end[np.append(0, np.cumsum([len(x) for x in full]))].tolist()
        found = [text[a:b].decode("utf-8", "replace") for a, b in zip(to, to[1:])]
        return pd.Series([None if x is None else t[1:] if model.dummy_prefix and t[:1] == " " else t for x, t in zip(lists, found)], dtype=object)

    return encoded.withColumn(out, text(F.col(ids)))
