"""Learning of byte-pair merges, exact, by tasks that hold a share of the distinct words each.

A task keeps its words as linked symbols in arrays, and the places of each pair. A pair's places all come up when the later
one of its two tokens is made, so they are kept with that token. For each batch of merges the tasks send what changed in
their counts of pairs; the first task adds that up and sends back the merges that are next. One task needs no exchange;
several run as a barrier stage, and talk to the first one by sockets, as a barrier's own messages take a second each. What a task holds follows its share of the words; the first one also holds the counts of pairs.
"""

from __future__ import annotations

import heapq
import json
import secrets
import socket
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Up to so many distinct words are trained on in one task; beyond that in tasks of about WORDS_IN_A_TASK, as far as there are cores.
WORDS_IN_ONE_TASK = 2_000_000
WORDS_IN_A_TASK = 250_000
#: How many pairs of greatest count are looked at for a batch, and about how many are kept in order.
TOP_PAIRS = 64
IN_ORDER = 20_000
#: How long a task waits for another one.
WAIT_S = 1800
#: Symbols below are characters (code points) or ids; merged characters get numbers from here on.
BEYOND_CHARACTERS = 0x110000


def safe_batch(pairs: list[tuple[int, int, int]], more: bool) -> list[tuple[int, int, int]]:
    """Of pairs (left, right, n) by falling n and rising ids, those that one-by-one training would merge next, in this order.

    A merge only makes pairs of its token, each no more frequent than the pair of its left or right part that it replaces.
    So the pairs before the first one that shares a token with an earlier one are next, but for those as frequent as it,
    where a new pair could come between. more: the list goes on after its end.
    """
    used: set[int] = set()
    out: list[tuple[int, int, int]] = []
    for a, b, n in pairs:
        if a in used or b in used:
            return [x for x in out if x[2] > n] or out[:1]
        out.append((a, b, n))
        used |= {a, b}
    return ([x for x in out if x[2] > out[-1][2]] or out[:1]) if more else out


def merged(ids: np.ndarray, size: np.ndarray, pairs: list[tuple[int, int]], rank: np.ndarray, made: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of symbols end to end (size: how many each has) with all merges applied: lowest rank first, leftmost first.

    rank, made: of each pair; none is above all symbols and ranks. All words take their next merge at once.
    """
    codes = np.array([a * none + b for a, b in pairs] or [-1], np.int64)
    order = np.argsort(codes)
    codes = codes[order]
    rank, made = (x[order] if pairs else np.array([none], np.int64) for x in (rank, made))
    ended = [(np.flatnonzero(size == 0), size[size == 0], ids[:0])]
    number = np.flatnonzero(size > 0)
    size = size[number]
    while len(number):
        pair = np.append(ids[:-1] * none + ids[1:], -2)
        at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
        found = np.where(codes[at] == pair, rank[at], none)
        end = np.cumsum(size)
        found[end - 1] = none
        least = np.minimum.reduceat(found, end - size)
        over = least == none
        of_over = np.repeat(over, size)
        ended.append((number[over], size[over], ids[of_over]))
        number, size, least, ids, found, at = number[~over], size[~over], least[~over], ids[~of_over], found[~of_over], at[~of_over]
        if not len(number):
            break
        hit = found == np.repeat(least, size)
        if (hit[1:] & hit[:-1]).any():  # of a run of one token the first two, then the next two
            place = np.arange(len(hit))
            hit &= (place - np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))) % 2 == 0
        ids[hit] = made[at[hit]]
        end = np.cumsum(size)
        size = size - np.add.reduceat(hit, end - size, dtype=np.int64)
        ids = ids[~np.append(False, hit[:-1])]
    number, size, ids = (np.concatenate(x) for x in zip(*ended))
    order, begin = np.argsort(number), np.cumsum(size) - size
    size, begin = size[order], begin[order]
    return ids[np.arange(len(ids)) - np.repeat(np.cumsum(size) - size - begin, size)], size


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of n for each code, without those that are 0."""
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    total = np.add.reduceat(n, first)
    return codes[first][total != 0], total[total != 0]


class Words:
    """One task's words. Pairs are codes: left << 32 | right."""

    def __init__(self, symbols: np.ndarray, size: np.ndarray, n: np.ndarray, first: int):
        keep = size > 1
        self.symbol = symbols.astype(np.int32)[np.repeat(keep, size)]
        self.n, size = n[keep].astype(np.int64), size[keep]
        end = np.cumsum(size)
        self.word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.after = np.arange(1, len(self.symbol) + 1, dtype=np.int32)
        self.before = np.arange(-1, len(self.symbol) - 1, dtype=np.int32)
        self.after[end - 1] = -1
        self.before[end - size] = -1
        self.first, self.places = first, {}
        at = np.flatnonzero(self.after >= 0).astype(np.int32)
        self.counts = _summed(*self._put(first - 1, at))

    def _codes(self, at: np.ndarray) -> np.ndarray:
        return self.symbol[at].astype(np.int64) << 32 | self.symbol[self.after[at]]

    def _put(self, token: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = self._codes(at)
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        begin = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
        self.places[token] = (codes[begin], np.append(begin, len(codes)), at)
        return codes, self.n[self.word[at]]

    def _of(self, left: int, right: int) -> np.ndarray:
        codes, begin, at = self.places[max(left, right, self.first - 1)]
        k = int(np.searchsorted(codes, left << 32 | right))
        return at[begin[k] : begin[k + 1]] if k < len(codes) and codes[k] == left << 32 | right else at[:0]

    def merge(self, left: int, right: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """Puts a token for all its places; (codes, changes of their counts), codes in several parts."""
        i = self._of(left, right)
        i = i[self.symbol[i] == left]
        i = i[self.after[i] >= 0]
        i = i[self.symbol[self.after[i]] == right]
        j = self.after[i]
        if left == right and len(i):  # of a run of one token the first two, then the next two; places are in order
            place = np.arange(len(i))
            keep = (place - np.maximum.accumulate(np.where(np.append(False, j[:-1] == i[1:]), 0, place))) % 2 == 0
            i, j = i[keep], j[keep]
        if not len(i):
            self._put(new, i)
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, k = self.before[i], self.after[j]
        old = np.unique(np.concatenate((h[h >= 0], i, j[k >= 0])))
        codes, n = self._codes(old), -self.n[self.word[old]]
        self.symbol[i], self.symbol[j], self.after[i] = new, -1, k
        self.before[k[k >= 0]] = i[k >= 0]
        h = self.before[i]
        more, m = self._put(new, np.unique(np.concatenate((h[h >= 0], i[k >= 0]))))
        return np.concatenate((codes, more)), np.concatenate((n, m))


class Counts:
    """Counts of all pairs, and those of greatest count in order; ties go to the lesser order(left, right)."""

    def __init__(self, order: Callable[[int, int], object]):
        self.order, self.total, self.heap, self.floor = order, {}, [], 1 << 62

    def _push(self, code: int, n: int) -> None:
        heapq.heappush(self.heap, (-n, self.order(code >> 32, code & 0xFFFFFFFF), code))

    def add(self, codes: np.ndarray, changes: np.ndarray) -> None:
        total = self.total
        for code, d in zip(codes.tolist(), changes.tolist()):
            n = total.get(code, 0) + d
            if n > 0:
                total[code] = n
                if n >= self.floor:
                    self._push(code, n)
            else:
                total.pop(code, None)

    def next(self, most: int) -> list[tuple[int, int, int]]:
        """The merges that are next, at most so many; none where no pair is left."""
        found: dict[int, int] = {}
        while not found:
            while self.heap and len(found) < TOP_PAIRS:
                n, _, code = heapq.heappop(self.heap)
                if self.total.get(code) == -n and code not in found:
                    found[code] = -n
            if not found:
                if not self.total:
                    return []
                values = np.fromiter(self.total.values(), np.int64, len(self.total))
                k = min(IN_ORDER, len(values))
                self.floor = int(np.partition(values, len(values) - k)[len(values) - k])
                for code, n in self.total.items():
                    if n >= self.floor:
                        self._push(code, n)
        pairs = [(code >> 32, code & 0xFFFFFFFF, n) for code, n in found.items()]
        batch = safe_batch(pairs, len(found) < len(self.total))[:most]
        for code in list(found)[len(batch) :]:
            self._push(code, found[code])
        return batch


class Link:
    """What the first task of a barrier stage and each of the others send each other. A task that is lost breaks its connection, which fails the stage."""

    def __init__(self, context):
        self.leads, self.others = context.partitionId() == 0, []
        tasks = context.getTaskInfos()
        server = None
        if self.leads:
            server = socket.create_server((tasks[0].address.rpartition(":")[0], 0), backlog=len(tasks))
            server.settimeout(WAIT_S)
        at = json.loads(context.allGather(json.dumps([*server.getsockname()[:2], secrets.token_hex(16)]) if server else "")[0])
        key = at[2].encode()
        if not server:
            self.others.append(socket.create_connection((at[0], at[1]), WAIT_S))
            self._send(self.others[0], key)
            return
        while len(self.others) < len(tasks) - 1:
            other, _ = server.accept()
            other.settimeout(WAIT_S)
            if self._read(other, 1 << 10) == key:
                self.others.append(other)
            else:
                other.close()
        server.close()

    def _send(self, to: socket.socket, data: bytes) -> None:
        to.sendall(struct.pack(">Q", len(data)) + data)

    def _read(self, other: socket.socket, most: int = 1 << 62) -> bytes:
        def exactly(n: int) -> bytes:
            data = bytearray()
            while len(data) < n:
                if not (part := other.recv(min(n - len(data), 1 << 20))):
                    raise ConnectionError("another task of the training ended")
                data += part
            return bytes(data)

        size = struct.unpack(">Q", exactly(8))[0]
        return exactly(size) if size <= most else b""

    def gather(self, data: bytes) -> list[bytes]:
        """What all tasks sent, for the first one."""
        if self.leads:
            return [data, *(self._read(x) for x in self.others)]
        self._send(self.others[0], data)
        return []

    def share(self, data: bytes) -> bytes:
        """What the first task has."""
        if not self.leads:
            return self._read(self.others[0])
        for x in self.others:
            self._send(x, data)
        return data


def learn(words: Words, merges: int, order_of: Callable[[list[tuple[int, int]]], Callable[[int, int], object]], link: Link | None = None) -> list[tuple[int, int, int]]:
    """The merges (left, right, n), where this task leads; every task takes part. order_of: from the merges so far."""
    out: list[tuple[int, int, int]] = []
    pairs: list[tuple[int, int]] = []
    counts = Counts(order_of(pairs)) if link is None or link.leads else None
    codes, changes = words.counts
    del words.counts
    while True:
        if link and (sent := link.gather(codes.tobytes() + changes.tobytes())):
            each = [np.frombuffer(x, np.int64) for x in sent]
            codes, changes = _summed(np.concatenate([x[: len(x) // 2] for x in each]), np.concatenate([x[len(x) // 2 :] for x in each]))
        batch = []
        if counts:
            counts.add(codes, changes)
            batch = counts.next(merges - len(out)) if len(out) < merges else []
            out += batch
        if link:
            batch = json.loads(link.share(json.dumps(batch).encode()))
        if not batch:
            return out
        parts = []
        for left, right, _ in batch:
            pairs.append((left, right))
            parts.append(words.merge(left, right, words.first + len(pairs) - 1))
        codes, changes = _summed(*(np.concatenate(x) for x in zip(*parts)))


def by_ids(pairs: list[tuple[int, int]]) -> Callable[[int, int], object]:
    return lambda left, right: left << 32 | right


class Texts:
    """The text of characters and of merges of them."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.pairs, self.merged = pairs, []

    def of(self, symbol: int) -> str:
        if symbol < BEYOND_CHARACTERS:
            return chr(symbol)
        while len(self.merged) <= symbol - BEYOND_CHARACTERS:
            left, right = self.pairs[len(self.merged)]
            self.merged.append(self.of(left) + self.of(right))
        return self.merged[symbol - BEYOND_CHARACTERS]

    def order(self, left: int, right: int) -> tuple[str, str]:
        return self.of(left), self.of(right)


def by_texts(pairs: list[tuple[int, int]]) -> Callable[[int, int], object]:
    return Texts(pairs).order


def symbols_of(words: pa.Array, ids_of_bytes: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols end to end, how many each word has): ids of bytes, or characters where none are given."""
    words = words.cast(pa.large_string())
    if ids_of_bytes is None:
        return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.int32), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return np.array(ids_of_bytes, np.int32)[data], np.diff(off)


def tasks_for(words: DataFrame, one_task: int) -> int:
    count = words.count()
    if count <= one_task:
        return 1
    sc = words.sparkSession.sparkContext._jsc.sc()
    slots = sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())
    return max(1, min(slots, max(2, -(-count // WORDS_IN_A_TASK))))


def learnt(words: DataFrame, merges: int, first: int, ids_of_bytes: list[int] | None, tasks: int) -> DataFrame:
    """(rank, l, r, n) of distinct words with counts (word, n), none of them null: l and r are ids, or texts where words are taken by characters."""
    kind = "int" if ids_of_bytes else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get() if tasks > 1 else None
        symbols, size, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            if b.num_rows:
                s, k = symbols_of(b.column("word"), ids_of_bytes)
                symbols.append(s)
                size.append(k)
                n.append(b.column("n").to_numpy(zero_copy_only=False))
        own = Words(*map(np.concatenate, (symbols, size, n)), first)
        del symbols, size, n
        link = Link(context) if context else None
        found = learn(own, merges, by_ids if ids_of_bytes else by_texts, link)
        if link is None or link.leads:
            text = None if ids_of_bytes else Texts([x[:2] for x in found]).of
            side = lambda k: pa.array([x[k] if text is None else text(x[k]) for x in found], pa.int32() if text is None else pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), side(0), side(1), pa.array([x[2] for x in found], pa.int64())], ["rank", "l", "r", "n"])

    return words.select("word", "n").repartition(tasks).mapInArrow(run, f"rank int, l {kind}, r {kind}, n long", barrier=tasks > 1)


def merges_of(words: Iterable[tuple[str, int]], count: int) -> list[tuple[str, str, int]]:
    """The first merges of characters (left, right, weight) over words with counts; ties go to the pair of lesser symbols."""
    rows = list(words)
    symbols, size = symbols_of(pa.array([w for w, _ in rows], pa.string()), None)
    found = learn(Words(symbols, size, np.array([n for _, n in rows], np.int64), BEYOND_CHARACTERS), count, by_texts)
    text = Texts([x[:2] for x in found]).of
    return [(text(left), text(right), n) for left, right, n in found]
