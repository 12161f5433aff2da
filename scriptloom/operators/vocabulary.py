"""Byte-level vocabularies: special tokens first, then the 256 bytes, then merges; training and lookups.

A token is bytes. Tables hold it as hexadecimal digits, with the id and the visible text (U+FFFD for bytes that
are no character on their own, blanks cut off at both ends).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.scripts import WHITE
from scriptloom.operators.merges import WORDS_IN_ONE_TASK, learnt, merged, safe_batch, tasks_for  # noqa: F401 (safe_batch belongs to training)
from scriptloom.sources.shared import written

_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The printable character that stands for each byte in files of byte-level vocabularies.
PRINTABLE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BYTE_OF = {c: b for b, c in PRINTABLE.items()}
#: Bytes by the order of their printable characters; a vocabulary's ids follow it.
ALPHABET = sorted(range(256), key=PRINTABLE.__getitem__)
#: Longer words (bytes) are encoded one by one.
LONG_WORD = 64


def printable(token: bytes) -> str:
    return "".join(PRINTABLE[b] for b in token)


def from_printable(text: str) -> bytes:
    return bytes(_BYTE_OF[c] for c in text)


def stripped(text: Column) -> Column:
    """Without white space at both ends; white space is one fixed class."""
    return F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+$", "")


def real_specials(specials: Iterable) -> list[str]:
    """Special tokens from configuration values: lists are flattened, absent ones ("None" too) and repeats dropped."""
    flat = [x for s in specials for x in (s if isinstance(s, (list, tuple)) else [s])]
    return list(dict.fromkeys(x for x in flat if x is not None and x != "None"))


class ByteVocabulary:
    """Tokens by id. merges: (left, right) pairs of bytes, most important first."""

    def __init__(self, specials: Iterable[str] = (), merges: Iterable[tuple[bytes, bytes]] = ()):
        self.specials = real_specials(specials)
        self.first_byte = len(self.specials)
        self.pieces: list[bytes] = [s.encode() for s in self.specials] + [bytes([b]) for b in ALPHABET]
        self.byte_id = {b: self.first_byte + k for k, b in enumerate(ALPHABET)}
        of = {p: i for i, p in enumerate(self.pieces) if i >= self.first_byte}
        self.merges: list[tuple[bytes, bytes]] = []
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            if left not in of or right not in of:
                raise ValueError(f"a part of the merge {left!r} {right!r} is no earlier token")
            self.merges.append((left, right))
            self.joined[of[left], of[right]] = of[left + right] = len(self.pieces)
            self.pieces.append(left + right)
        self.id_of = {s: i for i, s in enumerate(self.specials)}
        self.id_of_bytes = of

    @classmethod
    def of_pairs(cls, specials: Iterable[str], pairs: Iterable[tuple[int, int]]) -> ByteVocabulary:
        """From merges as pairs of ids."""
        base = cls(specials)
        pieces, merges = base.pieces, []
        for left, right in pairs:
            merges.append((pieces[left], pieces[right]))
            pieces.append(pieces[left] + pieces[right])
        return cls(specials, merges)

    def __len__(self) -> int:
        return len(self.pieces)

    def byte_ids(self) -> range:
        return range(self.first_byte, self.first_byte + 256)

    def token_to_id(self, token: str, default: int | None = None) -> int | None:
        """The id of a special token, or of one that has the text's bytes."""
        return self.id_of.get(token, self.id_of_bytes.get(token.encode(), default))

    def id_to_token(self, i: int) -> str | None:
        return self.pieces[i].decode("utf-8", "replace") if 0 <= i < len(self.pieces) else None

    def visible(self, i: int) -> str:
        return self.pieces[i].decode("utf-8", "replace").strip()

    def encode_word(self, word: str) -> list[int]:
        """Lowest merge first, leftmost first, by a heap over the neighbours: n log n for a word of n bytes."""
        ids: list[int | None] = [self.byte_id[b] for b in word.encode()]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, k) for k in range(n - 1) if (m := self.joined.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            right = after[k] if ids[k] is not None else n
            if right >= n or self.joined.get((ids[k], ids[right])) != m:
                continue
            ids[k], ids[right] = m, None
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (new := self.joined.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (new, a))
        return [i for i in ids if i is not None]

    def encode_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each word has: as encode_word(), all words at once."""
        held = pa.array(words, pa.large_string())
        off = np.frombuffer(held.buffers()[1], np.int64)[: len(words) + 1] if words else np.zeros(1, np.int64)
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        size = np.diff(off)
        place = np.array([self.byte_id[b] for b in range(256)], np.int64)
        made = np.array([*self.joined.values()], np.int64)
        short = size <= LONG_WORD
        ids, own = merged(place[data[np.repeat(short, size)]], size[short], list(self.joined), made, made, len(self.pieces))
        if short.all():
            return ids.astype(np.int32), own
        rows = iter(np.split(ids, np.cumsum(own)[:-1]) if len(own) else [])
        every = [next(rows) if s else np.array(self.encode_word(w), np.int64) for w, s in zip(words, short.tolist())]
        return np.concatenate(every).astype(np.int32), np.array([len(x) for x in every], np.int64)

    def rows(self) -> list[tuple[str, int, str]]:
        return [(p.hex().upper(), i, self.visible(i)) for i, p in enumerate(self.pieces)]

    def table(self, spark: SparkSession) -> DataFrame:
        """(token, id, visible) of every id."""
        return spark.createDataFrame(self.rows(), "token string, id int, visible string")


def placeholder_vocabulary(spark: SparkSession, n: int) -> DataFrame:
    """(token, id): a name made of each id."""
    return spark.range(n).select(F.format_string("<token_%d>", "id").alias("token"), F.col("id").cast("int"))


def lowest_ids(added: DataFrame) -> DataFrame:
    """(token, id): of repeated added tokens the least id."""
    return added.groupBy("token").agg(F.min("id").alias("id"))


def unreadable(vocab: DataFrame) -> DataFrame:
    """The tokens whose bytes are no text on their own: their decoding has U+FFFD."""
    bytes_ = F.unhex("token")
    return vocab.where(~F.is_valid_utf8(bytes_.cast("string")) | F.contains(F.make_valid_utf8(bytes_.cast("string")), F.lit("�")))


def train(words: DataFrame, merges: int, specials: Iterable[str] = (), one_task: int = WORDS_IN_ONE_TASK) -> ByteVocabulary:
    """The vocabulary of so many merges, learnt from distinct words with counts (word, n). Null words don't count.

    The driver gets the merges alone: their number, not the corpus, bounds what it holds.
    """
    base = ByteVocabulary(specials)
    some = written(words.where("word is not null and length(word) > 0").select("word", "n"), "words")
    found = learnt(some, merges, len(base), [base.byte_id[b] for b in range(256)], tasks_for(some, one_task))
    return ByteVocabulary.of_pairs(base.specials, [(r["l"], r["r"]) for r in sorted(found.collect())])  # an orderBy() would train twice, for its sample
