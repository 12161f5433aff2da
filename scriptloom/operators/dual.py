"""Texts to ids by two vocabularies, and back.

A text is cut at special tokens, normalized between them, and cut into runs of the target script and runs without it.
Target runs are encoded by the new vocabulary and their ids mapped to ids of the old one; other runs by the old one.
Decoding takes runs of ids that are mapped, or aren't, each by its vocabulary.

Both are Column functions: Python workers cut the texts and look their words up in a cache of bounded size, some rows at a
time, and send each such piece back on its own, so that what they hold follows neither the corpus nor Spark's batches.
Nothing is shuffled. Null texts and null lists give null; an empty text has no ids, and no ids are the empty text.
"""

from __future__ import annotations

import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions import scripts as S
from scriptloom.functions import shaping as H
from scriptloom.functions.cutting import Cutter, letters_and_numbers, rejoined
from scriptloom.operators.idmap import repaired
from scriptloom.operators.vocabulary import ByteVocabulary

#: What a worker's cache of words may take, about; what is cut, encoded or decoded at a time: a row at least.
CACHE_BYTES = 48 << 20
PIECE_BYTES = 1 << 20
PIECE_IDS = 1 << 18
BAD = "�"


def _worker_state() -> dict:
    return sys.modules.setdefault("_dual_worker_state", types.ModuleType("_dual_worker_state")).__dict__


class UnmappedId(ValueError):
    """An id of the new vocabulary has no entry in the map."""


def _pieces(rows: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of texts or lists of ids, of bounded size."""
    if pa.types.is_list(rows.type) or pa.types.is_large_list(rows.type):
        weight, most = pc.list_value_length(rows), PIECE_IDS
    else:
        weight, most = pc.binary_length(rows), PIECE_BYTES
    size = pc.fill_null(weight, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)]):
        yield rows.slice(a, b - a)


def _arrays(lists: pa.Array) -> Iterator[np.ndarray | None]:
    values, off = lists.values.to_numpy(), lists.offsets.to_numpy()
    for k, x in enumerate(lists.is_valid().to_pylist()):
        yield values[off[k] : off[k + 1]] if x else None


class Codec:
    """What an executor needs of a model: words to ids with a cache, ids to bytes."""

    def __init__(self, old: ByteVocabulary, new: ByteVocabulary, new_to_old: dict[int, int], old_to_new: dict[int, int], special_route: str, strict: bool, cutter: Cutter):
        self.old, self.new, self.new_to_old, self.strict, self.special_route, self.cutter = old, new, new_to_old, strict, special_route, cutter
        self.forget()
        n = len(old)
        self.through = np.full(len(new), -1, np.int32)
        for i, o in new_to_old.items():
            if 0 <= i < len(new):
                self.through[i] = o
        self.mapped = np.zeros(n + 1, bool)  # the last place is that of unknown ids
        text = [*old.pieces, b""]
        for o, i in old_to_new.items():
            if 0 <= o < n:
                self.mapped[o], text[o] = True, new.pieces[i]
        self.text = text
        self.size = np.array([len(x) for x in text], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(text), np.uint8)
        self.special = np.zeros(n + 1, bool)
        self.special[: old.first_byte] = True
        self.old_pieces = dict(enumerate(old.pieces))
        self.new_pieces = {o: new.pieces[i] for o, i in old_to_new.items()}
        self.suspicious = {i for i, p in self.old_pieces.items() if BAD in p.decode("utf-8", "replace")} | set(old.byte_ids())
        self.names = pa.array([x.decode("utf-8", "replace") for x in text], pa.string())

    def forget(self) -> None:
        self.known: dict[str, dict[str, bytes]] = {route: {} for route in "012"}
        self.held = 0

    def _through(self, ids: list[int]) -> list[int]:
        if self.strict and any(i not in self.new_to_old for i in ids):
            raise UnmappedId(f"no id of the old vocabulary for {[i for i in ids if i not in self.new_to_old]}")
        return [self.new_to_old[i] for i in ids if i in self.new_to_old]

    def special_ids(self, word: str) -> list[int]:
        if self.special_route == "new" and word in self.new.id_of:
            return self._through([self.new.id_of[word]])
        return [self.old.id_of[word]] if word in self.old.id_of else self.old.encode_word(word)

    def learn(self, route: str, words: set[str]) -> None:
        """Makes the ids of words known."""
        new = list(words - self.known[route].keys())
        if route == "2":
            rows = [self.special_ids(w) for w in new]
            ids, size = np.array([*chain.from_iterable(rows)], np.int32), np.array([len(x) for x in rows], np.int64)
        else:
            ids, size = (self.new if route == "1" else self.old).encode_many(new)
        if route == "1":
            to = self.through[ids]
            if (to < 0).any():
                if self.strict:
                    raise UnmappedId(f"no id of the old vocabulary for {sorted({*ids[to < 0].tolist()})}")
                size = np.diff(np.append(0, np.cumsum(to >= 0))[np.append(0, np.cumsum(size))])
                to = to[to >= 0]
            ids = to
        whole, end = np.asarray(ids, np.int32).tobytes(), (4 * np.cumsum(size)).tolist()
        self.known[route].update(zip(new, (whole[a:b] for a, b in zip([0, *end], end))))
        self.held += sum(map(len, new)) * 2 + len(whole) + 220 * len(new)

    def _lists(self, rows: list[bytes | None]) -> pa.Array:
        to = np.append(0, np.cumsum([len(x or b"") // 4 for x in rows], dtype=np.int64))
        null = np.array([x is None for x in rows] + [False])
        ids = pa.array(np.frombuffer(b"".join(x or b"" for x in rows), np.int32))
        return pa.ListArray.from_arrays(pa.array(to, pa.int32(), mask=null), ids)

    def _encoded(self, cut: list[list[tuple[str, list[str]]] | None]) -> pa.Array:
        if self.held > CACHE_BYTES:
            self.forget()
        for route in "012":
            self.learn(route, set(chain.from_iterable(words for row in cut if row for r, words in row if r == route)))
        of = {route: known.__getitem__ for route, known in self.known.items()}
        return self._lists([None if x is None else b"".join(chain.from_iterable(map(of[route], words) for route, words in x)) for x in cut])

    def encode_words(self, lists: pa.Array) -> pa.Array:
        """Of lists of words with the mark of their route before them."""
        return self._encoded([None if x is None else [(w[0], [w[1:]]) for w in x] for x in lists.to_pylist()])

    def encode(self, texts: pa.Array) -> tuple[pa.Array, list[list | None]]:
        """The ids of texts, and what the texts were cut into."""
        cut = [None if t is None else self.cutter.cut(t) for t in texts.to_pylist()]
        return self._encoded(cut), cut

    def encoding(self, texts: pa.Array, eos: int | None) -> pa.Array:
        """Structs of ids and their texts, with eos at the end."""
        ids, _ = self.encode(texts)
        if eos is not None:
            rows = [None if x is None else x.tobytes() + np.int32(eos).tobytes() for x in _arrays(ids)]
            ids = self._lists(rows)
        return pa.StructArray.from_arrays([ids, self.tokens(ids)], ["ids", "tokens"])

    def roundtrip(self, texts: pa.Array) -> pa.Array:
        """Structs of the number of ids, the text as it was encoded (normalized) and the text of the ids."""
        ids, cut = self.encode(texts)
        normal = pa.array([None if x is None else rejoined(x) for x in cut], pa.string())
        decoded = [self.decode(x, False, True) for x in _pieces(ids)]
        return pa.StructArray.from_arrays([pc.list_value_length(ids).cast(pa.int32()), normal, pa.concat_arrays(decoded)], ["n", "normal", "decoded"])

    def _rows(self, lists: pa.Array, skip: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, those of unknown ones the last place; offsets; null rows)"""
        null = np.asarray(lists.is_null())
        count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.where((ids < 0) | (ids >= len(self.old)), len(self.old), ids)
        to = np.append(0, np.cumsum(count))
        if skip and len(ids):
            keep = ~self.special[ids]
            to = np.append(0, np.cumsum(keep))[to]
            ids = ids[keep]
        return ids, to, null

    def decode(self, lists: pa.Array, skip: bool, repair: bool) -> pa.Array:
        ids, to, null = self._rows(lists, skip)
        size = self.size[ids]
        end = np.append(0, np.cumsum(size))
        data = self.blob[np.arange(int(end[-1])) - np.repeat(end[:-1] - self.at[ids], size)]
        whole, cut = data.tobytes(), end[to].tolist()
        turn = np.flatnonzero(self.mapped[ids[1:]] != self.mapped[ids[:-1]]) + 1 if len(ids) > 1 else np.zeros(0, np.int64)
        # A run that begins inside a character is no text on its own.
        inside = turn[(end[turn] < len(data)) & ((data[np.minimum(end[turn], len(data) - 1)] & 0xC0) == 0x80)] if len(data) else turn[:0]
        broken = np.zeros(len(null), bool)
        if len(inside):
            row = np.searchsorted(to, inside, "right") - 1
            broken[row[to[row] < inside]] = True
        out: list[str | None] = []
        for r in range(len(null)):
            if null[r]:
                out.append(None)
                continue
            text = None
            if not broken[r]:
                try:
                    text = whole[cut[r] : cut[r + 1]].decode()
                except UnicodeDecodeError:
                    pass
            if text is None:
                text = self._by_runs(ids[to[r] : to[r + 1]].tolist())
            if repair and BAD in text:
                text = repaired(ids[to[r] : to[r + 1]].tolist(), self.old_pieces, self.new_pieces, self.suspicious)
            out.append(text)
        return pa.array(out, pa.string())

    def _by_runs(self, ids: list[int]) -> str:
        parts: list[list] = []
        for i in ids:
            kind = bool(self.mapped[i])
            if not parts or parts[-1][0] != kind:
                parts.append([kind, []])
            parts[-1][1].append(self.text[i])
        return "".join(b"".join(p).decode("utf-8", "replace") for _, p in parts)

    def tokens(self, lists: pa.Array) -> pa.Array:
        ids, to, null = self._rows(lists, False)
        return pa.ListArray.from_arrays(pa.array(to, pa.int32(), mask=np.append(null, False)), self.names.take(pa.array(ids)))


class DualModel:
    """An old vocabulary whose ids are partly reused for the tokens of a new one.

    new_to_old: the map; its inverse takes the greatest new id where several share an old one, unless old_to_new is given.
    special_route: the vocabulary that encodes special tokens, where it has them. on_unmapped: "error", or "drop" for ids
    without an entry. normalize_first: rules see the special tokens too.
    """

    def __init__(self, spark: SparkSession, old: ByteVocabulary, new: ByteVocabulary, new_to_old: dict[int, int], script: str = "arabic", rules: dict[int, list[int]] | None = None, specials: list[str] | None = None, *, old_to_new: dict[int, int] | None = None, special_route: str = "new", on_unmapped: str = "error", normalize_first: bool = False):
        if special_route not in ("old", "new") or on_unmapped not in ("error", "drop"):
            raise ValueError("special_route is old or new, on_unmapped is error or drop")
        self.old, self.new, self.new_to_old, self.script = old, new, new_to_old, script
        self.rules = S.ARABIC_RULES if rules is None else rules
        self.specials = old.specials if specials is None else specials
        self.special_route, self.on_unmapped, self.normalize_first = special_route, on_unmapped, normalize_first
        self.old_to_new = {o: n for n, o in sorted(new_to_old.items())} if old_to_new is None else old_to_new
        cutter = Cutter(letters_and_numbers(spark), script, self.rules, self.specials, normalize_first)
        codec = Codec(old, new, new_to_old, self.old_to_new, special_route, on_unmapped == "error", cutter)
        self.codec = codec
        # Bounded by the vocabularies (some MB), whatever the corpus.
        self._sent, self._key = spark.sparkContext.broadcast(cloudpickle.dumps(codec)), uuid.uuid4().hex

    def _get(self) -> Callable[[], Codec]:
        sent, key = self._sent, self._key

        def get() -> Codec:
            state = _worker_state()
            if key not in state:
                state.clear()  # a worker outlives its query, and has one model at a time
                state[key] = pickle.loads(sent.value)
            return state[key]

        return get

    def words(self, text: Column) -> Column:
        """The words of a text in order, each with the mark of its vocabulary before it."""
        if self.normalize_first:
            text = S.normalized(text, self.rules)
        gap = (lambda x: x) if self.normalize_first else (lambda x: S.normalized(x, self.rules))
        # An inner lambda that used the outer one's variable would keep Spark from taking the Python function out of the plan.
        with_mark = lambda mark, s: F.transform(S.pretokens(s["text"]), lambda w: F.concat(F.lit(mark), w))
        marked = lambda p: F.flatten(F.transform(S.segments(gap(p), self.script), lambda s: F.when(s["is_target"], with_mark("1", s)).otherwise(with_mark("0", s))))
        if not self.specials:
            return marked(text)
        return F.flatten(F.transform(S.special_split(text, self.specials), lambda p: F.when(p.isin(self.specials), F.array(F.concat(F.lit("2"), p))).otherwise(marked(p))))

    def _by_pieces(self, of: Callable[[Codec, pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
        """A function of a Column of texts or lists; its results leave a worker piece by piece, not by Spark's batches."""
        get, pieces = self._get(), _pieces

        @F.arrow_udf(kind)
        def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in batches:
                for some in pieces(rows):
                    yield of(get(), some)

        return each

    def encode(self, text: Column) -> Column:
        """Ids of the old vocabulary."""
        return self._by_pieces(lambda codec, x: codec.encode(x)[0], "array<int>")(text)

    def roundtrip(self, text: Column) -> Column:
        """A struct: n (the number of ids), normal (the text as it is encoded) and decoded, by decode(). The ids stay in the worker."""
        return self._by_pieces(lambda codec, x: codec.roundtrip(x), "struct<n:int,normal:string,decoded:string>")(text)

    def _decoded(self, ids: Column, skip_special_tokens: bool, repair: bool) -> Column:
        return self._by_pieces(lambda codec, x: codec.decode(x, skip_special_tokens, repair), "string")(ids.cast("array<int>"))

    def decode_basic(self, ids: Column, skip_special_tokens: bool = False) -> Column:
        """Text of ids, run by run; bytes that don't fit at the ends of a run become U+FFFD."""
        return self._decoded(ids, skip_special_tokens, False)

    def decode(self, ids: Column, skip_special_tokens: bool = False) -> Column:
        """As decode_basic(); where that has U+FFFD, characters split across runs are put together again."""
        return self._decoded(ids, skip_special_tokens, True)

    def tokens(self, ids: Column) -> Column:
        """The text of each id alone."""
        return self._by_pieces(lambda codec, x: codec.tokens(x), "array<string>")(ids.cast("array<int>"))

    def encoding(self, text: Column, eos: int | None = None) -> Column:
        """One struct: ids (with eos at the end, if given), type_ids, tokens, offsets (the whole text for each id), attention_mask."""
        both = self._by_pieces(lambda codec, x: codec.encoding(x, eos), "struct<ids:array<int>,tokens:array<string>>")(text)
        ids = both["ids"]
        n = F.size(ids)
        span = F.struct(F.lit(0).alias("start"), F.octet_length(text).alias("stop"))
        fields = [ids.alias("ids"), F.array_repeat(F.lit(0), n).alias("type_ids"), both["tokens"].alias("tokens"), F.array_repeat(span, n).alias("offsets"), F.array_repeat(F.lit(1), n).alias("attention_mask")]
        return F.when(text.isNotNull(), F.struct(*fields))

    def encode_plus(self, text: Column, pair: Column | None = None, *, bos: int, eos: int, pad: int, add_special_tokens: bool = False, max_length: int | None = None, padding: Column | int | None = None, multiple_of: int | None = None, legacy: bool = False) -> Column:
        """(input_ids, attention_mask) of a text or a pair.

        padding: the length to reach. legacy: a pair is dropped unless special tokens are added and nothing is cut, and a cut
        with special tokens keeps one id at least, so that it may exceed max_length.
        """
        ids = self.encode(text)
        if pair is not None and (not legacy or (add_special_tokens and max_length is None)):
            ids = H.paired(ids, self.encode(pair), eos)
            ids = H.truncated(ids, max_length) if max_length is not None else ids
        elif max_length is not None:
            if not add_special_tokens:
                ids = H.truncated(ids, max_length)
            else:
                ids = H.with_specials(ids, max_length, bos, eos)
                ids = ids if legacy else H.truncated(ids, max_length)
        elif add_special_tokens:
            ids = F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))
        to = F.size(ids) if padding is None else F.greatest(F.size(ids), padding if isinstance(padding, Column) else F.lit(padding))
        to = H.up_to_multiple(to, multiple_of) if multiple_of else to
        return F.when(text.isNotNull(), F.struct(H.padded(ids, to, pad).alias("input_ids"), H.attention_mask(ids, to).alias("attention_mask")))

    def register(self, spark: SparkSession) -> None:
        """Registers dual_encode(text) and dual_decode(ids) for SQL: encode works on words(text), so SQL passes those."""
        get = self._get()
        spark.udf.register("dual_encode_words", F.arrow_udf(lambda words: get().encode_words(words), "array<int>"))
        spark.udf.register("dual_decode", F.arrow_udf(lambda lists: get().decode(lists, False, True), "string"))

    def stats(self) -> dict[str, int]:
        """Sizes of the maps; common: ids that come back through both; replacement: ids that are no text on their own."""
        common = sum(self.new_to_old.get(n) == o for o, n in self.old_to_new.items())
        bad = sum(BAD in p.decode("utf-8", "replace") for p in self.old.pieces)
        return {"new_size": len(self.new_to_old), "old_size": len(self.old_to_new), "mapped": len(self.new_to_old), "common": common, "replacement": bad}

    # Lookups of single ids.
    def new_to_old_id(self, i: int) -> int | None:
        return self.new_to_old.get(i)

    def old_to_new_id(self, i: int) -> int | None:
        return self.old_to_new.get(i)

    def is_mapped(self, i: int) -> bool:
        return i in self.old_to_new

    def has_replacement_char(self, i: int) -> bool:
        return 0 <= i < len(self.old) and BAD in self.old.pieces[i].decode("utf-8", "replace")

    def is_common_token(self, i: int) -> bool:
        return self.new_to_old.get(self.old_to_new.get(i, -1)) == i

    def target_ids(self) -> tuple[list[int], list[int]]:
        """(ids of the old vocabulary whose text has the target script, ids that stand for such tokens of the new one)."""
        import re

        hit = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in S.RANGES[self.script]) + "]")
        old = [i for i, p in enumerate(self.old.pieces) if hit.search(p.decode("utf-8", "replace"))]
        return old, sorted(o for n, o in self.new_to_old.items() if hit.search(self.new.pieces[n].decode("utf-8", "replace")))


def legacy_eos(ids: Column, tokens: Column, eos: int | None) -> Column:
    """The old wrapper's rule: a last token that holds EOS or END is dropped, or becomes eos where one is given. It eats words such as ENDING."""
    last = F.element_at(tokens, -1)
    hit = (F.size(tokens) > 0) & last.rlike("EOS|END")
    rest = F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))
    return F.when(hit, rest if eos is None else F.concat(rest, F.array(F.lit(eos)))).otherwise(ids)


def token_map(old: ByteVocabulary, new: ByteVocabulary, reusable: list[int]) -> dict[int, int]:
    """New ids to old ids: the same token by its bytes, the others in order with the reusable ids that no common token has."""
    special = {s: old.id_of[s] for s in new.specials if s in old.id_of}
    common = {i: special[s] for s, i in new.id_of.items() if s in special}
    common |= {i: old.id_of_bytes[p] for p, i in new.id_of_bytes.items() if p in old.id_of_bytes}
    taken = set(common.values())
    free = [i for i in sorted(set(reusable)) if i not in taken]
    fresh = [i for i in range(len(new)) if i not in common]
    if len(fresh) > len(free):
        raise ValueError(f"{len(fresh)} new tokens, but only {len(free)} reusable ids")
    return common | dict(zip(fresh, free))
