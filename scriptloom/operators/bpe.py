"""Byte-pair merges: counts of words and pairs, training, encoding of distinct words."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.cutting import letters_and_numbers, pretoken_pattern
from scriptloom.functions.scripts import pretokens
from scriptloom.operators.dual import _pieces as pieces
from scriptloom.operators.merges import BEYOND_CHARACTERS, WORDS_IN_ONE_TASK, learnt, merged, merges_of, symbols_of, tasks_for  # noqa: F401 (merges_of belongs to training)
from scriptloom.sources.shared import written

CACHE_BYTES = 48 << 20


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): one shuffle of partial counts."""
    return docs.select(F.explode(pretokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(l, r, n) of neighbouring characters, weighted by the words' counts."""
    c = words.withColumn("c", F.filter(F.split("word", ""), lambda x: x != ""))
    pairs = c.where("size(c) > 1").select("n", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("l"), F.expr("slice(c, 2, size(c) - 1)").alias("r"))).alias("p"))
    return pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("n").alias("n"))


def train(words: DataFrame, merges: int, one_task: int = WORDS_IN_ONE_TASK) -> DataFrame:
    """(rank, l, r, n): the table of merges of characters; null words don't count. vocabulary.train() is for vocabularies of bytes."""
    some = written(words.where("word is not null").select("word", "n"), "words")
    return learnt(some, merges, BEYOND_CHARACTERS, None, tasks_for(some, one_task))


def apply_merges(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    s = list(word)
    while len(s) > 1:
        best = min((ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(s, s[1:])))
        if best[0] == 1 << 60:
            break
        l, r = s[best[1]], s[best[1] + 1]
        new, k = [], 0
        while k < len(s):
            if k + 1 < len(s) and s[k] == l and s[k + 1] == r:
                new.append(l + r)
                k += 2
            else:
                new.append(s[k])
                k += 1
        s = new
    return s


def _sizes(merges: list[tuple[str, str]], docs: DataFrame):
    """A Column function: (words, tokens) of each text. Workers cut the texts some rows at a time, and keep the words that they have met up to CACHE_BYTES."""
    spark, key, of = docs.sparkSession, uuid.uuid4().hex, pieces
    # Symbols are characters, and numbers beyond them for other texts: two merges may make the same text.
    rank = {tuple(m): i for i, m in enumerate(merges)}
    texts = dict.fromkeys(x for l, r in rank for x in (l, r, l + r))
    of_text = {x: ord(x) if len(x) == 1 else BEYOND_CHARACTERS + k for k, x in enumerate(texts)}
    made = np.array([of_text[l + r] for l, r in rank], np.int64)
    sent = spark.sparkContext.broadcast(([(of_text[l], of_text[r]) for l, r in rank], np.array([*rank.values()], np.int64), made, BEYOND_CHARACTERS + len(texts) + len(merges)))
    apply, symbols = merged, symbols_of
    patterns = [pretoken_pattern(letters_and_numbers(spark), last) for last in (0xFFFF, 0x10FFFF)]

    @F.arrow_udf("struct<words:int,tokens:long>")
    def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = sys.modules.setdefault("_bpe_worker_state", types.ModuleType("_bpe_worker_state")).__dict__
        if key not in state:
            state.clear()  # a worker outlives its query
            state[key] = ({}, [0])
        cache, held = state[key]
        near, beyond = map(re.compile, patterns)
        far = re.compile("[\U00010000-\U0010FFFF]")
        for batch in batches:
            for texts in of(batch):
                cut = [None if t is None else (beyond if far.search(t) else near).findall(t) for t in texts.to_pylist()]
                if held[0] > CACHE_BYTES:
                    cache.clear()
                    held[0] = 0
                new = list(set(chain.from_iterable(x for x in cut if x)) - cache.keys())
                ids, size = symbols(pa.array(new, pa.string()), None)
                cache.update(zip(new, apply(ids.astype(np.int64), size, *sent.value)[1].tolist()))
                held[0] += 170 * len(new) + 2 * sum(map(len, new))
                words = pa.array([None if x is None else len(x) for x in cut], pa.int32())
                tokens = pa.array([None if x is None else sum(map(cache.__getitem__, x)) for x in cut], pa.int64())
                yield pa.StructArray.from_arrays([words, tokens], ["words", "tokens"])

    return sizes


def encode_words(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """(word, n, symbols): each distinct word once, in Arrow batches; merges are sent to each executor once."""
    ranks = words.sparkSession.sparkContext.broadcast({tuple(m): i for i, m in enumerate(merges)})

    @F.pandas_udf("array<string>")
    def encode(w: pd.Series) -> pd.Series:
        return w.map(lambda x: None if x is None else apply_merges(x, ranks.value))

    return words.withColumn("symbols", encode("word"))


def encoded_sizes(docs: DataFrame, merges: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words, tokens), of the documents of each key that have words. Words are encoded where they stand; only sums are shuffled."""
    t = docs.select(key, _sizes(merges, docs)(F.col(text)).alias("s"))
    return t.groupBy(key).agg(F.sum("s.words").alias("words"), F.sum("s.tokens").alias("tokens")).where("words > 0")  # a filter before would run the function twice
