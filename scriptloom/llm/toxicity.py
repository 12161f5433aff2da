"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = logistic(w . x - b_k) for the thresholds b_1 < b_2 < ...: all thresholds share the weights w.
The result is the expected grade, the sum over k of P(grade >= k), and P(grade >= 1).

Features are presences of words and of runs of four and of five bytes inside a word with the space before it, hashed
to 2^22 buckets; those whose document frequency differs between the classes by at least MIN_Z standard
errors are kept, MAX_FEATURES at most. A text is read whole.

The labels say only toxic or not. A toxic training document's grade is 1, 2 or 3 by the tercile of the
number of its features that are tied to toxicity; the others have grade 0.

The fit uses at most MAX_PER_CLASS labelled documents of each class (a documented bound; those of least
hash of doc_id, so the same ones each time), weighted to the classes' shares among all labels. Scoring
reads every document, without a shuffle.

Defined results: a null or empty text has no features and so the scores of the thresholds alone. Rows with
a null doc_id are scored like others. Repeated rows are scored alike; repeated labels of a document count
once, as toxic if any says so; labels of unknown documents count for nothing. Without a label of either
class every score is 0. Further columns are ignored by score() and kept by keep_clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import ending_freed, freed, id_and_text, picked, shared
from scriptloom.llm.textbatch import U64, Words, chunks, mix, words

BITS = 22
GRAMS = (4, 5)
MAX_PER_CLASS = 3000
MAX_FEATURES = 1024
MIN_Z = 4.0
MIN_TOXIC = 4
GRADES = 4
L2 = 1e-4
STEPS = 400
REJECT_AT = 0.4
SCHEMA = "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean"


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature of a batch: each word, and each gram inside " word"."""
    size = w.end - w.start
    codes, owner = [w.hashes() | U64(1)], [np.arange(len(size))]
    padded = np.concatenate((np.full(1, 32, np.uint8), w.data, np.zeros(max(GRAMS), np.uint8))).astype(np.uint64)
    for gram in GRAMS:
        runs = np.maximum(size + 2 - gram, 0)  # the space counts as the first byte
        own = np.repeat(np.arange(len(size)), runs)
        if not len(own):
            continue
        place = np.arange(len(own)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = w.start[own] + place  # in padded, the byte before the gram's second one
        code = np.where(place == 0, U64(32), padded[at])
        for j in range(1, gram):
            code = (code << U64(8)) | padded[at + j]
        codes.append(mix(code) & ~U64(1))
        owner.append(own)
    return np.concatenate(owner), (mix(np.concatenate(codes)) >> U64(64 - BITS)).astype(np.int64)


def _sparse(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    row = 0
    for part in chunks(batch, size=1 << 18):
        w = words(part.column("text"))
        owner, bucket = _buckets(w)
        yield row, w.text_of_word()[owner] if len(owner) else owner, bucket, owner, w.count
        row += part.num_rows


@dataclass
class OrdinalModel:
    features: np.ndarray  # buckets, sorted
    weights: np.ndarray
    thresholds: np.ndarray  # none if no document can be toxic

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on the whole of x; thresholds are kept in order by positive steps."""
    n, m = x.shape
    weight = weight / weight.sum()
    above = np.array([max(1e-6, weight[y >= k].sum()) for k in range(1, grades)])
    logit = np.log((1 - np.minimum(above, 1 - 1e-6)) / above)
    par = np.concatenate((np.zeros(m), logit[:1], np.log(np.maximum(np.diff(logit), 0.05))))
    mean, square = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        w, steps_ = par[:m], np.exp(par[m + 1 :])
        b = par[m] + np.concatenate(([0.0], np.cumsum(steps_)))
        p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - b[None, :], -30, 30)))
        full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
        here = np.maximum(full[np.arange(n), y] - full[np.arange(n), y + 1], 1e-12)
        slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), axis=1)
        up, down = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        d_eta = -(up - down) / here * weight
        d_b = np.zeros(grades - 1)
        np.add.at(d_b, np.maximum(y - 1, 0), np.where(y > 0, up / here, 0) * weight)
        np.add.at(d_b, np.minimum(y, grades - 2), np.where(y < grades - 1, -down / here, 0) * weight)
        grad = np.concatenate((x.T @ d_eta + l2 * w, [d_b.sum()], [d_b[k:].sum() * steps_[k - 1] for k in range(1, grades - 1)]))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        par = par - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return par[:m], par[m] + np.concatenate(([0.0], np.cumsum(np.exp(par[m + 1 :]))))


def fit_texts(texts: list[str], toxic: np.ndarray, share: float) -> OrdinalModel:
    """A model of labelled texts; share is the toxic share among all labels."""
    toxic = np.asarray(toxic, bool)
    none = np.zeros(0)
    if not len(toxic) or toxic.all() or not toxic.any():
        return OrdinalModel(none.astype(np.int64), none, none)
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    frequency = np.zeros((2, 1 << BITS), np.int32)
    for row, doc, bucket, _, _ in _sparse(batch):
        pair = np.unique((doc.astype(np.int64) << BITS) | bucket)
        label = toxic[row + (pair >> BITS)]
        for c in (0, 1):
            frequency[c] += np.bincount(pair[label == c] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
    n0, n1 = int((~toxic).sum()), int(toxic.sum())
    often = np.flatnonzero(frequency[1] + frequency[0] >= MIN_TOXIC)
    f0, f1 = frequency[:, often]
    p0, p1, p = (f0 + 0.5) / (n0 + 1), (f1 + 0.5) / (n1 + 1), (f0 + f1 + 0.5) / (n0 + n1 + 1)
    z = np.zeros(1 << BITS, np.float32)
    z[often] = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    good = np.flatnonzero(np.abs(z) >= MIN_Z)
    if len(good) > MAX_FEATURES:
        good = good[np.argsort(-np.abs(z[good]), kind="stable")[:MAX_FEATURES]]
    good = np.sort(good)
    place = np.full(1 << BITS, -1, np.int32)
    place[good] = np.arange(len(good))
    x = np.zeros((len(toxic), len(good)))
    hits = np.zeros(len(toxic))
    for row, doc, bucket, _, count in _sparse(batch):
        f = place[bucket]
        hit = f >= 0
        x[row + doc[hit], f[hit]] = 1
        tied = np.flatnonzero(hit & (z[bucket] > 2 * MIN_Z))
        pair = np.unique(doc[tied].astype(np.int64) * len(place) + bucket[tied])
        hits[row : row + len(count)] = np.bincount(pair // len(place), minlength=len(count))
    cuts = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    y = np.where(toxic, 1 + (hits > cuts[0]) + (hits > cuts[1]), 0).astype(np.int64)
    weight = np.where(toxic, share / n1, (1 - share) / n0)
    w, b = fit_ordinal(x, y, weight, GRADES, L2, STEPS)
    return OrdinalModel(good, w, b)


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> OrdinalModel:
    known = picked(labels, doc_id="long", toxic="int").withColumnRenamed("toxic", "t")
    known = known.where("doc_id is not null and t is not null").groupBy("doc_id").agg((F.max("t") > 0).alias("t"))
    counts = {bool(r["t"]): r["count"] for r in known.groupBy("t").count().collect()}
    if len(counts) < 2:
        return fit_texts([], np.zeros(0, bool), 0.0)
    own = id_and_text(docs)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("t").orderBy(*order).limit(max_per_class).unionByName(known.where("not t").orderBy(*order).limit(max_per_class))
    # At most 2 * max_per_class pairs of 9 bytes: small by the bound, so they can be sent to all executors.
    rows = own.join(F.broadcast(some), "doc_id").toArrow().combine_chunks()
    rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")]))
    model = fit_texts(rows["text"].to_pylist(), rows["t"].to_numpy(), counts[True] / (counts[True] + counts[False]))
    del rows
    freed()
    return model


def score_batch(batch: pa.RecordBatch, model: OrdinalModel, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade >= k) of each row, and the row's linear score."""
    eta = np.zeros(batch.num_rows)
    m = max(1, len(model.features))
    for row, doc, bucket, _, _ in _sparse(batch):
        f = place[bucket]
        hit = f >= 0
        pair = np.unique(doc[hit].astype(np.int64) * m + f[hit])
        np.add.at(eta, row + pair // m, model.weights[pair % m])
    return (model.probabilities(eta) if len(model.thresholds) else np.zeros((batch.num_rows, GRADES - 1))), eta


def _place(model: OrdinalModel) -> np.ndarray:
    place = np.full(1 << BITS, -1, np.int16)
    place[model.features] = np.arange(len(model.features))
    return place


def score(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, P(grade >= 1), the expected severity, the most probable grade, and whether P(grade >= 1) reaches reject_at."""
    fitted = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted()
        place = _place(model)
        for batch in ending_freed(batches):
            p, _ = score_batch(batch, model, place)
            each = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1), axis=1)
            out = [batch.column("doc_id"), p[:, 0], p.sum(axis=1), each.argmax(axis=1).astype(np.int32), p[:, 0] >= reject_at]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], ["doc_id", "p_toxic", "expected_severity", "grade", "toxic"])

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject. The score is of the row's own text, so no join is needed."""
    fitted = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted()
        place = _place(model)
        for batch in ending_freed(batches):
            p, _ = score_batch(batch, model, place)
            yield batch.filter(pa.array(p[:, 0] < reject_at))

    return docs.mapInArrow(run, docs.schema)
