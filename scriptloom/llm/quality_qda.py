"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text gives the statistics named in STATISTICS, transformed to be nearer to normal (logarithms of
counts, arcsine roots of shares). Class covariances are shrunk twice: towards the pooled covariance by
POOL, then towards its mean variance by RIDGE. A score is the difference of the two log densities, each
from a Mahalanobis distance by a cached Cholesky factor, plus the log of the prior odds.

Statistics come from one pass over all texts, whole; the classes' moments from all labelled documents
(sums of products, added up on the executors); scores from the statistics. Only statistics are shuffled.

Defined results: a null text has the statistics of an empty one. A row with a null doc_id is scored as
others. Repeated labels of a document count once, as good if all say so. Repeated rows are scored alike.
With fewer than two labelled documents of a class, score is 0 and every document counts as good.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import id_and_text, picked, shared, written
from scriptloom.llm.textbatch import U64, byte_buffer, chunks, mix, shingles, words

POOL = 0.3
RIDGE = 0.02
STATISTICS = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "spaces", "distinct_words", "repeated_runs", "line_words", "short_words", "symbol_kinds"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    data, off = byte_buffer(texts)
    n = len(off) - 1

    def counted(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[off[1:]] - total[off[:-1]]

    size = np.diff(off)
    upper, lower = (data >= 65) & (data <= 90), ((data >= 97) & (data <= 122)) | (data >= 192)
    digit, space = (data >= 48) & (data <= 57), (data <= 32)
    symbol = (data < 128) & ~(upper | lower | digit | space)
    letters = counted(upper | lower)
    w = words(texts)
    count = w.count
    text, h = w.text_of_word(), w.hashes()

    def distinct(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        _, first = np.unique(mix(keys + owner.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), return_index=True)
        return np.bincount(owner[first], minlength=n)

    run, to = shingles(h, w.first, 3)
    runs = np.diff(to)
    size_of_word = w.end - w.start
    in_words = np.bincount(text, size_of_word, minlength=n)
    short = np.bincount(text, size_of_word <= 3, minlength=n)
    at = np.flatnonzero(symbol)
    doc_of = np.searchsorted(off, at, "right") - 1
    kinds = np.bincount(np.unique(doc_of * 128 + data[at]) // 128, minlength=n) if len(at) else np.zeros(n)
    lines = counted(data == 10) + 1
    return np.column_stack(
        [
            np.log1p(size), np.log1p(count), np.log1p(in_words / np.maximum(count, 1)), _share(counted(upper), letters), _share(counted(digit), size), _share(counted(symbol), size),
            _share(counted(space), size), _share(distinct(text, h), count), _share(runs - distinct(np.repeat(np.arange(n), runs), run), runs), np.log1p(count / lines), _share(short, count), np.log1p(kinds),
        ]
    ).astype(np.float64)


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in x.T)], ["doc_id", *STATISTICS])

    return id_and_text(docs).mapInArrow(run, STATS_SCHEMA)


def forward_substituted(low: np.ndarray, y: np.ndarray) -> np.ndarray:
    """z of low z = y for a lower triangle; y has a column for each document."""
    z = np.empty_like(y)
    for i in range(len(low)):
        z[i] = (y[i] - low[i, :i] @ z[:i]) / low[i, i]
    return z


@dataclass
class QuadraticModel:
    means: np.ndarray  # 2 x d, class 0 then class 1
    factors: np.ndarray  # lower Cholesky factors of the shrunk covariances
    offset: float  # log prior odds less half the difference of the log determinants

    def score(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, with priors."""
        half = [0.5 * (forward_substituted(low, (x - m).T) ** 2).sum(axis=0) for m, low in zip(self.means, self.factors)]
        return self.offset + half[0] - half[1]


def model_of(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> QuadraticModel | None:
    """The model of two classes' counts, sums (2 x d) and sums of products (2 x d x d)."""
    if (counts < 2).any():
        return None
    means = sums / counts[:, None]
    scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / (counts.sum() - 2)
    scale = np.maximum(np.diag(pooled), 1e-6)
    factors = []
    for c in (0, 1):
        cov = (1 - pool) * scatter[c] / (counts[c] - 1) + pool * pooled
        factors.append(np.linalg.cholesky((1 - ridge) * cov + ridge * np.diag(scale)))
    logs = [np.log(np.diag(f)).sum() for f in factors]
    return QuadraticModel(means, np.array(factors), float(np.log(counts[1] / counts[0]) - logs[1] + logs[0]))


def fit(stats: DataFrame, labels: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> QuadraticModel | None:
    """Moments over all labelled documents, added up by one aggregate; the driver gets 2 rows of 91 numbers."""
    known = picked(labels, doc_id="long", quality="int").withColumnRenamed("quality", "good")
    known = known.where("doc_id is not null and good is not null").groupBy("doc_id").agg((F.min("good") > 0).cast("int").alias("good"))
    d = len(STATISTICS)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(STATISTICS)]
    products = [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = {r["good"]: r for r in stats.join(known, "doc_id").groupBy("good").agg(F.count("*").alias("n"), *sums, *products).collect()}
    if len(rows) < 2:
        return None
    p = np.array([[[rows[c][f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)] for c in (0, 1)])
    return model_of(np.array([rows[c]["n"] for c in (0, 1)], float), np.array([[rows[c][f"s{i}"] for i in range(d)] for c in (0, 1)]), p, pool, ridge)


def score(stats: DataFrame, model: QuadraticModel | None) -> DataFrame:
    """doc_id, the log density difference, and whether the document counts as good."""
    if model is None:
        return stats.select("doc_id", F.lit(0.0).alias("score"), F.lit(True).alias("good"))
    fitted = shared(stats.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = fitted().score(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(s >= 0)], ["doc_id", "score", "good"])

    return stats.mapInArrow(run, "doc_id long, score double, good boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics are written once (13 numbers a document), then used for the fit and for the scores."""
    stats = written(document_statistics(docs), "document-statistics")
    return score(stats, fit(stats, labels))
