"""Quality classifier: vectors of hashed words and character n-grams, averaged per document, under a softmax.

Words and byte 3- and 4-grams share one hashed table of vectors; a word that repeats the one before it adds one more
feature, the same for all words. The model is fitted by stochastic gradient descent in numpy, in one task over a sample
of at most `max_rows` labelled rows; the driver gets the model's table alone, never the rows or their features. Because
the output is linear in the averaged vectors, scoring needs one number per bucket: each task sums fixed-point numbers
over a whole text, so equal texts have equal scores wherever they are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from lexloom.functions.arrays import quoted

from .scratch import fresh, small_batches
from .textkernel import doc_runs, utf8, word_hashes

BITS, DIMENSIONS, EPOCHS, RATE, MAX_ROWS, THRESHOLD = 16, 8, 12, 0.5, 2000, 0.3
_WINDOW = 1 << 22
_GRAMS = ((3, 0x9E3779B1), (4, 0x85EBCA77))
_SCALE = 1 << 16


def _words(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, offsets of documents among them, and where a word repeats the one before it."""
    h, at, _ = word_hashes(x, offsets, lower=False)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[at[:-1][at[:-1] < len(h)]] = False
    return (h >> np.uint64(64 - BITS)).astype(np.int64), at, same


def _grams(x: np.ndarray, n: int, odd: int) -> np.ndarray:
    """Buckets of the byte n-grams of x."""
    if len(x) < n:
        return np.zeros(0, np.int64)
    y = x.astype(np.uint32)
    h = y[: len(x) - n + 1].copy()
    for k in range(1, n):
        h = h << np.uint32(8) | y[k : len(x) - n + 1 + k]
    return ((h + np.uint32(n)) * np.uint32(odd) >> np.uint32(32 - BITS)).astype(np.int64)


REPEAT = 1 << BITS  # the bucket after the hashed ones


def features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of one document."""
    words, _, same = _words(x, np.array([0, len(x)]))
    total = np.bincount(words, minlength=REPEAT + 1)
    total[REPEAT] += int(same.sum())
    for n, odd in _GRAMS:
        for a in range(0, len(x), _WINDOW):
            total += np.bincount(_grams(x[a : a + _WINDOW + n - 1], n, odd), minlength=REPEAT + 1)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    """table: fixed-point addition to the logit per bucket; bias: the logit of a text without features."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        x, offsets = utf8(column)
        total, count = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for a, b in doc_runs(offsets):
            part, at = x[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words, w_at, same = _words(part, at)
            run = np.concatenate([[0], np.cumsum(self.table[words] + same * self.table[REPEAT])])
            total[a:b] += run[w_at[1:]] - run[w_at[:-1]]
            run = np.concatenate([[0], np.cumsum(same)])
            count[a:b] += np.diff(w_at) + run[w_at[1:]] - run[w_at[:-1]]
            for n, odd in _GRAMS:
                sizes = np.maximum(0, np.diff(at) - n + 1)
                count[a:b] += sizes
                if b == a + 1:
                    for i in range(0, len(part), _WINDOW):
                        total[a] += self.table[_grams(part[i : i + _WINDOW + n - 1], n, odd)].sum()
                else:
                    run = np.concatenate([[0], np.cumsum(self.table[_grams(part, n, odd)])])
                    first = np.minimum(at[:-1], len(run) - 1)
                    total[a:b] += run[np.minimum(first + sizes, len(run) - 1)] - run[first]
        logit = self.bias + total / (_SCALE * np.maximum(count, 1))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], seed: int = 1, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent over (buckets, counts, label) rows; the prior alone where there are no rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (REPEAT + 1, DIMENSIONS))
    out, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    out[1] = rng.uniform(-1, 1, DIMENSIONS)
    rows = [(i, (c / max(1, c.sum())).astype(np.float32), y) for i, c, y in rows]
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, weight, label = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            mean = weight @ vectors[at] if len(at) else np.zeros(DIMENSIONS)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            step = p @ out
            out -= lr * np.outer(p, mean)
            bias -= lr * 0.1 * p
            if len(at):
                # An average over many features has small gradients: each vector's step is scaled up to its document's size.
                vectors[at] -= lr * math.sqrt(len(at)) * weight[:, None] * step
    return Model(np.rint(vectors @ (out[1] - out[0]) * _SCALE).astype(np.int64), float(bias[1] - bias[0]))


def _counted(batches):
    """The (buckets, counts, label) rows of batches of texts and labels."""
    for batch in batches:
        x, at = utf8(batch.column(0))
        for a, b, y in zip(at, at[1:], batch.column(1).to_pylist()):
            i, c = features(x[a:b])
            yield i.astype("<u4"), c.astype("<u4"), int(y > 0)


def _fitted(seed: int):
    def run(batches):
        m = fit(_counted(batches), seed)
        yield pa.RecordBatch.from_arrays([pa.array([m.table.astype("<i8").tobytes()], pa.binary()), pa.array([m.bias], pa.float64())], names=["table", "bias"])

    return run


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", order_col: str = "doc_id", max_rows: int = MAX_ROWS, seed: int = 1) -> Model:
    """Fit on the max_rows rows whose order_col hashes lowest, fewer if there are fewer. Rows without a label don't count."""
    small_batches(labelled.sparkSession)
    part = labelled.filter(F.col(label_col).isNotNull()).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(order_col).alias("h")
    )
    part = part.orderBy("h", "text", "label").limit(max_rows)
    one = part.coalesce(1).select("text", "label").mapInArrow(_fitted(seed), "table binary, bias double").collect()  # one row, or none of no rows
    return Model(np.frombuffer(one[0]["table"], "<i8"), one[0]["bias"]) if one else fit([], seed)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with two more, score and predicted, which replace any columns of those names, in
    whatever letter case; other columns keep their values.

    Null and empty texts get the score of a text without features, repeated rows the same score, an empty table no rows.
    """
    small_batches(docs.sparkSession)
    table, bias = model.table, model.bias
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    kept = docs.select(*[F.col(quoted(c)) for c in names])
    out = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(*fresh(kept, "text")), *kept.columns)

    def run(batches):
        m = Model(table, bias)
        for batch in batches:
            s = m.scores(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return out.mapInArrow(run, StructType([*kept.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType()))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, as they are: columns of any name keep their values. Null texts
    count as empty, equal texts stay or go together, an empty table gives no rows."""
    small_batches(docs.sparkSession)
    table, bias, at = model.table, model.bias, [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        m = Model(table, bias)
        for batch in batches:
            text = batch.column(at)
            yield batch.filter(pa.array(m.scores(text.fill_null("") if text.null_count else text) >= threshold))

    return docs.mapInArrow(run, docs.schema)
