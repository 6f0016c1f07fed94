"""Toxicity by FTRL-proximal logistic regression over hashed words (whole and beginnings), word pairs and skip pairs.

Every coordinate has its own learning rate, and L1 keeps most weights at exactly zero, so the model that goes to the
executors is a short list of (bucket, weight). Features are present or absent: a text has each at most once. Words are
stretches of letters, digits and non-ASCII characters, in lower case (A-Z).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import labelled_sample

BITS = 20
#: Bound of the labelled sample that a model is fitted on.
SAMPLE_ROWS = 8000
ALPHA, BETA, L2 = 2.0, 1.0, 0.0
#: L1 for a sample of L1_ROWS rows. Sums of slopes that are mere chance grow with the root of the rows, and so does L1.
L1, L1_ROWS = 8.0, 3000
#: A toxic example counts so many times; there are fewer of them.
TOXIC_WEIGHT = 2.0
#: Longer words also count by their first so many bytes, since endings vary.
STEMS = (4, 5, 6)
#: Few examples are gone through more often: until so many are seen, within these numbers of passes.
SEEN, PASSES = 40_000, (4, 20)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.buckets] = self.weights
        return w


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all words, word beginnings, pairs and skip pairs (one word between), repeats included."""
    data = K.lowered(data)
    starts, ends, row = K.spans(data, at, K.separators("marks"))
    word = K.span_hashes(data, starts, ends)
    hashes, rows = [word], [row]
    for gap in (1, 2):
        n = len(word) - gap
        if n > 0:
            near = row[:n] == row[gap:]
            hashes.append(K.mix(word[:n][near] * K.U(0x8EBC6AF09C88C6E3 + 2 * gap) + word[gap:][near]))
            rows.append(row[:n][near])
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        hashes.append(K.mix(K.span_hashes(data, starts[longer], starts[longer] + size) + K.U(size)))
        rows.append(row[longer])
    bucket = (np.concatenate(hashes) >> K.U(64 - BITS)).astype(np.int64)
    return np.concatenate(rows), bucket


def train(sample: list[tuple[str, int]]) -> Model:
    """FTRL-proximal over the sample, in its order, several times. Nothing to learn from: all weights zero, score 0.5."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias, without L1
    shrink = np.full(len(z), L1 * np.sqrt(len(sample) / L1_ROWS))
    shrink[-1] = 0.0
    rows = []
    for lo in range(0, len(sample), 256):
        texts = pa.array([t for t, _ in sample[lo : lo + 256]], pa.string())
        for a, b, data, at in K.pieces(texts):
            row, bucket = features(data, at)
            key = np.unique((row << BITS) | bucket)
            cut = np.searchsorted(key >> BITS, np.arange(b - a + 1))
            rows += [((key[i:j] & ((1 << BITS) - 1)).astype(np.int32), sample[lo + a + k][1]) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= shrink[i], 0.0, (np.sign(zi) * shrink[i] - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(min(max(SEEN // max(len(sample), 1), PASSES[0]), PASSES[1])):
        for bucket, label in rows:
            i = np.append(bucket, 1 << BITS)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * (TOXIC_WEIGHT if label else 1.0)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(len(z)))
    kept = np.flatnonzero(w[:-1])
    return Model(kept, w[kept], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    return train(labelled_sample(docs, labels, "toxic", usable, sample_rows))


def score_texts(docs: DataFrame, model: Model, *keep: Column | str) -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1, higher: label 1 likelier), for every row of ``docs``.

    A null or empty text has the score of the bias alone.
    """
    plain = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.dense()
        for batch in batches:
            total = np.full(batch.num_rows, model.bias)
            for lo, hi, data, at in K.pieces(batch.column(batch.num_columns - 1)):
                row, bucket = features(data, at)
                active = weight[bucket] != 0
                key = np.unique((row[active] << BITS) | bucket[active])
                total[lo:hi] += np.bincount(key >> BITS, weight[key & ((1 << BITS) - 1)], minlength=hi - lo)
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{types}score double")
