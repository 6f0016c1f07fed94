"""Quality by compression: does a text compress better with a dictionary of good texts or with one of bad texts?

Two zstandard dictionaries are built from labelled texts. A text is cut into blocks, each block is compressed with both,
and the difference of the two total sizes, divided by the size of the text, is the text's margin. Blocks are small, so
that a long text is judged by the dictionaries and not by what it repeats itself. A monotone calibration (isotonic
regression on labelled texts that are in neither dictionary) turns margins into probabilities of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

#: Bound of the labelled sample that a model is fitted on.
SAMPLE_ROWS = 6000
DICTIONARY_BYTES = 112 * 1024
BLOCK_BYTES = 1024
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    margins: list[float]
    scores: list[float]


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; with too few samples to train on, the texts themselves."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def compressors(model: Model) -> tuple:
    made = []
    for d in (model.good, model.bad):
        trained = zstandard.ZstdCompressionDict(d) if d else None
        if trained:
            trained.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=False, write_content_size=False, write_dict_id=False))
    return tuple(made)


def margin(text: bytes, pair: tuple) -> float:
    """Bytes that the good dictionary saves against the bad one, for each byte of text; 0 for an empty text."""
    if not text:
        return 0.0
    good, bad = pair
    saved = 0
    for block in blocks(text):
        saved += len(bad.compress(block)) - len(good.compress(block))
    return saved / len(text)


def isotonic(x: list[float], y: list[int]) -> tuple[list[float], list[float]]:
    """Knots of the non-decreasing fit of y by x (pool adjacent violators), with one good and one bad case added to each pool."""
    pools: list[list[float]] = []
    for a, b in sorted(zip(x, y, strict=True)):
        pools.append([a, a, b, 1])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, end, total, n = pools.pop()
            pools[-1] = [pools[-1][0], end, pools[-1][2] + total, pools[-1][3] + n]
    knots, scores = [], []
    for start, end, total, n in pools:
        knots += [start] if start == end else [start, end]
        scores += [(total + 1) / (n + 2)] * (1 if start == end else 2)
    return knots, list(np.maximum.accumulate(scores)) if scores else []


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Half of the sample makes the dictionaries, the other half the calibration; the halves alternate within a label.

    Without labels the model gives 0.5; with one kind of label only, that label's side of 0.5.
    """
    sample = labelled_sample(docs, labels, "quality", usable, sample_rows)
    texts = {q: [t.encode() for t, label in sample if label == q] for q in (0, 1)}
    model = Model(*(dictionary(texts[q][::2]) if texts[q] else b"" for q in (1, 0)), [], [])
    rest = [(t, q) for q in (0, 1) for t in (texts[q][1::2] or texts[q])]
    pair = compressors(model)
    model.margins, model.scores = isotonic([margin(t, pair) for t, _ in rest], [q for _, q in rest])
    return model


def score_texts(docs: DataFrame, model: Model, *keep: Column | str) -> DataFrame:
    """The columns ``keep`` and ``margin``, ``score`` (0 to 1, higher: label 1 likelier), for every row of ``docs``.

    A null or empty text has margin 0 and the score of that margin. A score lies between the calibrated scores of the
    two nearest margins.
    """
    plain = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model)
        for batch in batches:
            margins = np.array([margin(t.as_buffer().to_pybytes() if t.is_valid else b"", pair) for t in batch.column(batch.num_columns - 1)], float)
            scores = np.interp(margins, model.margins, model.scores) if model.margins else np.full(len(margins), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margins), pa.array(scores)], names=[*batch.schema.names[:-1], "margin", "score"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{types}margin double, score double")
