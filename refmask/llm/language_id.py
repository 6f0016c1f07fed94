"""Language identification by error-correcting output codes.

Each language has a codeword of bits: with up to ALL_SPLITS_UP_TO languages every split in two is a bit, with more the bits are
random ones. For each bit a naive Bayes classifier over hashed byte n-grams (1 to 4 bytes)
tells the languages with a 1 from those with a 0. A text's margins are decoded to the codeword with the least
logistic loss, each bit weighted by how well its two sides are apart. The n-gram counts cover all training texts: every
task sums a table of languages x buckets, so what reaches the driver depends on the number of languages only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
#: With more languages than this, codewords are random, of CODE_BITS_PER_LOG2 * log2(languages) bits.
ALL_SPLITS_UP_TO = 6
CODE_BITS_PER_LOG2 = 10
SMOOTHING = 0.5
#: Texts handled at once: each takes a table of BUCKETS counts.
PIECE_ROWS = 256
SHARPNESS = 3.0
#: The best language is called ambiguous if it has less than this much more probability than the next.
AMBIGUITY = 0.2


def histograms(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, one row a text. ASCII digits and marks count as spaces, A-Z as a-z."""
    data = np.where(K.separators("marks")[data], 32, K.lowered(data)).astype(K.U)
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    total = np.zeros(rows * BUCKETS, np.float32)
    for order in ORDERS:
        n = len(data) - order + 1
        if n <= 0:
            break
        key = np.zeros(n, K.U)
        for j in range(order):
            key = (key << K.U(8)) | data[j : j + n]
        bucket = ((key + K.U(order << 40)) * K.U(0x9E3779B97F4A7C15)) >> K.U(64 - 13)
        within = row[:n] == row[order - 1 :]
        total += np.bincount(row[:n][within] * BUCKETS + bucket[within].astype(np.int64), minlength=rows * BUCKETS).astype(np.float32)
    return total.reshape(rows, BUCKETS)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        codes = batch.column(1).dictionary_encode()
        names, index = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        for lo, hi, data, at in K.pieces(batch.column(0), 1 << 20, PIECE_ROWS):
            counts = histograms(data, at)
            for code in np.unique(index[lo:hi]):
                tables[names[code]] = tables.get(names[code], 0) + counts[index[lo:hi] == code].astype(np.float64).sum(0)
    for name, t in tables.items():
        yield pa.RecordBatch.from_pydict({"lang": [name] * BUCKETS, "bucket": pa.array(np.arange(BUCKETS), pa.int32()), "n": t})


def codewords(languages: int) -> np.ndarray:
    """Rows of -1 and 1. Few languages: every split in two, once. More: the same random bits on every run."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= ALL_SPLITS_UP_TO:
        splits = np.arange(1, 1 << (languages - 1))
        return np.stack([np.where((splits >> i) & 1, 1.0, -1.0) if i < languages - 1 else -np.ones(len(splits)) for i in range(languages)])
    bits = int(np.ceil(CODE_BITS_PER_LOG2 * np.log2(languages)))
    best, best_gap = None, -1
    for seed in range(100):  # of a hundred codes, the one whose closest words differ most
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (languages, bits))
        gap = int(((bits - code @ code.T) / 2 + bits * np.eye(languages)).min())
        if gap > best_gap and (np.abs(code.sum(0)) < languages).all():
            best, best_gap = code, gap
    return best if best is not None else np.random.default_rng(0).choice([-1.0, 1.0], (languages, bits))


def fit(training: DataFrame) -> dict:
    """A model from (text, lang) rows; rows with a null in either teach nothing."""
    counts = (
        training.where("text is not null and lang is not null")
        .select("text", "lang")
        .mapInArrow(_tables, "lang string, bucket int, n double")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("table"))  # BUCKETS entries a language
        .collect()
    )
    languages = sorted((r.lang for r in counts), key=lambda x: x.encode())
    if not languages:
        return {"languages": [], "code": np.zeros((0, 0))}
    tables = {r.lang: np.array([x.n for x in r.table]) for r in counts}
    share = np.stack([(tables[x] + SMOOTHING) / (tables[x] + SMOOTHING).sum() for x in languages])
    code = codewords(len(languages))
    ones, zeros = (np.stack([share[side].mean(0) if side.any() else np.full(BUCKETS, 1 / BUCKETS) for side in (code == s).T]) for s in (1, -1))
    weights = np.log(ones) - np.log(zeros)  # bits x buckets
    # Each language's expected margin; a bit's middle and spread are those of its closest two languages.
    expected = share @ weights.T
    low = np.where(code == 1, expected, np.inf).min(0)
    high = np.where(code == -1, expected, -np.inf).max(0)
    middle, half = ((low + high) / 2, np.maximum((low - high) / 2, 1e-3)) if len(languages) > 1 else (expected[0], np.ones(1))
    importance = half / half.sum()
    return {"languages": languages, "code": code, "weights": weights.T.astype(np.float32), "middle": middle, "half": half, "importance": importance}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language, its probability, and the lead over the next."""
    loss = np.logaddexp(0, -SHARPNESS * margins[:, None, :] * model["code"][None]) @ model["importance"]
    p = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    ranked = np.sort(p, 1)
    lead = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
    return best, p[np.arange(len(p)), best], lead


def identify(docs: DataFrame, model: dict, *keep: Column) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred, score and ambiguous, for every row of ``docs``.

    ``und`` with score 0 for a null text, one without a letter, and if nothing was learned. Equal losses go to the
    language first by code point. A single learned language is always chosen.
    """
    plain = docs.select("doc_id", *keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    kept = [c for c in plain.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, text = batch.num_rows, batch.column(batch.num_columns - 1)
            names, score, unsure = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if model["languages"]:
                for lo, hi, data, at in K.pieces(text, 1 << 20, PIECE_ROWS):
                    counts = histograms(data, at)
                    margins = (counts @ model["weights"]) / np.maximum(counts.sum(1, keepdims=True), 1)
                    best, p, lead = decode((margins - model["middle"]) / model["half"], model)
                    names[lo:hi] = np.array(model["languages"], object)[best]
                    score[lo:hi], unsure[lo:hi] = p, lead < AMBIGUITY
                none = text.is_null().to_numpy(zero_copy_only=False)
                names[none], score[none], unsure[none] = "und", 0.0, True
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", "ambiguous"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{types}, lang_pred string, score double, ambiguous boolean")
