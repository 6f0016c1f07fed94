"""Remove passages that repeat an earlier passage anywhere in the corpus; the earliest stays, offsets are retained.

Units are hashed, and their digests grouped over all documents. A text is cut into units in two ways: at its line ends, and
at borders that follow from the words themselves, wherever lines are wrapped: between two words whose MD5 digests agree
in their first BORDER_BITS bits (one place in four). A passage is thus cut alike in every text, however the words around
it are arranged. What is compared are stretches: from each unit the fewest units onward that have ``min_words`` words
together. So a long line is a stretch of its own, short lines and units are compared together with those that follow. Words are compared with A-Z in lower case and white space as one space, by 96
bits of their MD5.

The occurrence that ranks first stays: the smallest (doc_id, hash of the text, place); the words of all others go. The
place that stays for a removed word may itself lie in another repeated stretch, but ranks before it, so of every
passage one occurrence stays.

An occurrence that repeats another of its own Arrow batch is removed then and there, so a digest sends at most one row a
batch to the shuffle, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import written

#: Shorter stretches stay: stock phrases and licence lines repeat in texts that copy nothing else.
MIN_WORDS = 30
BORDER_BITS = 2
#: Bytes of text whose stretches are compared within a task before they are shuffled; a longer text is taken alone.
TASK_BYTES = 1 << 24
#: Removed places are broadcast to the scan of the texts up to this many, and beyond it joined by shuffling.
BROADCAST_SPANS = 500_000
_WORDS_KEPT = 1 << 20


class _Bits(dict):
    """First bits of the MD5 of words, by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = bits = md5(word).digest()[0] >> (8 - BORDER_BITS)
        return bits


def stretches(ends: np.ndarray, rows: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the stretches, and the words after their last. ``ends``: whether a unit ends after a word, always so
    after a text's last; ``rows``: the text each word is in."""
    bounds = np.concatenate([[0], np.flatnonzero(ends) + 1])
    onward = np.searchsorted(bounds, bounds[:-1] + min_words)
    a, b = bounds[:-1], bounds[np.minimum(onward, len(bounds) - 1)]
    fits = (onward < len(bounds)) & (rows[a] == rows[b - 1])
    return a[fits], b[fits]


def text_stretches(data: np.ndarray, at: np.ndarray, bits: _Bits, min_words: int) -> tuple[np.ndarray, ...]:
    """Row, start and end in characters, and digest (n x 2) of the stretches of some texts, given as bytes and offsets.

    A stretch ends where the next word begins, or with the text.
    """
    starts, ends, rows = K.spans(data, at, K.separators("spaces"))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros((0, 2), np.int64),)
    low = data.tobytes().lower()
    words = list(chain.from_iterable(low[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)))
    code = np.fromiter(map(bits.__getitem__, words), np.int64, len(words))
    last = np.append(rows[1:] != rows[:-1], True)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    by_line = last | np.append(breaks[starts[1:]] > breaks[ends[:-1]], True)
    by_words = last | np.append(code[1:] == code[:-1], True)
    first, after = np.divmod(np.unique(np.concatenate([a * len(words) + b - 1 for a, b in (stretches(cut, rows, min_words) for cut in (by_line, by_words))])), len(words))
    after += 1
    # Digests of the words with one space between them.
    normal = b" ".join(words)
    places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    a, b = places[first].tolist(), (places[after] - 1).tolist()
    digests = np.frombuffer(b"".join([md5(normal[i:j]).digest() for i, j in zip(a, b, strict=True)]), np.int64).reshape(-1, 2)
    # Characters: bytes that do not continue one.
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = rows[first]
    base = chars[at[row]]
    end = np.where(last[after - 1], at[row + 1], np.append(starts, len(data))[after])
    return row, chars[starts[first]] - base, chars[end] - base, digests


def _units(min_words: int):
    """Stretches as (doc_id, key, high, low, length): ``high`` and the upper half of ``low`` are 96 bits of the digest, the
    lower half of ``low`` is the start. A negative length marks a repeat of a stretch of the same batch."""
    names = ["doc_id", "key", "high", "low", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _Bits()
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            held, size = [], 0
            for lo, hi, data, at in K.pieces(batch.column(2)):
                row, start, end, digest = text_stretches(data, at, bits, min_words)
                held.append((row + lo, start, end, digest))
                size += len(data)
                if size < TASK_BYTES and hi < batch.num_rows:
                    continue
                row, start, end, digest = (np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
                if not len(row):
                    continue
                order = np.lexsort((start, keys[row], number[row], ~null[row], digest[:, 1], digest[:, 0]))
                row, start, end, digest = row[order], start[order], end[order], digest[order]
                doc = np.stack([null[row], number[row], keys[row], start], 1)
                same = np.append(False, (digest[1:] == digest[:-1]).all(1))
                # Rows that are equal in id and text are one document.
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
                again = same & (doc != doc[first]).any(1)
                kept = ~same | again
                length = np.where(again, start - end, end - start)
                # Known repeats are dealt out by their place, not by the digest that may be frequent.
                place = K.mix(keys[row].view(K.U) + start.astype(K.U)).view(np.int64)
                high = np.where(again, place, digest[:, 0])
                low = (digest[:, 1] << 32) | start
                columns = [pa.array(number[row][kept], pa.int64(), mask=null[row][kept]), keys[row][kept], high[kept], low[kept], length[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, start, length) of every place to remove, in characters of the original text, apart from each other.

    ``key`` is a hash of the text. Rows equal in id and text are one document here: what is removed from one is removed
    from each. Documents rank by doc_id, null first, then by key. A place runs from its first word to where the next
    word begins, or to the end of the text. Null, empty and short texts have none.
    """
    schema = "doc_id bigint, key bigint, high bigint, low bigint, length bigint"
    # Narrow rows, since every stretch is shuffled once; the rest is unpacked beyond the exchange.
    units = _keyed(docs).where("text is not null").mapInArrow(_units(min_words), schema).repartition("high")
    units = units.selectExpr("doc_id", "key", "high", "shiftright(low, 32) AS rest", "low & 4294967295 AS start", "length")
    by_digest = Window.partitionBy("high", "rest").orderBy(F.col("doc_id").asc_nulls_first(), "key", "start")
    where = F.struct("doc_id", "key", "start")
    ranked = units.withColumn("first", F.first(where).over(by_digest))
    gone = ranked.where((F.col("length") < 0) | ~where.eqNullSafe(F.col("first")))
    gone = gone.select("doc_id", "key", "start", (F.col("start") + F.abs("length")).alias("end"))
    by_text = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    reached = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    apart = gone.withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    apart = apart.withColumn("part", F.sum("new").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = apart.groupBy("doc_id", "key", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.select("doc_id", "key", "start", (F.col("end") - F.col("start")).alias("length"))


def _without(text: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
    def cut(t, a, n):
        if t is None or a is None:
            return None
        edges = [0, *(x for i, k in zip(a, n, strict=True) for x in (i, i + k)), len(t)]
        return "".join(t[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))

    return pd.Series([cut(*x) for x in zip(text, starts, lengths, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with text reduced to what stays, and ``removed``: array<struct<start bigint, length bigint>>, in order.

    ``start`` and ``length`` are in characters of the original text; ``removed`` is null where nothing goes. Null texts
    stay null, and nothing is removed from empty ones; a text all of whose words go becomes empty or white space, not null.
    All other columns are kept, whatever their names, but for one named ``removed``, which is replaced; equal rows stay as
    many as they were. Only ``__id``, ``__key`` and ``__spans`` are reserved.
    """
    spans = written(repeated_spans(docs, min_words), "repeated")
    gone = spans.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__spans"))
    if spans.count() <= BROADCAST_SPANS:
        gone = F.broadcast(gone)
    same: Column = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    out = docs.drop("removed").join(gone, same, "left")
    hit = F.col("__spans").isNotNull()
    cut = F.pandas_udf(_without, "string")(F.when(hit, F.col("text")), F.col("__spans.start"), F.col("__spans.length"))
    return out.withColumn("removed", F.col("__spans")).withColumn("text", F.when(hit, cut).otherwise(F.col("text"))).drop("__id", "__key", "__spans")
