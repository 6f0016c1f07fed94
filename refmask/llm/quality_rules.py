"""Quality rules whose cut-offs keep the share of wrongly rejected good documents below a chosen limit.

Each rule rejects documents whose ratio (marks, repeated lines, repeated phrases, capitals) is above a cut-off. Cut-offs
are learned per stratum from labelled documents. A cut-off is admitted only if the exact binomial test rejects "more than
``alpha`` of the good documents go": P(Bin(n, alpha) <= rejected) <= level. Cut-offs of one rule are tested from the
safest to the boldest and testing stops at the first failure, which needs no correction (fixed sequence). Over all
strata and rules the level is ``delta`` divided by their number (Bonferroni), and each rule has its share of the limit,
``risk`` / rules. So with probability 1 - ``delta`` no stratum loses more than ``risk`` of its good documents to the
learned cut-offs. A stratum with too few labels gets no cut-off and keeps everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import written

STATS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint"
#: Rule name and its ratio. Every ratio is 0 where its divisor is 0.
RULES = {
    "symbols": "n_symbols / word_chars",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_phrases": "n_repeat_words / n_words",
    "capitals": "n_capitals / word_chars",
}
#: Ratios are compared as whole steps of this size; cut-off c rejects ratios of more than c steps.
STEPS = 100
RISK, DELTA = 0.05, 0.05


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space = K.separators("spaces")
    line_end = np.zeros(256, bool)
    line_end[10] = True
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    for batch in batches:
        ids, n = batch.column(0), batch.num_rows
        out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")}
        for lo, hi, data, at in K.pieces(batch.column(1)):
            rows, here = hi - lo, slice(lo, hi)
            starts, ends, row = K.spans(data, at, space)
            out["n_words"][here] = np.bincount(row, minlength=rows)
            out["word_chars"][here] = K.sums(~space[data] & ((data & 0xC0) != 0x80), at)
            out["n_symbols"][here] = K.sums(symbol[data], at)
            second = np.zeros(len(data), bool)  # capitals of Latin-1 letters: the byte after C3, but not the times sign
            second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            out["n_capitals"][here] = K.sums(((data >= 65) & (data <= 90)) | second, at)

            a, b, line_row = K.spans(data, at, line_end)
            words_before = np.searchsorted(starts, np.stack([a, b]))
            worded = words_before[1] > words_before[0]
            a, b, line_row = a[worded], b[worded], line_row[worded]
            key = K.mix(K.span_hashes(data, a, b) + line_row.astype(K.U) * K.U(0xA0761D6478BD642F))
            first = np.unique(key, return_index=True)[1]
            lines = np.bincount(line_row, minlength=rows)
            out["n_lines"][here] = lines
            out["n_dup_lines"][here] = lines - np.bincount(line_row[first], minlength=rows)

            three, begin = K.runs(K.span_hashes(data, starts, ends), row, 3)
            key = K.mix(three + row[begin].astype(K.U) * K.U(0xA0761D6478BD642F))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(len(starts), bool)
            for j in range(3):
                covered[begin[twice] + j] = True
            out["n_repeat_words"][here] = np.bincount(row[covered], minlength=rows)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(v) for v in out.values())], names=["doc_id", *out])


def text_stats(docs: DataFrame) -> DataFrame:
    """The counts behind the rules, for every row of ``docs`` (doc_id, text); a null or empty text has zeros.

    Lines and three-word windows are compared by 64-bit hashes together with their document.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_stats, STATS)


def _steps(ratio: str) -> str:
    over, under = ratio.split(" / ")
    return f"CASE WHEN {under} > 0 THEN CAST(LEAST({STEPS}, {over} * {STEPS} DIV {under}) AS INT) ELSE 0 END"


def at_most(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly in log space."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoffs(counts: dict[tuple[str, str], list[int]], risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """For each (stratum, rule): the boldest admitted cut-off. ``counts``: good documents by step, 0 to STEPS."""
    chosen: dict[tuple[str, str], int] = {}
    rules = len({rule for _, rule in counts}) or 1
    level = delta / (len(counts) or 1)
    for key, by_step in sorted(counts.items()):
        total, rejected = sum(by_step), 0
        for cutoff in range(STEPS - 1, -1, -1):  # STEPS itself rejects nothing
            rejected += by_step[cutoff + 1]
            if at_most(rejected, total, risk / rules) > level:
                break
            chosen[key] = cutoff
    return chosen


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``failed_rules`` and ``kept``.

    Null strata form a stratum of their own, "" (as does an empty name). Documents labelled both good and bad, and null
    labels, teach nothing. Without labels there are no cut-offs, and only the base rule rejects. Rows that repeat count
    and are judged like any other. Other columns of ``docs`` are not returned.
    """
    spark = docs.sparkSession
    strata = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    # The stratum rides along the id through the statistics, so no join is needed to bring it back.
    stats = written(_stats_with(docs.select("doc_id", "text", strata.alias("stratum"))), "quality-stats")
    for rule, ratio in RULES.items():
        stats = stats.withColumn(f"step_{rule}", F.expr(_steps(ratio)))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low")).where("low = 1").select("doc_id")
    long = stats.join(good, "doc_id", "left_semi").selectExpr(
        "stratum", f"stack({len(RULES)}, {', '.join(f'{r!r}, step_{r}' for r in RULES)}) as (rule, step)"
    )
    counts: dict[tuple[str, str], list[int]] = {}
    for s, rule, step, n in long.groupBy("stratum", "rule", "step").count().collect():  # strata x rules x steps
        counts.setdefault((s, rule), [0] * (STEPS + 1))[step] = n
    cutoffs = spark.createDataFrame(
        [(s, rule, c) for (s, rule), c in choose_cutoffs(counts, risk, delta).items()], "stratum string, rule string, cutoff int"
    )
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    failed = F.array_compact(F.array(*(F.when(F.col(f"step_{r}") > F.coalesce(F.col(f"cut_{r}"), F.lit(STEPS)), F.lit(r)) for r in RULES)))
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return (
        stats.join(wide, "stratum", "left")
        .withColumn("base_failed", base)
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
    )


def _stats_with(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in _stats(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], names=[*out.schema.names, "stratum"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", "stratum").mapInArrow(run, f"{STATS}, stratum string")
