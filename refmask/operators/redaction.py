"""Redaction of a corpus: one narrow stage, one row per script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refmask.functions import text as tx
from refmask.functions.redact import BOTH, ENTRIES, ENTRIES_TYPE, TEXT, redact
from refmask.functions.sqltext import empty, when
from refmask.functions.typos import FINDINGS_TYPE, find_typos
from refmask.schema import KEYS


def redact_scripts(
    scripts: DataFrame,
    keys=KEYS,
    redact_columns: bool = False,
    on_typos: str = "continue",
    max_findings: int | None = None,
    want: str = BOTH,
) -> DataFrame:
    """``keys…, mode, status, text, entries, findings`` for ``keys…, text[, mode]``.

    With ``want`` only texts (``TEXT``) or dictionaries (``ENTRIES``) are made; the other column is missing.

    ``mode`` is the effective one. ``status`` is ``blank`` (nothing to do), ``typos`` (findings, and
    ``on_typos='skip'``) or ``ok``; only ``ok`` rows have a redacted text.
    """
    if on_typos not in ("continue", "skip"):
        raise ValueError("on_typos must be 'continue' or 'skip'")
    mode = tx.effective_mode("mode" if "mode" in scripts.columns else "'sql'", "text")
    blank = tx.is_blank("text")
    findings = when(
        f"mode = 'sql' AND NOT {blank}", find_typos("text", max_findings), empty(FINDINGS_TYPE)
    )
    status = "'ok'"
    if on_typos == "skip":
        status = when("size(findings) > 0", "'typos'", status)
    return (
        scripts.select(*keys, "text", F.expr(mode).alias("mode"))
        .withColumn("findings", F.expr(findings))
        .withColumn("status", F.expr(when(blank, "'blank'", status)))
        .withColumn(
            "result", F.expr(when("status = 'ok'", redact("text", "mode", redact_columns, want)))
        )
        .select(*keys, "mode", "status", *_outputs(want), "findings")
    )


def _outputs(want: str) -> list[Column]:
    text, entries = ("result.text", "result.entries") if want == BOTH else ("result", "result")
    return [
        *([F.col(text).alias("text")] if want != ENTRIES else []),
        *([F.expr(f"coalesce({entries}, {empty(ENTRIES_TYPE)})").alias("entries")] if want != TEXT else []),
    ]


def redacted_texts(annotated: DataFrame, keys=KEYS) -> DataFrame:
    return annotated.select(*keys, "mode", "text", "status")
