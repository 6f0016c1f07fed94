"""Scripts as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmask.functions import text as tx
from refmask.functions.arrays import lookup
from refmask.functions.sqltext import let, struct, transform
from refmask.operators.rows import explode_rows
from refmask.schema import KEYS


def line_counts(scripts: DataFrame, keys=KEYS) -> DataFrame:
    return scripts.select(*keys, F.expr(tx.line_count("text")).alias("lines"))


def numbered_lines(annotated: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, line, text, has_typo`` for rows with ``text`` and ``findings``."""
    lines = "split(text, chr(10))"
    typo_lines = "array_distinct(findings.line)"
    flags = lookup(
        transform(lines, lambda _, i: f"{i} + 1"),
        typo_lines,
        transform(typo_lines, lambda _: "true"),
    )
    numbered = let(
        flags,
        lambda flags: transform(
            lines,
            lambda line, i: struct(
                line=f"{i} + 1", text=line, has_typo=f"coalesce(get({flags}, {i}), false)"
            ),
        ),
    )
    return explode_rows(annotated, keys, numbered).select(
        *keys, "row.line", "row.text", "row.has_typo"
    )
