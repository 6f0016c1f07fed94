"""Misspelled keywords across a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmask.functions.sqltext import empty, struct, when
from refmask.functions.typos import FINDINGS_TYPE, find_typos, fix_typos, typo_summary
from refmask.operators.rows import explode_rows
from refmask.schema import KEYS


def with_findings(
    scripts: DataFrame, max_findings: int | None = None
) -> DataFrame:
    """``scripts`` with a ``findings`` array; PySpark scripts are not checked."""
    findings = find_typos("text", max_findings)
    if "mode" in scripts.columns:
        findings = when("mode = 'pyspark'", empty(FINDINGS_TYPE), findings)
    return scripts.withColumn("findings", F.expr(findings))


def findings_table(annotated: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, rule, line, found, fix`` from rows with a ``findings`` array."""
    return explode_rows(annotated, keys, "findings").select(
        *keys, "row.rule", "row.line", "row.found", "row.fix"
    )


def typo_findings(
    scripts: DataFrame, keys=KEYS, max_findings: int | None = None
) -> DataFrame:
    return findings_table(with_findings(scripts, max_findings), keys)


def typo_lines(annotated: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, line``: the distinct lines with findings, without a shuffle."""
    return explode_rows(annotated, keys, "array_distinct(findings.line)").withColumnRenamed(
        "row", "line"
    )


def typo_summaries(annotated: DataFrame, keys=KEYS) -> DataFrame:
    return annotated.select(*keys, F.expr(typo_summary("findings")).alias("summary"))


def fix_scripts(scripts: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, status, text, replacements``: repaired SQL scripts.

    ``status`` is ``fixed``, ``no_typos``, or ``not_sql`` for PySpark scripts, which stay as they are.
    """
    fixed = fix_typos("text")
    status = when("fixed.replacements > 0", "'fixed'", "'no_typos'")
    if "mode" in scripts.columns:
        fixed = when("mode = 'pyspark'", struct(text="text", replacements="0"), fixed)
        status = when("mode = 'pyspark'", "'not_sql'", status)
    return scripts.withColumn("fixed", F.expr(fixed)).select(
        *keys, F.expr(status).alias("status"), "fixed.text", "fixed.replacements"
    )
