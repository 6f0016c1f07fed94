"""Whole jobs: redact a corpus, restore edited scripts, repair typos, reload a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refmask.functions.redact import BOTH, ENTRIES, TEXT
from refmask.functions.sqltext import empty, when
from refmask.functions.typos import FINDINGS_TYPE
from refmask.operators import mapping as mp
from refmask.operators import typos as ty
from refmask.operators.redaction import redact_scripts, redacted_texts
from refmask.operators.restoration import restore_scripts
from refmask.schema import KEYS
from refmask.sources import runs


@dataclass(frozen=True)
class Options:
    """Settings of a job. ``mode`` is used for scripts that bring none of their own."""

    mode: str = "sql"
    redact_columns: bool = False
    on_typos: str = "continue"
    max_findings: int | None = None


@dataclass(frozen=True)
class Redaction:
    """Result of a redaction job: one annotated row per script, and tables derived from it.

    The derived tables redact anew if ``annotated`` is not read from a saved run, but only as far as they need: texts
    without dictionaries, and dictionaries without texts.
    """

    annotated: DataFrame
    keys: tuple[str, ...] = KEYS
    # Texts or dictionaries alone, where they are not read from a saved run.
    derive: Callable[[str], DataFrame] | None = None

    @property
    def redacted(self) -> DataFrame:
        return redacted_texts(self.derive(TEXT) if self.derive else self.annotated, self.keys)

    @property
    def mapping(self) -> DataFrame:
        return mp.mapping_table(self.derive(ENTRIES) if self.derive else self.annotated, self.keys)

    @property
    def findings(self) -> DataFrame:
        return ty.findings_table(self.annotated, self.keys)

    def save(
        self, path: str, run_id: str, scripts: DataFrame, options: Options = Options()
    ) -> Redaction:
        """Write originals, options and the annotated rows, and go on from the written table."""
        spark = self.annotated.sparkSession
        originals = with_mode(scripts, options.mode).select(*self.keys, "text", "mode")
        settings = spark.createDataFrame([(options.mode, options.redact_columns)], "mode STRING, redact_columns BOOLEAN")
        runs.save_run(path, run_id, settings, scripts=originals, annotated=self.annotated)
        return Redaction(runs.load_table(spark, path, run_id, "annotated", key_types(scripts, self.keys)), self.keys)


def key_types(table: DataFrame, keys=KEYS) -> str:
    """The key columns of a table with their types, as DDL."""
    return ", ".join(f"{key} {table.schema[key].dataType.simpleString()}" for key in keys)


def with_mode(scripts: DataFrame, mode: str) -> DataFrame:
    if "mode" in scripts.columns:
        return scripts
    return scripts.withColumn("mode", F.lit(mode))


def redact_corpus(scripts: DataFrame, options: Options = Options(), keys=KEYS) -> Redaction:
    """Gate, detect the mode, look for typos, redact; no shuffle."""

    def derive(want: str) -> DataFrame:
        table = with_mode(scripts, options.mode)
        return redact_scripts(table, keys, options.redact_columns, options.on_typos, options.max_findings, want)

    return Redaction(derive(BOTH), tuple(keys), derive)


def restore_corpus(edited: DataFrame, mapping: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, status, text`` for edited scripts and a mapping in long or packed form.

    A packed mapping has one row a script; several long ones are joined by ``merge_mappings`` first.
    """
    packed = mapping if "entries" in mapping.columns else mp.pack_mapping(mapping, keys)
    return restore_scripts(edited, packed, keys)


def fix_corpus(scripts: DataFrame, options: Options = Options(), keys=KEYS) -> DataFrame:
    """``keys…, status, text, replacements, findings``: repaired SQL scripts, checked again."""
    fixed = ty.fix_scripts(with_mode(scripts, options.mode), keys)
    rechecked = ty.with_findings(fixed, options.max_findings)
    return rechecked.withColumn(
        "findings", F.expr(when("status = 'not_sql'", empty(FINDINGS_TYPE), "findings"))
    )


def reload_run(
    spark: SparkSession, path: str, run_id: str, keys: str = "script_id BIGINT"
) -> dict[str, DataFrame]:
    """A saved run with the findings of its original scripts derived anew as ``findings``.

    A run without its originals is an error rather than one without findings.
    """
    if not runs.has_table(spark, path, run_id, "scripts"):
        raise ValueError(f"run {run_id!r} was saved without its scripts")
    tables = runs.load_run(spark, path, run_id, keys)
    names = tuple(part.split()[0] for part in keys.split(","))
    mode = F.coalesce("mode", tables["options"].select("mode").scalar())
    scripts = tables["scripts"].withColumn("mode", mode)
    return {**tables, "findings": ty.typo_findings(scripts, names)}
