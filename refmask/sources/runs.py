"""Saved runs: Parquet tables partitioned by ``run_id``, whole or absent.

Layout: ``<path>/<table>/run_id=<id>/attempt=<a>/…`` for the tables ``scripts`` (originals), ``annotated``
(redacted text, mapping and findings, one row per script), ``edited``, ``restored`` and ``options``.
The mapping and findings tables are column-pruned explodes of ``annotated``, so they are not stored
twice.

Each save is an attempt with folders of its own. Once all its tables are written, their names and row counts go to
``<path>/manifests/run_id=<id>/attempt=<a>``, in one file. Readers know tables from manifests only. So what a save that stopped
half-way has left is never read, and the save can be tried again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refmask import schema
from refmask.schema import KEYS

TABLES = {
    "scripts": schema.SCRIPTS,
    "annotated": schema.ANNOTATED,
    "edited": schema.TEXTS,
    "restored": schema.RESTORED,
}
DEFAULT_MODE = "sql"


MANIFEST = "table STRING, attempt STRING, rows BIGINT"


def save_run(path: str, run_id: str, options: DataFrame | None = None, **tables: DataFrame) -> None:
    """Write the given tables of a run, all or none. A table that the run has already is an error."""
    if options is not None:
        if options.count() != 1:
            raise ValueError("a run has one row of options")
        tables = {**tables, "options": options.select(F.to_json(F.struct("mode", "redact_columns")).alias("value"))}
    for name in tables:
        if name not in TABLES and name != "options":
            raise ValueError(f"unknown table {name!r}")
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    known = manifest(spark, path, run_id)
    for name in tables:
        if name in known:
            raise ValueError(f"table {name!r} of run {run_id!r} exists")
    # A letter first, so that no attempt looks like a number.
    attempt = f"a{uuid.uuid4().hex}"
    rows = []
    for name, table in tables.items():
        location = _location(path, name, run_id, attempt)
        if name == "options":
            table.write.text(location)
        else:
            table.write.parquet(location)
        rows.append((name, attempt, _count(spark, name, location)))
    entries = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    entries.write.json(_location(path, "manifests", run_id, attempt))


def _count(spark: SparkSession, name: str, location: str) -> int:
    """Rows as they were written: for Parquet the footers tell."""
    if name == "options":
        return spark.read.text(location).count()
    written = _if_exists(spark.read.parquet, location)
    return 0 if written is None else written.count()


def manifest(spark: SparkSession, path: str, run_id: str) -> dict[str, tuple[str, int]]:
    """Attempt and row count of the tables that were saved whole, a few a run."""
    saved = _if_exists(spark.read.schema(MANIFEST).json, f"{path}/manifests/run_id={run_id}/*")
    return {} if saved is None else {r.table: (r.attempt, r.rows) for r in saved.collect()}


def whole_tables(manifests: DataFrame, found: DataFrame) -> DataFrame:
    """``run_id, table, attempt, rows, status`` of manifests and of the row counts ``found``, (run_id, table, attempt, rows).

    ``whole``: as the manifest says; ``damaged``: other rows than it says, or none at all; ``unfinished``: rows of an
    attempt without a manifest, which may be deleted.
    """
    keys = ["run_id", "table", "attempt"]
    said = manifests.select(*keys, F.col("rows").alias("said"))
    both = said.join(found.select(*keys, F.col("rows").alias("there")), keys, "full")
    status = F.when(F.col("said").isNull(), "unfinished").when(F.col("said") == F.coalesce("there", F.lit(0)), "whole").otherwise("damaged")
    return both.select(*keys, F.coalesce("there", F.lit(0).cast("bigint")).alias("rows"), status.alias("status"))


def load_table(
    spark: SparkSession, path: str, run_id: str, name: str, keys: str = "script_id BIGINT"
) -> DataFrame:
    """One table of a run, empty if it was never saved whole; ``keys`` are its key columns with their types."""
    typed = schema.with_keys(TABLES[name], keys)
    attempt, rows = manifest(spark, path, run_id).get(name, (None, 0))
    if attempt is None:
        return spark.createDataFrame([], typed)
    saved = _if_exists(spark.read.schema(typed).parquet, _location(path, name, run_id, attempt))
    if saved is None and rows:
        raise ValueError(f"table {name!r} of run {run_id!r} is missing")
    return spark.createDataFrame([], typed) if saved is None else saved


def has_table(spark: SparkSession, path: str, run_id: str, name: str) -> bool:
    """Whether the table was saved, with or without rows."""
    return name in manifest(spark, path, run_id)


def load_run(
    spark: SparkSession, path: str, run_id: str, keys: str = "script_id BIGINT"
) -> dict[str, DataFrame]:
    """All tables of a run and its ``options``; missing or unusable parts have defaults."""
    tables = {name: load_table(spark, path, run_id, name, keys) for name in TABLES}
    tables["options"] = load_options(spark, path, run_id)
    return tables


def load_options(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    attempt, _ = manifest(spark, path, run_id).get("options", (None, 0))
    saved = None if attempt is None else spark.read.text(_location(path, "options", run_id, attempt))
    if saved is None:
        saved = spark.createDataFrame([], "value STRING")
    # An aggregate without groups gives one row also where nothing was saved.
    return sanitise_options(saved.agg(F.max("value").alias("value")), "value")


def sanitise_options(states: DataFrame, column: str, keys=()) -> DataFrame:
    """``keys…, mode, redact_columns`` from JSON; what cannot be used becomes the default."""
    state = F.from_json(F.col(column), "mode STRING, redact_columns STRING")
    mode = F.when(state["mode"].isin("sql", "pyspark"), state["mode"]).otherwise(DEFAULT_MODE)
    return states.select(
        *keys,
        mode.alias("mode"),
        # Whatever counts as true where it was saved: not false, 0, null or nothing.
        F.coalesce(~state["redact_columns"].isin("false", "0", ""), F.lit(False)).alias("redact_columns"),
    )


def purge(path: str, target: str, spark: SparkSession, ids: DataFrame, keys=KEYS) -> None:
    """Copy the runs that hold any of the scripts in ``ids`` to ``target``, without those scripts.

    Which runs those are is found from the keys alone; other runs are not copied and need no change.
    Data is never changed in place: check the copy, then put its folders in the place of the old ones.
    """
    wanted = ids.select(*keys).distinct()
    manifests = _if_exists(spark.read.schema(f"{MANIFEST}, run_id STRING").json, f"{path}/manifests")
    if manifests is None:
        return
    # One row a saved table.
    listed = F.broadcast(manifests.select("attempt").distinct())
    saved = {name: _if_exists(spark.read.parquet, f"{path}/{name}") for name in TABLES}
    # Attempts without a manifest are left behind.
    tables = {name: table.join(listed, "attempt", "left_semi") for name, table in saved.items() if table is not None}
    touched = {r.attempt for table in tables.values() for r in touched_runs(table, wanted, keys, "attempt").collect()}
    runs = {str(r.run_id) for r in manifests.filter(F.col("attempt").isin(*touched)).select("run_id").distinct().collect()}
    whole = manifests.filter(F.col("run_id").isin(*runs))
    attempts = [r.attempt for r in whole.select("attempt").distinct().collect()]
    counts = []
    for name, table in tables.items():
        kept = table.filter(F.col("attempt").isin(*attempts)).join(wanted, list(keys), "left_anti")
        kept.write.partitionBy("run_id", "attempt").parquet(f"{target}/{name}")
        written = _if_exists(spark.read.parquet, f"{target}/{name}")
        if written is not None:
            counts.append(written.groupBy("attempt").agg(F.count("*").alias("left")).select(F.lit(name).alias("table"), "attempt", "left"))
    options = _if_exists(spark.read.text, f"{path}/options")
    if options is not None:
        options.filter(F.col("attempt").isin(*attempts)).write.partitionBy("run_id", "attempt").text(f"{target}/options")
    # As with a save, manifests come last; they say what is left.
    left = reduce(DataFrame.unionByName, counts, spark.createDataFrame([], "table STRING, attempt STRING, left BIGINT"))
    rows = F.when(F.col("table") == "options", F.col("rows")).otherwise(F.coalesce("left", F.lit(0)))
    named = whole.join(left, ["table", "attempt"], "left").select("table", "attempt", rows.alias("rows"), "run_id", F.col("attempt").alias("folder"))
    named.coalesce(1).write.partitionBy("run_id", "folder").json(f"{target}/manifests")


def touched_runs(table: DataFrame, wanted: DataFrame, keys=KEYS, by: str = "run_id") -> DataFrame:
    """``run_id`` of the runs that hold any of the keys in ``wanted``; reads the keys only."""
    return table.select(by, *keys).join(wanted, list(keys), "left_semi").select(by).distinct()


def _if_exists(read, location: str) -> DataFrame | None:
    try:
        return read(location)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _location(path: str, table: str, run_id: str, attempt: str) -> str:
    return f"{path}/{table}/run_id={run_id}/attempt={attempt}"
