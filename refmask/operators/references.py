"""References found in scripts, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmask.functions import redact as rd
from refmask.operators.rows import explode_rows
from refmask.schema import KEYS


def table_references(scripts: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, pos, kind, ref, canon, accepted`` for the table names of SQL and PySpark scripts.

    Scripts without a ``mode`` column are taken as SQL.
    """
    mode = "mode" if "mode" in scripts.columns else "'sql'"
    # Only the cutting is done in the row; what concerns one name is cheaper as columns than within an array.
    parts = scripts.select(*keys, F.expr(mode).alias("_mode"), F.posexplode_outer(F.expr(rd.table_parts("text", mode))).alias("_at", "ref"))
    hits = parts.filter("_at % 3 > 0 AND ref <> ''")
    return hits.select(
        *keys,
        F.expr("int(_at DIV 3) + 1").alias("pos"),
        F.lit("table").alias("kind"),
        "ref",
        F.expr(rd.table_canon("ref", "_mode")).alias("canon"),
        F.expr(f"_at % 3 = 1 AND {rd.is_table('ref', '_mode')}").alias("accepted"),
    )


def column_references(redacted: DataFrame, keys=KEYS) -> DataFrame:
    """The same for qualified columns; expects texts whose tables are already redacted."""
    return _exploded(redacted, keys, "column", rd.column_refs("text"))


def _exploded(scripts: DataFrame, keys, kind: str, refs: str) -> DataFrame:
    return explode_rows(scripts, keys, refs).select(
        *keys, "row.pos", F.lit(kind).alias("kind"), "row.ref", "row.canon", "row.accepted"
    )
