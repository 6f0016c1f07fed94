"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(table: DataFrame, keys, array: str | Column) -> DataFrame:
    """``keys…, row``: one row per element of ``array``, an expression or a column.

    A plain ``explode`` makes the optimiser filter on the array's size first. That filter computes
    the whole array a second time, and below a preceding repartition, where it may run in one task.
    """
    elements = F.expr(array) if isinstance(array, str) else array
    rows = table.select(*keys, F.explode_outer(elements).alias("row"))
    return rows.filter(F.col("row").isNotNull())
