"""Running totals over ordered numbers without bringing them all into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Numbers are dealt out by ranges of so many. A range is ordered in one task; of all others only its sum counts.
RANGE = 1 << 16


def running_total(table: DataFrame, by: str, position: str, weight: str, name: str) -> DataFrame:
    """``table`` with ``name``: the sum of ``weight`` over the rows of the same ``by`` up to and with its ``position``.

    ``position`` is a number from 0 on, ``weight`` a BIGINT. The numbers of a range are added up where they meet,
    those of the ranges before it come as one sum a range. Rows of one position count together, so a
    position that repeats without bound should be grouped first.
    """
    ranged = table.withColumn("_range", F.expr(f"{position} DIV {RANGE}"))
    sums = ranged.groupBy(by, "_range").agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    upto = Window.partitionBy(by, "_range").orderBy(position)  # with the row's peers
    within = ranged.withColumn("_within", F.sum(weight).over(upto))
    total = (F.col("_before") + F.col("_within")).alias(name)
    return within.join(starts, [by, "_range"]).select(*table.columns, total)
