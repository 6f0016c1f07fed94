"""Mappings: the long table, the packed form (one row per script), and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmask.functions.redact import ENTRIES_TYPE
from refmask.functions.restore import mapping_summary
from refmask.operators.rows import explode_rows
from refmask.schema import KEYS


def mapping_table(annotated: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, placeholder, kind, n, original, canon``: one row per placeholder."""
    return explode_rows(annotated, keys, "entries").select(
        *keys, "row.placeholder", "row.kind", "row.n", "row.original", "row.canon"
    )


def pack_mapping(mapping: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, entries``: one row per script, tables before columns, each in order of number.

    A placeholder that occurs twice in a script's rows (say, of two runs) counts once, with its least
    original; ``merge_mappings`` says which run wins. A group is what one script's dictionary holds, so it is bounded by the size of a script.
    """
    order = (F.col("kind") == "column").cast("int")
    entry = F.struct("n", "placeholder", "kind", "original", "canon")
    ranked = F.struct(order.alias("rank"), entry.alias("entry"))
    sorted_entries = F.sort_array(F.collect_set(ranked))
    once = F.filter(
        "ranked", lambda r, i: (i == 0) | (r.entry.placeholder != F.get("ranked", i - 1).entry.placeholder)
    )
    return (
        mapping.groupBy(*keys)
        .agg(sorted_entries.alias("ranked"))
        .select(*keys, once.alias("ranked"))
        .select(*keys, F.col("ranked.entry").cast(ENTRIES_TYPE).alias("entries"))
    )


def merge_mappings(newest: DataFrame, *older: DataFrame, keys=KEYS) -> DataFrame:
    """Long mappings as one; where several have a placeholder of a script, the newest one's row stays."""
    names = (*keys, "placeholder", "kind", "n", "original", "canon")
    ranked = [m.select(*names, F.lit(age).alias("age")) for age, m in enumerate((newest, *older))]
    together = reduce(DataFrame.unionByName, ranked)
    entry = F.struct("kind", "n", "original", "canon")
    best = together.groupBy(*keys, "placeholder").agg(F.min_by(entry, F.struct("age", entry)).alias("e"))
    return best.select(*keys, "placeholder", "e.kind", "e.n", "e.original", "e.canon")


def mapping_union(tables: DataFrame, columns: DataFrame, keys=KEYS) -> DataFrame:
    """Table and column mappings as one table; ``pack_mapping`` puts tables first."""
    names = (*keys, "placeholder", "kind", "n", "original", "canon")
    return tables.select(*names).unionByName(columns.select(*names))


def mapping_summaries(packed: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, summary``: the mapping of each script as readable lines."""
    return packed.select(*keys, F.expr(mapping_summary("entries")).alias("summary"))
