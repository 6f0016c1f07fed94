"""Runs over what has changed only: which scripts are new or changed, which are gone, and the newest view across runs.

Only keys and hashes are compared. The texts of what was found stay where they are read: the keys found go to the scan
as a broadcast if there are few of them, which is counted, and only otherwise is the scan shuffled to meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refmask.operators.intermediate import computed_once
from refmask.schema import KEYS

# Keys are broadcast to a scan up to this many.
BROADCAST_KEYS = 1_000_000


def text_hash(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def script_hashes(scripts: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, text_hash``: what to keep of a run for the next one."""
    return scripts.select(*keys, text_hash().alias("text_hash"))


def changed_scripts(scripts: DataFrame, previous: DataFrame, keys=KEYS) -> DataFrame:
    """The rows of ``scripts`` that are new or whose text differs from that of the ``previous`` run.

    ``previous`` is a table of ``script_hashes``; no old text is read, and no text moves to be compared. A key that is
    there several times, with different texts, is changed for those rows whose text is not among the old ones. Null keys
    are never known, so their rows are always new.
    """
    # Hashes move as 32 bytes instead of 64 digits.
    digest = F.unhex("text_hash").alias("text_hash")
    known = previous.select(*keys, digest)
    current = script_hashes(scripts, keys).select(*keys, digest)
    changed = computed_once(current.join(known, [*keys, "text_hash"], "left_anti").distinct(), "changed-keys")
    marked = scripts.withColumn("_hash", F.unhex(text_hash()))
    same = F.col("_hash") == F.col("_changed_hash")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_changed_{key}"))
    wanted = changed.select(*(F.col(k).alias(f"_changed_{k}") for k in keys), F.col("text_hash").alias("_changed_hash"))
    return marked.join(few(wanted), same, "left_semi").drop("_hash")


def removed_scripts(scripts: DataFrame, previous: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…`` of the scripts that the ``previous`` run had and that are gone; keys only."""
    return previous.select(*keys).distinct().join(scripts.select(*keys).distinct(), list(keys), "left_anti")


def current_view(versions: DataFrame, order: str, keys=KEYS, removed: DataFrame | None = None) -> DataFrame:
    """The newest row of each script among those of several runs, as they come from ``runs``: greatest ``order``.

    ``removed`` has ``keys…`` and ``order``: scripts that a run found gone, unless a later one has them again. A
    script that only one run has is told by a count of its key; the keys of the others, which are few if runs hold what
    has changed, and their newest order go to the scan. Rows of one script and one order all stay.
    """
    rows = versions.select(*keys, F.col(order).alias("_order"), F.lit(True).alias("_there"))
    if removed is not None:
        rows = rows.unionByName(removed.select(*keys, F.col(order).alias("_order"), F.lit(False).alias("_there")))
    by_key = rows.groupBy(*keys).agg(F.min("_order").alias("_first"), F.max("_order").alias("_newest"), F.max_by("_there", F.struct("_order", "_there")).alias("_there"))
    several = computed_once(by_key.filter("_first < _newest OR NOT _there"), "superseded-keys")
    newest = several.select(*(F.col(k).alias(f"_s_{k}") for k in keys), "_newest", "_there")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_s_{key}"))
    joined = versions.join(few(newest), same, "left")
    return joined.filter(F.col("_newest").isNull() | (F.col("_there") & (F.col(order) == F.col("_newest")))).select(*versions.columns)


def few(keys: DataFrame, most: int | None = None) -> DataFrame:
    """``keys`` marked for broadcast if there are at most ``most`` of them."""
    return F.broadcast(keys) if keys.count() <= (BROADCAST_KEYS if most is None else most) else keys


def usage_delta(previous: DataFrame, old: DataFrame, new: DataFrame, by: tuple[str, ...], counts: tuple[str, ...]) -> DataFrame:
    """``by…, counts…``: a roll-up brought up to date from its ``previous`` state and the scripts that changed.

    ``old`` and ``new`` are the same roll-up (say ``table_usage``) of those scripts alone, as they were and as they are: what
    they had is subtracted and what they have is added. Rows whose counts all come to nothing go.
    """
    signed = previous.select(*by, *counts)
    signed = signed.unionByName(old.select(*by, *((-F.col(c)).alias(c) for c in counts))).unionByName(new.select(*by, *counts))
    total = signed.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counts))
    some = F.lit(False)
    for c in counts:
        some = some | (F.col(c) != 0)
    return total.filter(some)
