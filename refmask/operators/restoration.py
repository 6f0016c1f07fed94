"""Restoring edited scripts and annotating placeholders: one equi-join on the script key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmask.functions import text as tx
from refmask.functions.redact import ENTRIES_TYPE
from refmask.functions.restore import placeholder_tokens, restore
from refmask.functions.sqltext import empty, when
from refmask.operators.rows import explode_rows
from refmask.schema import KEYS


def with_entries(texts: DataFrame, packed: DataFrame, keys=KEYS) -> DataFrame:
    """``texts`` with the ``entries`` of their script, empty where there is no mapping.

    ``packed`` has one row per key, so the join never multiplies rows, and both of its sides are
    plain shuffles that adaptive execution may split where one script has very many edits. The
    extra key keeps it so when ``packed`` comes out of an aggregation on the same keys, whose
    partitioning the join would otherwise take over and could no longer split.
    """
    # Hashes of different types differ: hash both sides in the type the mapping has.
    types = [packed.schema[key].dataType for key in keys]
    typed = (F.col(key).try_cast(type_) for key, type_ in zip(keys, types))
    left = texts.withColumn("_spread", F.xxhash64(*typed))
    right = packed.select(*keys, "entries", F.xxhash64(*keys).alias("_spread"))
    joined = left.join(right, [*keys, "_spread"], "left").drop("_spread")
    return joined.withColumn("entries", F.expr(f"coalesce(entries, {empty(ENTRIES_TYPE)})"))


def restore_scripts(edited: DataFrame, packed: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, status, text``; ``status`` is ``blank``, ``no_mapping`` or ``ok``.

    There may be any number of edits per script; only ``ok`` rows have a restored text.
    """
    return restore_with_entries(
        with_entries(edited.select(*keys, "text"), packed, keys), keys
    )


def restore_with_entries(edited: DataFrame, keys=KEYS) -> DataFrame:
    """The same for edits that carry the ``entries`` of their script: no join."""
    mapped = when("coalesce(size(entries), 0) > 0", "'ok'", "'no_mapping'")
    status = when(tx.is_blank("text"), "'blank'", mapped)
    restored = when("status = 'ok'", restore("text", "entries"))
    return edited.withColumn("status", F.expr(status)).select(
        *keys, "status", F.expr(restored).alias("text")
    )


def restore_all_with(edited: DataFrame, mapping: DataFrame, keys=KEYS) -> DataFrame:
    """One mapping, say an imported file, for all edits: ``keys…, status, text``.

    ``mapping`` has one row with ``entries``; more are an error, none means no mapping.
    """
    entries = mapping.select("entries").scalar()
    return restore_with_entries(edited.select(*keys, "text").withColumn("entries", entries), keys)


def token_table(texts: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, pos, token, original`` for every placeholder in texts that carry ``entries``."""
    return explode_rows(texts, keys, placeholder_tokens("text", "entries")).select(
        *keys, "row.pos", "row.token", "row.original"
    )


def annotate_tokens(texts: DataFrame, packed: DataFrame, keys=KEYS) -> DataFrame:
    """``token_table`` for texts whose mapping is kept elsewhere."""
    return token_table(with_entries(texts.select(*keys, "text"), packed, keys), keys)
