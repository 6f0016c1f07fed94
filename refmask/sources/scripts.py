"""Reading original and edited scripts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refmask.functions.text import normalise_newlines
from refmask.schema import KEYS


def scripts_from(table: DataFrame, text="text", keys=KEYS) -> DataFrame:
    """``keys…, text[, mode]`` of any table, with newlines as every operator expects them.

    ``keys`` may map new names to columns: ``{"script_id": "doc_id"}``.
    """
    named = keys if isinstance(keys, dict) else {k: k for k in keys}
    mode = [F.col("mode")] if "mode" in table.columns else []
    return table.select(
        *(F.col(source).alias(name) for name, source in named.items()),
        F.expr(normalise_newlines(text)).alias("text"),
        *mode,
    )


def path_below(root: str, location: Column) -> Column:
    """The part of a file's location below ``root``, an absolute path or URI; it names a file in any root.

    Locations are URIs: scheme, host and ``root`` are cut off, escapes are undone.
    """
    folder = re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    if not folder.startswith("/") and root.rstrip("/"):
        raise ValueError(f"not an absolute path or URI: {root!r}")
    path = F.regexp_replace(location, r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring(plain, len(folder) + 2, 1 << 30)


def read_scripts(spark: SparkSession, root: str) -> DataFrame:
    """One script per file below the folder ``root``; the file's path below it is the key.

    So an edited copy of a folder has the keys of the original one.
    """
    key = path_below(root, F.col("_metadata.file_path"))
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return scripts_from(files.select(key.alias("script_id"), F.col("value").alias("text")))


def spread(scripts: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt out to so many partitions.

    Redaction is bound by CPU, and a single Parquet row group is read by a single task. Whoever knows
    that an input is stored in fewer row groups than there are cores asks for this; it shuffles.
    """
    return scripts.repartition(partitions)
