"""The same jobs on streams.

Redaction looks at one row at a time, so it is stateless and appends. Restoring joins the stream with
a saved mapping, which is read anew for every batch and keeps no state, or with a stream of mappings,
where watermarks bound the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refmask.operators.restoration import restore_scripts, restore_with_entries
from refmask.plans.jobs import Options, Redaction, redact_corpus
from refmask.schema import KEYS


def redact_stream(scripts: DataFrame, options: Options = Options(), keys=KEYS) -> Redaction:
    return redact_corpus(scripts, options, keys)


def restore_stream(edited: DataFrame, packed: DataFrame, keys=KEYS) -> DataFrame:
    """Edits as a stream, the packed mapping as a static table."""
    if packed.isStreaming:
        raise ValueError("the mapping must be a static table")
    return restore_scripts(edited, packed, keys)


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a Parquet table; ``availableNow=True`` ends when the input is used up."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("checkpointLocation", checkpoint).start(path)


# Copies of each mapping, over which the edits of its script are dealt out.
SALTS = 8


def restore_streams(edited: DataFrame, packed: DataFrame, within: str = "1 hour", keys=KEYS, salts: int = SALTS) -> DataFrame:
    """Edits and packed mappings both as streams: ``keys…, at, status, text``.

    Both carry an event time ``at``. An edit may come up to ``within`` (an interval) before or after the
    mapping of its script. Watermarks of that length bound the state: rows later than that are dropped,
    and an edit whose mapping has not come by then is given out as ``no_mapping``. A mapping is one row a
    script, so the join needs no aggregate before it.

    A script with very many edits would have all of them in the state of one task. So an edit goes to one of ``salts`` parts
    of its script, by a hash of its own text and time, and each mapping is copied to all parts: state of
    edits is spread, that of mappings grows by the factor.
    """
    if salts < 1:
        raise ValueError("salts must be at least 1")
    # Watermarks before the salt: they belong to the columns that it leaves alone.
    left = edited.select(*keys, "at", "text").withWatermark("at", within)
    left = left.withColumn("_part", F.pmod(F.xxhash64("text", "at"), F.lit(salts)).cast("int"))
    right = packed.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("at").alias("_at"), "entries")
    right = right.withWatermark("_at", within)
    right = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = F.expr(f"_at BETWEEN at - INTERVAL {within} AND at + INTERVAL {within}") & (F.col("_part") == F.col("_copy"))
    for key in keys:
        same = same & (F.col(key) == F.col(f"_{key}"))
    return restore_with_entries(left.join(right, same, "left"), (*keys, "at"))
