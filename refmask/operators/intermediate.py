"""Results that a job uses more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def computed_once(table: DataFrame, name: str) -> DataFrame:
    """``table``, computed now or once: written to the folder in ``spark.checkpoint.dir``, or persisted where none is set.

    Without it each use computes the table anew, and uses of uses multiply. What is written outlives lost executors, what
    is persisted is computed again in part. Nothing removes the written folder.
    """
    spark = table.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return table.persist()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
