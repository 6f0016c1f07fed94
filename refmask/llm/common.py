"""What several operators share: reading tables, written intermediate results, held-out folds, label samples."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: Bound of the texts of a labelled sample that come to the driver.
SAMPLE_BYTES = 64 << 20
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only in local mode, as in tests, a folder of this machine where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="refmask-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result that later steps use more than once to the shared folder, and go on from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now rather than when the driver next collects its garbage.

    Spark deletes them once nothing on the driver refers to the job any more; a driver that does little else may not
    notice for long, while executors' disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def row_key() -> Column:
    """16 bytes that stand for a row's doc_id and text; null and empty differ."""
    text = F.when(F.col("text").isNotNull(), F.concat(F.lit("="), F.col("text"))).otherwise("")
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)))


def held_out(doc_id: Column | str, folds: int, remainder: int) -> Column:
    """Whether a row is in the held-out fold; a row without an id is not, and is never learned from either."""
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most ``limit`` (text, label) rows, and ``most_bytes`` of text, to fit a model on, the same ones on every run.

    The ids with the smallest hashes are chosen from the label table alone, so what is broadcast to the scan of the
    texts is bounded by ``limit``, and what comes back by ``most_bytes`` too: rows count in that order, and those that do not
    fit in any more are left out. Ids with two different labels are left out. ``usable`` is a
    condition on doc_id that keeps the held-out fold out.
    """
    ids = (
        labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
        .select("doc_id", "label", F.xxhash64("doc_id").alias("rank"))
        .orderBy("rank", "doc_id")
        .limit(limit)
    )
    sizes = F.sum(F.octet_length("text")).over(Window.orderBy("rank", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(F.broadcast(ids), "doc_id")
        .orderBy("rank", "doc_id", "text")
        .limit(limit)
        .withColumn("upto", sizes)
        .where(F.col("upto") <= most_bytes)
        .select("text", F.col("label").cast("int"))
    )
    return [(r[0], r[1]) for r in rows.collect()]
