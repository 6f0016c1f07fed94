import time

import pytest

from pyspark.sql import functions as F

from refmask import Options, redact_corpus, restore_corpus
from refmask.functions.redact import ENTRIES_TYPE
from refmask.streaming.jobs import append_to, redact_stream, restore_stream, restore_streams


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "scripts")
    rows = spark.range(0, 60, 1, 3).selectExpr(
        "id AS script_id",
        "concat('select a.x from s', id % 4, '.t join u', id % 3, '.v FROMM') AS text",
    )
    rows.write.parquet(path)
    return path


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(stream, path):
    query = append_to(stream, f"{path}/out", f"{path}/checkpoint", availableNow=True)
    assert query.awaitTermination(120)
    return stream.sparkSession.read.parquet(f"{path}/out")


def test_stream_equals_batch(spark, source, tmp_path):
    batch = redact_corpus(spark.read.parquet(source), Options(redact_columns=True))
    stream = redact_stream(
        stream_of(spark, source, "script_id BIGINT, text STRING"), Options(redact_columns=True)
    )
    for name in ("annotated", "mapping", "findings"):
        got = finish(getattr(stream, name), str(tmp_path / name))
        expected = getattr(batch, name)
        assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty(), name
        assert got.count() >= 60


def test_restoring_a_stream_equals_batch(spark, source, tmp_path):
    job = redact_corpus(spark.read.parquet(source))
    job.annotated.write.parquet(str(tmp_path / "mapping"))
    packed = spark.read.parquet(str(tmp_path / "mapping"))
    edits = packed.select("script_id", "text").union(packed.select("script_id", "text"))
    edits.repartition(3).write.parquet(str(tmp_path / "edits"))
    stream = restore_stream(
        stream_of(spark, str(tmp_path / "edits"), "script_id BIGINT, text STRING"), packed
    )
    got = finish(stream, str(tmp_path / "restored"))
    expected = restore_corpus(edits, packed)
    assert got.count() == 120
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_the_mapping_must_be_static(spark, source):
    stream = stream_of(spark, source, "script_id BIGINT, text STRING")
    with pytest.raises(ValueError):
        restore_stream(stream, redact_stream(stream).annotated)


def test_two_streams_equal_batch(spark, source, tmp_path):
    """Edits meet their mapping before or after it; those without one come out once the watermark has passed."""
    packed = redact_corpus(spark.read.parquet(source)).annotated.withColumn("at", F.expr("timestamp_seconds(86400 + script_id * 60)"))
    packed.repartition(3).write.parquet(str(tmp_path / "mapping"))
    edits = packed.selectExpr("script_id", "text", "at + make_interval(0, 0, 0, 0, 0, script_id % 40 - 20) AS at")
    edits = edits.unionByName(edits.filter("script_id < 5").withColumn("script_id", F.expr("script_id + 1000")))
    late = spark.sql("SELECT 5000L AS script_id, 'end' AS text, TIMESTAMP '1970-01-05' AS at")
    edits.coalesce(1).write.parquet(str(tmp_path / "edits"))
    time.sleep(1.1)  # files are taken in the order of their times
    late.write.mode("append").parquet(str(tmp_path / "edits"))
    last = late.selectExpr("script_id", "at", "CAST(array() AS %s) AS entries" % ENTRIES_TYPE)
    packed.select("script_id", "at", "entries").unionByName(last).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "mapping"))
    stream = restore_streams(
        stream_of(spark, str(tmp_path / "edits"), "script_id BIGINT, text STRING, at TIMESTAMP"),
        stream_of(spark, str(tmp_path / "mapping"), f"script_id BIGINT, at TIMESTAMP, entries {ENTRIES_TYPE}"),
        "2 hours",
    )
    got = finish(stream, str(tmp_path / "restored")).drop("at").filter("script_id < 5000")
    expected = restore_corpus(edits, packed)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
    assert got.filter("status = 'no_mapping'").count() == 5


def test_edits_of_a_hot_script_are_spread(spark, tmp_path):
    """100,000 edits of one script reach all state partitions, and come out as in a batch."""
    packed = redact_corpus(spark.createDataFrame([(7, "select 1 from a.b")], "script_id BIGINT, text STRING")).annotated
    edits = spark.range(0, 100_000, 1, 4).selectExpr("7L AS script_id", "concat('drop redacted.Table_1 -- ', id) AS text", "timestamp_seconds(86400 + id % 600) AS at")
    edits.write.parquet(str(tmp_path / "edits"))
    packed.selectExpr("script_id", "timestamp_seconds(86400) AS at", "entries").write.parquet(str(tmp_path / "mapping"))
    stream = restore_streams(
        stream_of(spark, str(tmp_path / "edits"), "script_id BIGINT, text STRING, at TIMESTAMP"),
        stream_of(spark, str(tmp_path / "mapping"), f"script_id BIGINT, at TIMESTAMP, entries {ENTRIES_TYPE}"),
        "2 hours",
        salts=16,
    )
    # The join's tasks are the partitions of the state.
    out = finish(stream.withColumn("task", F.spark_partition_id()), str(tmp_path / "restored"))
    tasks = {r.task: r["count"] for r in out.groupBy("task").count().collect()}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(tasks.values()) < 60_000
    got, expected = out.drop("task", "at"), restore_corpus(edits, packed)
    assert got.count() == 100_000
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
