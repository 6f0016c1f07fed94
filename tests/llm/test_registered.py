"""The registered queries: against their DuckDB texts where there are some, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from refmask.llm.queries import ORACLES, QUERIES
from tests.llm.test_near_copies import brute as brute_copies
from tests.llm.test_passages import brute as brute_passages
from tests.llm.test_passages import brute_spans, without

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(ORACLES[name])
    result = QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(result.columns)
    assert plain(result.collect(), result.columns) == plain(want.fetchall(), want.columns)


def test_all_are_registered():
    for n in range(1, 14):
        assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1
    assert entry.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLES])
def test_query_covers_its_table(spark, name):
    rows = spark.read.parquet(f"{SF}/{'pages' if 'url' in name else 'documents'}.parquet").count()
    result = QUERIES[name](spark, SF)
    assert result.count() == rows or name.startswith("op8")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    texts = lambda df: [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]

    one = stages[0](spark, docs, SF).cache()
    assert one.columns == docs.columns and set(texts(one)) <= set(texts(docs))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert one.join(labels, "doc_id").where("quality = 1").count() >= 0.97 * docs.join(labels, "doc_id").where("quality = 1").count()

    two = stages[1](spark, one, SF).cache()
    groups = {int(d): int(c) for d, _, c in brute_copies(texts(one))}
    assert [d for d, _ in texts(two)] == sorted(d for d in groups if groups[d] == d) and two.columns == docs.columns

    three = stages[2](spark, two, SF).cache()
    want = brute_spans(texts(two), 30)
    assert texts(three) == [(d, without(t, want[i])) for i, (d, t) in enumerate(texts(two))] and any(want.values())
    assert three.where("n_chars <> length(text)").count() == two.where("n_chars <> length(text)").count() and three.columns == docs.columns

    four = stages[3](spark, three, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute_passages(texts(three), items)
    gone = {d for d, _ in texts(three)} - {d for d, _ in texts(four)}
    assert {d for (d, _), s in found.items() if s >= 0.95} <= gone <= {d for d, _ in found}

    mix = stages[4](spark, four, SF)
    assert mix.count() == four.count()
    assert sum(r.taken for r in mix.collect()) == pytest.approx(sum(len(t.encode().split()) for _, t in texts(four)), rel=0.05)


def test_pipeline_on_odd_rows(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "a b", "en", "s", 3), (4, "word " * 40_000, "en", "s", 9), (4, "word " * 40_000, "en", "s", 9)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns or k == 4
            docs = out if k else docs  # the classifier may reject odd texts; the others are to see them
        assert docs.count() <= len(rows)
