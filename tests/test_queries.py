"""Every registered query against its DuckDB text at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.queries import ORACLES, QUERIES

SF_DIR = entry.SMOKE_DIR


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in "orders lineitem customer supplier documents pages conversations benchmark".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(rows, columns, names):
    order = [columns.index(name) for name in names]
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    got = result.collect()
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == sorted(result.columns)
    names = sorted(result.columns)
    expected = comparable(relation.fetchall(), relation.columns, names)
    assert comparable(got, result.columns, names) == expected
    assert expected


def test_entry(spark):
    assert entry.entry(spark).columns == ["script_id", "text"]


def test_redaction_is_one_narrow_stage(spark):
    """Nothing but the dealing out of the single input file moves rows."""
    for name in ("f2_redact_columns", "e3_mapping_of_prose", "d4_findings_in_prose", "f6_restore_prose"):
        result = entry.queries()[name](spark, SF_DIR)
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "RoundRobinPartitioning" in plan
        assert "Python" not in plan
        # An array is not computed a second time to filter on its size.
        assert "Filter" not in plan or "size(" not in plan.split("Filter", 1)[1].split("\n", 1)[0]
