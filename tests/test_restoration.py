import pytest

from refmask import Options, redact_corpus, restore_corpus
from refmask.operators.mapping import mapping_summaries, mapping_union, pack_mapping
from refmask.operators.restoration import annotate_tokens, token_table

T = "redacted.Table_"
ENTRY = "script_id BIGINT, placeholder STRING, kind STRING, n INT, original STRING, canon STRING"


def entry(placeholder, original, script_id=0):
    n = int(placeholder.rsplit("_", 1)[1])
    kind = "column" if "col" in placeholder.lower() else "table"
    return (script_id, placeholder, kind, n, original, original.lower())


@pytest.fixture(scope="module")
def mapping(spark):
    rows = [
        entry(f"{T}1", "cat.s.T"),
        entry(f"{T}10", "ten"),
        entry(f"{T}2", f"$& $1 \\ ${{x}} {T}1"),
        entry("redacted.Col_1", "x.y"),
        entry("REDACTED.TABLE_7", "loud"),
        entry("redacted.table_8", "quiet"),
    ]
    return spark.createDataFrame(rows, ENTRY)


CASES = {
    f"from {T}1 join {T}10": "from cat.s.T join ten",
    f"'{T}1' -- {T}1\n{T}1.c": "'cat.s.T' -- cat.s.T\ncat.s.T.c",
    f"x{T}1 {T}1x {T}1_ {T}100": f"x{T}1 {T}1x {T}1_ {T}100",
    f"é{T}1é.{T}1": "écat.s.Té.cat.s.T",
    f"from {T}2": f"from $& $1 \\ ${{x}} {T}1",
    "redacted.Col_1 + Redacted.Col_1": "x.y + Redacted.Col_1",
    "REDACTED.TABLE_7 redacted.Table_7 redacted.table_8": "loud redacted.Table_7 quiet",
    "nothing": "nothing",
    f"\ufdd0{T}1\ufdd1": "\ufdd0cat.s.T\ufdd1",
}


def test_restore(scripts, mapping):
    edited = scripts(*CASES).selectExpr("0L AS script_id", "text")
    got = sorted(r.text for r in restore_corpus(edited, mapping).collect())
    assert got == sorted(CASES.values())


def test_keys_of_other_types_meet(scripts, mapping):
    for key in ("INT", "STRING", "DECIMAL(20,0)"):
        edited = scripts(f"{T}1").selectExpr(f"CAST(0 AS {key}) AS script_id", "text")
        assert [r.text for r in restore_corpus(edited, mapping).collect()] == ["cat.s.T"]
    narrow = mapping.selectExpr("INT(script_id) AS script_id", "* EXCEPT (script_id)")
    edited = scripts(f"{T}1").selectExpr("explode(array(0L, 9999999999L)) AS script_id", "text")
    got = sorted((r.script_id, r.status) for r in restore_corpus(edited, narrow).collect())
    assert got == [(0, "ok"), (9999999999, "no_mapping")]


def test_status(scripts, mapping):
    edited = scripts(f"{T}1", f"{T}1").unionByName(scripts(" \n", "x").selectExpr("script_id", "text"))
    got = sorted((r.script_id, r.status, r.text or "") for r in restore_corpus(edited, mapping).collect())
    assert got == [(0, "blank", ""), (0, "ok", "cat.s.T"), (1, "no_mapping", ""), (1, "no_mapping", "")]


def test_round_trip_gives_first_spellings(scripts):
    table = scripts("select A . x from S.T join s.t where a.X", "from u.v join w.x")
    job = redact_corpus(table, Options(redact_columns=True))
    got = {r.script_id: r.text for r in restore_corpus(job.redacted, job.mapping).collect()}
    assert got == {0: "select A.x from S.T join S.T where A.x", 1: "from u.v join w.x"}


def test_tokens(scripts, mapping):
    edited = scripts(f"{T}1 {T}3x REDACTED.table_8, a{T}10 REDACTED.TABLE_7")
    got = [tuple(r)[1:] for r in annotate_tokens(edited, pack_mapping(mapping)).orderBy("pos").collect()]
    assert got == [
        (1, f"{T}1", "cat.s.T"),
        (2, f"{T}3", "No mapping found"),
        (3, "REDACTED.table_8", "quiet"),
        (4, f"{T}10", "ten"),
        (5, "REDACTED.TABLE_7", "loud"),
    ]


def test_tokens_of_a_redaction_need_no_join(scripts):
    job = redact_corpus(scripts("from a.b join c.d"))
    plan = token_table(job.annotated)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert [r.original for r in token_table(job.annotated).orderBy("pos").collect()] == ["a.b", "c.d"]


def test_union_and_summary_put_tables_first(spark, mapping):
    columns = mapping.filter("kind = 'column'")
    tables = mapping.filter("kind = 'table' AND n < 7")
    packed = pack_mapping(mapping_union(columns, tables))
    empty = packed.selectExpr("1L AS script_id", "slice(entries, 1, 0) AS entries")
    got = {r.script_id: r.summary for r in mapping_summaries(packed.unionByName(empty)).collect()}
    assert got[0].split("\n")[0] == f"{T}1 -> cat.s.T"
    assert got[0].split("\n")[-1] == "redacted.Col_1 -> x.y"
    assert got[1] == "No mapping generated yet."


def test_a_script_with_most_of_the_edits_is_split(spark):
    """The join of a hot script is spread over tasks, also behind an aggregated mapping."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        edited = spark.range(0, 40_000, 1, 8).selectExpr(
            "CASE WHEN id % 3 > 0 THEN 7L ELSE id END AS script_id",
            f"concat('from {T}1 -- ', sha2(string(id), 256)) AS text",
        )
        mapping = spark.range(0, 40_000, 1, 8).selectExpr(
            "id AS script_id", f"'{T}1' AS placeholder", "'table' AS kind", "1 AS n",
            "concat('s.t', id) AS original", "concat('s.t', id) AS canon",
        )
        restored = restore_corpus(edited, mapping)
        rows = restored.collect()
        plan = restored._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plan
    assert len(rows) == 40_000
    assert all(r.text.startswith(f"from s.t{r.script_id} --") for r in rows)
