"""Golden cases: every rule of recognition, numbering and rewriting."""

import pytest

from refmask import Options, redact_corpus
from refmask.operators.restoration import restore_with_entries


def redacted(table, **options):
    job = redact_corpus(table, Options(**options))
    return {r.script_id: r for r in job.annotated.collect()}


def texts(scripts, *sources, mode=None, **options):
    rows = redacted(scripts(*sources, mode=mode), **options)
    return [rows[i].text for i in range(len(sources))]


T = "redacted.Table_"
C = "redacted.Col_"

SQL_CASES = {
    # every position a table can be in
    "select * from a.b": f"select * from {T}1",
    "x left join a.b on 1": f"x left join {T}1 on 1",
    "update a.b set c = 1": f"update {T}1 set c = 1",
    "insert into a.b values (1)": f"insert into {T}1 values (1)",
    "Delete  From a.b where c": f"Delete  From {T}1 where c",
    "MERGE\nINTO a.b t using s": f"MERGE\nINTO {T}1 t using s",
    "truncate table a.b": f"truncate table {T}1",
    "from only a.b": f"from only {T}1",
    "from only": f"from {T}1",
    "from only where x": f"from only {T}1 x",
    # names
    "from a . b\n. c": f"from {T}1",
    "from a.b.c.d.e": f"from {T}1",
    "from [my t].[x y]": f"from {T}1",
    'from "a".`b`.[c].d e': f"from {T}1 e",
    "from t$1#.x_2": f"from {T}1",
    "xfrom a.b": "xfrom a.b",
    "from_ a.b": "from_ a.b",
    "éfrom a.b": f"éfrom {T}1",
    "from\u00a0a.b": f"from\u00a0{T}1",
    # bare names need a clause, an alias with a clause, or the end of the text behind them
    "from t": f"from {T}1",
    "from t  \n": f"from {T}1  \n",
    "from t where x": f"from {T}1 where x",
    "from t, u": f"from {T}1, u",
    "(select 1 from t) q": f"(select 1 from {T}1) q",
    "from t;": f"from {T}1;",
    "from t group\n by x": f"from {T}1 group\n by x",
    "from t group x y": "from t group x y",
    "from t x where y": f"from {T}1 x where y",
    "from t as x where y": f"from {T}1 as x where y",
    "from t as": f"from {T}1 as",
    "from t as where": f"from {T}1 as where",
    "from t as where x": "from t as where x",
    "from t x": f"from {T}1 x",
    "from t x$ where y": "from t x$ where y",
    "from the mall we go": "from the mall we go",
    "from t wherever x": "from t wherever x",
    "insert into t (a) values (1)": "insert into t (a) values (1)",
    "insert into t select 1": "insert into t select 1",
    "from t -- note": "from t -- note",
    "from t with (nolock)": "from t with (nolock)",
    "insert into table t values (1)": f"insert into {T}1 t values (1)",
    # never taken for tables
    "from a.b, c.d": f"from {T}1, c.d",
    "merge into a.b using c.d": f"merge into {T}1 using c.d",
    "create table a.b (c int)": "create table a.b (c int)",
    "insert overwrite a.b": "insert overwrite a.b",
    "from db..t": "from db..t",
    "from {var}.t": "from {var}.t",
    "from /* x */ a.b": "from /* x */ a.b",
    "from (select 1)": "from (select 1)",
    "from pandas import x": "from pandas import x",
    "from a.b  import x": "from a.b  import x",
    "from a.b importer": f"from {T}1 importer",
    # taken for tables although they are not
    "with q as (select 1) select * from q": f"with q as (select 1) select * from {T}1",
    "extract(year from d)": f"extract(year from {T}1)",
    "a is distinct from b.c": f"a is distinct from {T}1",
    # protected text
    "'from a.b' from c.d": f"'from a.b' from {T}1",
    "'it''s from a.b' from c.d": f"'it''s from a.b' from {T}1",
    "-- from a.b\nfrom c.d": f"-- from a.b\nfrom {T}1",
    "/* from a.b */ from c.d": f"/* from a.b */ from {T}1",
    "/*/ from a.b */ from c.d": f"/*/ from a.b */ from {T}1",
    '"from a.b" from c.d': f'"from a.b" from {T}1',
    "`from a.b` [from a.b] from c.d": f"`from a.b` [from a.b] from {T}1",
    "from a.b 'from c.d": f"from {T}1 'from c.d",
    "from a.b /* from c.d": f"from {T}1 /* from c.d",
    "from a.b [from c.d": f"from {T}1 [from c.d",
    # numbering
    "from a.b join c.d join A . B": f"from {T}1 join {T}2 join {T}1",
    "from [a].[b] join a.b": f"from {T}1 join {T}2",
    # a name is replaced where it stands
    "from f where x": f"from {T}1 where x",
    "from o.m join j.n": f"from {T}1 join {T}2",
    # a keyword at the end of a comment belongs to the comment
    "-- rows come from\nfrom a.b": f"-- rows come from\nfrom {T}1",
    # numbers already present are not given out again
    f"from {T}1 join a.b join c.d -- {T}3": f"from {T}1 join {T}2 join {T}4 -- {T}3",
    f"from a.b -- {T}1x {T}2": f"from {T}1 -- {T}1x {T}2",
    "from REDACTED.TABLE_1 join a.b": f"from REDACTED.TABLE_1 join {T}1",
    f"from redacted . Table_9 join {T}x": f"from {T}1 join {T}2",
    f"from {C}1": f"from {T}1",
    # white space inside quotes counts
    "from [my t] join [myt]": f"from {T}1 join {T}2",
    # names of object members are ordinary names
    "from constructor join __proto__ join constructor": f"from {T}1 join {T}2 join {T}1",
    # doubled quotes stay inside
    'from "a""b" join `c``d`': f"from {T}1 join {T}2",
    'from "a"""': f"from {T}1",
    'from ""': 'from ""',
    # marks used inside the library are ordinary characters
    "from a.b \ufdd0 \ufdd1 join c.d": f"from {T}1 \ufdd0 \ufdd1 join {T}2",
    "from a.b \\ $1 ${ref} join c.d": f"from {T}1 \\ $1 ${{ref}} join {T}2",
}


def test_sql_tables(scripts):
    got = texts(scripts, *SQL_CASES)
    for (source, expected), text in zip(SQL_CASES.items(), got):
        assert text == expected, repr(source)


COLUMN_CASES = {
    "select x.a, x . b, x.A from t.u": f"select {C}1, {C}2, {C}1 from {T}1",
    "select a.b.c": f"select {C}1.c",
    'select a."b c", a.[d], "q".e, [q].f, `q`.g.h': f'select {C}1, {C}2, "q".e, [q].f, `q`.g.h',
    "select 'a.b', a.c -- d.e": f"select 'a.b', {C}1 -- d.e",
    "select 1.5, 2a.b, éa.b": f"select 1.5, 2{C}1, é{C}1",
    "select redacted.x, y.Table_3, y.[col_4], y.Table_x": f"select redacted.x, y.Table_3, y.[col_4], {C}1",
    f"select {C}1, a.b": f"select {C}1, {C}2",
    "alter table a.b add c": "alter table a.b add c",
    "from a.b.c import x.y": f"from a.b.{'c'} import {C}1",
    "alter table" + " " * 43 + "a.b, table" + " " * 44 + "a.b": "alter table"
    + " " * 43
    + "a.b, table"
    + " " * 44
    + "a.b",
    "-- from\na.b": f"-- from\n{C}1",
}


def test_sql_columns(scripts):
    got = texts(scripts, *COLUMN_CASES, redact_columns=True)
    for (source, expected), text in zip(COLUMN_CASES.items(), got):
        assert text == expected, repr(source)


def test_columns_stay_without_the_option(scripts):
    assert texts(scripts, "select x.a from t.u") == [f"select x.a from {T}1"]


def test_mapping_lists_tables_before_columns_with_first_spelling(scripts):
    table = scripts("select X . a from T . U join t.u join v.w where x.A")
    entries = redacted(table, redact_columns=True)[0].entries
    assert [tuple(e) for e in entries] == [
        (1, f"{T}1", "table", "T . U", "t.u"),
        (2, f"{T}2", "table", "v.w", "v.w"),
        (1, f"{C}1", "column", "X.a", "x.a"),
    ]


PYSPARK_CASES = {
    'spark.table("a.b")': f'spark.table("{T}1")',
    "Spark . Read .\nTable ( 'a.b' )": f"Spark . Read .\nTable ( '{T}1' )",
    'df.write.saveAsTable("a.b")': f'df.write.saveAsTable("{T}1")',
    'df.write.mode("x").insertInto("a.b", True)': f'df.write.mode("x").insertInto("{T}1", True)',
    'x = spark.table(" a.B ") + spark.table("A.b")': f'x = spark.table("{T}1") + spark.table("{T}1")',
    'spark.table("tmp")': 'spark.table("tmp")',
    'spark.table("a. b")': 'spark.table("a. b")',
    'spark.table(f"a.b")': 'spark.table(f"a.b")',
    'spark.table("a.b\')': 'spark.table("a.b\')',
    'spark.table("a\\.b")': 'spark.table("a\\.b")',
    'spark.table("a.\nb")': 'spark.table("a.\nb")',
    'spark.table(name) # "a.b"': 'spark.table(name) # "a.b"',
    'spark.sql("select * from a.b")': 'spark.sql("select * from a.b")',
    'spark.readStream.table("a.b")': 'spark.readStream.table("a.b")',
    'myspark.table("a.b")': 'myspark.table("a.b")',
    '# spark.table("a.b")': f'# spark.table("{T}1")',
    f'spark.table("{T}1"), spark.table("a.b")': f'spark.table("{T}1"), spark.table("{T}2")',
    'F.col("a.b")': 'F.col("a.b")',
}


def test_pyspark_tables(scripts):
    got = texts(scripts, *PYSPARK_CASES, mode="pyspark", redact_columns=True)
    for (source, expected), text in zip(PYSPARK_CASES.items(), got):
        assert text == expected, repr(source)


def test_mode_is_detected_unless_pyspark_was_requested(scripts):
    cases = {
        'spark.table("a.b")': "pyspark",
        "SPARK . read . table (": "pyspark",
        "df . write . saveAsTable(": "pyspark",
        "df.write.insertInto (": "pyspark",
        'df.write.mode("x").saveAsTable("a.b")': "sql",
        "select spark.table_x": "sql",
        "xspark.table(": "sql",
    }
    rows = redacted(scripts(*cases))
    assert [rows[i].mode for i in range(len(cases))] == list(cases.values())
    requested = redacted(scripts("select 1 from a.b", mode="pyspark"))[0]
    assert (requested.mode, requested.text) == ("pyspark", "select 1 from a.b")


def test_gates(scripts):
    table = scripts(" \n\u00a0", None, "FROMM a.b", "from a.b")
    skipping = redacted(table, on_typos="skip")
    assert [skipping[i].status for i in range(4)] == ["blank", "blank", "typos", "ok"]
    assert [skipping[i].text for i in range(4)] == [None, None, None, f"from {T}1"]
    assert [len(skipping[i].entries) for i in range(4)] == [0, 0, 0, 1]
    going_on = redacted(table)
    assert [going_on[i].status for i in range(4)] == ["blank", "blank", "ok", "ok"]
    with pytest.raises(ValueError):
        redact_corpus(table, Options(on_typos="ask"))


def test_typos_are_looked_for_in_sql_only(scripts):
    rows = redacted(scripts('spark.table("a.b") FROMM', "x FROMM"))
    assert [len(rows[i].findings) for i in range(2)] == [0, 1]


def test_redacting_twice_changes_nothing(spark, scripts):
    table = scripts(*[c for c in SQL_CASES if "redacted" not in c.lower()])
    once = redact_corpus(table, Options(redact_columns=True)).redacted
    twice = redact_corpus(once, Options(redact_columns=True))
    assert twice.mapping.count() == 0
    assert twice.redacted.select("script_id", "text").exceptAll(once.select("script_id", "text")).isEmpty()


def test_result_does_not_depend_on_partitioning(scripts):
    table = scripts(*SQL_CASES)
    one = redact_corpus(table.coalesce(1)).annotated
    many = redact_corpus(table.repartition(7)).annotated
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_composite_and_string_keys(spark):
    table = spark.createDataFrame([("a", 1, "from x.y"), ("a", 2, "from z.w")], "f STRING, n INT, text STRING")
    job = redact_corpus(table, keys=("f", "n"))
    assert sorted(tuple(r)[:3] for r in job.mapping.collect()) == [("a", 1, f"{T}1"), ("a", 2, f"{T}1")]


def test_very_long_texts(scripts):
    """No recursion per character, and no quadratic work for many distinct names."""
    n = 30_000
    many = " ".join(f"from s.t_{i} join S.T_{i};" for i in range(n))
    sources = (
        "from a.b '" + "x" * 300_000,
        "from a.b /*" + "*x" * 150_000,
        'from "' + '""' * 100_000 + '" x',
        "from a.b " + " " * 200_000 + "join c.d",
        "a1" * 100_000 + " from a.b",
        many,
    )
    rows = redacted(scripts(*sources), redact_columns=True)
    assert rows[0].text.startswith(f"from {T}1 '")
    assert rows[1].text.startswith(f"from {T}1 /*")
    assert rows[2].text == f"from {T}1 x"
    assert rows[3].text.endswith(f"join {T}2")
    assert rows[4].text.endswith(f"from {T}1")
    expected = " ".join(f"from {T}{i} join {T}{i};" for i in range(1, n + 1))
    assert rows[5].text == expected
    assert [e.n for e in rows[5].entries] == list(range(1, n + 1))
    assert rows[5].entries[-1].original == f"s.t_{n - 1}"


def test_very_long_texts_are_restored(spark, scripts):
    n = 30_000
    source = " ".join(f"from s.t_{i} join s.t_{i};" for i in range(n))
    job = redact_corpus(scripts(source))
    restored = restore_with_entries(job.annotated).first()
    assert restored.text == source


def test_texts_and_dictionaries_cost_only_themselves(scripts):
    """Neither is computed for the other, and both agree with the annotated rows."""
    texts = ("SELECT x.y FROM a.b x JOIN c.d z ON x.k = z.k", "FROM e.f", "", None, 'spark.table("g.h")')
    for columns in (False, True):
        job = redact_corpus(scripts(*texts), Options(redact_columns=columns))
        rows = {r.script_id: r for r in job.annotated.collect()}
        assert {r.script_id: (r.mode, r.text, r.status) for r in job.redacted.collect()} == {k: (r.mode, r.text, r.status) for k, r in rows.items()}
        got = sorted((r.script_id, r.placeholder, r.kind, r.n, r.original, r.canon) for r in job.mapping.collect())
        assert got == sorted((k, e.placeholder, e.kind, e.n, e.original, e.canon) for k, r in rows.items() for e in r.entries) and len(got) > 3
        plan = job.redacted._jdf.queryExecution().optimizedPlan().toString()
        assert "canon" not in plan
        plan = job.mapping._jdf.queryExecution().optimizedPlan().toString()
        # Texts are joined together again for the columns only, which are looked for in the redacted text.
        assert plan.count("array_join") == (1 if columns else 0)
