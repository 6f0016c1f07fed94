from pyspark.sql import functions as F

from refmask import Options, fix_corpus
from refmask.functions import text as tx
from refmask.operators import lines as ln
from refmask.operators import typos as ty

MIXED = "select 1\nFROMM t\nlefft\n\njoin u merge intoo v -- frmo\n'updtae' Fromm"


def found(table):
    return [tuple(r)[1:] for r in table.collect()]


def test_findings_are_in_order_of_rule_then_position(scripts):
    assert found(ty.typo_findings(scripts(MIXED))) == [
        (1, 2, "FROMM", "FROM"),
        (1, 6, "Fromm", "FROM"),
        (2, 5, "frmo", "FROM"),
        (3, 3, "lefft\n\njoin", "LEFT JOIN"),
        (12, 6, "updtae", "UPDATE"),
        (14, 5, "intoo", "INTO"),
        (20, 5, "merge intoo", "MERGE INTO"),
    ]


def test_cap_counts_findings_per_script(scripts):
    table = scripts("UPATE\n" + "FROMM\n" * 9, "FROMM " * 7)
    capped = ty.typo_findings(table, max_findings=8)
    assert capped.groupBy("script_id").count().orderBy("script_id").collect() == [(0, 8), (1, 7)]
    assert ty.typo_findings(table).count() == 17
    lines = ty.typo_lines(ty.with_findings(table, max_findings=8)).collect()
    assert sorted(tuple(r) for r in lines) == [(0, i) for i in range(2, 10)] + [(1, 1)]


def test_whole_words_only(scripts):
    assert found(ty.typo_findings(scripts("xFROMM FROMM1 FROMM_ éFROMM DELET  FRO"))) == [(1, 1, "FROMM", "FROM")]


def test_summaries(scripts):
    rows = ty.typo_summaries(ty.with_findings(scripts("a\nFROMM b UPATE", "ok"))).collect()
    got = {r.script_id: r.summary for r in rows}
    assert got == {
        0: "Potential SQL typos:\n- line 2: FROMM -> FROM\n- line 2: UPATE -> UPDATE",
        1: "No SQL typo warnings.",
    }


def test_fixing(scripts):
    cases = {
        MIXED: (
            "select 1\nFROM t\nLEFT JOIN u merge INTO v -- FROM\n'UPDATE' FROM",
            6,
        ),
        "DELET FROMM t": ("DELETE FROM t", 2),
        "delet  from t": ("DELETE FROM t", 1),
        "fine": ("fine", 0),
    }
    rows = {r.script_id: r for r in fix_corpus(scripts(*cases)).collect()}
    for i, (text, replacements) in enumerate(cases.values()):
        assert (rows[i].text, rows[i].replacements) == (text, replacements)
        assert rows[i].status == ("fixed" if replacements else "no_typos")
        assert rows[i].findings == []


def test_pyspark_scripts_are_not_fixed(scripts):
    row = fix_corpus(scripts("FROMM"), Options(mode="pyspark")).first()
    assert (row.status, row.text, row.replacements, row.findings) == ("not_sql", "FROMM", 0, [])


def test_numbered_lines(scripts):
    table = ty.with_findings(scripts("a\n\nFROMM\n", ""))
    got = [tuple(r) for r in ln.numbered_lines(table).orderBy("script_id", "line").collect()]
    assert got == [
        (0, 1, "a", False),
        (0, 2, "", False),
        (0, 3, "FROMM", True),
        (0, 4, "", False),
        (1, 1, "", False),
    ]
    assert [r.lines for r in ln.line_counts(table).orderBy("script_id").collect()] == [4, 1]


def test_many_typo_lines_without_cap(scripts):
    table = ty.with_findings(scripts("FROMM x\n\n" * 1000))
    rows = ln.numbered_lines(table).collect()
    assert sorted(r.line for r in rows if r.has_typo) == list(range(1, 2001, 2)) and len(rows) == 2001


def value(spark, expression, **columns):
    table = spark.createDataFrame([tuple(columns.values())], list(columns))
    return table.select(F.expr(expression)).first()[0]


def test_text_functions(spark):
    canonical = lambda ref: value(spark, tx.canonical_ref("x"), x=ref)
    assert canonical("dbo . T") == canonical("DBO.t") == "dbo.t"
    assert canonical("[dbo].[T]") == "[dbo].[t]"
    assert canonical('A\u00a0. "B  c""\td"') == 'a."b  c""\td"'
    strip = lambda name: value(spark, tx.strip_identifier_quotes("x"), x=name)
    assert [strip(n) for n in (' "a" ', "`a`", "[a]", "[a`", "a", '"a\nb"')] == ["a", "a", "a", "[a`", "a", "a\nb"]
    assert [value(spark, tx.is_qualified_or_quoted("x"), x=n) for n in ("a", "a.b", "`a`", "[a]", '"a"')] == [
        False, True, True, True, True,
    ]
    assert [value(spark, tx.is_blank("x"), x=n) for n in ("", " \n\u3000\ufeff", " x")] == [True, True, False]
    assert value(spark, tx.normalise_newlines("x"), x="a\r\nb\rc\n\r") == "a\nb\nc\n\n"
    assert value(spark, tx.mapping_line("x", "y"), x="p", y="o") == "p -> o"
