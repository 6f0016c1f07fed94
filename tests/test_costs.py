"""What a row costs: values are bound without being copied, and names are not taken one by one where all can be at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from refmask.functions import redact as rd
from refmask.operators.audit import leak_audit, leak_audit_corpus
from refmask.operators.incremental import changed_scripts, script_hashes
from refmask.operators.references import table_references
from refmask.operators.restoration import restore_with_entries
from refmask.operators.typos import typo_findings
from refmask.operators.mapping import mapping_table, pack_mapping
from refmask.plans.jobs import Options, redact_corpus
from refmask.sources.mapping_json import import_mapping, imported_mapping

MARKS = chr(0xFDD0) + chr(0xFDD1)
TEXTS = (
    'SELECT 1 FROM Cat . "A  b" x JOIN cat."A  b" y ON 1 = 1 -- from q.r\nDELETE FROM [x`y] ; UPDATE [x`y] SET k = \'\'',
    "SELECT 1 FROM redacted.Table_1 JOIN Redacted . Table_2 x ON 1 = 1 JOIN a.b c ON c.d = redacted.Col_1 AND c . d = c.Table_3",
    f"SELECT '{MARKS}' FROM a.b{MARKS} JOIN c.d ON 1 = 1 -- {MARKS}",
    "nothing here",
    "\n".join(f"SELECT 1 FROM Wide.t{i % 150};" for i in range(400)),
)


def test_redaction_takes_all_names_of_a_script_at_once(scripts):
    """the same as name by name, and restored to what it was."""
    table = scripts(*TEXTS)
    for columns in (False, True):
        job = redact_corpus(table, Options(redact_columns=columns))
        back = {r.script_id: (r.status, r.text) for r in restore_with_entries(job.annotated).collect()}
        found = {r.script_id: r for r in job.annotated.collect()}
        assert [e.canon for e in found[0].entries][:2] == ['cat."A  b"'.lower(), "[x`y]"]
        assert [(e.n, e.canon) for e in found[1].entries if e.kind == "table"] == [(2, "redacted.table_2"), (3, "a.b")]
        assert [e.n for e in found[4].entries] == list(range(1, 151))
        for i, text in enumerate(TEXTS):
            assert back[i][0] == ("ok" if found[i].entries else "no_mapping")
            if i in (2, 4):
                assert back[i][1] == text
        plan = job.annotated._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(array(" not in plan and "concat_ws(" in plan


def test_what_concerns_one_name_is_done_after_the_explode(scripts):
    """names, their canonical forms and whether they count, as in the row."""
    table = scripts(*TEXTS, None, "")
    rows = {(r.script_id, r.pos, r.kind, r.ref, r.canon, r.accepted) for r in table_references(table).collect()}
    within = table.select("script_id", F.explode(F.expr(rd.sql_table_refs("text"))).alias("r")).select("script_id", "r.*")
    assert rows == {(r.script_id, r.pos, "table", r.ref, r.canon, r.accepted) for r in within.collect()} and len(rows) > 400
    plan = table_references(table)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.split("\n") if "Generate" in line)
    assert "lower(" not in generate and "named_struct" not in generate


def test_misspellings_within_others_are_found_in_one_pass(scripts):
    """F8, F11: a rule whose hit ends in another one's hit, each with its own line, in a text that is scanned once."""
    table = scripts("x FROMM a\nmerge\n\n intoo b Merge INTOO c\nintoo MERGEINTO d delet from", f"merge intoo {MARKS}\nfromm", "INTOO", "none")
    found = typo_findings(table)
    assert {(r.script_id, r.rule, r.line, r.found, r.fix) for r in found.collect()} == {
        (0, 1, 1, "FROMM", "FROM"),
        (0, 14, 4, "intoo", "INTO"),
        (0, 14, 4, "INTOO", "INTO"),
        (0, 14, 5, "intoo", "INTO"),
        (0, 16, 5, "delet from", "DELETE FROM"),
        (0, 17, 5, "MERGEINTO", "MERGE INTO"),
        (0, 20, 2, "merge\n\n intoo", "MERGE INTO"),
        (0, 20, 4, "Merge INTOO", "MERGE INTO"),
        (1, 1, 2, "fromm", "FROM"),
        (1, 14, 1, "intoo", "INTO"),
        (1, 20, 1, "merge intoo", "MERGE INTO"),
        (2, 14, 1, "INTOO", "INTO"),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=[") == 2  # whether there is any, and where


def test_paths_of_a_text_are_made_canonical_at_once(scripts):
    """paths with spaces, quotes, brackets and marks of our own around them, all in one pass."""
    texts = (
        f'SELECT 1 FROM A.B x -- {MARKS}a . b{MARKS} [a].b a.B.c "a.b" a',
        'SELECT 1 FROM [x . y].Z q -- [X . Y] . z, [x.y].z; "A  b".c',
        'SELECT 1 FROM "A  b".c q -- "a  B" . C.d, "A  b"',
    )
    job = redact_corpus(scripts(*texts))
    assert {tuple(r) for r in leak_audit(job.annotated).collect()} == {(0, "table", "a.b", 3), (1, "table", "[x . y].z", 1), (2, "table", '"a  b".c', 1)}
    corpus = leak_audit_corpus(job.annotated, job.mapping)
    assert {tuple(r) for r in corpus.collect()} == {
        (0, "table", "a.b", 3), (1, "table", "[x . y].z", 1), (1, "table", '"a  b".c', 1), (2, "table", '"a  b".c', 1)
    }
    for audit in (leak_audit(job.annotated), corpus):
        plan = audit._jdf.queryExecution().optimizedPlan().toString()
        assert "concat_ws(" in next(line for line in plan.split("\n") if "Generate" in line)


def test_hashes_move_as_bytes(scripts):
    """what is compared is half as long, and what has changed is the same."""
    before = scripts("a", "b", None, "d")
    after = scripts("a", "B", None, None, "e")
    plan = changed_scripts(after, script_hashes(before))
    assert sorted((r.script_id, r.text) for r in plan.collect()) == [(1, "B"), (3, None), (4, "e")]
    assert "unhex(" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_imported_entries_are_rows_of_their_own(spark):
    """the entries of mappings without packing, strings read as texts, and the last value of a repeated key."""
    documents = (
        '{"redacted.Table_1": "A . b", "redacted.Col_2": "x\\u00e9\\n\\"y\\"", "redacted.Table_3": 7, "redacted.Table_4": null, "other": "z"}',
        '{"redacted.Table_1": "old", "redacted.Table_2": "b", "redacted.Table_1": "new.T", "redacted.Table_2": 5}',
        '\ufeff{"REDACTED.col_7": " q ", "redacted.Table_99999999999": "big", "redacted.Table_5": "  ", "redacted.Table_6": {"a": [1, "s"]}}',
        '{"redacted.Table_1": "a.b", "redacted.Table_2": 1e999999999, "redacted.Table_3": 123456789012345678901234567890123456789012345678901234567890}',
        '[{"redacted.Table_1": "a.b"}]', '{"redacted.Table_1": "a.b"} {"redacted.Table_1": "c.d"}', "{bad", "{}", "", None,
    )
    files = spark.createDataFrame(list(enumerate(documents)), "script_id BIGINT, json STRING")
    rows = sorted(map(str, imported_mapping(files).collect()))
    assert rows == sorted(map(str, mapping_table(import_mapping(files)).collect()))
    assert sorted((r.script_id, r.placeholder, r.original, r.canon) for r in imported_mapping(files).filter("script_id < 3").collect()) == [
        (0, "redacted.Col_2", 'x\u00e9\n"y"', 'x\u00e9"y"'),
        (0, "redacted.Table_1", "A . b", "a.b"),
        (1, "redacted.Table_1", "new.T", "new.t"),
        (2, "REDACTED.col_7", " q ", "q"),
        (2, "redacted.Table_99999999999", "big", "big"),
    ]
    packed = pack_mapping(imported_mapping(files).unionByName(imported_mapping(files)))
    assert sorted(map(str, mapping_table(packed).collect())) == rows
    plan = imported_mapping(files)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate")[0]
    assert "lower(" in above and "VariantType" not in above and "aggregate(" not in above


def test_modes_are_told_by_a_pattern_only_where_a_bracket_is(scripts):
    """the same modes, and the pattern for calls is not tried on texts that have none."""
    table = scripts("spark.table", "SPARK . read\n.table (", "x.write.saveAsTable('a.b')", "select (1)", "", "spark.table\uff08")
    job = redact_corpus(table)
    assert [r.mode for r in job.redacted.orderBy("script_id").collect()] == ["sql", "pyspark", "pyspark", "sql", "sql", "sql"]
    assert "Contains(text" in job.redacted._jdf.queryExecution().optimizedPlan().toString()
