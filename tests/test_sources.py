import json

import pytest
from pyspark.sql import functions as F

from refmask import Options, redact_corpus, reload_run, restore_corpus
from refmask.operators.mapping import mapping_table, merge_mappings
from refmask.operators.restoration import restore_all_with
from refmask.sources import runs
from refmask.sources.mapping_json import (
    export_mapping,
    import_mapping,
    read_mapping_files,
    read_mappings,
    write_mapping_files,
    write_mappings,
)
from refmask.sources.scripts import read_scripts, spread

T = "redacted.Table_"

IMPORTS = {
    '{"redacted.Table_1":"a.b"}': "ok",
    '\ufeff {"redacted.Table_1":"a.b"} ': "ok",
    '{"redacted.Table_1":"a","other":"x","redacted.Col_2":7,"redacted.Table_x":"y"}': "ok",
    '{"redacted.Table_1":"  "}': "no_valid_entries",
    '{"redacted.Table_1":null}': "no_valid_entries",
    '{"redacted.Table_1":["a"]}': "no_valid_entries",
    '{"redacted.Table_1":"a","redacted.Table_1":7}': "no_valid_entries",
    "{}": "no_valid_entries",
    "[1,2]": "not_object",
    '[{"redacted.Table_1":"a"}]': "not_object",
    "null": "not_object",
    '"redacted.Table_1"': "not_object",
    "7": "not_object",
    "": "bad_json",
    "{bad": "bad_json",
    "{'redacted.Table_1':'a'}": "bad_json",
    '{"redacted.Table_1":"a",}': "bad_json",
    '{"redacted.Table_1":"a"} x': "bad_json",
    '{"redacted.Table_1":"a"},{"redacted.Table_2":"a"}': "bad_json",
}


def test_import_status(scripts):
    files = scripts(*IMPORTS).withColumnRenamed("text", "json")
    got = {r.script_id: r for r in import_mapping(files).collect()}
    for i, (document, status) in enumerate(IMPORTS.items()):
        assert got[i].status == status, document
        assert bool(got[i].entries) == (status == "ok"), document


def test_import_keeps_valid_entries_untrimmed_in_order(scripts):
    document = {
        "redacted.Col_1": "X.y",
        f"{T}10": " Ten ",
        "REDACTED.table_2": "two",
        f"{T}99999999999": "far",
        "x": "y",
    }
    files = scripts(json.dumps(document)).withColumnRenamed("text", "json")
    rows = [tuple(e) for e in import_mapping(files).first().entries]
    assert rows == [
        (None, f"{T}99999999999", "table", "far", "far"),
        (2, "REDACTED.table_2", "table", "two", "two"),
        (10, f"{T}10", "table", " Ten ", "ten"),
        (1, "redacted.Col_1", "column", "X.y", "x.y"),
    ]


def test_export_and_import_files(spark, scripts, tmp_path):
    job = redact_corpus(scripts("from a.b join c.d", "nothing", "from e.f"))
    exported = {r.script_id: json.loads(r.json) for r in export_mapping(job.annotated).collect()}
    assert exported == {0: {f"{T}1": "a.b", f"{T}2": "c.d"}, 2: {f"{T}1": "e.f"}}
    path = str(tmp_path / "mappings")
    write_mapping_files(job.annotated, path, [0, 2])
    assert sorted(r.script_id for r in read_mapping_files(spark, path).collect()) == ["0", "2"]
    imported = import_mapping(read_mapping_files(spark, path))
    assert imported.filter("status = 'ok'").count() == 2
    assert sorted(r.original for r in mapping_table(imported).collect()) == ["a.b", "c.d", "e.f"]


def test_scripts_from_files(spark, tmp_path):
    folder = tmp_path / "scripts" / "deep"
    folder.mkdir(parents=True)
    (folder / "one.sql").write_bytes(b"from a.b\r\nwhere x\r")
    (folder / "two.sql").write_bytes(b"from c.d")
    table = read_scripts(spark, str(tmp_path / "scripts"))
    job = redact_corpus(table)
    got = {r.script_id: r.text for r in job.redacted.collect()}
    assert got == {"deep/one.sql": f"from {T}1\nwhere x\n", "deep/two.sql": f"from {T}1"}
    with pytest.raises(ValueError, match="absolute"):
        read_scripts(spark, "scripts")


def test_edited_folder_meets_its_mapping(spark, tmp_path):
    """Original folder, mapping as files and as JSON Lines, edited folder: every edit finds its mapping."""
    names = ("a b/one+two.sql", "50%/ü.sql", "plain.sql")
    for kind in ("original", "edited"):
        for name in names:
            file = tmp_path / kind / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(f"from lake.t{len(name)}" if kind == "original" else f"drop {T}1")
    originals = read_scripts(spark, str(tmp_path / "original"))
    assert sorted(r.script_id for r in originals.collect()) == sorted(names)
    job = redact_corpus(originals)
    write_mapping_files(job.annotated, str(tmp_path / "files"), list(names))
    write_mappings(job.annotated, f"file://{tmp_path}/lines")
    edited = read_scripts(spark, f"file://{tmp_path}/edited")
    for mapping in (read_mapping_files(spark, str(tmp_path / "files")), read_mappings(spark, str(tmp_path / "lines"), "script_id STRING")):
        restored = restore_corpus(edited, import_mapping(mapping))
        assert {r.script_id: (r.status, r.text) for r in restored.collect()} == {n: ("ok", f"drop lake.t{len(n)}") for n in names}


def test_one_imported_mapping_for_all_edits(spark, scripts):
    files = scripts('{"redacted.Table_1":"a.b"}').withColumnRenamed("text", "json")
    restored = restore_all_with(scripts(f"from {T}1", "", f"drop {T}1, {T}2"), import_mapping(files))
    assert {r.script_id: tuple(r)[1:] for r in restored.collect()} == {0: ("ok", "from a.b"), 1: ("blank", None), 2: ("ok", f"drop a.b, {T}2")}
    none = restore_all_with(scripts(f"from {T}1"), import_mapping(files).limit(0))
    assert none.first().status == "no_mapping"


def test_mappings_of_two_runs(spark, scripts):
    """The newest run's original wins, and no edit is restored twice."""
    old, new = (redact_corpus(scripts(f"from {name}.t join both.x")).mapping for name in ("old", "new"))
    edited = scripts(f"{T}1 {T}2")
    assert [r.text for r in restore_corpus(edited, merge_mappings(new, old)).collect()] == ["new.t both.x"]
    assert [r.text for r in restore_corpus(edited, new.union(old)).collect()] == ["new.t both.x"]


def test_inputs_are_spread_as_asked(spark):
    assert spread(spark.range(100).coalesce(1), 5).rdd.getNumPartitions() == 5


def test_runs(spark, scripts, tmp_path):
    path = str(tmp_path / "runs")
    table = scripts("FROMM a.b\nfrom c.d", 'spark.table("x.y") FROMM', mode="sql")
    with_columns = Options(redact_columns=True)
    saved = redact_corpus(table, with_columns).save(path, "r1", table, with_columns)
    assert "FileScan parquet" in saved.mapping._jdf.queryExecution().executedPlan().toString()
    edited = scripts(f"delete from {T}1", f"drop {T}1")
    runs.save_run(path, "r1", edited=edited, restored=restore_corpus(edited, saved.annotated))

    loaded = reload_run(spark, path, "r1")
    assert {r.script_id: r.text for r in loaded["restored"].collect()} == {0: "delete from c.d", 1: "drop x.y"}
    assert loaded["options"].first() == ("sql", True)
    assert sorted(r.script_id for r in loaded["findings"].collect()) == [0, 1]
    assert loaded["edited"].count() == 2

    nothing = runs.load_run(spark, path, "r0")
    assert nothing["options"].first() == ("sql", False)
    assert all(nothing[name].isEmpty() for name in runs.TABLES)
    with pytest.raises(ValueError, match="exist"):
        runs.save_run(path, "r1", scripts=table)
    with pytest.raises(ValueError):
        runs.save_run(path, "r2", other=table)
    runs.save_run(path, "r3", annotated=saved.annotated)
    with pytest.raises(ValueError, match="without its scripts"):
        reload_run(spark, path, "r3")

    target = str(tmp_path / "purged")
    runs.purge(path, target, spark, spark.createDataFrame([(0,)], "script_id BIGINT"))
    kept = runs.load_run(spark, target, "r1")
    for name in runs.TABLES:
        assert [r.script_id for r in kept[name].collect()] == [1], name
    assert kept["options"].first() == ("sql", True)
    assert runs.load_table(spark, path, "r1", "scripts").count() == 2


def test_scripts_without_a_mode_use_the_saved_one(spark, scripts, tmp_path):
    for mode, findings in (("sql", 1), ("pyspark", 0)):
        options = spark.createDataFrame([(mode, False)], "mode STRING, redact_columns BOOLEAN")
        runs.save_run(str(tmp_path), mode, options, scripts=scripts("FROMM"))
        assert reload_run(spark, str(tmp_path), mode)["findings"].count() == findings


def test_only_needed_columns_of_a_run_are_read(spark, scripts, tmp_path):
    saved = redact_corpus(scripts("from a.b")).save(str(tmp_path), "r", scripts("from a.b"))
    plan = saved.mapping.select("original")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "entries" in schema and "text" not in schema and "findings" not in schema


def test_settings_are_sanitised(spark, scripts):
    states = scripts(
        '{"mode":"pyspark","redact_columns":true}', '{"mode":"python"}', "{bad", "[]", '{"redact_columns":"x"}'
    )
    got = {r.script_id: tuple(r)[1:] for r in runs.sanitise_options(states, "text", ("script_id",)).collect()}
    assert got == {
        0: ("pyspark", True),
        1: ("sql", False),
        2: ("sql", False),
        3: ("sql", False),
        4: ("sql", True),
    }


def test_runs_with_other_keys(spark, tmp_path):
    table = spark.createDataFrame([("x/y.sql", 3, "from a.b FROMM")], "file STRING, part INT, text STRING")
    keys = ("file", "part")
    redact_corpus(table, keys=keys).save(str(tmp_path), "r", table)
    loaded = reload_run(spark, str(tmp_path), "r", "file STRING, part INT")
    assert [(r.file, r.part, r.found) for r in loaded["findings"].collect()] == [("x/y.sql", 3, "FROMM")]
    assert loaded["annotated"].first().text == "from redacted.Table_1 FROMM"


def test_a_save_that_stops_leaves_nothing_to_read(spark, scripts, tmp_path, monkeypatch):
    """Between two tables, and before the manifest: the run is absent, and a second try makes it whole."""
    path = str(tmp_path / "runs")
    table = scripts("from a.b FROMM", "from c.d")
    broken = table.select("script_id", F.expr("IF(script_id >= 0, raise_error('stop'), text)").cast("string").alias("text"))
    with pytest.raises(Exception, match="stop"):
        runs.save_run(path, "r", scripts=table, edited=broken)
    assert (tmp_path / "runs" / "scripts").exists()
    assert not runs.has_table(spark, path, "r", "scripts") and runs.load_table(spark, path, "r", "scripts").isEmpty()
    with pytest.raises(ValueError, match="without its scripts"):
        reload_run(spark, path, "r")
    runs.save_run(path, "r", scripts=table, edited=table)
    assert runs.load_table(spark, path, "r", "scripts").count() == 2 and reload_run(spark, path, "r")["findings"].count() == 1
    # What the first try left is not copied either.
    runs.purge(path, str(tmp_path / "kept"), spark, spark.createDataFrame([(1,)], "script_id BIGINT"))
    assert [r.text for r in runs.load_table(spark, str(tmp_path / "kept"), "r", "scripts").collect()] == ["from a.b FROMM"]
    assert runs.manifest(spark, str(tmp_path / "kept"), "r")["scripts"][1] == 1


def test_empty_tables_are_saved(spark, scripts, tmp_path):
    runs.save_run(str(tmp_path), "r", edited=scripts("x").limit(0).select("script_id", "text"))
    assert runs.has_table(spark, str(tmp_path), "r", "edited") and runs.load_table(spark, str(tmp_path), "r", "edited").isEmpty()
