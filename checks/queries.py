"""Queries on whole tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpora as co
from checks import oracles as oc
from refmask.functions import lexicon as lx
from refmask.functions import text as tx
from refmask.operators import audit as au
from refmask.operators import corpus as cp
from refmask.operators import incremental as inc
from refmask.operators import lines as ln
from refmask.operators import mapping as mp
from refmask.operators import references as rf
from refmask.operators import restoration as rs
from refmask.operators import typos as ty
from refmask.operators.intermediate import computed_once
from refmask.plans.jobs import Options, fix_corpus, redact_corpus, restore_corpus
from refmask.sources.mapping_json import export_mapping, import_mapping, imported_mapping
from refmask.sources.runs import sanitise_options, touched_runs, whole_tables
from refmask.sources.scripts import path_below, scripts_from

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

COLUMNS_ON = Options(redact_columns=True)


def query(oracle: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def _wide(table: DataFrame) -> DataFrame:
    """Counters as BIGINT, the type the oracles use."""
    return table.select(
        *(F.col(c).cast("bigint") if t == "int" else F.col(c) for c, t in table.dtypes)
    )


def _sql(spark, sf_dir, options=Options()):
    return redact_corpus(co.frame(spark, sf_dir, co.SQL_SCRIPTS), options)


def _batches(spark, sf_dir):
    return redact_corpus(co.batch_scripts(spark, sf_dir))


# -- sources -------------------------------------------------------------------------------------

_MESSY_NEWLINES = (
    "SELECT doc_id AS script_id, replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', chr(13)) AS text FROM documents"
)


@query(
    "SELECT script_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text "
    f"FROM ({_MESSY_NEWLINES})"
)
def a1_scripts_from_table(spark, sf_dir):
    return scripts_from(co.frame(spark, sf_dir, _MESSY_NEWLINES))


@query(
    "SELECT s_suppkey AS script_id, ['not_object', 'ok', 'no_valid_entries', 'ok', 'bad_json'][s_suppkey % 5 + 1] AS status FROM supplier"
)
def a3_import_status(spark, sf_dir):
    return import_mapping(co.frame(spark, sf_dir, co.MAPPING_FILES)).select("script_id", "status")


@query(
    "SELECT s_suppkey AS script_id, 'redacted.Table_1' AS placeholder, 'table' AS kind, CAST(1 AS BIGINT) AS n, "
    "'cat.s_' || s_nationkey AS original, 'cat.s_' || s_nationkey AS canon FROM supplier WHERE s_suppkey % 5 = 1 "
    "UNION ALL SELECT s_suppkey, 'redacted.Table_2', 'table', 2, ' Q.r', 'q.r' FROM supplier WHERE s_suppkey % 5 = 3 "
    "UNION ALL SELECT s_suppkey, 'redacted.Col_2', 'column', 2, 'a.' || lower(s_name), 'a.' || lower(s_name) "
    "FROM supplier WHERE s_suppkey % 5 = 3"
)
def a3_import_mapping(spark, sf_dir):
    return _wide(mp.mapping_table(import_mapping(co.frame(spark, sf_dir, co.MAPPING_FILES))))


@query(
    "SELECT o_orderkey AS script_id, CAST(json_object("
    f"'redacted.Table_1', {co.ORDER_TABLE}, 'redacted.Table_2', {co.PRIORITY_TABLE}) AS VARCHAR) AS json FROM orders"
)
def a4_export_mapping(spark, sf_dir):
    return export_mapping(_sql(spark, sf_dir).annotated)


@query(
    "SELECT o_orderkey AS script_id, 'redacted.Table_' || n AS placeholder, 'table' AS kind, n, original, original AS canon FROM ("
    f"SELECT o_orderkey, CAST(1 AS BIGINT) AS n, {co.ORDER_TABLE} AS original FROM orders "
    f"UNION ALL SELECT o_orderkey, 2, {co.PRIORITY_TABLE} FROM orders)"
)
def a4_export_then_import(spark, sf_dir):
    exported = export_mapping(_sql(spark, sf_dir).annotated, pretty=True)
    return _wide(mp.mapping_table(import_mapping(exported)))


@query(
    "SELECT s_suppkey AS script_id, CASE WHEN s_suppkey % 4 = 0 THEN 'pyspark' ELSE 'sql' END AS mode, "
    "s_suppkey % 4 = 1 AS redact_columns FROM supplier"
)
def a6_saved_options(spark, sf_dir):
    states = co.frame(spark, sf_dir, co.SAVED_OPTIONS)
    return sanitise_options(states, "value", ("script_id",))


# One file per order, below a folder of originals and one of edits; locations are URIs.
@query(
    "SELECT o_orderkey AS script_id, 'd ' || o_custkey % 7 || '/s+' || o_orderkey || '.sql' AS original, "
    "'d ' || o_custkey % 7 || '/s+' || o_orderkey || '.sql' AS edited FROM orders"
)
def a2_edited_keys(spark, sf_dir):
    files = co.frame(
        spark,
        sf_dir,
        "SELECT o_orderkey AS script_id, '/d%20' || CAST(o_custkey % 7 AS STRING) || '/s+' || CAST(o_orderkey AS STRING) || '.sql' AS path FROM orders",
    )
    original, edited = (
        path_below(root, F.concat(F.lit(uri), "path")).alias(name)
        for name, root, uri in (("original", "/data/originals", "file:///data/originals"), ("edited", "hdfs://host:1/e/", "hdfs://host:1/e"))
    )
    return files.select("script_id", original, edited)


@query("SELECT DISTINCT CAST(l_orderkey % 50 AS BIGINT) AS run_id FROM lineitem WHERE l_suppkey % 29 = 3 AND l_orderkey % 50 < 30")
def a7_touched_runs(spark, sf_dir):
    """Which runs a purge has to rewrite: runs of scripts named by supplier and order."""
    rows = co.frame(spark, sf_dir, "SELECT l_orderkey AS script_id, l_suppkey, l_orderkey % 50 AS run_id FROM lineitem")
    return touched_runs(rows, rows.filter("l_suppkey % 29 = 3 AND run_id < 30").select("script_id"))


# -- predicates and modes ------------------------------------------------------------------------

_HINT = oc._q(
    rf"(?i)\bspark{oc._W}*\.{oc._W}*(?:read{oc._W}*\.{oc._W}*)?table{oc._W}*\("
    rf"|\.{oc._W}*write{oc._W}*\.{oc._W}*(?:saveAsTable|insertInto){oc._W}*\("
)


@query(
    f"SELECT source, script_id, CASE WHEN regexp_matches(text, {_HINT}) THEN 'pyspark' ELSE 'sql' END AS mode "
    f"FROM ({co.ALL_TEXTS})"
)
def b1_detect_mode(spark, sf_dir):
    texts = co.frame(spark, sf_dir, co.ALL_TEXTS)
    return texts.select("source", "script_id", F.expr(tx.detect_mode("text")).alias("mode"))


_REQUESTED = (
    "SELECT script_id, text, CASE WHEN script_id % 3 = 0 THEN 'pyspark' WHEN script_id % 3 = 1 THEN 'sql' ELSE 'other' END AS mode "
    f"FROM ({co.MIXED_SCRIPTS})"
)


@query(
    "SELECT script_id, CASE WHEN mode = 'pyspark' OR script_id < 0 THEN 'pyspark' ELSE 'sql' END AS mode "
    f"FROM ({_REQUESTED})"
)
def b2_effective_mode(spark, sf_dir):
    return redact_corpus(co.frame(spark, sf_dir, _REQUESTED)).redacted.select("script_id", "mode")


_GATED = (
    "SELECT o_orderkey AS script_id, CASE WHEN o_orderkey % 7 = 0 THEN ' ' || chr(10) || chr(160) "
    f"ELSE {co.order_script(co.ORDER_TABLE, co.PRIORITY_TABLE)} END AS text FROM orders"
)


@query(
    "SELECT o_orderkey AS script_id, CASE WHEN o_orderkey % 7 = 0 THEN 'blank' WHEN o_orderkey % 5 = 0 THEN 'typos' ELSE 'ok' END AS status, "
    "CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 THEN "
    f"{co.order_script(chr(39) + 'redacted.Table_1' + chr(39), chr(39) + 'redacted.Table_2' + chr(39))} END AS text FROM orders"
)
def b3_gates(spark, sf_dir):
    job = redact_corpus(co.frame(spark, sf_dir, _GATED), Options(on_typos="skip"))
    return job.redacted.select("script_id", "status", "text")


@query(oc.prose_refs(co.PROSE_SCRIPTS))
def b8_accepted_refs(spark, sf_dir):
    return _wide(rf.table_references(co.frame(spark, sf_dir, co.PROSE_SCRIPTS)))


# -- scalar functions ----------------------------------------------------------------------------

_SPELLINGS = (
    "SELECT o_orderkey AS script_id, 'Cat' || chr(9) || '. ' || chr(160) || '\"' || o_orderpriority || ' X\"' || chr(10) || '.[My ' || o_orderstatus || ']. ' "
    "|| 'T_' || CAST(o_custkey AS STRING) AS ref FROM orders"
)


@query(
    "SELECT o_orderkey AS script_id, 'cat.\"' || lower(o_orderpriority) || ' x\".[my ' || lower(o_orderstatus) || '].t_' || o_custkey AS canon FROM orders"
)
def c1_canonical_refs(spark, sf_dir):
    refs = co.frame(spark, sf_dir, _SPELLINGS)
    return refs.select("script_id", F.expr(tx.canonical_ref("ref")).alias("canon"))


_QUOTED_NAMES = (
    "SELECT c_custkey AS script_id, CASE c_custkey % 5 WHEN 0 THEN ' \"' || c_name || '\"' WHEN 1 THEN '`' || c_name || '`' || chr(10) "
    "WHEN 2 THEN '[' || c_name || ']' WHEN 3 THEN '[' || c_name || '\"' ELSE ' ' || c_name END AS name FROM customer"
)


@query(
    "SELECT c_custkey AS script_id, CASE WHEN c_custkey % 5 = 3 THEN '[' || c_name || '\"' ELSE c_name END AS name FROM customer"
)
def c3_unquoted_names(spark, sf_dir):
    names = co.frame(spark, sf_dir, _QUOTED_NAMES)
    return names.select("script_id", F.expr(tx.strip_identifier_quotes("name")).alias("name"))


@query(
    f"SELECT source, script_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM ({co.ALL_TEXTS})"
)
def c5_line_counts(spark, sf_dir):
    return _wide(ln.line_counts(co.frame(spark, sf_dir, co.ALL_TEXTS), ("source", "script_id")))


# -- references, findings, tokens and lines as rows ----------------------------------------------

_BATCH_REFS = f"""WITH {oc.BATCH_NUMBERS}
    SELECT script_id, pos, 'table' AS kind, ref, canon, true AS accepted FROM refs"""


@query(_BATCH_REFS)
def d1_refs(spark, sf_dir):
    scripts = co.batch_scripts(spark, sf_dir)
    return _wide(rf.table_references(scripts))


@query(oc.prose_refs(f"{co.PAGES} UNION ALL SELECT -1 - script_id, text FROM ({co.CONVERSATIONS})"))
def d1_refs_in_pages(spark, sf_dir):
    texts = co.frame(
        spark, sf_dir, f"{co.PAGES} UNION ALL SELECT -1 - script_id, text FROM ({co.CONVERSATIONS})"
    )
    return _wide(rf.table_references(texts))


_COLUMN_REFS = (
    "'f.id'",
    "'b.' || lower(o_orderstatus) || '_amt'",
    "'f.k'",
    "'b.k'",
    "'f.p'",
)


@query(
    " UNION ALL ".join(
        f"SELECT o_orderkey AS script_id, CAST({i} AS BIGINT) AS pos, 'column' AS kind, {ref} AS ref, {ref} AS canon, true AS accepted FROM orders"
        for i, ref in enumerate(_COLUMN_REFS, 1)
    )
)
def d2_column_refs(spark, sf_dir):
    redacted = _sql(spark, sf_dir).redacted
    return _wide(rf.column_references(redacted))


@query(
    " UNION ALL ".join(
        f"SELECT c_custkey AS script_id, CAST({i} AS BIGINT) AS pos, 'table' AS kind, {ref} AS ref, {ref} AS canon, {ok} AS accepted FROM customer"
        for i, ref, ok in (
            (1, co.PYSPARK_NAMES[0], "true"),
            (2, co.PYSPARK_NAMES[1], "true"),
            (3, "'tmp_view'", "false"),
            (4, co.PYSPARK_NAMES[2], "true"),
        )
    )
)
def d3_pyspark_refs(spark, sf_dir):
    scripts = co.frame(spark, sf_dir, co.PYSPARK_SCRIPTS).withColumn("mode", F.lit("pyspark"))
    return _wide(rf.table_references(scripts))


@query(
    "SELECT o_orderkey AS script_id, CAST(3 AS BIGINT) AS rule, CAST(3 AS BIGINT) AS line, 'LEFFT JOIN' AS found, 'LEFT JOIN' AS fix "
    "FROM orders WHERE o_orderkey % 5 = 0"
)
def d4_findings(spark, sf_dir):
    return _wide(_sql(spark, sf_dir).findings)


@query(oc.findings(co.MISSPELT_PROSE))
def d4_findings_in_prose(spark, sf_dir):
    return _wide(ty.typo_findings(co.frame(spark, sf_dir, co.MISSPELT_PROSE)))


_TOKENS = """WITH edits AS ({edited}),
    tokens AS (SELECT script_id, unnest(regexp_extract_all(text, '(?i)redacted\\.(?:Table|Col)_[0-9]+')) AS token,
                      unnest(range(1, len(regexp_extract_all(text, '(?i)redacted\\.(?:Table|Col)_[0-9]+')) + 1)) AS pos FROM edits)
    SELECT script_id, pos, token, CASE token WHEN 'redacted.Table_1' THEN {first} WHEN 'redacted.Table_2' THEN {second}
           ELSE 'No mapping found' END AS original FROM tokens JOIN orders ON o_orderkey = script_id"""


@query(_TOKENS.format(edited=co.EDITED_SCRIPTS, first=co.ORDER_TABLE, second=co.PRIORITY_TABLE))
def d5_tokens(spark, sf_dir):
    packed = _sql(spark, sf_dir).annotated
    return _wide(rs.annotate_tokens(co.frame(spark, sf_dir, co.EDITED_SCRIPTS), packed))


@query(
    "SELECT script_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text, "
    f"false AS has_typo FROM ({co.DOCUMENTS})"
)
def d6_lines(spark, sf_dir):
    return _wide(ln.numbered_lines(ty.with_findings(co.frame(spark, sf_dir, co.DOCUMENTS))))


@query(
    f"WITH found AS (SELECT DISTINCT script_id, line FROM ({oc.findings(co.MISSPELT_PROSE)})), "
    "l AS (SELECT script_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, "
    f"unnest(string_split(text, chr(10))) AS text FROM ({co.MISSPELT_PROSE})) "
    "SELECT l.script_id, l.line, text, found.line IS NOT NULL AS has_typo FROM l LEFT JOIN found USING (script_id, line)"
)
def d6_lines_with_typos(spark, sf_dir):
    return _wide(ln.numbered_lines(ty.with_findings(co.frame(spark, sf_dir, co.MISSPELT_PROSE))))


# -- dictionaries and summaries ------------------------------------------------------------------


@query(
    f"WITH {oc.BATCH_NUMBERS} SELECT script_id, 'redacted.Table_' || CAST(n AS VARCHAR) AS placeholder, 'table' AS kind, n, original, canon FROM numbers"
)
def e3_mapping_sql(spark, sf_dir):
    return _wide(_batches(spark, sf_dir).mapping)


@query(oc.prose_mapping(co.PROSE_SCRIPTS))
def e3_mapping_of_prose(spark, sf_dir):
    return _wide(redact_corpus(co.frame(spark, sf_dir, co.PROSE_SCRIPTS)).mapping)


_ORDER_ENTRIES = (
    (co.ORDER_TABLE, "Table", 1),
    (co.PRIORITY_TABLE, "Table", 2),
    *((ref, "Col", i) for i, ref in enumerate(_COLUMN_REFS, 1)),
)


@query(
    " UNION ALL ".join(
        f"SELECT o_orderkey AS script_id, 'redacted.{name}_{n}' AS placeholder, '{'table' if name == 'Table' else 'column'}' AS kind, "
        f"CAST({n} AS BIGINT) AS n, {ref} AS original, {ref} AS canon FROM orders"
        for ref, name, n in _ORDER_ENTRIES
    )
)
def e4_mapping_union(spark, sf_dir):
    """Tables of a run, columns of imported mappings."""
    pairs = " || ',' || ".join(f"'\"redacted.Col_{i}\":\"' || {ref} || '\"'" for i, ref in enumerate(_COLUMN_REFS, 1))
    files = co.frame(spark, sf_dir, f"SELECT o_orderkey AS script_id, '{{' || {pairs} || '}}' AS json FROM orders")
    union = mp.mapping_union(_sql(spark, sf_dir).mapping, imported_mapping(files))
    return _wide(mp.mapping_table(mp.pack_mapping(union)))


@query(oc.findings(co.MISSPELT_PROSE, lx.PANEL_FINDINGS))
def e5_findings_capped(spark, sf_dir):
    scripts = co.frame(spark, sf_dir, co.MISSPELT_PROSE)
    return _wide(ty.typo_findings(scripts, max_findings=lx.PANEL_FINDINGS))


@query(
    "SELECT o_orderkey AS script_id, "
    + " || chr(10) || ".join(f"'redacted.{name}_{n} -> ' || {ref}" for ref, name, n in _ORDER_ENTRIES)
    + " AS summary FROM orders"
)
def e7_mapping_summary(spark, sf_dir):
    return mp.mapping_summaries(_sql(spark, sf_dir, COLUMNS_ON).annotated)


@query(
    "SELECT o_orderkey AS script_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Potential SQL typos:' || chr(10) || '- line 3: LEFFT JOIN -> LEFT JOIN' "
    "ELSE 'No SQL typo warnings.' END AS summary FROM orders"
)
def e8_typo_summary(spark, sf_dir):
    return ty.typo_summaries(_sql(spark, sf_dir).annotated)


@query(f"SELECT DISTINCT script_id, line FROM ({oc.findings(co.MISSPELT_PROSE)})")
def e9_typo_lines(spark, sf_dir):
    scripts = ty.with_findings(co.frame(spark, sf_dir, co.MISSPELT_PROSE))
    return _wide(ty.typo_lines(scripts))


# -- rewrites ------------------------------------------------------------------------------------


def _placeholder(n: int, name: str = "Table") -> str:
    return f"'redacted.{name}_{n}'"


@query(
    f"SELECT o_orderkey AS script_id, {co.order_script(_placeholder(1), _placeholder(2))} AS text FROM orders"
)
def f1_redact_sql(spark, sf_dir):
    return _sql(spark, sf_dir).redacted.select("script_id", "text")


@query(oc.batch_texts("'redacted.Table_' || CAST({0}.n AS VARCHAR)"))
def f1_redact_batches(spark, sf_dir):
    return _batches(spark, sf_dir).redacted.select("script_id", "text")


@query(oc.prose_redacted(co.PROSE_SCRIPTS))
def f1_redact_prose(spark, sf_dir):
    job = redact_corpus(co.frame(spark, sf_dir, co.PROSE_SCRIPTS))
    return job.redacted.select("script_id", "text")


@query(
    "SELECT o_orderkey AS script_id, "
    + co.order_script(
        _placeholder(1), _placeholder(2), tuple(_placeholder(i, "Col") for i in range(1, 6))
    )
    + " AS text FROM orders"
)
def f2_redact_columns(spark, sf_dir):
    return _sql(spark, sf_dir, COLUMNS_ON).redacted.select("script_id", "text")


@query(oc.prose_columns(co.PROSE_SCRIPTS))
def f2_redact_columns_in_prose(spark, sf_dir):
    job = redact_corpus(co.frame(spark, sf_dir, co.PROSE_SCRIPTS), COLUMNS_ON)
    return job.redacted.select("script_id", "text")


_PYSPARK_REDACTED = (
    f"SELECT c_custkey AS script_id, {co.pyspark_script(*(_placeholder(i) for i in (1, 2, 3)))} AS text FROM customer"
)


@query(_PYSPARK_REDACTED)
def f3_redact_pyspark(spark, sf_dir):
    job = redact_corpus(co.frame(spark, sf_dir, co.PYSPARK_SCRIPTS), Options(mode="pyspark"))
    return job.redacted.select("script_id", "text")


@query(
    f"SELECT o_orderkey AS script_id, 'sql' AS mode, {co.order_script(_placeholder(1), _placeholder(2))} AS text FROM orders "
    f"UNION ALL SELECT -1 - script_id, 'pyspark', text FROM ({_PYSPARK_REDACTED})"
)
def f4_redact_mixed(spark, sf_dir):
    job = redact_corpus(co.frame(spark, sf_dir, co.MIXED_SCRIPTS))
    return job.redacted.select("script_id", "mode", "text")


@query(
    "SELECT o_orderkey AS script_id, CASE WHEN o_orderkey % 5 = 0 THEN 'fixed' ELSE 'no_typos' END AS status, "
    + co.order_script(co.ORDER_TABLE, co.PRIORITY_TABLE, join="'LEFT JOIN '")
    + " AS text, CAST(o_orderkey % 5 = 0 AS BIGINT) AS replacements FROM orders"
)
def f5_fix_typos(spark, sf_dir):
    return _wide(ty.fix_scripts(co.frame(spark, sf_dir, co.SQL_SCRIPTS)))


@query(oc.fixed(co.MISSPELT_PROSE))
def f5_fix_prose(spark, sf_dir):
    return _wide(ty.fix_scripts(co.frame(spark, sf_dir, co.MISSPELT_PROSE)))


@query(oc.batch_texts("{0}.original"))
def f6_restore_batches(spark, sf_dir):
    return rs.restore_with_entries(_batches(spark, sf_dir).annotated).select("script_id", "text")


@query(co.SQL_SCRIPTS)
def f6_restore_roundtrip(spark, sf_dir):
    return rs.restore_with_entries(_sql(spark, sf_dir, COLUMNS_ON).annotated).select("script_id", "text")


@query(oc.prose_restored(co.PROSE_SCRIPTS))
def f6_restore_prose(spark, sf_dir):
    job = redact_corpus(co.frame(spark, sf_dir, co.PROSE_SCRIPTS))
    return rs.restore_with_entries(job.annotated)


_RESTORED = (
    "replace(replace(replace(replace(text, 'redacted.Table_10', '?'), 'redacted.Table_1', "
    f"{co.ORDER_TABLE}), 'redacted.Table_2', {co.PRIORITY_TABLE}), '?', 'redacted.Table_10')"
)


@query(
    "SELECT script_id, CASE WHEN script_id % 10 = 3 THEN 'blank' ELSE 'ok' END AS status, "
    f"CASE WHEN script_id % 10 <> 3 THEN {_RESTORED} END AS text "
    f"FROM ({co.EDITED_SCRIPTS}) JOIN orders ON o_orderkey = script_id"
)
def f6_restore_edited(spark, sf_dir):
    job = _sql(spark, sf_dir)
    return restore_corpus(co.frame(spark, sf_dir, co.EDITED_SCRIPTS), job.annotated)


@query(
    "SELECT script_id, CASE WHEN script_id % 10 = 3 THEN 'blank' ELSE 'ok' END AS status, CASE WHEN script_id % 10 <> 3 THEN "
    "replace(replace(replace(text, 'redacted.Table_10', '?'), 'redacted.Table_1', (SELECT 'cat.s_' || s_nationkey FROM supplier WHERE s_suppkey = 1)), "
    f"'?', 'redacted.Table_10') END AS text FROM ({co.EDITED_SCRIPTS})"
)
def p4_one_mapping_for_all(spark, sf_dir):
    """An imported mapping applied to all edits."""
    imported = import_mapping(co.frame(spark, sf_dir, co.MAPPING_FILES).filter("script_id = 1"))
    return rs.restore_all_with(co.frame(spark, sf_dir, co.EDITED_SCRIPTS), imported)


# -- jobs ----------------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey AS script_id, 'sql' AS mode, 'ok' AS status, CAST(7 AS BIGINT) AS entries, CAST(o_orderkey % 5 = 0 AS BIGINT) AS findings, "
    + co.order_script(
        _placeholder(1), _placeholder(2), tuple(_placeholder(i, "Col") for i in range(1, 6))
    )
    + " AS text FROM orders"
)
def p1_redact_job(spark, sf_dir):
    rows = _sql(spark, sf_dir, COLUMNS_ON).annotated
    return rows.select(
        "script_id",
        "mode",
        "status",
        F.size("entries").cast("bigint").alias("entries"),
        F.size("findings").cast("bigint").alias("findings"),
        "text",
    )


@query(
    "SELECT file_id, script_id, part, CASE WHEN part % 3 = 0 THEN 'blank' WHEN file_id % 5 IN (1, 3) THEN 'ok' ELSE 'no_mapping' END AS status, "
    "CASE WHEN part % 3 = 0 THEN NULL WHEN file_id % 5 = 1 THEN 'DELETE FROM cat.s_' || s_nationkey || ' -- ' || part || ', redacted.Table_2' "
    "WHEN file_id % 5 = 3 THEN 'DELETE FROM redacted.Table_1 -- ' || part || ',  Q.r' END AS text "
    "FROM (SELECT l_suppkey AS file_id, l_orderkey AS script_id, l_linenumber AS part FROM lineitem) JOIN supplier ON s_suppkey = file_id"
)
def p2_restore_status(spark, sf_dir):
    """Many edits per imported mapping: one edit per line item, one mapping file per supplier."""
    edits = co.frame(
        spark,
        sf_dir,
        "SELECT l_suppkey AS file_id, l_orderkey AS script_id, l_linenumber AS part, CASE WHEN l_linenumber % 3 = 0 THEN chr(9) "
        "ELSE 'DELETE FROM redacted.Table_1 -- ' || CAST(l_linenumber AS STRING) || ', redacted.Table_2' END AS text FROM lineitem",
    )
    files = co.frame(spark, sf_dir, co.MAPPING_FILES).withColumnRenamed("script_id", "file_id")
    packed = import_mapping(files, ("file_id",))
    edited = rs.with_entries(edits, packed, ("file_id",))
    return _wide(rs.restore_with_entries(edited, ("file_id", "script_id", "part")))


@query(
    f"WITH f AS ({oc.fixed(co.MISSPELT_PROSE)}), g AS (SELECT script_id, count(*) AS n FROM ({oc.findings('SELECT script_id, text FROM f')}) GROUP BY script_id) "
    "SELECT script_id, status, text, replacements, CAST(coalesce(n, 0) AS BIGINT) AS findings_after FROM f LEFT JOIN g USING (script_id)"
)
def p3_fix_job(spark, sf_dir):
    """Repaired texts, and how many misspellings the second check finds in them."""
    fixed = fix_corpus(co.frame(spark, sf_dir, co.MISSPELT_PROSE))
    return _wide(fixed.select("script_id", "status", "text", "replacements", F.size("findings").alias("findings_after")))


_SAVED = "SELECT l_suppkey AS run_id, CASE l_linenumber WHEN 1 THEN 'scripts' WHEN 2 THEN 'annotated' WHEN 3 THEN 'edited' ELSE 'restored' END AS tab, l_orderkey FROM lineitem"


@query(
    f"SELECT run_id, tab AS \"table\", 'a' || run_id AS attempt, CASE WHEN run_id % 3 = 1 AND tab = 'edited' THEN n - 1 ELSE n END AS rows, "
    "CASE WHEN run_id % 5 = 0 THEN 'unfinished' WHEN run_id % 3 = 1 AND tab = 'edited' THEN 'damaged' ELSE 'whole' END AS status "
    f"FROM (SELECT run_id, tab, count(*) AS n FROM ({_SAVED}) GROUP BY run_id, tab)"
)
def a5_whole_runs(spark, sf_dir):
    """Manifests of runs against what is there: some saves never ended, some tables have lost a row."""
    items = co.frame(spark, sf_dir, _SAVED).withColumnRenamed("tab", "table").withColumn("attempt", F.concat(F.lit("a"), F.col("run_id").cast("string")))
    counts = items.groupBy("run_id", "table", "attempt").agg(F.count("*").alias("rows"))
    lost = F.when(F.expr("run_id % 3 = 1 AND table = 'edited'"), 1).otherwise(0)
    return whole_tables(counts.filter("run_id % 5 <> 0"), counts.withColumn("rows", F.col("rows") - lost))


# -- views of a corpus ---------------------------------------------------------------------------


@query(
    "SELECT name AS canon, count(DISTINCT o_orderkey) AS scripts, count(*) AS refs FROM ("
    f"SELECT o_orderkey, {co.ORDER_TABLE} AS name FROM orders UNION ALL SELECT o_orderkey, {co.PRIORITY_TABLE} FROM orders) GROUP BY name"
)
def x1_table_usage(spark, sf_dir):
    return au.table_usage(co.frame(spark, sf_dir, co.SQL_SCRIPTS))


@query(
    f"SELECT rule, fix, count(DISTINCT script_id) AS scripts, count(*) AS findings FROM ({oc.findings(co.MISSPELT_PROSE)}) GROUP BY rule, fix"
)
def x2_typo_rollup(spark, sf_dir):
    return _wide(au.typo_rollup(ty.typo_findings(co.frame(spark, sf_dir, co.MISSPELT_PROSE))))


# What the rules leave: the second table of a list, USING, CREATE TABLE, strings; and a table named in full nowhere else.
_LEAKY = (
    f"SELECT o_orderkey AS script_id, 'SELECT 1 FROM ' || {co.ORDER_TABLE} || ' x, ' || upper({co.ORDER_TABLE}) || ' y;' || chr(10) "
    f"|| 'MERGE INTO ' || {co.PRIORITY_TABLE} || ' t USING ' || {co.ORDER_TABLE} || ' s ON 1 = 1;' || chr(10) "
    f"|| CASE WHEN o_orderkey % 3 = 0 THEN 'CREATE TABLE ' || {co.PRIORITY_TABLE} || ' (k INT);' "
    f"WHEN o_orderkey % 3 = 1 THEN 'spark.sql(\"SELECT 1 AS ' || {co.PRIORITY_TABLE} || '\")' ELSE 'SELECT other.name' END AS text FROM orders"
)


@query(
    f"SELECT o_orderkey AS script_id, 'table' AS kind, {co.ORDER_TABLE} AS canon, CAST(2 AS BIGINT) AS times FROM orders "
    f"UNION ALL SELECT o_orderkey, 'table', {co.PRIORITY_TABLE}, 1 FROM orders WHERE o_orderkey % 3 < 2"
)
def x3_leak_audit(spark, sf_dir):
    return au.leak_audit(redact_corpus(co.frame(spark, sf_dir, _LEAKY)).annotated)


# Every script names two tables of other scripts in a comment: one in a longer path, one in capitals and spaced, and one that no script has.
_ELSEWHERE = "'cat_' || CAST((o_custkey + 1) % 7 AS STRING) || '.silver.ord_' || CAST((o_orderkey + 3) % 11 AS STRING)"
_OTHER_PRIORITY = "'ref.prio_' || CASE WHEN o_orderkey % 2 = 0 THEN '1_urgent' ELSE '9_none' END"
_CROSS = (
    f"SELECT o_orderkey AS script_id, {co.order_script(co.ORDER_TABLE, co.PRIORITY_TABLE)} || ' -- like ' || {_ELSEWHERE} || '.id or ' "
    f"|| upper(replace({_OTHER_PRIORITY}, '.', ' . ')) || ', not silver.ord_1' AS text FROM orders"
)


@query(
    f"WITH names AS (SELECT {co.ORDER_TABLE} AS canon FROM orders UNION SELECT {co.PRIORITY_TABLE} FROM orders) "
    "SELECT script_id, 'table' AS kind, canon, CAST(count(*) AS BIGINT) AS times FROM ("
    f"SELECT o_orderkey AS script_id, {_ELSEWHERE} AS canon FROM orders UNION ALL SELECT o_orderkey, {_OTHER_PRIORITY} FROM orders) JOIN names USING (canon) GROUP BY ALL"
)
def x3_leak_audit_corpus(spark, sf_dir):
    """Names that another script has redacted and that this one still holds."""
    annotated = redact_corpus(co.frame(spark, sf_dir, _CROSS)).annotated
    return au.leak_audit_corpus(annotated, mp.mapping_table(annotated))


@query(
    "SELECT o_orderkey AS script_id, CAST(2 AS BIGINT) AS expected, "
    "CAST(CASE o_orderkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 2 END AS BIGINT) AS found, "
    "CAST(CASE o_orderkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 0 END AS BIGINT) AS missing, "
    "CAST(CASE WHEN o_orderkey % 10 IN (1, 2) THEN 1 ELSE 0 END AS BIGINT) AS unknown FROM orders"
)
def x4_restore_coverage(spark, sf_dir):
    return au.restore_coverage(co.frame(spark, sf_dir, co.EDITED_SCRIPTS), _sql(spark, sf_dir).annotated)


_NAMES = (
    f"SELECT canon, row_number() OVER (ORDER BY substr(md5(canon), 1, 2), canon) AS n FROM "
    f"(SELECT {co.ORDER_TABLE} AS canon FROM orders UNION SELECT {co.PRIORITY_TABLE} FROM orders)"
)


# Some scripts bring placeholders along: numbers in between, a long run of them, and one that is no number of ours.
_LITERAL = (
    "CASE WHEN o_orderkey % 11 = 0 THEN ' -- was redacted.Table_' || CAST(o_custkey % 40 * 2 + 1 AS STRING) "
    "WHEN o_orderkey % 11 = 1 THEN ' -- not redacted.Table_' || CAST(30 + o_custkey % 25 AS STRING) || ', redacted.Table_02 or redacted.Table_99999999999999999999' ELSE '' END"
)
_LITERAL_SCRIPTS = f"SELECT o_orderkey AS script_id, {co.order_script(co.ORDER_TABLE, co.PRIORITY_TABLE)} || {_LITERAL} AS text FROM orders"
_FIRST_RUN = "o_orderkey % 11 < 5"


def _free(taken_where: str, above: str = "0") -> str:
    """DuckDB text: the numbers above ``above`` that no script holds, ranked."""
    taken = f"SELECT CASE o_orderkey % 11 WHEN 0 THEN o_custkey % 40 * 2 + 1 ELSE 30 + o_custkey % 25 END FROM orders WHERE o_orderkey % 11 < 2 AND {taken_where}"
    return f"SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT unnest(range(1, 2000)) AS n) WHERE n > {above} AND n NOT IN ({taken})"


_AROUND = f"SELECT canon, f.n FROM ({_NAMES}) a JOIN ({_free('true')}) f ON f.k = a.n"


@query(
    f"WITH names AS ({_AROUND}) SELECT o_orderkey AS script_id, "
    + co.order_script("'redacted.Table_' || a.n", "'redacted.Table_' || b.n")
    + f" || {_LITERAL} AS text FROM orders JOIN names a ON a.canon = {co.ORDER_TABLE} JOIN names b ON b.canon = {co.PRIORITY_TABLE}"
)
def x5_corpus_redact(spark, sf_dir):
    """One dictionary around the placeholders that some scripts bring along."""
    scripts = co.frame(spark, sf_dir, _LITERAL_SCRIPTS)
    job = redact_corpus(scripts)
    dictionary = cp.corpus_dictionary(job.mapping, taken=cp.taken_numbers(scripts))
    return cp.redact_annotated_with_dictionary(job.annotated, dictionary)


@query(
    f"WITH old AS (SELECT DISTINCT canon FROM (SELECT {co.ORDER_TABLE} AS canon FROM orders WHERE {_FIRST_RUN} UNION SELECT {co.PRIORITY_TABLE} FROM orders WHERE {_FIRST_RUN})), "
    f"one AS (SELECT canon, f.n FROM (SELECT canon, row_number() OVER (ORDER BY substr(md5(canon), 1, 2), canon) AS k FROM old) JOIN ({_free(_FIRST_RUN)}) f USING (k)), "
    f"new AS (SELECT canon FROM ({_NAMES}) WHERE canon NOT IN (SELECT canon FROM old)), "
    f"two AS (SELECT canon, f.n FROM (SELECT canon, row_number() OVER (ORDER BY substr(md5(canon), 1, 2), canon) AS k FROM new) JOIN ({_free('true', '(SELECT max(n) FROM one)')}) f USING (k)) "
    "SELECT 'table' AS kind, canon, canon AS original, n, 'redacted.Table_' || n AS placeholder, CAST(version AS BIGINT) AS version "
    "FROM (SELECT *, 1 AS version FROM one UNION ALL SELECT *, 2 FROM two)"
)
def x5_dictionary_grows(spark, sf_dir):
    """A first run over part of the scripts, a second one over all: no number of the first changes."""
    scripts = co.frame(spark, sf_dir, _LITERAL_SCRIPTS)
    early = scripts.filter("script_id % 11 < 5")
    one = computed_once(cp.corpus_dictionary(redact_corpus(early).mapping, taken=cp.taken_numbers(early)), "dictionary-1")
    two = cp.grow_dictionary(one, redact_corpus(scripts).mapping, taken=cp.taken_numbers(scripts))
    return one.withColumn("version", F.lit(1).cast("bigint")).unionByName(two.withColumn("version", F.lit(2).cast("bigint")))


@query(f"SELECT 'table' AS kind, canon, canon AS original, n, 'redacted.Table_' || n AS placeholder FROM ({_NAMES})")
def x5_corpus_dictionary(spark, sf_dir):
    return cp.corpus_dictionary(_sql(spark, sf_dir).mapping)


def _before(scripts: DataFrame) -> DataFrame:
    """The scripts as an earlier run had them: some missing, some with another text, some that are gone now."""
    earlier = scripts.filter("script_id % 7 <> 1").withColumn(
        "text", F.when(F.expr("script_id % 3 = 0"), F.concat("text", F.lit(" -- old"))).otherwise(F.col("text"))
    )
    return earlier.unionByName(scripts.filter("script_id % 5 = 2").withColumn("script_id", F.expr("-script_id")))


@query(f"SELECT script_id, text FROM ({co.SQL_SCRIPTS}) WHERE script_id % 3 = 0 OR script_id % 7 = 1")
def x6_incremental(spark, sf_dir):
    scripts = co.frame(spark, sf_dir, co.SQL_SCRIPTS)
    return inc.changed_scripts(scripts, inc.script_hashes(_before(scripts)))


@query("SELECT -o_orderkey AS script_id FROM orders WHERE o_orderkey % 5 = 2")
def x6_removed(spark, sf_dir):
    scripts = co.frame(spark, sf_dir, co.SQL_SCRIPTS)
    return inc.removed_scripts(scripts, inc.script_hashes(_before(scripts)))


_THREE_RUNS = (
    f"SELECT 1 AS run, script_id, text FROM ({co.SQL_SCRIPTS}) "
    f"UNION ALL SELECT 2, script_id, text || ' -- second' FROM ({co.SQL_SCRIPTS}) WHERE script_id % 3 = 0 "
    f"UNION ALL SELECT 3, script_id, text || ' -- third' FROM ({co.SQL_SCRIPTS}) WHERE script_id % 4 = 0"
)


@query(
    "SELECT script_id, CAST(max(run) AS BIGINT) AS run, CASE WHEN max(run) = 1 THEN any_value(base) WHEN max(run) = 2 THEN any_value(base) || ' -- second' ELSE any_value(base) || ' -- third' END AS text "
    f"FROM (SELECT t.*, b.text AS base FROM ({_THREE_RUNS}) t JOIN ({co.SQL_SCRIPTS}) b USING (script_id)) GROUP BY script_id "
    "HAVING script_id % 10 <> 7 OR max(run) >= 2"
)
def x6_current_view(spark, sf_dir):
    """Three runs, the later two with what had changed; the second found some scripts gone."""
    versions = co.frame(spark, sf_dir, _THREE_RUNS)
    gone = versions.filter("run = 1 AND script_id % 10 = 7").select("script_id", F.lit(2).alias("run"))
    return _wide(inc.current_view(versions, "run", removed=gone))


@query(
    "SELECT name AS canon, count(DISTINCT o_orderkey) AS scripts, count(*) AS refs FROM ("
    f"SELECT o_orderkey, {co.ORDER_TABLE} AS name FROM orders UNION ALL SELECT o_orderkey, {co.PRIORITY_TABLE} FROM orders "
    f"UNION ALL SELECT o_orderkey, {co.ORDER_TABLE} FROM orders WHERE o_orderkey % 3 = 0) GROUP BY name"
)
def x1_usage_delta(spark, sf_dir):
    """Table usage after some scripts changed, from the usage before and those scripts alone."""
    scripts = co.frame(spark, sf_dir, co.SQL_SCRIPTS)
    before = scripts.withColumn("text", F.when(F.expr("script_id % 3 = 0"), F.lit("SELECT 1 FROM gone.t x JOIN gone.t y ON 1 = 1")).otherwise(F.col("text")))
    again = f"SELECT o_orderkey AS script_id, {co.order_script(co.ORDER_TABLE, co.PRIORITY_TABLE)} || chr(10) || 'SELECT 1 FROM ' || {co.ORDER_TABLE} || ' z' AS text FROM orders"
    after = co.frame(spark, sf_dir, again).withColumn("kept", F.expr("script_id % 3 = 0"))
    after = after.filter("kept").drop("kept").unionByName(scripts.filter("script_id % 3 <> 0"))
    changed = inc.changed_scripts(after, inc.script_hashes(before))
    old = before.join(changed.select("script_id"), "script_id", "left_semi")
    counts = ("scripts", "refs")
    return inc.usage_delta(au.table_usage(before), au.table_usage(old), au.table_usage(changed), ("canon",), counts)


@query(f"SELECT rule, fix, count(DISTINCT script_id) AS scripts, count(*) AS findings FROM ({oc.findings(co.MISSPELT_PROSE)}) GROUP BY rule, fix")
def x2_rollup_delta(spark, sf_dir):
    """The roll-up of misspellings after some documents changed."""
    scripts = co.frame(spark, sf_dir, co.MISSPELT_PROSE)
    before = scripts.withColumn("text", F.when(F.expr("script_id % 4 = 1"), F.lit("SELECT 1 FROMM a.b INTOO c")).otherwise(F.col("text")))
    changed = inc.changed_scripts(scripts, inc.script_hashes(before))
    old = before.join(changed.select("script_id"), "script_id", "left_semi")
    rollup = [au.typo_rollup(ty.typo_findings(s)) for s in (before, old, changed)]
    return _wide(inc.usage_delta(*rollup, ("rule", "fix"), ("scripts", "findings")))


# -- names the rules must not cut or overlook ----------------------------------------------------

_DEEP = "'srv_' || CAST(o_custkey % 5 AS STRING) || '.db.cat.sch.t_' || CAST(o_orderkey % 9 AS STRING)"


@query(
    "SELECT o_orderkey AS script_id, 'SELECT 1 FROM redacted.Table_1 x JOIN redacted.Table_1 y ON 1 = 1' AS text FROM orders"
)
def f1_redact_deep_names(spark, sf_dir):
    """Names of five parts, spelled in two ways."""
    deep = f"SELECT o_orderkey AS script_id, 'SELECT 1 FROM ' || {_DEEP} || ' x JOIN ' || upper(replace({_DEEP}, '.', ' . ')) || ' y ON 1 = 1' AS text FROM orders"
    return redact_corpus(co.frame(spark, sf_dir, deep)).redacted.select("script_id", "text")


_GAP = "SELECT o_orderkey AS script_id, 'CREATE TABLE' || repeat(' ', CAST(o_orderkey % 90 + 1 AS INT)) || 'q.r AS SELECT f.id FROM a.b f' AS text FROM orders"


@query(
    "SELECT o_orderkey AS script_id, 'CREATE TABLE' || repeat(' ', CAST(o_orderkey % 90 + 1 AS INT)) || 'q.r AS SELECT redacted.Col_1 FROM redacted.Table_1 f' AS text FROM orders"
)
def f2_redact_wide_gaps(spark, sf_dir):
    """A table keyword protects the pair after it however much white space is between."""
    return redact_corpus(co.frame(spark, sf_dir, _GAP), COLUMNS_ON).redacted.select("script_id", "text")


_IMPORTS = "SELECT c_custkey AS script_id, 'from pkg_' || CAST(c_nationkey AS STRING) || '.mod import x' || chr(10) || 'FROM lib.t' || CAST(c_custkey % 5 AS STRING) AS text FROM customer"


@query(
    "SELECT c_custkey AS script_id, 'from pkg_' || CAST(c_nationkey AS STRING) || '.mod import x' || chr(10) || 'FROM redacted.Table_1' AS text FROM customer"
)
def b9_import_guard(spark, sf_dir):
    return redact_corpus(co.frame(spark, sf_dir, _IMPORTS)).redacted.select("script_id", "text")


_GUARDED = (
    "'/* FROM a.b' || chr(10) || ' JOIN c.d */ SELECT `FROM x.y`, [JOIN p.q], ''FROM in k.l'', \"UPDATE z.z\" -- FROM e.f' || chr(10) "
    "|| 'FROM ' || {name} || ' x /* FROM never.closed'"
)


@query(
    f"SELECT c_custkey AS script_id, {_GUARDED.format(name=chr(39) + 'redacted.Table_1' + chr(39))} AS text FROM customer"
)
def b10_protected(spark, sf_dir):
    name = "'cat.seg_' || lower(c_mktsegment)"
    scripts = co.frame(spark, sf_dir, f"SELECT c_custkey AS script_id, {_GUARDED.format(name=name)} AS text FROM customer")
    return redact_corpus(scripts).redacted.select("script_id", "text")


@query(
    "WITH r AS (SELECT l_suppkey AS script_id, l_partkey, l_orderkey, l_linenumber FROM lineitem), "
    "o AS (SELECT script_id, 'wh.p' || l_partkey AS canon, row_number() OVER (PARTITION BY script_id ORDER BY l_orderkey, l_linenumber, l_partkey) AS i FROM r), "
    "f AS (SELECT script_id, canon, min(i) AS first FROM o GROUP BY ALL) "
    "SELECT script_id, 'redacted.Table_' || n AS placeholder, 'table' AS kind, n, canon AS original, canon FROM "
    "(SELECT script_id, canon, row_number() OVER (PARTITION BY script_id ORDER BY first) AS n FROM f)"
)
def e1_many_names(spark, sf_dir):
    """One script per supplier with all parts it delivers: hundreds of names each, more than linear search takes."""
    items = (
        "SELECT l_suppkey AS script_id, sort_array(collect_list(struct(l_orderkey, l_linenumber, l_partkey))) AS items "
        "FROM lineitem GROUP BY l_suppkey"
    )
    scripts = co.frame(spark, sf_dir, items, deal_out=False).selectExpr(
        "script_id", "array_join(transform(items, i -> 'SELECT 1 FROM wh.p' || i.l_partkey || ';'), chr(10)) AS text"
    )
    return _wide(redact_corpus(scripts).mapping)


# Cases in which a simpler way of replacing goes wrong: script and what it must become, {k} being the customer's number.
_DEFECTS = (
    ("from f where x = {k}", "from redacted.Table_1 where x = {k}"),
    ("SELECT 1 FROM [p$&$1 $$ {k}] x", "SELECT 1 FROM redacted.Table_1 x"),
    ("-- rows come from\nFROM a.b{k}", "-- rows come from\nFROM redacted.Table_1"),
    ("SELECT 1 FROM redacted.Table_1 JOIN seg.t{k} ON 1 = 1", "SELECT 1 FROM redacted.Table_1 JOIN redacted.Table_2 ON 1 = 1"),
    ("SELECT 1 FROM [my t{k}] JOIN [myt{k}] ON 1 = 1", "SELECT 1 FROM redacted.Table_1 JOIN redacted.Table_2 ON 1 = 1"),
    ("SELECT {k} FROM constructor JOIN s.__proto__ p ON 1 = 1", "SELECT {k} FROM redacted.Table_1 JOIN redacted.Table_2 p ON 1 = 1"),
    ("SELECT 1 FROM [redacted.Table_2] JOIN c.d{k} ON 1 = 1", "SELECT 1 FROM redacted.Table_1 JOIN redacted.Table_3 ON 1 = 1"),
    ('SELECT 1 FROM "a""b{k}" x WHERE 1 = 1', "SELECT 1 FROM redacted.Table_1 x WHERE 1 = 1"),
)


def _defects(column: int, name: str) -> str:
    """SQL text of one row per customer and case."""

    def text(case: str) -> str:
        return "'" + case.replace("\n", "' || chr(10) || '").replace("{k}", "' || CAST(c_custkey AS STRING) || '") + "'"

    return " UNION ALL ".join(f"SELECT c_custkey * 10 + {i} AS script_id, {text(case[column])} AS {name} FROM customer" for i, case in enumerate(_DEFECTS))


@query(f"SELECT script_id, text, restored FROM ({_defects(1, 'text')}) JOIN ({_defects(0, 'restored')}) USING (script_id)")
def q_defects(spark, sf_dir):
    """Names inside other words, `$` in names, keywords that end comments, literal placeholders, white space in quotes, names of object
    members, originals that look like placeholders, doubled quotes: redacted and restored."""
    job = redact_corpus(co.frame(spark, sf_dir, _defects(0, "text")))
    restored = rs.restore_with_entries(job.annotated).select("script_id", F.col("text").alias("restored"))
    return job.redacted.select("script_id", "text").join(restored, "script_id")
