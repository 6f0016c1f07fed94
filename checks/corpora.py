"""Script corpora as SQL text over the given tables.

Each text runs unchanged in Spark and DuckDB and covers every row of its table, so a query and its
oracle start from the same scripts. Table names stand alone after FROM; ``frame`` points them at files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from refmask.sources.scripts import spread

VIEW_PREFIX = "refmask_checks_"
TABLES = "orders lineitem customer supplier documents pages conversations benchmark".split()

# One script per order. The names of its two tables are the parameters of the template.
ORDER_TABLE = "'cat_' || CAST(o_custkey % 7 AS STRING) || '.silver.ord_' || CAST(o_orderkey % 11 AS STRING)"
PRIORITY_TABLE = "'ref.prio_' || lower(replace(replace(o_orderpriority, '-', '_'), ' ', '_'))"


def order_script(first: str, second: str, columns=("'f.id'", None, "'f.k'", "'b.k'", "'f.p'"), join=None):
    """The order template with its two tables and five columns as SQL expressions."""
    amount = columns[1] or "'b.' || lower(o_orderstatus) || '_amt'"
    join = join or "CASE WHEN o_orderkey % 5 = 0 THEN 'LEFFT JOIN ' ELSE 'LEFT JOIN ' END"
    return (
        f"'SELECT ' || {columns[0]} || ', ' || {amount} || chr(10) || 'FROM ' || {first} || ' AS f' || chr(10) "
        f"|| {join} || {second} || ' b ON ' || {columns[2]} || ' = ' || {columns[3]} || chr(10) "
        f"|| 'WHERE ' || {columns[4]} || ' > ' || CAST(o_custkey AS STRING) || ';'"
    )


SQL_SCRIPTS = (
    f"SELECT o_orderkey AS script_id, {order_script(ORDER_TABLE, PRIORITY_TABLE)} AS text FROM orders"
)

# One script per order with one statement per line item: one to many references, the same table
# spelled in different ways, decoys in comments and strings.
def line_tables(row: str) -> tuple[str, str]:
    """Source and target table of the line item ``row``."""
    name = f"'wh_' || CAST({row}.l_suppkey % 3 AS STRING) || '.Stage.part_' || CAST({row}.l_partkey % 4 AS STRING)"
    spelled = f"CASE WHEN {row}.l_linenumber % 2 = 0 THEN upper({name}) ELSE replace({name}, '.', ' . ') END"
    return spelled, f"'mart_' || CAST({row}.l_suppkey % 5 AS STRING)"


def line_statement(source: str, target: str, part: str) -> str:
    return (
        f"'INSERT INTO ' || {target} || ' SET q = ''from x.y'' -- was from old.t' || chr(10) "
        f"|| 'SELECT p.q FROM ' || {source} || ' p WHERE p.k = ' || CAST({part} AS STRING) || ';'"
    )


LINE_ITEMS = (
    "SELECT l_orderkey AS script_id, sort_array(collect_list(struct(l_linenumber, l_partkey, l_suppkey))) AS items "
    "FROM lineitem GROUP BY l_orderkey"
)


def batch_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = f"transform(items, s -> {line_statement(*line_tables('s'), 's.l_partkey')})"
    # Grouping deals the rows out; the input needs no exchange of its own.
    orders = frame(spark, sf_dir, LINE_ITEMS, deal_out=False)
    return orders.selectExpr("script_id", f"array_join({statements}, chr(10)) AS text")


PYSPARK_NAMES = (
    "'cat_' || CAST(c_nationkey AS STRING) || '.silver.cust'",
    "'ref.seg_' || lower(c_mktsegment)",
    "'mart.out_' || CAST(c_custkey % 13 AS STRING)",
)


def pyspark_script(first: str, second: str, third: str) -> str:
    return (
        f"'df = spark.table(\"' || {first} || '\")' || chr(10) "
        f"|| 'dim = spark . read.table( \"' || {second} || '\")' || chr(10) "
        "|| 'local = spark.table(\"tmp_view\")  # FROM a.b' || chr(10) "
        f"|| 'df.join(dim, \"k\").write.mode(\"overwrite\").saveAsTable(''' || {third} || ''')'"
    )


PYSPARK_SCRIPTS = (
    f"SELECT c_custkey AS script_id, {pyspark_script(*PYSPARK_NAMES)} AS text FROM customer"
)
# Both kinds, all handed in as SQL; keys of customers are made negative to keep them apart.
MIXED_SCRIPTS = (
    f"SELECT script_id, text FROM ({SQL_SCRIPTS}) "
    f"UNION ALL SELECT -1 - script_id AS script_id, text FROM ({PYSPARK_SCRIPTS})"
)

EDITED_SCRIPTS = (
    "SELECT o_orderkey AS script_id, "
    "CASE WHEN o_orderkey % 10 = 0 THEN 'SELECT 1 FROM redacted.Table_1 x' "
    "WHEN o_orderkey % 10 = 1 THEN 'SELECT 1 FROM redacted.Table_1 JOIN redacted.Table_10 ON 1=1' "
    "WHEN o_orderkey % 10 = 2 THEN 'SELECT 1 FROM REDACTED.TABLE_2' "
    "WHEN o_orderkey % 10 = 3 THEN ' ' || chr(10) "
    "ELSE 'SELECT count(*) FROM redacted.Table_2 b JOIN redacted.Table_1 f ON f.k = b.k -- redacted.Table_1' END AS text "
    "FROM orders"
)

MAPPING_FILES = (
    "SELECT s_suppkey AS script_id, "
    "CASE WHEN s_suppkey % 5 = 0 THEN '[1,2]' "
    "WHEN s_suppkey % 5 = 1 THEN '{\"redacted.Table_1\":\"cat.s_' || CAST(s_nationkey AS STRING) || '\",\"redacted.Col_1\":7,\"other\":\"x\"}' "
    "WHEN s_suppkey % 5 = 2 THEN '{\"redacted.Table_1\":\"  \"}' "
    "WHEN s_suppkey % 5 = 3 THEN '{\"redacted.Col_2\":\"a.' || lower(s_name) || '\",\"redacted.Table_2\":\"q\",\"redacted.Table_2\":\" Q.r\"}' "
    "ELSE '{bad' END AS json FROM supplier"
)

# Saved settings, some of them unusable.
SAVED_OPTIONS = (
    "SELECT s_suppkey AS script_id, "
    "CASE WHEN s_suppkey % 4 = 0 THEN '{\"mode\":\"pyspark\",\"redact_columns\":false}' "
    "WHEN s_suppkey % 4 = 1 THEN '{\"mode\":\"' || lower(s_name) || '\",\"redact_columns\":true}' "
    "WHEN s_suppkey % 4 = 2 THEN '{}' ELSE '{bad' END AS value FROM supplier"
)

# The texts as they are: prose, and web pages full of double quotes.
DOCUMENTS = "SELECT doc_id AS script_id, text FROM documents"
PAGES = "SELECT page_id AS script_id, html AS text FROM pages"
CONVERSATIONS = "SELECT conv_id * 100000 + turn AS script_id, text FROM conversations"
BENCHMARK = "SELECT item_id AS script_id, text FROM benchmark"
ALL_TEXTS = " UNION ALL ".join(
    f"SELECT '{name}' AS source, script_id, text FROM ({corpus})"
    for name, corpus in (
        ("documents", DOCUMENTS),
        ("pages", PAGES),
        ("conversations", CONVERSATIONS),
        ("benchmark", BENCHMARK),
        ("sql", SQL_SCRIPTS),
        ("pyspark", PYSPARK_SCRIPTS),
    )
)
# Every sentence end of the documents becomes a table reference: up to thousands per script.
PROSE_SCRIPTS = (
    "SELECT doc_id AS script_id, replace(text, '. ', ' FROM Lake.' || lang || '.T_' || CAST(n_chars % 7 AS STRING) "
    "|| ' x JOIN \"' || source || ' d\" ON x.' || lang || ' = y . k WHERE ') AS text FROM documents"
)
# Every comma becomes a misspelled keyword.
MISSPELT_PROSE = (
    "SELECT doc_id AS script_id, replace(replace(replace(text, ', ', ' FROMM '), '. ', chr(10) || 'merge' || chr(10) || 'intoo '), "
    "' de ', ' Delet frmo ') AS text FROM documents"
)


def frame(spark: SparkSession, sf_dir: str, corpus: str, deal_out: bool = True) -> DataFrame:
    """``corpus`` as a DataFrame over the Parquet files in ``sf_dir``, which have one row group each."""
    used = set(re.findall(rf"\bFROM ({'|'.join(TABLES)})\b", corpus))
    for name in used:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if deal_out:
            table = spread(table, spark.sparkContext.defaultParallelism)
        table.createOrReplaceTempView(f"{VIEW_PREFIX}{name}")
    query = re.sub(rf"\bFROM ({'|'.join(used)})\b", rf"FROM {VIEW_PREFIX}\1", corpus)
    scripts = spark.sql(query)
    for name in used:
        spark.catalog.dropTempView(f"{VIEW_PREFIX}{name}")
    return scripts
