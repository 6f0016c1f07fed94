"""Mappings as JSON objects ``{placeholder: original}``, one per script."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refmask.functions import text as tx
from refmask.functions.arrays import first_seen
from refmask.functions.redact import ENTRIES_TYPE
from refmask.functions.sqltext import empty, keep_if, let, struct, transform, when
from refmask.operators.rows import explode_rows
from refmask.schema import KEYS
from refmask.sources.scripts import path_below

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def read_mapping_files(spark: SparkSession, root: str) -> DataFrame:
    """``script_id, json``: one mapping per file below ``root``.

    The key is the value of the file's ``script_id=`` folder, as ``write_mapping_files`` lays them out,
    else the file's path below ``root`` without a final ``.json``.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    path = path_below(root, F.col("_metadata.file_path"))
    folder = F.regexp_extract(path, r"(?:\A|/)script_id=([^/]*)/[^/]*\z", 1)
    unescaped = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    key = F.when(folder != "", unescaped).otherwise(F.regexp_replace(path, r"\.json\z", ""))
    return files.select(key.alias("script_id"), F.col("value").alias("json"))


def write_mappings(packed: DataFrame, path: str, keys=KEYS) -> None:
    """The mappings of a corpus as JSON Lines: the keys, and the mapping's JSON as a string."""
    export_mapping(packed, keys).write.json(path)


def read_mappings(spark: SparkSession, path: str, keys: str = "script_id BIGINT") -> DataFrame:
    """``keys…, json`` as ``write_mappings`` wrote them; ``keys`` are the key columns with their types."""
    return spark.read.schema(f"{keys}, json STRING").json(path)


def import_mapping(files: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, status, entries`` for ``keys…, json``.

    ``status`` is ``bad_json``, ``not_object``, ``no_valid_entries`` or ``ok``. Entries need a
    placeholder as key and a non-blank string as value; others are dropped. A repeated key has its
    last value. (A key repeated deeper inside, in a value that would be dropped, counts as bad JSON.)
    """
    # Parsed again only where it is not a single object, to tell bad JSON from other JSON.
    other = F.try_parse_json("wrapped")
    is_one_value = other.isNotNull() & (
        F.size(F.try_variant_get(other, "$", "array<variant>")) == 1
    )
    status = (
        F.when(F.size("valid") > 0, "ok")
        .when(F.col("object").isNotNull(), "no_valid_entries")
        .when(is_one_value, "not_object")
        .otherwise("bad_json")
    )
    return (
        _objects(files, keys)
        .withColumn("valid", F.expr(_valid_entries("object", "texts")))
        .select(
            *keys,
            status.alias("status"),
            F.expr(f"coalesce(valid, {empty(ENTRIES_TYPE)})").alias("entries"),
        )
    )


def imported_mapping(files: DataFrame, keys=KEYS) -> DataFrame:
    """``keys…, placeholder, kind, n, original, canon``: the entries of ``import_mapping`` as one row each.

    What concerns one entry is done after the explode, as ordinary columns.
    """
    pairs = explode_rows(_objects(files, keys), keys, _pairs("object", "texts"))
    valid = pairs.filter(tx.is_mapping_entry("row.key", "row.original")).selectExpr(*keys, "row.key AS placeholder", "row.original")
    kind, n = when(_is_column("placeholder"), "'column'", "'table'"), _number("placeholder")
    return valid.selectExpr(*keys, "placeholder", f"{kind} AS kind", f"{n} AS n", "original", f"{tx.canonical_ref('original')} AS canon")


def _objects(files: DataFrame, keys) -> DataFrame:
    """``keys…, wrapped, parsed, object, texts``; ``object`` is NULL where the document is not a single object."""
    # In an array of its own, anything after the object makes the document invalid.
    wrapped = F.concat(F.lit("["), F.regexp_replace("json", "\\A\uFEFF", ""), F.lit("]"))
    # Variants tell strings from other values, but taking a string out of one is slower than reading all as texts.
    read = [F.from_json(wrapped, f"array<map<string,{t}>>", _STRICT).alias(name) for t, name in (("variant", "parsed"), ("string", "texts"))]
    one = F.when(F.size("parsed") == 1, F.get("parsed", F.lit(0)))
    return files.select(*keys, wrapped.alias("wrapped"), *read).withColumn("object", one).withColumn("texts", F.get("texts", F.lit(0)))


def _pairs(values: str, texts: str) -> str:
    """``array<struct<key, original>>`` of one object, of a repeated key the last; ``original`` is NULL for what is no string."""

    def last_of_each(pairs: str) -> str:
        last = let(f"reverse({pairs})", lambda r: transform(first_seen(f"{r}.key"), lambda s: f"get({r}, {s}.pos)"))
        return when(f"size(array_distinct({pairs}.key)) = size({pairs})", pairs, last)

    def pairs(texts: str) -> str:
        def pair(p: str, i: str) -> str:
            is_text = f"schema_of_variant({p}.value) = 'STRING'"
            return struct(key=f"{p}.key", original=when(is_text, f"coalesce(get({texts}, {i}), CAST({p}.value AS STRING))"))

        return let(transform(f"map_entries({values})", pair), last_of_each)

    return let(f"map_values({texts})", pairs)


def _is_column(placeholder: str) -> str:
    return f"startswith(lower({placeholder}), 'redacted.col')"


def _number(placeholder: str) -> str:
    return f"try_cast(substring_index({placeholder}, '_', -1) AS INT)"


def _valid_entries(values: str, texts: str) -> str:
    valid = keep_if(_pairs(values, texts), lambda p: tx.is_mapping_entry(f"{p}.key", f"{p}.original"))

    def ranked(p: str) -> str:
        return struct(rank=_is_column(f"{p}.key"), n=_number(f"{p}.key"), placeholder=f"{p}.key", original=f"{p}.original")

    entries = transform(
        f"sort_array({transform(valid, ranked)})",
        lambda e: struct(
            n=f"{e}.n",
            placeholder=f"{e}.placeholder",
            kind=when(f"{e}.rank", "'column'", "'table'"),
            original=f"{e}.original",
            canon=tx.canonical_ref(f"{e}.original"),
        ),
    )
    return f"CAST({entries} AS {ENTRIES_TYPE})"


def export_mapping(packed: DataFrame, keys=KEYS, pretty: bool = False) -> DataFrame:
    """``keys…, json`` for every script that has a mapping."""
    pairs = F.transform("entries", lambda e: F.struct(e.placeholder, e.original))
    document = F.to_json(F.map_from_entries(pairs), {"pretty": "true"} if pretty else {})
    return packed.filter(F.size("entries") > 0).select(*keys, document.alias("json"))


def write_mapping_files(packed: DataFrame, path: str, ids: list, key: str = KEYS[0]) -> None:
    """One folder ``key=…`` with one pretty JSON document for each of the scripts in ``ids``.

    For handing single mappings to people; ``write_mappings`` is for those of a corpus.
    """
    documents = export_mapping(packed.filter(F.col(key).isin(ids)), (key,), pretty=True)
    documents.repartition(key).write.partitionBy(key).text(path)
