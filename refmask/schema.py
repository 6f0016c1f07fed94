"""Schemas (DDL) of the tables that jobs read and write."""

from __future__ import annotations

from refmask.functions.redact import ENTRIES_TYPE
from refmask.functions.typos import FINDINGS_TYPE

SCRIPTS = "script_id BIGINT, text STRING, mode STRING"
TEXTS = "script_id BIGINT, text STRING"
# One row per script: what a redaction job produces. The long tables are explodes of it.
ANNOTATED = (
    "script_id BIGINT, mode STRING, status STRING, text STRING, "
    f"entries {ENTRIES_TYPE}, findings {FINDINGS_TYPE}"
)
RESTORED = "script_id BIGINT, status STRING, text STRING"

KEYS = ("script_id",)


def with_keys(table: str, keys: str) -> str:
    """The schema of a table with other key columns (DDL) than ``script_id BIGINT``."""
    return table.replace("script_id BIGINT", keys, 1)
