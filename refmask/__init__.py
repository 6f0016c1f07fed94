"""Masking of table and column references in corpora of SQL and PySpark scripts, on Spark."""

from refmask.plans.jobs import (
    Options,
    Redaction,
    fix_corpus,
    redact_corpus,
    reload_run,
    restore_corpus,
)

__all__ = [
    "Options",
    "Redaction",
    "fix_corpus",
    "redact_corpus",
    "reload_run",
    "restore_corpus",
]
