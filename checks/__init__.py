"""Corpora derived from the given tables, and the queries that are checked on them."""
