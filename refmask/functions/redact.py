"""Redaction of one text as an expression.

Each function gives ``struct<text, entries>`` where ``entries`` is the script's dictionary:
``array<struct<n, placeholder, kind, original, canon>>`` in order of numbering. Everything is local
to the row, so redacting a corpus needs no shuffle and works on streams unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from refmask.functions import lexicon as lx
from refmask.functions import text as tx
from refmask.functions.arrays import LINEAR_SEARCH_MAX, first_seen, first_seen_numbers
from refmask.functions.marking import cut, join, matches, with_marks
from refmask.functions.sqltext import empty, keep_if, let, literal, pattern, struct, transform, when

ENTRIES_TYPE = (
    "array<struct<n:int,placeholder:string,kind:string,original:string,canon:string>>"
)
REFS_TYPE = "array<struct<pos:int,ref:string,canon:string,accepted:boolean>>"

Expression = Callable[[str], str]
# What an expression gives: the struct, or one of its fields alone. A field of the struct would still cost all of it, since
# what is bound by ``let`` is hidden from column pruning.
BOTH, TEXT, ENTRIES = "both", "text", "entries"


def sql_table_key(ref: str) -> str:
    """Key of a table name, NULL where the match stays as it is."""
    return when(tx.is_likely_table(ref), tx.canonical_ref(ref))


def column_key(pair: str) -> str:
    return when(tx.is_likely_column(pair), tx.canonical_ref(tx.column_ref(pair)))


def pyspark_table_key(ref: str) -> str:
    return when(tx.is_likely_pyspark_table(ref), tx.canonical_ref(tx.strip_space(ref)))


def redact_sql_tables(text: str, want: str = BOTH) -> str:
    return _redact(
        text,
        regex=lx.SQL_TABLE,
        keep=lx.KEEP_TABLE,
        keys_of=_sql_table_keys,
        original_of=lambda ref: ref,
        kind="table",
        prefix=lx.TABLE_PLACEHOLDER,
        taken=lx.TABLE_NUMBERS,
        want=want,
    )


def redact_sql_columns(text: str, want: str = BOTH) -> str:
    """Qualified columns; expects a text whose tables are already redacted."""
    return _redact(
        text,
        regex=lx.SQL_COLUMN,
        keep=lx.KEEP_COLUMN,
        keys_of=_column_keys,
        original_of=tx.column_ref,
        kind="column",
        prefix=lx.COLUMN_PLACEHOLDER,
        taken=lx.COLUMN_NUMBERS,
        want=want,
    )


def redact_sql(text: str, redact_columns: bool = False, want: str = BOTH) -> str:
    if not redact_columns:
        return redact_sql_tables(text, want)
    if want == TEXT:
        return let(redact_sql_tables(text, TEXT), lambda tables: redact_sql_columns(tables, TEXT))

    def columns_of(tables: str) -> str:
        if want == ENTRIES:
            return f"concat({tables}.entries, {redact_sql_columns(f'{tables}.text', ENTRIES)})"
        return let(
            redact_sql_columns(f"{tables}.text"),
            lambda columns: struct(
                text=f"{columns}.text", entries=f"concat({tables}.entries, {columns}.entries)"
            ),
        )

    return let(redact_sql_tables(text), columns_of)


def redact_pyspark(text: str, want: str = BOTH) -> str:
    return _redact(
        text,
        regex=lx.PYSPARK_TABLE,
        keep=lx.KEEP_PYSPARK,
        keys_of=_pyspark_keys,
        original_of=tx.strip_space,
        kind="table",
        prefix=lx.TABLE_PLACEHOLDER,
        taken=lx.TABLE_NUMBERS,
        want=want,
    )


def redact(text: str, mode: str, redact_columns: bool = False, want: str = BOTH) -> str:
    """Dispatch on the mode of the row; only the chosen branch is evaluated."""
    return when(f"{mode} = 'pyspark'", redact_pyspark(text, want), redact_sql(text, redact_columns, want))


def _redact(
    text: str,
    regex: str,
    keep: str,
    keys_of: Callable[[str, str], str],
    original_of: Expression,
    kind: str,
    prefix: str,
    taken: str,
    want: str,
) -> str:
    """``keys_of(refs, mark)`` gives the keys of all references, NULL where one stays as it is."""

    def from_parts(parts: str, mark: str) -> str:
        nothing = {TEXT: text, ENTRIES: empty(ENTRIES_TYPE)}
        some = let(matches(parts), lambda refs: let(keys_of(refs, mark), lambda keys: from_keys(parts, refs, keys)))
        return when(f"size({parts}) = 1", struct(**nothing) if want == BOTH else nothing[want], some)

    def from_keys(parts: str, refs: str, keys: str) -> str:
        return let(
            f"array_distinct(array_compact({keys}))",
            lambda distinct: let(
                _placeholders(text, f"size({distinct})", prefix, taken),
                lambda names: result(parts, refs, keys, distinct, names),
            ),
        )

    def result(parts: str, refs: str, keys: str, distinct: str, names: str) -> str:
        def entries(first_of: Expression) -> str:
            return transform(
                distinct,
                lambda key, i: struct(
                    n=f"int(substring_index(get({names}, {i}), '_', -1))",
                    placeholder=f"get({names}, {i})",
                    kind=f"'{kind}'",
                    original=original_of(f"get({refs}, {first_of(key, i)})"),
                    canon=key,
                ),
            )

        few = f"size({distinct}) <= {LINEAR_SEARCH_MAX}"
        listed = when(
            few,
            entries(lambda key, _: f"int(array_position({keys}, {key}) - 1)"),
            let(first_seen(keys), lambda firsts: entries(lambda _, i: f"get({firsts}, {i}).pos")),
        )
        # Numbers by a search for each reference, or for more names all at once.
        numbers = when(f"NOT ({few})", first_seen_numbers(keys))
        replaced = let(
            numbers,
            lambda numbers: join(
                parts,
                lambda _, i: f"get({names}, coalesce(get({numbers}, {i}), int(array_position({distinct}, get({keys}, {i})))) - 1)",
            ),
        )
        fields = {TEXT: replaced, ENTRIES: f"CAST({listed} AS {ENTRIES_TYPE})"}
        return struct(**fields) if want == BOTH else fields[want]

    return cut(text, regex, keep, lambda parts, mark: let(parts, lambda parts: from_parts(parts, mark)))


# Keys of all references of a script at once: joined by a mark that none of them holds, one pass makes them canonical. Names
# are quoted and closed within a reference, so no pass goes over a mark. Single references are judged only where one of them
# may have to stay.


def _sql_table_keys(refs: str, mark: str) -> str:
    def split_again(canon: str) -> str:
        each = transform(refs, sql_table_key)
        return when(f"contains({canon}, lower('{lx.TABLE_PLACEHOLDER}'))", each, f"split({canon}, {mark})")

    return let(f"concat_ws({mark}, {refs})", lambda joined: let(tx.canonical_ref(joined), split_again))


def _column_keys(refs: str, mark: str) -> str:
    def split_again(joined: str) -> str:
        plain = f"NOT {joined} RLIKE {pattern(lx.MAY_BE_RESERVED)} AND NOT {joined} RLIKE {pattern(lx.SPACE)}"
        return when(plain, f"split(lower({joined}), {mark})", transform(refs, column_key))

    return let(f"concat_ws({mark}, {refs})", split_again)


def _pyspark_keys(refs: str, _: str) -> str:
    return transform(refs, pyspark_table_key)


def _placeholders(text: str, count: str, prefix: str, taken: str) -> str:
    """At least ``count`` placeholders whose numbers do not occur in ``text`` yet."""
    fresh = transform(f"sequence(1, {count} + 1)", lambda n: f"'{prefix}' || {n}")

    def around(present: str) -> str:
        numbers = transform(
            f"sequence(1, {count} + size({present}) + 1)", lambda n: f"string({n})"
        )
        return transform(
            f"array_except({numbers}, {present})", lambda n: f"'{prefix}' || {n}"
        )

    present = f"regexp_extract_all({text}, {pattern(taken)}, 1)"
    return when(f"contains({text}, '{prefix}')", let(present, around), fresh)


# -- references as a list ------------------------------------------------------------------------


def sql_table_refs(text: str) -> str:
    """All table hits of a SQL text, ``accepted`` or not, as ``array<struct<pos, ref, canon, …>>``."""

    def listed(parts: str) -> str:
        found = transform(parts, lambda part, j: struct(ref=part, at=f"{j} % 3"))
        return keep_if(found, lambda hit: f"{hit}.at > 0 AND {hit}.ref <> ''")

    return _numbered_refs(
        let(sql_table_parts(text), listed),
        lambda hit: f"{hit}.at = 1 AND {tx.is_likely_table(f'{hit}.ref')}",
        tx.canonical_ref,
    )


def sql_table_parts(text: str) -> str:
    """A SQL text cut into ``[text, name, skipped name, text, …]``, of each hit one name that is not empty."""

    def listed(mark: str, _: str) -> str:
        template = " || ".join(
            (literal("${keep}${lead}${skiplead}"), mark, literal("${ref}"), mark, literal("${skip}"), mark)
        )
        marked = f"regexp_replace({text}, {pattern(lx.SQL_TABLE_ALL)}, {template})"
        # Text that is never looked into has no name; three marks meet nowhere else, for a hit begins with a keyword.
        return f"split(replace({marked}, {mark} || {mark} || {mark}, ''), {mark})"

    return with_marks(text, listed)


def pyspark_table_parts(text: str) -> str:
    """The same for a PySpark text, where nothing is skipped."""

    def listed(mark: str, _: str) -> str:
        template = f"{literal(lx.KEEP_PYSPARK)} || {mark} || {literal('${ref}')} || {mark} || {mark}"
        return f"split(regexp_replace({text}, {pattern(lx.PYSPARK_TABLE)}, {template}), {mark})"

    return with_marks(text, listed)


def table_parts(text: str, mode: str) -> str:
    return when(f"{mode} = 'pyspark'", pyspark_table_parts(text), sql_table_parts(text))


def table_canon(ref: str, mode: str) -> str:
    return tx.canonical_ref(when(f"{mode} = 'pyspark'", tx.strip_space(ref), ref))


def is_table(ref: str, mode: str) -> str:
    return when(f"{mode} = 'pyspark'", tx.is_likely_pyspark_table(ref), tx.is_likely_table(ref))


def column_refs(text: str) -> str:
    return _plain_refs(
        cut(text, lx.SQL_COLUMN, lx.KEEP_COLUMN),
        tx.is_likely_column,
        lambda ref: tx.canonical_ref(tx.column_ref(ref)),
    )


def _plain_refs(parts: str, accepts: Expression, canon: Expression) -> str:
    hits = transform(
        keep_if(matches(parts), lambda ref: f"{ref} <> ''"), lambda ref: struct(ref=ref)
    )
    return _numbered_refs(hits, lambda hit: accepts(f"{hit}.ref"), canon)


def _numbered_refs(hits: str, accepts: Expression, canon: Expression) -> str:
    refs = transform(
        hits,
        lambda hit, i: struct(
            pos=f"{i} + 1", ref=f"{hit}.ref", canon=canon(f"{hit}.ref"), accepted=accepts(hit)
        ),
    )
    return f"CAST({refs} AS {REFS_TYPE})"
