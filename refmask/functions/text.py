"""Scalar functions on references and script texts."""

from __future__ import annotations

from refmask.functions import lexicon as lx
from refmask.functions.sqltext import literal, pattern, when


def _matches(text: str, regex: str) -> str:
    return f"({text} RLIKE {pattern(regex)})"


def strip_space(value: str) -> str:
    """Drop white space (all kinds in ``lexicon.SPACE``) at both ends."""
    return f"regexp_replace({value}, {pattern(lx.OUTER_SPACE)}, '')"


def is_blank(text: str) -> str:
    return f"({text} IS NULL OR NOT {_matches(text, lx.NOT_SPACE)})"


def normalise_newlines(text: str) -> str:
    return when(
        f"contains({text}, chr(13))", f"regexp_replace({text}, {pattern(lx.NEWLINE)}, chr(10))", text
    )


def canonical_ref(ref: str) -> str:
    """Key under which spellings of one name meet: lower case, no white space outside quotes."""
    compact = f"regexp_replace({ref}, {pattern(lx.SPACE_OUTSIDE_QUOTES)}, {literal('$1')})"
    return f"lower({when(_matches(ref, lx.SPACE), compact, ref)})"


def column_ref(pair: str) -> str:
    """``left.right`` without the white space around the dot."""
    compact = f"regexp_replace({pair}, {pattern(lx.COLUMN_HEAD)}, {literal('$1.')})"
    return when(_matches(pair, lx.SPACE), compact, pair)


def strip_identifier_quotes(identifier: str) -> str:
    """Drop one pair of matching identifier quotes."""
    regex = pattern(lx.IDENTIFIER_QUOTES)
    return f"regexp_replace({strip_space(identifier)}, {regex}, {literal('$1$2$3')})"


def is_qualified_or_quoted(ref: str) -> str:
    return f"(contains({ref}, '.') OR left({ref}, 1) IN ('\"', '`', '['))"


def is_table_placeholder(ref: str) -> str:
    return _matches(ref, lx.IS_TABLE_PLACEHOLDER)


def is_likely_table(ref: str) -> str:
    return f"({ref} <> '' AND NOT startswith({ref}, '(') AND NOT {is_table_placeholder(ref)})"


def is_likely_pyspark_table(ref: str) -> str:
    return f"({_matches(ref, lx.PYSPARK_NAME)} AND NOT {is_table_placeholder(strip_space(ref))})"


def is_likely_column(pair: str) -> str:
    """False for pairs that already are placeholders or live in their name space."""
    return f"({pair} <> '' AND NOT {_matches(pair, lx.RESERVED_PAIR)})"


def is_mapping_entry(key: str, original: str) -> str:
    return f"({_matches(key, lx.PLACEHOLDER_KEY)} AND NOT {is_blank(original)})"


def detect_mode(text: str) -> str:
    # A hint ends in a bracket; looking for one is much faster than the pattern.
    return when(f"contains({text}, '(') AND {_matches(text, lx.PYSPARK_HINT)}", "'pyspark'", "'sql'")


def effective_mode(requested: str, text: str) -> str:
    """``pyspark`` stays as requested; anything else is SQL unless the text looks like PySpark."""
    return when(f"{requested} = 'pyspark'", "'pyspark'", detect_mode(text))


def line_count(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')) + 1)"


def mapping_line(placeholder: str, original: str) -> str:
    return f"({placeholder} || ' -> ' || {original})"


def finding_line(line: str, found: str, fix: str) -> str:
    return f"('line ' || {line} || ': ' || {found} || ' -> ' || {fix})"
