"""Cutting a text at the matches of a pattern, and putting it together again.

Spark does not tell where a pattern matched. One ``regexp_replace`` puts a mark around every match
and one ``split`` at the mark yields ``[text, match, text, match, …, text]``: a single regular
expression pass, from which joining gives back the text byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable

from refmask.functions.sqltext import keep_if, let, literal, pattern, transform, when

# Unicode non-characters: reserved for internal use, never in exchanged text. A text that has them
# nevertheless gets marks extended by its own hash, which it cannot contain.
OPEN = literal(chr(0xFDD0))
CLOSE = literal(chr(0xFDD1))


def with_marks(text: str, body: Callable[[str, str], str]) -> str:
    """``body(open, close)`` with two marks that do not occur in ``text``."""
    tag = when(
        f"contains({text}, {OPEN}) OR contains({text}, {CLOSE})", f"sha2({text}, 256)", "''"
    )
    # Bound, so that they are put together once a row and not at each use.
    return let(
        tag,
        lambda tag: let(f"{OPEN} || {tag}", lambda start: let(f"{CLOSE} || {tag}", lambda stop: body(start, stop))),
    )


def cut(text: str, regex: str, keep: str = "", body: Callable[[str, str], str] = lambda parts, _: parts) -> str:
    """``[text, match, text, …]``: odd elements are the group ``ref`` of each match.

    ``keep`` names (as replacement text) the groups that stay in the text before the reference. Where there
    are such groups, a match without a reference is text. ``body`` gets the parts and a mark that none of them holds.
    """

    def marked(start: str, stop: str) -> str:
        if not keep:
            template = f"{start} || {literal('${ref}')} || {start}"
            return body(f"split(regexp_replace({text}, {pattern(regex)}, {template}), {start})", start)
        template = f"{literal(keep)} || {start} || {literal('${ref}')} || {stop}"
        found = f"replace(regexp_replace({text}, {pattern(regex)}, {template}), {start} || {stop}, '')"
        return body(f"split(replace({found}, {stop}, {start}), {start})", start)

    return with_marks(text, marked)


def matches(parts: str) -> str:
    """The odd elements of a cut text."""
    return keep_if(parts, lambda _, i: f"{i} & 1 = 1")


def join(parts: str, replacement: Callable[[str, str], str]) -> str:
    """A cut text with ``replacement(match, i)`` in the place of the i-th match, from 0; NULL keeps the match."""
    pieces = transform(
        parts,
        lambda part, i: when(f"{i} & 1 = 0", part, f"coalesce({replacement(part, f'shiftright({i}, 1)')}, {part})"),
    )
    return f"array_join({pieces}, '')"
