"""Putting originals back, and listing the placeholders of a text."""

from __future__ import annotations

from refmask.functions import lexicon as lx
from refmask.functions import text as tx
from refmask.functions.arrays import LINEAR_SEARCH_MAX, lookup
from refmask.functions.marking import cut, join, matches
from refmask.functions.sqltext import let, struct, transform, when


def restore(text: str, entries: str) -> str:
    """Replace whole-word placeholders by the originals of ``entries``, all in one pass.

    Case-sensitive, also inside strings and comments. Unknown placeholders stay, originals are
    taken literally and never searched again.
    """

    def from_parts(parts: str, names: str, originals: str) -> str:
        few = join(parts, lambda match, _: f"get({originals}, int(array_position({names}, {match}) - 1))")
        many = let(lookup(matches(parts), names, originals), lambda new: join(parts, lambda _, i: f"get({new}, {i})"))
        return when(f"size({names}) <= {LINEAR_SEARCH_MAX}", few, many)

    def with_names(parts: str) -> str:
        found = let(f"{entries}.placeholder", lambda names: let(f"{entries}.original", lambda originals: from_parts(parts, names, originals)))
        return when(f"size({parts}) = 1", text, found)

    return let(cut(text, lx.PLACEHOLDER_WORD), with_names)


def placeholder_tokens(text: str, entries: str) -> str:
    """``array<struct<pos, token, original>>`` of all placeholders in ``text``, in any case."""

    def annotated(tokens: str) -> str:
        names, originals = f"{entries}.placeholder", f"{entries}.original"
        lowered = transform(tokens, lambda token: f"lower({token})")
        found = struct(
            exact=lookup(tokens, names, originals), lowered=lookup(lowered, names, originals)
        )
        return let(
            found,
            lambda f: transform(
                tokens,
                lambda token, i: struct(
                    pos=f"{i} + 1",
                    token=token,
                    original=f"coalesce(get({f}.exact, {i}), get({f}.lowered, {i}), '{lx.NO_MAPPING_FOUND}')",
                ),
            ),
        )

    return let(matches(cut(text, lx.PLACEHOLDER)), annotated)


def mapping_summary(entries: str) -> str:
    lines = transform(entries, lambda e: tx.mapping_line(f"{e}.placeholder", f"{e}.original"))
    return when(
        f"size({entries}) = 0", f"'{lx.NO_MAPPING_YET}'", f"array_join({lines}, chr(10))"
    )
