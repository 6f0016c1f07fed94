"""Array helpers that stay inside one row: no shuffle, no Python.

A script is one cell, so numbering its references is a grouping *inside* the row. Everything here is
linear or n·log n in the array length: a generated script with 100,000 references must not turn the
usual "search the list for every element" into 10^10 comparisons.
"""

from __future__ import annotations

from refmask.functions.sqltext import keep_if, let, struct, transform, when

# Up to this many distinct values a linear search beats sorting. Only the speed depends on it.
LINEAR_SEARCH_MAX = 128


def first_seen(keys: str) -> str:
    """The distinct non-null ``keys`` in order of appearance, as ``{pos, key}`` with 0-based pos."""

    def by_search(distinct: str) -> str:
        return transform(
            distinct, lambda key: struct(pos=f"int(array_position({keys}, {key}) - 1)", key=key)
        )

    def by_sorting(entries: str) -> str:
        heads = keep_if(entries, lambda e, i: f"{e}.key IS NOT NULL AND {_starts_run(entries, e, i)}")
        return f"sort_array({transform(heads, lambda h: struct(pos=f'{h}.pos', key=f'{h}.key'))})"

    return let(
        f"array_distinct(array_compact({keys}))",
        lambda distinct: when(
            f"size({distinct}) <= {LINEAR_SEARCH_MAX}",
            by_search(distinct),
            let(_sorted_with_positions(keys), by_sorting),
        ),
    )


def first_seen_numbers(keys: str) -> str:
    """Number the distinct non-null ``keys`` 1, 2, … by first appearance; NULL keys give NULL."""
    return let(
        f"array_distinct(array_compact({keys}))",
        lambda distinct: when(
            f"size({distinct}) <= {LINEAR_SEARCH_MAX}",
            transform(keys, lambda key: f"int(array_position({distinct}, {key}))"),
            _numbers_by_sorting(keys),
        ),
    )


def lookup(keys: str, names: str, values: str) -> str:
    """For each of ``keys`` the element of ``values`` next to it in ``names``, NULL if absent.

    ``names`` are distinct and as many as ``values``.
    """

    def bound(b: str) -> str:
        # Numbering names and keys together gives every known key the index of its name.
        def by_numbering(numbers: str) -> str:
            return transform(
                f"{b}.keys",
                lambda key, i: f"get({b}.values, get({numbers}, {i} + size({b}.names)) - 1)",
            )

        return when(
            f"size({b}.names) <= {LINEAR_SEARCH_MAX}",
            transform(
                f"{b}.keys",
                lambda key: f"get({b}.values, int(array_position({b}.names, {key}) - 1))",
            ),
            let(_numbers_by_sorting(f"concat({b}.names, {b}.keys)"), by_numbering),
        )

    return let(struct(keys=keys, names=names, values=values), bound)


def _sorted_with_positions(keys: str) -> str:
    return f"sort_array({transform(keys, lambda key, i: struct(key=key, pos=i))})"


def _starts_run(entries: str, entry: str, i: str) -> str:
    return f"({i} = 0 OR NOT (get({entries}, {i} - 1).key <=> {entry}.key))"


def _numbers_by_sorting(keys: str) -> str:
    def from_sorted(entries: str) -> str:
        marked = transform(
            entries,
            lambda e, i: struct(
                key=f"{e}.key", pos=f"{e}.pos", start=i, head=_starts_run(entries, e, i)
            ),
        )
        return let(keep_if(marked, lambda e: f"{e}.head"), lambda heads: from_heads(entries, heads))

    def from_heads(entries: str, heads: str) -> str:
        # One run of equal keys per head; runs sorted by their first position get their numbers,
        # NULL keys sort last of all and get none.
        runs = transform(
            heads,
            lambda h, i: struct(
                skipped=f"{h}.key IS NULL",
                pos=f"{h}.pos",
                start=f"{h}.start",
                stop=f"coalesce(get({heads}, {i} + 1).start, size({entries}))",
            ),
        )
        numbered = transform(
            f"sort_array({runs})",
            lambda run, n: transform(
                f"sequence({run}.start, {run}.stop - 1)",
                lambda i: struct(
                    pos=f"get({entries}, {i}).pos", n=when(f"NOT {run}.skipped", f"{n} + 1")
                ),
            ),
        )
        return transform(f"sort_array(flatten({numbered}))", lambda e: f"{e}.n")

    return let(_sorted_with_positions(keys), from_sorted)
