"""Writing SQL expressions with higher-order functions."""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable

_counter = itertools.count(1)


def literal(value: str) -> str:
    """A string literal without escapes, whatever the session's parser settings are."""
    if "'" in value:
        raise ValueError("quotes are written \\x27 in patterns; see pattern()")
    # The parser would take ${name} for a configuration variable.
    quoted = " || ".join(f"r'{part}'" for part in value.replace("${", "$\0{").split("\0"))
    return f"({quoted})" if "||" in quoted else quoted


def pattern(regex: str) -> str:
    return literal(regex.replace("'", r"\x27"))


def _lambda(body: Callable[..., str]) -> str:
    names = [f"_v{next(_counter)}" for _ in inspect.signature(body).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def transform(array: str, body: Callable[..., str]) -> str:
    return f"transform({array}, {_lambda(body)})"


def keep_if(array: str, body: Callable[..., str]) -> str:
    return f"filter({array}, {_lambda(body)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once per row and hand it to ``body``.

    The optimiser may copy a projected expression into a lambda of the next projection, where it
    would run once per element; a lambda variable is never copied. An aggregate over nothing gives its
    start value to its last step as it is, while ``transform`` would copy what each level gives.
    """
    return f"aggregate(array(), {value}, {_lambda(lambda value, _: value)}, {_lambda(body)})"


def when(condition: str, then: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def empty(array_type: str) -> str:
    return f"CAST(array() AS {array_type})"
