"""Misspelled keywords of one text: findings and repair."""

from __future__ import annotations

from refmask.functions import lexicon as lx
from refmask.functions import text as tx
from refmask.functions.marking import cut, join, matches, with_marks
from refmask.functions.sqltext import empty, let, literal, pattern, struct, transform, when

FINDINGS_TYPE = "array<struct<rule:int,line:int,found:string,fix:string>>"
_HITS_TYPE = "array<struct<rule:int,pos:int,line:int,found:string>>"

_MISSPELLINGS = "array(" + ", ".join(f"'{bad}'" for bad, _ in lx.TYPO_RULES) + ")"
_CORRECTIONS = "array(" + ", ".join(f"'{fix}'" for _, fix in lx.TYPO_RULES) + ")"


def _spelled(found: str) -> str:
    return f"upper(regexp_replace({found}, {pattern(lx.SPACE + '++')}, ' '))"


def _rule(spelled: str) -> str:
    return f"int(array_position({_MISSPELLINGS}, {spelled}))"


def _rule_number(found: str) -> str:
    return _rule(_spelled(found))


def _correction(rule: str) -> str:
    return f"get({_CORRECTIONS}, {rule} - 1)"


def _scan(text: str) -> str:
    """Hits of all rules with the line each starts in, in one pass.

    A nested rule's hit ends in a misspelling of its own, one word, which is a second hit.
    """
    nested = [bad for bad, _ in lx.NESTED_RULES]

    def marked_text(open_mark: str, close_mark: str) -> str:
        template = f"{open_mark} || {literal('${ref}')} || {close_mark}"
        marked = f"regexp_replace({text}, {pattern(lx.typo_pattern((*lx.NESTED_RULES, *lx.FLAT_RULES)))}, {template})"
        return let(marked, lambda m: hits(m, open_mark, close_mark))

    def hits(marked: str, open_mark: str, close_mark: str) -> str:
        found = matches(f"split(replace({marked}, {close_mark}, {open_mark}), {open_mark})")
        # One line number per opening mark, in the order of the hits.
        lines = transform(
            f"split({marked}, chr(10))",
            lambda line, i: f"array_repeat({i} + 1, size(split({line}, {open_mark})) - 1)",
        )
        # Hits are letters and white space: brought to one spelling all at once.
        return let(
            found,
            lambda found: let(
                _spelled(f"concat_ws(',', {found})"),
                lambda spelled: let(
                    f"split({spelled}, ',')",
                    lambda names: let(f"flatten({lines})", lambda lines: listed(found, spelled, names, lines)),
                ),
            ),
        )

    def listed(found: str, spelled: str, names: str, lines: str) -> str:
        outer = transform(
            found,
            lambda f, i: struct(rule=_rule(f"get({names}, {i})"), pos=i, line=f"get({lines}, {i})", found=f),
        )
        every = transform(
            found,
            lambda f, i: when(
                f"get({names}, {i}) IN ({', '.join(repr(bad) for bad in nested)})",
                struct(
                    rule=_rule(f"substring_index(get({names}, {i}), ' ', -1)"),
                    pos=i,
                    line=f"get({lines}, {i}) + length({f}) - length(replace({f}, chr(10), ''))",
                    found=f"regexp_extract({f}, r'[A-Za-z]++$', 0)",
                ),
            ),
        )
        some = " OR ".join(f"contains({spelled}, '{bad}')" for bad in nested)
        inner = when(some, f"array_compact({every})", empty(_HITS_TYPE))
        return f"concat({outer}, {inner})"

    return with_marks(text, marked_text)


def find_typos(text: str, max_findings: int | None = None) -> str:
    """Findings in order of rule, then position; all, or the first ``max_findings`` of them."""
    ordered = f"sort_array({_scan(text)})"
    if max_findings is not None:
        ordered = f"slice({ordered}, 1, {max_findings})"
    findings = transform(
        ordered,
        lambda f: struct(
            rule=f"{f}.rule", line=f"{f}.line", found=f"{f}.found", fix=_correction(f"{f}.rule")
        ),
    )
    return when(
        f"{text} RLIKE {pattern(lx.ANY_TYPO)}",
        f"CAST({findings} AS {FINDINGS_TYPE})",
        empty(FINDINGS_TYPE),
    )


def fix_typos(text: str) -> str:
    """``struct<text, replacements>`` after applying all rules in order.

    Equal to one pass per rule: the rules' hits are disjoint except that a nested rule's inner
    misspelling is repaired first, and only the fed rules can gain hits from earlier repairs.
    """

    def one_pass(text: str, rules) -> str:
        def replaced(parts: str, found: str) -> str:
            fixes = transform(found, lambda f: _correction(_rule_number(f)))
            return struct(
                text=let(fixes, lambda new: join(parts, lambda _, i: f"get({new}, {i})")), replacements=f"size({found})"
            )

        return let(
            cut(text, lx.typo_pattern(rules)),
            lambda parts: let(matches(parts), lambda found: replaced(parts, found)),
        )

    def second(first: str) -> str:
        return let(
            one_pass(f"{first}.text", lx.FED_RULES),
            lambda again: struct(
                text=f"{again}.text", replacements=f"{first}.replacements + {again}.replacements"
            ),
        )

    return when(
        f"{text} RLIKE {pattern(lx.ANY_TYPO)}",
        let(one_pass(text, lx.FLAT_RULES), second),
        struct(text=text, replacements="0"),
    )


def typo_summary(findings: str) -> str:
    lines = transform(
        findings,
        lambda f: f"chr(10) || '- ' || {tx.finding_line(f'{f}.line', f'{f}.found', f'{f}.fix')}",
    )
    return when(
        f"size({findings}) = 0",
        f"'{lx.NO_TYPOS}'",
        f"'{lx.TYPOS_HEADING}' || array_join({lines}, '')",
    )
