"""DuckDB texts that compute the expected results another way.

Template corpora are built a second time with the expected values in place. For arbitrary texts the
oracles go from the character positions of the hits (window sums over split lengths), test the text
after each hit in steps, and number names with window functions; RE2 has no look-around.
"""

from __future__ import annotations

from checks import corpora as co
from refmask.functions import lexicon as lx

# Which characters are white space, and which make up an identifier. They must be those of the lexers.
_W = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_IDENT = r'(?:\[[^\]]+\]|"(?:[^"]|"")+"|`(?:[^`]|``)+`|[A-Za-z_][A-Za-z0-9_$#]*)'
_QUOTED = r'(?:\[[^\]]+\]|"(?:[^"]|"")+"|`(?:[^`]|``)+`)'
_BARE = r"[A-Za-z_][A-Za-z0-9_$#]*"
_NAME = rf"{_IDENT}(?:{_W}*\.{_W}*{_IDENT})*"
_PROTECTED = (
    r"--[^\n]*|(?s:/\*.*?(?:\*/|\z))|'[^']*(?:''[^']*)*(?:'|\z)"
    r'|"[^"]*(?:""[^"]*)*(?:"|\z)|`[^`]*(?:`|\z)|\[[^\]]*(?:\]|\z)'
)


def _words(phrases) -> str:
    return "|".join(p.replace(" ", f"{_W}+") for p in phrases)


_PREFIX = rf"\b(?i:{_words(lx.TABLE_KEYWORDS)}){_W}+(?:(?i:ONLY){_W}+)?"
_CLAUSE = rf"^(?:[,);]|(?i:{_words(lx.CLAUSE_WORDS)})\b)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canon(name: str) -> str:
    spaces = rf'("(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\])|{_W}+'
    return f"lower(regexp_replace({name}, {_q(spaces)}, '\\1', 'g'))"


# -- tables in arbitrary SQL texts ---------------------------------------------------------------


def table_hits(corpus: str) -> str:
    """CTEs ending in ``hits(script_id, i, seg, tok, lead, name, canon, accepted)``."""
    token = _q(f"(?:{_PREFIX}{_NAME})|(?:{_PROTECTED})")
    parse = _q(f"^({_PREFIX})({_NAME})$").replace("^(", "(?s)^(")
    return f"""
    src AS ({corpus}),
    lexed AS (SELECT script_id, text, regexp_extract_all(text, {token}) AS toks,
                     string_split_regex(text, {token}) AS segs FROM src),
    tokens AS (SELECT script_id, text, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok,
                      unnest(segs[1:len(toks)]) AS seg FROM lexed),
    placed AS (SELECT *, sum(length(seg) + length(tok)) OVER (PARTITION BY script_id ORDER BY i) AS stop
               FROM tokens),
    parsed AS (SELECT script_id, i, seg, tok,
                      regexp_extract(tok, {parse}, 1) AS lead, regexp_extract(tok, {parse}, 2) AS name,
                      regexp_replace(substr(text, CAST(stop AS BIGINT) + 1), {_q(f"^{_W}+")}, '') AS tail
               FROM placed),
    aliased AS (SELECT *, regexp_extract(tail, {_q(rf"^(?:(?i:AS){_W}+)?{_BARE}" + chr(92) + "b")}) AS alias FROM parsed),
    after AS (SELECT *, regexp_replace(substr(tail, length(alias) + 1), {_q(f"^{_W}+")}, '') AS rest FROM aliased),
    hits AS (SELECT script_id, i, seg, tok, lead, name, {_canon("name")} AS canon,
               name <> '' AND NOT regexp_matches(tail, '^(?i:import)\\b')
               AND NOT regexp_full_match(name, '(?i:redacted\\.Table_)[0-9]+')
               AND (contains(name, '.') OR left(name, 1) IN ('"', '`', '[') OR tail = ''
                    OR regexp_matches(tail, {_q(_CLAUSE)})
                    OR (alias <> '' AND (rest = '' OR regexp_matches(rest, {_q(_CLAUSE)})))) AS accepted
             FROM after)"""


_NUMBERED = """
    firsts AS (SELECT script_id, canon, min(i) AS first FROM hits WHERE accepted GROUP BY ALL),
    numbers AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY first) AS n FROM firsts),
    numbered AS (SELECT h.*, n, o.name AS original FROM hits h
                 LEFT JOIN numbers k ON h.accepted AND h.script_id = k.script_id AND h.canon = k.canon
                 LEFT JOIN hits o ON o.script_id = k.script_id AND o.i = k.first)"""


def prose_refs(corpus: str) -> str:
    return f"""WITH {table_hits(corpus)}
    SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY i) AS pos, 'table' AS kind,
           name AS ref, canon, accepted FROM hits WHERE name <> ''"""


def prose_redacted_ctes(corpus: str, new: str = "'redacted.Table_' || CAST(n AS STRING)") -> str:
    """CTEs ending in ``redacted(script_id, text)`` with ``new`` in place of each accepted name."""
    return f"""{table_hits(corpus)}, {_NUMBERED},
    bodies AS (SELECT script_id, string_agg(seg || CASE WHEN n IS NULL THEN tok ELSE lead || {new} END, '' ORDER BY i) AS body
               FROM numbered GROUP BY script_id),
    redacted AS (SELECT l.script_id, coalesce(body, '') || segs[len(segs)] AS text
                 FROM lexed l LEFT JOIN bodies b ON l.script_id = b.script_id)"""


def prose_redacted(corpus: str) -> str:
    return f"WITH {prose_redacted_ctes(corpus)} SELECT script_id, text FROM redacted"


def prose_restored(corpus: str) -> str:
    """Every name comes back in the first spelling its script uses; no mapping, no text."""
    return (
        f"WITH {prose_redacted_ctes(corpus, 'original')} SELECT r.script_id, "
        "CASE WHEN f.script_id IS NULL THEN 'no_mapping' ELSE 'ok' END AS status, "
        "CASE WHEN f.script_id IS NOT NULL THEN text END AS text FROM redacted r "
        "LEFT JOIN (SELECT DISTINCT script_id FROM firsts) f ON f.script_id = r.script_id"
    )


def prose_mapping(corpus: str) -> str:
    return f"""WITH {table_hits(corpus)}, {_NUMBERED}
    SELECT DISTINCT script_id, 'redacted.Table_' || CAST(n AS STRING) AS placeholder, 'table' AS kind, n, original, canon
    FROM numbered WHERE n IS NOT NULL"""


# -- columns in arbitrary SQL texts --------------------------------------------------------------


def prose_columns(corpus: str) -> str:
    """``script_id, text``: tables and columns of ``corpus`` redacted."""
    pair = rf"{_BARE}{_W}*\.{_W}*{_IDENT}"
    context = "|".join(
        rf"\b(?i:{w}){_W}+{pair}" for w in lx.TABLE_CONTEXT_WORDS
    )
    token = _q(rf"{_QUOTED}{_W}*\.{_W}*{_IDENT}|{_PROTECTED}|{context}|{pair}")
    split = _q(rf"(?s)^({_BARE}){_W}*\.{_W}*({_IDENT})$")
    bare_right = 'regexp_replace(rgt, \'^["`\\[](.*)["`\\]]$\', \'\\1\')'
    return f"""WITH {prose_redacted_ctes(corpus)},
    clexed AS (SELECT script_id, regexp_extract_all(text, {token}) AS toks, string_split_regex(text, {token}) AS segs FROM redacted),
    ctokens AS (SELECT script_id, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok, unnest(segs[1:len(toks)]) AS seg FROM clexed),
    cpairs AS (SELECT *, regexp_extract(tok, {split}, 1) AS lft, regexp_extract(tok, {split}, 2) AS rgt FROM ctokens),
    chits AS (SELECT *, {_canon("lft || '.' || rgt")} AS canon,
                lft <> '' AND lower(lft) <> 'redacted' AND NOT regexp_full_match({bare_right}, '(?i:Table|Col)_[0-9]+') AS accepted
              FROM cpairs),
    cnumbers AS (SELECT script_id, canon, row_number() OVER (PARTITION BY script_id ORDER BY min(i)) AS n
                 FROM chits WHERE accepted GROUP BY script_id, canon),
    cbodies AS (SELECT h.script_id, string_agg(seg || coalesce('redacted.Col_' || CAST(n AS STRING), tok), '' ORDER BY i) AS body
                FROM chits h LEFT JOIN cnumbers k ON h.accepted AND h.script_id = k.script_id AND h.canon = k.canon GROUP BY h.script_id)
    SELECT l.script_id, coalesce(body, '') || segs[len(segs)] AS text
    FROM clexed l LEFT JOIN cbodies b ON l.script_id = b.script_id"""


# -- misspellings in arbitrary texts -------------------------------------------------------------


def _rule_regex(bad: str) -> str:
    return _q(rf"(?i)\b{_words([bad])}\b")


def findings(corpus: str, max_findings: int | None = None) -> str:
    """Every rule searched on its own, lines counted in the text before each hit."""
    cap = "" if max_findings is None else f"QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY rule, i) <= {max_findings}"
    per_rule = " UNION ALL ".join(
        f"SELECT script_id, {i} AS rule, {_q(f)} AS fix, regexp_extract_all(text, {_rule_regex(b)}) AS toks, "
        f"string_split_regex(text, {_rule_regex(b)}) AS segs FROM src"
        for i, (b, f) in enumerate(lx.TYPO_RULES, 1)
    )
    newlines = "length({0}) - length(replace({0}, chr(10), ''))"
    return f"""WITH src AS ({corpus}), cut AS ({per_rule}),
    hits AS (SELECT script_id, rule, fix, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok, unnest(segs[1:len(toks)]) AS seg FROM cut),
    placed AS (SELECT *, 1 + sum({newlines.format("seg")} + {newlines.format("tok")}) OVER (PARTITION BY script_id, rule ORDER BY i)
                 - ({newlines.format("tok")}) AS line FROM hits)
    SELECT script_id, CAST(rule AS BIGINT) AS rule, CAST(line AS BIGINT) AS line, tok AS found, fix FROM placed {cap}"""


def fixed(corpus: str) -> str:
    """One replacement pass per rule, each on the result of the one before."""
    steps = [f"t0 AS (SELECT script_id, text, 0 AS replacements FROM ({corpus}))"]
    for i, (bad, fix) in enumerate(lx.TYPO_RULES, 1):
        regex = _rule_regex(bad)
        steps.append(
            f"t{i} AS MATERIALIZED (SELECT script_id, regexp_replace(text, {regex}, {_q(fix)}, 'g') AS text, "
            f"replacements + len(regexp_extract_all(text, {regex})) AS replacements FROM t{i - 1})"
        )
    return (
        "WITH " + ", ".join(steps) + " SELECT script_id, "
        "CASE WHEN replacements > 0 THEN 'fixed' ELSE 'no_typos' END AS status, text, "
        f"CAST(replacements AS BIGINT) AS replacements FROM t{len(lx.TYPO_RULES)}"
    )


# -- batches: expected values from the parameters of each statement ------------------------------

_SOURCE, _TARGET = co.line_tables("lineitem")
BATCH_NUMBERS = f"""
    lines AS (SELECT l_orderkey AS script_id, {_SOURCE} AS source, {_TARGET} AS target, l_partkey AS part,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS stmt FROM lineitem),
    refs AS (SELECT script_id, 2 * stmt - 1 AS pos, target AS ref, target AS canon FROM lines
             UNION ALL SELECT script_id, 2 * stmt, source, lower(replace(source, ' ', '')) FROM lines),
    numbers AS (SELECT script_id, canon, min(pos) AS first, arg_min(ref, pos) AS original,
                       row_number() OVER (PARTITION BY script_id ORDER BY min(pos)) AS n FROM refs GROUP BY script_id, canon)"""


def batch_texts(new: str) -> str:
    """The batch scripts with ``new`` (over the columns of ``numbers``) in place of each table."""
    return f"""WITH {BATCH_NUMBERS},
    renamed AS (SELECT l.script_id, stmt, part, {new.format("s")} AS source, {new.format("t")} AS target FROM lines l
                JOIN numbers s ON s.script_id = l.script_id AND s.canon = lower(replace(l.source, ' ', ''))
                JOIN numbers t ON t.script_id = l.script_id AND t.canon = l.target)
    SELECT script_id, string_agg({co.line_statement("source", "target", "part")}, chr(10) ORDER BY stmt) AS text
    FROM renamed GROUP BY script_id"""
