"""Word lists and the ``java.util.regex`` patterns built from them.

Every pattern is a literal in the plan, so Spark compiles it once per task. Loops over text are
possessive: a 200 kB string literal must not recurse once per character.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Fixed values. They define which text is recognised and must not be changed or reordered.
# ---------------------------------------------------------------------------------------------
TABLE_KEYWORDS = (
    "FROM",
    "JOIN",
    "UPDATE",
    "INTO",
    "MERGE INTO",
    "DELETE FROM",
    "TRUNCATE TABLE",
)
# A bare table name counts only if one of these (or the end of the script) follows it.
CLAUSE_PUNCTUATION = (",", ")", ";")
CLAUSE_WORDS = (
    "WHERE",
    "GROUP BY",
    "ORDER BY",
    "HAVING",
    "JOIN",
    "LEFT",
    "RIGHT",
    "INNER",
    "FULL",
    "CROSS",
    "UNION",
    "INTERSECT",
    "EXCEPT",
    "LIMIT",
    "QUALIFY",
    "WINDOW",
    "SAMPLE",
    "LATERAL",
    "ON",
    "USING",
    "SET",
    "VALUES",
)
# A column pair right after one of these is a table name.
TABLE_CONTEXT_WORDS = ("FROM", "JOIN", "UPDATE", "INTO", "TABLE", "ONLY")
# How many findings a small panel shows; nothing is limited to this unless asked for.
PANEL_FINDINGS = 8
# (misspelling, correction), numbered from 1; the order is the order in which repairs are applied.
TYPO_RULES = (
    ("FROMM", "FROM"),
    ("FRMO", "FROM"),
    ("LEFFT JOIN", "LEFT JOIN"),
    ("LEFTJOIN", "LEFT JOIN"),
    ("RIGTH JOIN", "RIGHT JOIN"),
    ("RIGHTJOIN", "RIGHT JOIN"),
    ("INNNER JOIN", "INNER JOIN"),
    ("INNERJOIN", "INNER JOIN"),
    ("FULLJOIN", "FULL JOIN"),
    ("CROSSJOIN", "CROSS JOIN"),
    ("OUTTER JOIN", "OUTER JOIN"),
    ("UPDTAE", "UPDATE"),
    ("UPATE", "UPDATE"),
    ("INTOO", "INTO"),
    ("DELETEFROM", "DELETE FROM"),
    ("DELET FROM", "DELETE FROM"),
    ("MERGEINTO", "MERGE INTO"),
    ("TRUNCATETABLE", "TRUNCATE TABLE"),
    ("TRUNCATE TABL", "TRUNCATE TABLE"),
    ("MERGE INTOO", "MERGE INTO"),
)
TABLE_PLACEHOLDER = "redacted.Table_"
COLUMN_PLACEHOLDER = "redacted.Col_"
NO_MAPPING_FOUND = "No mapping found"
NO_MAPPING_YET = "No mapping generated yet."
NO_TYPOS = "No SQL typo warnings."
TYPOS_HEADING = "Potential SQL typos:"
# ---------------------------------------------------------------------------------------------

# White space as the web platform defines it; Java's \s is its ASCII part. The intersection spares
# ordinary characters the test against every rare kind.
_RARE_SPACE = (
    r"\x{A0}[\x{1680}-\x{FEFF}&&"
    r"[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
)
SPACE = rf"[\s{_RARE_SPACE}]"
NOT_SPACE = rf"(?!{SPACE})(?s:.)"
NEWLINE = r"\r\n?"
# Java's \b knows letters beyond ASCII; \w does not.
WORD_START = r"(?<!\w)"
WORD_END = r"(?!\w)"


def _phrase(text: str) -> str:
    """Words of ``text`` separated by any run of white space."""
    return f"{SPACE}++".join(text.split(" "))


def _any_of(phrases) -> str:
    return "(?i:" + "|".join(_phrase(p) for p in phrases) + ")"


def _first_letters(words) -> str:
    letters = "".join(sorted({word[0] for word in words}))
    return letters + letters.lower()


# -- identifiers -------------------------------------------------------------------------------
# A doubled quote belongs to the name; the second form of each covers a name whose closing quote
# only exists if the doubled one is read as two.
_QUOTED = (
    r"(?>\[[^\]]++\]"
    r'|"(?:[^"]++|"")++"|"[^"]++"'
    r"|`(?:[^`]++|``)++`|`[^`]++`)"
)
_BARE = r"[\p{Alpha}_][\w$#]*+"
_IDENTIFIER = f"(?>{_QUOTED}|{_BARE})"
_DOT = rf"{SPACE}*+\.{SPACE}*+"
_MORE_PARTS = f"(?:{_DOT}{_IDENTIFIER})"

# -- text that is never looked into ------------------------------------------------------------
_PROTECTED = (
    r"--[^\n]*+"
    r"|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)"
    r"|'[^']*+(?:''[^']*+)*+(?:'|\z)"
    r'|"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
    r"|`[^`]*+(?:`|\z)"
    r"|\[[^\]]*+(?:\]|\z)"
)

# -- SQL tables --------------------------------------------------------------------------------
_CLAUSE = f"(?:[{''.join(CLAUSE_PUNCTUATION)}]|{_any_of(CLAUSE_WORDS)}{WORD_END})"
_ALIAS = rf"(?>(?i:AS{SPACE}++)?[\p{{Alpha}}_][\w$#]*(?<=\w){WORD_END})"
_TAIL = rf"{SPACE}*+(?:\z|{_CLAUSE}|{_ALIAS}{SPACE}*+(?:\z|{_CLAUSE}))"
_TABLE_PREFIX = (
    f"{WORD_START}{_any_of(TABLE_KEYWORDS)}{SPACE}++(?:(?i:ONLY){SPACE}++(?={_IDENTIFIER}))?+"
)
_TABLE_NAME = f"{_IDENTIFIER}{_MORE_PARTS}*+"
_ACCEPTED_NAME = (
    f"(?>{_QUOTED}{_MORE_PARTS}*+"
    f"|{_BARE}{_MORE_PARTS}++"
    f"|{_BARE}(?={_TAIL}))"
)
_NOT_IMPORT = f"(?!{SPACE}*+(?i:import){WORD_END})"
# Most positions of a text fail on this one test: they start neither protected text nor a word with
# the first letter of a keyword.
_PROTECTED_START = "-/'\"`\\["
_TABLE_GUARD = (
    rf"(?=[{_PROTECTED_START}{_first_letters(TABLE_KEYWORDS)}])(?:(?!\p{{Alpha}})|{WORD_START})"
)

# Groups of the reference patterns: ``ref`` is a reference that may be replaced, ``lead`` the text
# before it that belongs to the match, ``keep`` (or ``context``) text that is copied as it is.
# KEEP_… is the replacement text for everything but the reference.
KEEP_TABLE = "${keep}${lead}"
SQL_TABLE = (
    f"{_TABLE_GUARD}(?:(?<lead>{_TABLE_PREFIX})(?<ref>{_ACCEPTED_NAME}){_NOT_IMPORT}"
    f"|(?<keep>{_TABLE_PREFIX}{_TABLE_NAME}|{_PROTECTED}))"
)
# The same tokens, with names that fail the acceptance rule exposed in a group of their own.
SQL_TABLE_ALL = (
    f"{_TABLE_GUARD}(?:(?<lead>{_TABLE_PREFIX})(?<ref>{_ACCEPTED_NAME}){_NOT_IMPORT}"
    f"|(?<skiplead>{_TABLE_PREFIX})(?<skip>{_TABLE_NAME})"
    f"|(?<keep>{_PROTECTED}))"
)

# -- SQL columns -------------------------------------------------------------------------------
_PAIR = f"{_BARE}{_DOT}{_IDENTIFIER}"
_TABLE_CONTEXT = f"(?=[{_first_letters(TABLE_CONTEXT_WORDS)}])(?:" + "|".join(
    f"(?i:{w}){SPACE}++" for w in TABLE_CONTEXT_WORDS
) + ")"
KEEP_COLUMN = "${keep}${context}${lead}"
_NAME_START = r"(?<![\w$#])"
SQL_COLUMN = (
    rf"(?=[{_PROTECTED_START}\w$#])"
    rf"(?:(?=[{_PROTECTED_START}])(?<keep>{_QUOTED}{_DOT}{_IDENTIFIER}|{_PROTECTED})"
    rf"|{_NAME_START}(?:(?<context>[0-9$#]*+{WORD_START}{_TABLE_CONTEXT}{_PAIR})"
    rf"|(?<lead>[0-9$#]*+)(?<ref>{_PAIR})))"
)
# The left identifier of a matched pair and the dot after it.
COLUMN_HEAD = rf"\A({_BARE}){_DOT}"
# Pairs that are placeholders, or could be taken for one.
_NUMBERED = "(?i:Table|Col)_[0-9]++"
RESERVED_PAIR = (
    rf"\A(?:(?i:redacted)(?![\w$#])"
    rf"|{_BARE}{_DOT}(?:{_NUMBERED}|\"{_NUMBERED}\"|`{_NUMBERED}`|\[{_NUMBERED}\])\z)"
)
# A text of many pairs without this has no reserved pair.
MAY_BE_RESERVED = rf"(?i)(?=[rtc])(?:redacted|{_NUMBERED})"

# -- PySpark tables ----------------------------------------------------------------------------
_CALL = (
    rf"(?:{WORD_START}spark{_DOT}(?:read{_DOT})?table|\.{SPACE}*+(?:saveAsTable|insertInto))"
)
PYSPARK_TABLE = (
    rf"(?i)(?=[s.])(?<lead>{_CALL}{SPACE}*+\({SPACE}*+(?<quote>[\"']))"
    r"(?<ref>[^\"'\\\r\n]++)(?=\k<quote>)"
)
KEEP_PYSPARK = "${lead}"
# A name with a dot and, padding aside, no white space.
PYSPARK_NAME = (
    rf"\A{SPACE}*+(?:(?!{SPACE})[^.])*+\.(?:{NOT_SPACE})*+{SPACE}*+\z"
)
_PYSPARK_HINT_CALLS = (
    f"{WORD_START}spark{_DOT}(?:read{_DOT})?table|\\.{SPACE}*+write{_DOT}(?:saveAsTable|insertInto)"
)
PYSPARK_HINT = rf"(?i)(?=[s.])(?:{_PYSPARK_HINT_CALLS}){SPACE}*+\("

# -- placeholders ------------------------------------------------------------------------------
_PLACEHOLDER = r"redacted\.(?:Table|Col)_[0-9]+"
PLACEHOLDER = f"(?i)(?<ref>{_PLACEHOLDER})"
PLACEHOLDER_WORD = f"(?=[rR]){WORD_START}(?i)(?<ref>{_PLACEHOLDER}){WORD_END}"
PLACEHOLDER_KEY = rf"(?i)\A{_PLACEHOLDER}\z"
IS_TABLE_PLACEHOLDER = r"(?i)\Aredacted\.Table_[0-9]+\z"
# Numbers of the placeholders a script already contains, spelled the way restoring looks for them.
TABLE_NUMBERS = rf"{WORD_START}redacted\.Table_([0-9]+){WORD_END}"
COLUMN_NUMBERS = rf"{WORD_START}redacted\.Col_([0-9]+){WORD_END}"

# -- names anywhere in a text ------------------------------------------------------------------
# A dotted path of bare or quoted parts, wherever it stands: in code, comments or strings. Double quotes may also be those
# of a string around paths, so AUDIT_PATH takes no such parts; AUDIT_QUOTED looks from every place that does not follow a
# dot, whatever the quotes before it are paired with, for a path that may have them.
AUDIT_PART = r"(?>\[[^\]\n]++\]|`[^`\n]++`|" + _BARE + ")"
AUDIT_PATH = rf"(?<![\w$#]){AUDIT_PART}(?:{_DOT}{AUDIT_PART})*+"
AUDIT_QUOTED_PART = r'(?>"(?:[^"\n]++|"")++"|"[^"\n]++"|\[[^\]\n]++\]|`[^`\n]++`|' + _BARE + ")"
AUDIT_BARE = rf"\A{_BARE}"
_AUDIT_FROM = rf"(?=({AUDIT_QUOTED_PART}(?:{_DOT}{AUDIT_QUOTED_PART})*+))"
AUDIT_QUOTED = rf"(?<![\w$#])(?<!\.{SPACE}{{0,9}}){_AUDIT_FROM}"
# A look-behind has a length. Texts with wider gaps after a dot are cut by a pattern that takes such gaps with it.
AUDIT_WIDE_GAP = rf"\.{SPACE}{{10}}"
AUDIT_QUOTED_WIDE = rf"\.{SPACE}++{AUDIT_QUOTED_PART}|(?<![\w$#.]){_AUDIT_FROM}"

# -- quotes and white space -------------------------------------------------------------------------------
IDENTIFIER_QUOTES = r'(?s)\A(?:"(.*)"|`(.*)`|\[(.*)\])\z'
OUTER_SPACE = rf"\A{SPACE}++|{SPACE}++\z"
# Quoted parts are captured and put back, so only white space outside quotes goes.
SPACE_OUTSIDE_QUOTES = rf'("[^"]*+(?:""[^"]*+)*+"|`[^`]*+`|\[[^\]]*+\])|{SPACE}++'

# -- misspellings ------------------------------------------------------------------------------
def typo_pattern(rules) -> str:
    """Any of the misspellings of ``rules``, each as whole words."""
    words = [bad for bad, _ in rules]
    return f"(?=[{_first_letters(words)}]){WORD_START}(?<ref>{_any_of(words)}){WORD_END}"


ANY_TYPO = typo_pattern(TYPO_RULES)
# A rule whose misspelling contains another one (MERGE INTOO contains INTOO) cannot share a scan with
# it: each has to report its own hit.
NESTED_RULES = tuple(
    rule for rule in TYPO_RULES
    if any(bad != rule[0] and f" {bad} " in f" {rule[0]} " for bad, _ in TYPO_RULES)
)
FLAT_RULES = tuple(rule for rule in TYPO_RULES if rule not in NESTED_RULES)
# A rule whose misspelling ends in the correction of an earlier rule (DELET FROM after FROMM -> FROM)
# may have a hit only once that rule has been applied.
FED_RULES = tuple(
    rule for i, rule in enumerate(TYPO_RULES)
    if any(f" {rule[0]} ".endswith(f" {fix} ") for _, fix in TYPO_RULES[:i])
)
