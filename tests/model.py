"""A character-by-character model of the rules in plain Python, for small texts only.

It shares neither patterns nor code with the library: keywords are recognised by comparing words,
names by walking over characters.
"""

SPACES = set("\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff") | {
    chr(c) for c in range(0x2000, 0x200B)
}
LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
DIGITS = set("0123456789")
WORD = LETTERS | DIGITS
NAME = WORD | set("$#")
CLOSING = {'"': '"', "`": "`", "[": "]"}
# The keywords and clauses of the rules.
KEYWORD_PHRASES = ("FROM", "JOIN", "UPDATE", "INTO", "MERGE INTO", "DELETE FROM", "TRUNCATE TABLE")
CLAUSE_PHRASES = (
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
KEYWORDS = [phrase.split() for phrase in KEYWORD_PHRASES]
CLAUSES = [phrase.split() for phrase in CLAUSE_PHRASES]


def spaces(text, i):
    while i < len(text) and text[i] in SPACES:
        i += 1
    return i


def is_word_at(text, i, word):
    """End of ``word`` at ``i`` as a whole word, or None."""
    end = i + len(word)
    if text[i:end].upper() != word or not text[i:end].isascii():
        return None
    if i and text[i - 1] in WORD or end < len(text) and text[end] in WORD:
        return None
    return end


def phrase_at(text, i, words):
    end = is_word_at(text, i, words[0])
    for word in words[1:]:
        if end is None:
            return None
        start = spaces(text, end)
        end = is_word_at(text, start, word) if start > end else None
    return end


def bare(text, i):
    if i >= len(text) or text[i] not in LETTERS:
        return None
    while i < len(text) and text[i] in NAME:
        i += 1
    return i


def quoted(text, i):
    """End of a quoted identifier with at least one character inside."""
    if i >= len(text) or text[i] not in CLOSING:
        return None
    close = CLOSING[text[i]]
    j, first_close = i + 1, None
    while j < len(text):
        if text[j] != close:
            j += 1
        elif close != "]" and text[j : j + 2] == close * 2:
            if first_close is None and j > i + 1:
                first_close = j + 1
            j += 2
        else:
            return j + 1 if j > i + 1 else None
    return first_close


def identifier(text, i):
    return quoted(text, i) or bare(text, i)


def dotted(text, i, limit=None):
    """End of all further parts, or of up to ``limit``, and how many there are."""
    count = 0
    while limit is None or count < limit:
        dot = spaces(text, i)
        if text[dot : dot + 1] != ".":
            break
        end = identifier(text, spaces(text, dot + 1))
        if end is None:
            break
        i, count = end, count + 1
    return i, count


def protected(text, i):
    """End of a comment, string or quoted text starting at ``i``, or None."""
    if text.startswith("--", i):
        end = text.find("\n", i)
        return len(text) if end < 0 else end
    if text.startswith("/*", i):
        end = text.find("*/", i + 2)
        return len(text) if end < 0 else end + 2
    if text[i] in "'\"`[":
        close = {"[": "]"}.get(text[i], text[i])
        j = i + 1
        while j < len(text):
            if text[j] == close:
                if close in "'\"" and text[j + 1 : j + 2] == close:
                    j += 2
                    continue
                return j + 1
            j += 1
        return len(text)
    return None


def clause_at(text, i):
    return text[i : i + 1] in tuple(",);") and i < len(text) or any(
        phrase_at(text, i, c) for c in CLAUSES
    )


def accepts_tail(text, i):
    i = spaces(text, i)
    if i == len(text) or clause_at(text, i):
        return True
    start = i
    as_end = i + 2 if text[i : i + 2].upper() == "AS" else None
    if as_end and spaces(text, as_end) > as_end and bare(text, spaces(text, as_end)):
        start = spaces(text, as_end)
    end = bare(text, start)
    if end is None:
        return False
    while end > start and text[end - 1] not in WORD:
        end -= 1
    rest = spaces(text, end)
    return rest == len(text) or clause_at(text, rest)


def table_at(text, i):
    """(start of the name, its end, accepted) if a keyword with a name starts at ``i``."""
    for words in KEYWORDS:
        end = phrase_at(text, i, words)
        if end is None:
            continue
        start = spaces(text, end)
        if start == end:
            continue
        only = is_word_at(text, start, "ONLY")
        if only and spaces(text, only) > only and identifier(text, spaces(text, only)):
            start = spaces(text, only)
        first = identifier(text, start)
        if first is None:
            continue
        end, more = dotted(text, first)
        name = text[start:end]
        if is_word_at(text, spaces(text, end), "IMPORT"):
            accepted = False
        elif is_placeholder(name, ("redacted.table_",)):
            accepted = False
        else:
            accepted = more > 0 or text[start] in CLOSING or accepts_tail(text, end)
        return start, end, accepted
    return None


def is_placeholder(name, prefixes):
    for prefix in prefixes:
        digits = name[len(prefix) :]
        if name.lower().startswith(prefix) and digits and set(digits) <= DIGITS:
            return True
    return False


def canonical(name):
    out, i = "", 0
    while i < len(name):
        end = quoted(name, i) if name[i] in CLOSING else None
        if end:
            out, i = out + name[i:end], end
        else:
            out, i = out + ("" if name[i] in SPACES else name[i]), i + 1
    return out.lower()


def table_refs(text):
    refs, i = [], 0
    while i < len(text):
        hit = table_at(text, i)
        if hit:
            refs.append(hit)
            i = hit[1]
        else:
            i = protected(text, i) or i + 1
    return refs


def pair_at(text, i):
    end = bare(text, i)
    if end is None:
        return None
    dot = spaces(text, end)
    if text[dot : dot + 1] != ".":
        return None
    right = spaces(text, dot + 1)
    stop = identifier(text, right)
    return None if stop is None else (text[i:end], text[right:stop], stop)


def column_refs(text):
    refs, i = [], 0
    while i < len(text):
        if text[i] in CLOSING:
            end, more = (quoted(text, i), 0) if quoted(text, i) else (None, 0)
            if end:
                end, more = dotted(text, end, 1)
            i = end if more else protected(text, i)
            continue
        skip = protected(text, i)
        if skip:
            i = skip
            continue
        context = next(
            (
                e
                for w in ("FROM", "JOIN", "UPDATE", "INTO", "TABLE", "ONLY")
                if (e := i + len(w))
                and text[i:e].upper() == w
                and not (i and text[i - 1] in WORD)
                and spaces(text, e) > e
                and pair_at(text, spaces(text, e))
            ),
            None,
        )
        if context:
            i = pair_at(text, spaces(text, context))[2]
            continue
        in_name = i and text[i - 1] in NAME and not only_digits_before(text, i)
        pair = None if in_name else pair_at(text, i)
        if not pair:
            i += 1
            continue
        left, right, stop = pair
        inner = right[1:-1] if right[0] in CLOSING else right
        accepted = left.lower() != "redacted" and not is_placeholder(inner, ("table_", "col_"))
        refs.append((i, stop, f"{left}.{right}", accepted))
        i = stop
    return refs


def only_digits_before(text, i):
    """True if the run of name characters before ``i`` has no letter."""
    j = i
    while j and text[j - 1] in NAME:
        j -= 1
        if text[j] in LETTERS:
            return False
    return True


def taken(text, prefix):
    numbers, i = set(), text.find(prefix)
    while i >= 0:
        j = i + len(prefix)
        while j < len(text) and text[j] in DIGITS:
            j += 1
        whole = not (i and text[i - 1] in WORD) and not (j < len(text) and text[j] in WORD)
        if whole and j > i + len(prefix):
            numbers.add(text[i + len(prefix) : j])
        i = text.find(prefix, i + 1)
    return numbers


def replace(text, hits, prefix):
    """``hits``: (start, end, reference, accepted)."""
    used, names, mapping, out, at, n = taken(text, prefix), {}, {}, "", 0, 0
    for start, end, ref, accepted in hits:
        if not accepted:
            continue
        key = canonical(ref)
        if key not in names:
            n += 1
            while str(n) in used:
                n += 1
            names[key] = f"{prefix}{n}"
            mapping[names[key]] = ref
        out += text[at:start] + names[key]
        at = end
    return out + text[at:], mapping


def redact_tables(text):
    return replace(text, [(s, e, text[s:e], ok) for s, e, ok in table_refs(text)], "redacted.Table_")


def redact_columns(text):
    return replace(text, column_refs(text), "redacted.Col_")
