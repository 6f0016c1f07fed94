"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds the forms that they miss.

The field scores whole candidate segments of tokens. Features see a segment as a whole: how many digits and groups it has,
which separators, whether the Luhn sum holds, whether four groups are octets, how "at" and "dot" are written, what the word
before says, and whether it touches its neighbours. A segment has at most MAX_TOKENS tokens, so the sum over all
segmentations (to fit the weights) and the best one (to find spans) are dynamic programmes over places and lengths that
choose boundaries and types together. Tokens outside segments score 0; a segment right after another has a weight of its own.

The weights are fitted by gradient steps on the exact likelihood of ``labelled_sentences()``, a table made here by rule.
Texts are only cut into tokens around digits, @ and written-out "at"; the rest of a text cannot hold a segment.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
#: Tokens on either side of a place that may be part of a segment.
REACH = MAX_TOKENS
STEPS, RATE, L2 = 60, 0.5, 1e-3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_SEED = re.compile("[0-9]+|@")
# A written-out "at" counts if a word and then a dot, written out or not, follow.
_AT = re.compile(r"(?<![^\W\d_])[aA][tT](?=[\s)\]]+[\w-]+(?:\.\w|\s*[(\[]\s*(?:dot|DOT|Dot|\.)|\s+(?:dot|DOT|Dot)(?![^\W\d_])))")
_DOT = ("dot", "DOT", "Dot")
#: Segments of more digits are none of the kinds.
MAX_DIGITS = 24
_NUMERIC = frozenset("+().-/[]")
_MAIL = frozenset("._%+-@()[]")
# Words before a number or address, by what they announce.
CUES = {
    **dict.fromkeys(("tel", "phone", "telephone", "call", "fax", "mobile", "cell", "ring", "telefon", "teléfono", "téléphone", "handy"), 1),
    **dict.fromkeys(("mail", "email", "contact", "write", "address", "correo", "courriel"), 2),
    **dict.fromkeys(("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"), 3),
    **dict.fromkeys(("ip", "host", "server", "addr", "gateway"), 4),
    **dict.fromkeys(("order", "invoice", "id", "version", "isbn", "page", "pages", "date", "no", "number", "ref", "year", "since", "v", "serial"), 5),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its @, so that long stretches without one cost nothing."""
    at, done = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1) if at > done else None
        if domain:
            start = at
            while start > done and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, leftmost and apart within a kind; sorted."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


# Segments and their features.


def _shape(token: str) -> str:
    if "0" <= token[0] <= "9":
        return "d"
    return "w" if token[0].isalpha() else token


@dataclass
class Window:
    tokens: list[str]
    starts: list[int]
    ends: list[int]
    at: set[int]  # tokens that may be the at of an address


def windows(text: str) -> Iterator[Window]:
    """Tokens around the places that may be part of a segment, in stretches apart from each other."""
    ats = {m.start() for m in _AT.finditer(text)} | {m.start() for m in re.finditer("@", text)}
    near, width = [], 40 * REACH  # in characters, generously: it is cut in tokens below
    for place in sorted({m.start() for m in _SEED.finditer(text)} | ats):
        if near and place - width <= near[-1][1]:
            near[-1][1] = place + width
            near[-1][2].append(place)
        else:
            near.append([place - width, place + width, [place]])
    for a, b, places in near:
        found = list(_TOKEN.finditer(text, max(a, 0), min(b, len(text))))
        wanted = set(places)
        seeds = [k for k, m in enumerate(found) if m.start() in wanted]
        k = 0
        while k < len(seeds):
            lo = max(seeds[k] - REACH, 0)
            while k + 1 < len(seeds) and seeds[k + 1] - REACH <= seeds[k] + REACH:
                k += 1
            part = found[lo : seeds[k] + REACH + 1]
            yield Window([m.group() for m in part], [m.start() for m in part], [m.end() for m in part], {i for i, m in enumerate(part) if m.start() in ats})
            k += 1


def _around(w: Window, i: int, j: int) -> list[tuple]:
    cue = 0
    for k in range(i - 1, max(i - 4, -1), -1):
        cue = cue or CUES.get(w.tokens[k].lower(), 0)
    left = i > 0 and w.ends[i - 1] == w.starts[i]
    right = j < len(w.tokens) and w.starts[j] == w.ends[j - 1]
    before = _shape(w.tokens[i - 1]) if left else " "
    after = _shape(w.tokens[j]) if right else " "
    return [("cue", cue), ("left", before if before in "dw@.-/:_#=\"'" else "?" if left else " "), ("right", after if after in "dw@-/:_%" else " ")]


def numeric_features(w: Window, i: int, j: int) -> list[tuple]:
    """Features of a segment of numbers and separators (or written-out dots)."""
    tokens = w.tokens[i:j]
    groups = [t for t in tokens if _shape(t) == "d"]
    digits = "".join(groups)
    marks = {t if t not in _DOT else "dot" for t in tokens if _shape(t) != "d"}
    spaces = sum(w.starts[k] > w.ends[k - 1] for k in range(i + 1, j))
    n = len(digits)
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    sizes = [len(g) for g in groups]
    dated = len(groups) == 3 and sorted(sizes) in ([2, 2, 4], [1, 2, 4], [1, 1, 4], [2, 2, 2]) and n <= 8
    out = [("bias",), ("digits", min(n, 20)), ("groups", min(len(groups), 9)), ("spaces", min(spaces, 4)), ("octets", octets, "." in marks or "dot" in marks or "[" in marks)]
    out += [("luhn", 13 <= n <= 19, luhn(digits) if 13 <= n <= 19 else False), ("date", dated), ("least", min(min(sizes), 5)), ("most", min(max(sizes), 8))]
    out += [("starts", tokens[0] if tokens[0] in "+(" else "00" if digits.startswith("00") else "0" if digits[0] == "0" else "d")]
    out += [("fours", all(s == 4 for s in sizes)), ("ten", n == 10 and sizes[-1] == 4 and len(groups) == 3), ("balanced", tokens.count("(") == tokens.count(")") and tokens.count("[") == tokens.count("]"))]
    out += [("mark", m) for m in marks] + [("marks", min(len(marks), 3))] + [("joint", min(n, 20) // 3, min(len(groups), 5))]
    return out + _around(w, i, j)


def mail_features(w: Window, i: int, j: int, at: int) -> list[tuple]:
    """Features of a segment that may be an address; ``at`` is the place of its only @ or written-out at."""
    tokens = w.tokens[i:j]
    spelled = w.tokens[at] != "@"
    bracket = at > 0 and w.tokens[at - 1] in "([" and at + 1 < j and w.tokens[at + 1] in ")]"
    after = w.tokens[at + 1 : j]
    dot = "." if "." in after else "(dot)" if any(t in _DOT for t in after) and any(t in "([" for t in after) else "dot" if any(t in _DOT for t in after) else "none"
    words = [k for k in range(i, j) if _shape(w.tokens[k]) in "dw" and w.tokens[k] not in _DOT]
    # Two words side by side without a mark, a dot or the at between them do not belong to one address.
    torn = sum(b == a + 1 and at not in (a, b) and w.starts[b] > w.ends[a] for a, b in zip(words, words[1:], strict=False))
    last = tokens[-1]
    spaces = sum(w.starts[k] > w.ends[k - 1] for k in range(i + 1, j))
    out = [("bias",), ("at", spelled, bracket), ("dot", dot), ("form", spelled, bracket, dot), ("torn", min(torn, 2)), ("last", last.isalpha(), min(len(last), 6))]
    out += [("tokens", min(j - i, 12)), ("spaces", min(spaces, 4)), ("balanced", tokens.count("(") == tokens.count(")") and tokens.count("[") == tokens.count("]"))]
    return out + _around(w, i, j)


def candidates(w: Window) -> list[tuple[int, int, int, list[tuple]]]:
    """(kind, from, to, features) of all segments of at most MAX_TOKENS tokens that the kinds' alphabets allow."""
    out, shapes = [], [_shape(t) for t in w.tokens]
    n = len(shapes)
    for i in range(n):
        if shapes[i] in "d+(":
            count = 0
            for j in range(i + 1, min(i + MAX_TOKENS, n) + 1):
                t = w.tokens[j - 1]
                if shapes[j - 1] == "d":
                    count += len(t)
                    if count > MAX_DIGITS:
                        break
                    if count >= 4:
                        common = numeric_features(w, i, j)
                        out += [(kind, i, j, common) for kind in (1, 2, 3)]
                elif t not in _NUMERIC and t not in _DOT:
                    break
        if shapes[i] in "dw":
            at = -1
            for j in range(i + 1, min(i + MAX_TOKENS, n) + 1):
                t = w.tokens[j - 1]
                if j - 1 in w.at:
                    if at >= 0 or j - 1 == i:
                        break
                    at = j - 1
                elif shapes[j - 1] in "dw" and t not in _DOT:
                    if at >= 0:
                        out.append((0, i, j, mail_features(w, i, j, at)))
                elif t not in _MAIL and t not in _DOT:
                    break
    return out


# The field.


def viterbi(n: int, segments: list[tuple[int, int, int, float]], again: float) -> list[tuple[int, int, int]]:
    """The best choice of segments (kind, from, to, score) that do not overlap, over n tokens; ``again`` is the weight of one
    right after another. Ties go to fewer and then to earlier listed segments."""
    by_end: dict[int, list] = {}
    for s in segments:
        by_end.setdefault(s[2], []).append(s)
    # Best score after each token, if it is outside (0) or ends a segment (1), and how that came about.
    best, how = [[0.0, -np.inf]], [[None, None]]
    for p in range(1, n + 1):
        outside = 0 if best[p - 1][0] >= best[p - 1][1] else 1
        inside, by = -np.inf, None
        for kind, i, _, score in by_end.get(p, ()):
            state = 0 if best[i][0] >= best[i][1] + again else 1
            value = best[i][state] + (again if state else 0.0) + score
            if value > inside:
                inside, by = value, (kind, i, state)
        best.append([best[p - 1][outside], inside])
        how.append([outside, by])
    out, p = [], n
    state = 0 if best[n][0] >= best[n][1] else 1
    while p > 0:
        if state == 0:
            state, p = how[p][0], p - 1
        else:
            kind, i, state = how[p][1]
            out.append((kind, i, p))
            p = i
    return out[::-1]


@dataclass
class Model:
    weights: list[dict[tuple, float]]  # by kind
    again: float

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best segmentation, sorted."""
        out = []
        for w in windows(text):
            scored = []
            for kind, i, j, features in candidates(w):
                known = self.weights[kind]
                score = sum(known.get(f, 0.0) for f in features)
                if score > 0:  # a segment below 0 is never part of the best choice, but for ``again`` > 0
                    scored.append((kind, i, j, score))
            out += [(kind, w.starts[i], w.ends[j - 1]) for kind, i, j in viterbi(len(w.tokens), scored, min(self.again, 0.0))]
        return sorted(out)


def _sum(a: np.ndarray, axis: int) -> np.ndarray:
    """Log of the sum of exponentials along an axis; of nothing but -inf it is -inf."""
    top = np.maximum(a.max(axis, keepdims=True), -1e300)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def posterior(score: np.ndarray, place: np.ndarray, again: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability that a segment is chosen with none, and with another, right before it; and each case's log of the sum over
    all segmentations. ``score``: by case, end, length less 1 and kind, -inf where there is none; ``place``: such indexes."""
    cases, n = score.shape[0], score.shape[1] - 1
    whole = _sum(score.reshape(cases, n + 1, MAX_TOKENS, -1), 3)  # over kinds: by case, end and length
    ahead = np.full((cases, n + 1, 2), -np.inf)
    ahead[:, 0, 0] = 0.0
    for p in range(1, n + 1):
        ahead[:, p, 0] = _sum(ahead[:, p - 1], 1)
        k = min(p, MAX_TOKENS)
        entry = np.logaddexp(ahead[:, p - k : p, 0], ahead[:, p - k : p, 1] + again)[:, ::-1]
        ahead[:, p, 1] = _sum(entry + whole[:, p, :k], 1)
    behind = np.full((cases, n + MAX_TOKENS + 1, 2), -np.inf)
    behind[:, n] = 0.0
    ends = np.full((cases, n + MAX_TOKENS + 1, MAX_TOKENS), -np.inf)
    ends[:, : n + 1] = whole
    lengths = np.arange(MAX_TOKENS)
    for p in range(n - 1, -1, -1):
        started = _sum(ends[:, p + 1 + lengths, lengths] + behind[:, p + 1 + lengths, 1], 1)
        behind[:, p, 0] = np.logaddexp(behind[:, p + 1, 0], started)
        behind[:, p, 1] = np.logaddexp(behind[:, p + 1, 0], started + again)
    total = _sum(ahead[:, n], 1)
    case, end, less, _ = place.T
    start = end - less - 1
    value = score[tuple(place.T)] + behind[case, end, 1] - total[case]
    first, second = np.exp(ahead[case, start, 0] + value), np.exp(ahead[case, start, 1] + again + value)
    return first, second, total


def train(sentences: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS) -> Model:
    """Weights of the segment features that make the marked segments likely, all sentences at once."""
    names: dict[tuple, int] = {}
    rows, wanted, sizes, cases = [], [], [], 0
    for text, spans in sentences:
        marked = set(spans)
        for w in windows(text):
            found = candidates(w)
            if not found:
                continue
            rows += [(cases, kind, i, j, [names.setdefault((kind, x), len(names)) for x in f]) for kind, i, j, f in found]
            wanted += [(kind, w.starts[i], w.ends[j - 1]) in marked for kind, i, j, _ in found]
            sizes.append(len(w.tokens))
            cases += 1
    if not rows:
        return Model([{} for _ in KINDS], 0.0)
    n, truth = max(sizes), np.array(wanted)
    place = np.array([(c, j, j - i - 1, kind) for c, kind, i, j, _ in rows])
    flat = np.concatenate([np.array(f) for *_, f in rows])
    owner = np.repeat(np.arange(len(rows)), [len(f) for *_, f in rows])
    weights, again = np.zeros(len(names)), 0.0
    squares, again_squares = np.full(len(weights), 1e-8), 1e-8
    right_after = sum(truth[k] and any(truth[m] and rows[m][0] == rows[k][0] and rows[m][3] == rows[k][2] for m in range(max(0, k - 200), k)) for k in range(len(rows)))
    for _ in range(steps):
        score = np.full((cases, n + 1, MAX_TOKENS, len(KINDS)), -np.inf)
        score[tuple(place.T)] = np.bincount(owner, weights[flat], minlength=len(rows))
        first, second, _ = posterior(score, place, again)
        slope = np.bincount(flat, (truth - first - second)[owner], minlength=len(weights)) - L2 * len(rows) * weights / len(weights)
        squares += slope * slope
        weights += RATE * slope / np.sqrt(squares)
        again_slope = right_after - second.sum()
        again_squares += again_slope**2
        again += RATE * again_slope / np.sqrt(again_squares)
    known: list[dict] = [{} for _ in KINDS]
    for (kind, feature), k in names.items():
        known[kind][feature] = float(weights[k])
    return Model(known, float(again))


def labelled_sentences(count: int = 700, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A labelled table made by rule: numbers and addresses in many forms, and others that only look alike, among words."""
    pick = random.Random(seed)
    number = lambda k: "".join(pick.choice("0123456789") for _ in range(k))
    word = lambda: "".join(pick.choice("abcdefghilmnoprstuvé") for _ in range(pick.randint(2, 9)))
    name = lambda: word().replace("é", "e")
    octet = lambda: str(pick.randint(0, 255))

    def card(size: int) -> str:
        body = number(size - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def apart(digits: str, mark: str, size: int = 4) -> str:
        return mark.join(digits[k : k + size] for k in range(0, len(digits), size))

    def not_a_card(size: int) -> str:
        while luhn(digits := number(size)):
            pass
        return digits

    a, d, e = number, octet, name
    forms: list[tuple[int, list]] = [
        (0, [lambda: f"{e()}.{e()}@{e()}.com", lambda: f"{e()}{a(2)}@{e()}.{e()}.org", lambda: f"{e()} (at) {e()} (dot) com", lambda: f"{e()} at {e()} dot org", lambda: f"{e()}[at]{e()}.net",
             lambda: f"{e()} (at) {e()}.de", lambda: f"{e()}.{e()} [at] {e()} [dot] {e()} [dot] uk", lambda: f"{e()} @ {e()}.com", lambda: f"{e()} AT {e()} DOT com"]),
        (1, [lambda: f"{d()}.{d()}.{d()}.{d()}", lambda: f"{d()}[.]{d()}[.]{d()}[.]{d()}", lambda: f"{d()} dot {d()} dot {d()} dot {d()}", lambda: f"{d()}(.){d()}(.){d()}(.){d()}"]),
        (2, [lambda: card(16), lambda: apart(card(16), "-"), lambda: apart(card(16), " "), lambda: apart(card(16), "."), lambda: apart(card(16), " - "), lambda: apart(card(15), "/", 5), lambda: apart(card(16), "  ")]),
        (3, [lambda: f"+{a(1)} ({a(3)}) {a(3)}-{a(4)}", lambda: f"({a(3)}) {a(3)}-{a(4)}", lambda: f"{a(3)}-{a(3)}-{a(4)}", lambda: f"{a(3)}.{a(3)}.{a(4)}", lambda: f"00{pick.randint(1, 9)}{a(1)} {a(2)} {a(7)}",
             lambda: f"0{a(2)}/{a(7)}", lambda: f"+{pick.randint(1, 9)}{a(1)} {a(2)} {a(7)}", lambda: f"0{a(3)} {a(3)} {a(4)}", lambda: f"+{pick.randint(1, 9)}{a(11)}"]),
    ]
    others = [
        lambda: f"{pick.randint(1900, 2090)}-{pick.randint(10, 12)}-{pick.randint(10, 28)}", lambda: f"{pick.randint(1, 28)}.{pick.randint(1, 12)}.{pick.randint(1900, 2090)}", lambda: f"{pick.randint(10, 23)}:{a(2)}",
        lambda: f"{pick.randint(1, 999)},{a(3)}.{a(2)}", lambda: f"{pick.randint(10, 99)}-{a(3)}", lambda: a(pick.randint(1, 12)), lambda: not_a_card(16), lambda: apart(not_a_card(16), " "), lambda: apart(not_a_card(16), "-"),
        lambda: f"978-{a(1)}-{a(2)}-{a(6)}-{a(1)}", lambda: f"{a(1)}.{a(1)}.{a(2)}", lambda: f"{a(1)}.{a(2)}.{a(1)}.{a(1)}.{a(2)}", lambda: f"at {e()}", lambda: f"{e()} at {e()}", lambda: f"{e()} at {e()} and {e()}. {e()}",
        lambda: f"@{e()}", lambda: "".join(pick.choice("0123456789abcdef") for _ in range(32)), lambda: "".join(pick.choice("0123456789ABCDEF") for _ in range(40)), lambda: f"{a(3)}.{pick.randint(256, 999)}.{a(3)}.{a(3)}",
        lambda: f"{a(pick.randint(17, 24))}", lambda: f"({pick.randint(1900, 2090)})", lambda: f"{a(2)}/{a(2)}", lambda: f"{a(3)} {a(3)}", lambda: f"{a(4)} - {a(4)}", lambda: f"{a(2)} %", lambda: f"{e()}{a(16)}", lambda: f"{a(4)}{e()}{a(4)}",
    ]
    cues = {0: ("mail", "write", "contact"), 1: ("ip", "host", "server"), 2: ("card", "visa"), 3: ("tel", "phone", "call", "fax"), 5: ("order", "id", "version", "isbn", "page")}
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(pick.randint(0, 4))), []
        for _ in range(pick.randint(1, 2)):
            kind = pick.choice((0, 1, 2, 3, 5, 5, 5))
            item = pick.choice(others if kind == 5 else forms[kind][1])()
            if pick.random() < 0.3:
                text += " " + pick.choice(cues[kind]) + pick.choice(("", ":", "."))
            text += pick.choice((" ", " ", "\n")) if text else ""
            if kind != 5:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + pick.choice(("", "", ".", ",", "!"))
            text += "".join(" " + word() for _ in range(pick.randint(1, 4)))
        out.append((text, spans))
    return out


def fit() -> Model:
    return train(labelled_sentences())


def all_spans(text: str, model: Model) -> tuple[list, list]:
    """The spans of the fixed patterns, and those with what the field adds: its segments that overlap none of them."""
    base = base_spans(text)
    added, taken = [], sorted((a, b) for _, a, b in base)
    k, reach = 0, 0
    for kind, a, b in sorted(model.spans(text), key=lambda s: s[1]):
        while k < len(taken) and taken[k][0] < b:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= a:
            added.append((kind, a, b))
    return base, sorted(base + added)


def may_hold(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts, given as bytes and offsets, have a digit, an @, or "at" not within a word of ASCII letters at all."""
    low = K.lowered(data)
    letter = (low >= 97) & (low <= 122)
    seed = (low >= 48) & (low <= 57) | (low == 64)
    pair = (low[:-1] == 97) & (low[1:] == 116)
    pair[1:] &= ~letter[:-2]
    pair[:-1] &= ~letter[2:]
    seed[:-1] |= pair
    # Texts that meet at their ends may look like one more, never like one less: a letter of the next text hides no "at".
    ends = at[1:][np.diff(at) > 1]
    seed[ends - 2] |= (low[ends - 2] == 97) & (low[ends - 1] == 116)
    starts = at[:-1][np.diff(at) > 1]
    seed[starts] |= (low[starts] == 97) & (low[starts + 1] == 116)
    return K.sums(seed, at) > 0


def find_personal_data(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep``, ``base`` and ``spans`` for every row of ``docs``: array<struct<kind, start, end>>, by kind (email,
    ip, card, phone) and start, in characters, end exclusive.

    ``base`` are the spans of the fixed patterns; ``spans`` has these and what the field adds. A null or empty text has
    none. Rows that repeat are treated alike; other columns are not returned, whatever their names.
    """
    plain = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            if not batch.num_rows:
                continue
            both, texts = ([], []), batch.column(batch.num_columns - 1)
            some = np.concatenate([may_hold(data, at) for _, _, data, at in K.pieces(texts)])
            for t, worth in zip(texts, some, strict=True):
                found = all_spans(t.as_py(), model) if worth else ([], [])
                for out, spans in zip(both, found, strict=True):
                    out.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, listed) for x in both)], names=[*batch.schema.names[:-1], "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{types}base {kind}, spans {kind}")
