"""Periodic runs of words: a suffix automaton whose link tree is recoloured by link-cut access, word by word.

The suffix links of the automaton form a tree, and the prefix that ends at a word is a path in it up to the root. Every
path segment carries the place where its strings were last seen. Access to a word's prefix walks up through the segments
and recolours them. A segment of strings up to ``k`` words long that was last seen ``d`` words ago is a square if
``k >= d``: the last ``k + d`` words have period ``d``, and none smaller, since the string was not seen in between. With
``k >= (LEAST - 1) d`` the stretch is long enough to be a run; it then reaches ``k + d`` words back, and is extended onward
as far as the period holds. Segments are splay trees, so n words cost O(n log n) steps altogether.

Where a run lies, every three words in a row occur three times or more in the text, so all else is set aside first, by
counting 64-bit hashes of three words; what is left is a small part of ordinary texts. No run is lost that way, and what
is found by the automaton is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: A run is at least so many periods, and so many words, long.
LEAST, LEAST_WORDS = 4, 6
GRAM = 3


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, longest string, state of each prefix); state 0 holds the empty string."""
    follow: list[dict] = [{}]
    link, longest, prefix = [-1], [0], []
    last = 0
    for w in word:
        new = len(link)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p >= 0:
            q = follow[p][w]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                follow.append(dict(follow[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and follow[p].get(w) == q:
                    follow[p][w] = copy
                    p = link[p]
        prefix.append(new)
        last = new
    return link, longest, prefix


class LastSeen:
    """The link tree, cut into paths of strings last seen at the same place; each path is a splay tree by depth."""

    def __init__(self, link: list[int]):
        n = len(link)
        self.up = [p if p > 0 else -1 for p in link]  # in a splay tree the parent, at its root the path above; no root state
        self.shallow, self.deep = [-1] * n, [-1] * n
        self.seen = [-1] * n  # valid at the root of a splay tree

    def _turn(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        p = up[x]
        g = up[p]
        if shallow[p] == x:
            c = shallow[p] = deep[x]
            deep[x] = p
        else:
            c = deep[p] = shallow[x]
            shallow[x] = p
        if c >= 0:
            up[c] = p
        up[p], up[x] = x, g
        if g >= 0:
            if shallow[g] == p:
                shallow[g] = x
            elif deep[g] == p:
                deep[g] = x

    def _splay(self, x: int) -> None:
        """Make x the root of its path's tree."""
        up, shallow, deep = self.up, self.shallow, self.deep
        top = x
        while up[top] >= 0 and (shallow[up[top]] == top or deep[up[top]] == top):
            top = up[top]
        if top == x:
            return
        seen = self.seen[top]
        above = up[top]
        while up[x] != above or shallow[above] == x or deep[above] == x:
            p = up[x]
            g = up[p]
            if p != top:
                self._turn(p if (shallow[g] == p) == (shallow[p] == x) else x)
            self._turn(x)
            if p == top or g == top:
                break
        self.seen[x] = seen

    def access(self, x: int, place: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from x to the root; yields (deepest state, place last seen) of the segments it had."""
        up, deep, seen = self.up, self.deep, self.seen
        below = -1
        while x >= 0:
            self._splay(x)
            yield x, seen[x]
            if deep[x] >= 0:  # strings longer than this path's stay as they were
                seen[deep[x]] = seen[x]
            deep[x] = below
            seen[x] = place
            below, x = x, up[x]


def runs_of(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of some words, given as numbers, by start and period."""
    n = len(word)
    if n < LEAST_WORDS:
        return []
    link, longest, prefix = suffix_automaton(word)
    paths = LastSeen(link)
    found, reached = [], {}
    for r, x in enumerate(prefix):
        for state, seen in paths.access(x, r):
            d, k = r - seen, longest[state]
            if seen < 0 or k < (LEAST - 1) * d or r < reached.get(d, 0):
                continue
            end = r + 1
            while end < n and word[end] == word[end - d]:
                end += 1
            reached[d] = end
            start = r + 1 - k - d
            if end - start >= LEAST_WORDS:
                found.append((start, end - start, d))
    return sorted(found)


def _repetitive(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words all whose three words in a row occur three times or more in their text."""
    three, begin = K.runs(key, rows, GRAM)
    _, inverse, count = np.unique(K.mix(three + rows[begin].astype(K.U) * K.U(0xA0761D6478BD642F)), return_inverse=True, return_counts=True)
    often = begin[count[inverse] >= 3]
    if not len(often):
        return often, often
    cut = np.flatnonzero((np.diff(often) != 1) | (rows[often[1:]] != rows[often[:-1]])) + 1
    starts, ends = often[np.concatenate([[0], cut])], often[np.concatenate([cut - 1, [len(often) - 1]])] + GRAM
    wide = ends - starts >= LEAST_WORDS
    return starts[wide], ends[wide]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space = K.separators("spaces")
    for batch in batches:
        for lo, hi, data, at in K.pieces(batch.column(batch.num_columns - 1)):
            starts, ends, rows = K.spans(data, at, space)
            first = np.searchsorted(rows, np.arange(hi - lo + 1))
            raw = data.tobytes()
            runs: dict[int, list] = {}
            for a, b in zip(*(x.tolist() for x in _repetitive(K.span_hashes(data, starts, ends), rows)), strict=True):
                numbers: dict[bytes, int] = {}
                word = [numbers.setdefault(raw[i:j], len(numbers)) for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                row = int(rows[a])
                runs.setdefault(row, []).extend((a - int(first[row]) + s, n, q) for s, n, q in runs_of(word))
            collapsed = []
            for row in range(hi - lo):
                text = raw[at[row] : at[row + 1]].split()
                if row in runs:
                    drop = np.zeros(len(text) + 1, np.int64)
                    for s, n, q in runs[row]:
                        drop[s + q] += 1
                        drop[s + n] -= 1
                    text = [w for w, d in zip(text, np.cumsum(drop).tolist(), strict=False) if not d]
                collapsed.append(b" ".join(text).decode())
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(runs.get(row, ()))] for row in range(hi - lo)]
            kept = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            counts = pa.array(np.diff(first), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*kept, counts, pa.array(listed, kind), pa.array(collapsed, pa.string())], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"]
            )


def periodic_runs(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, ``n_words``, ``runs`` and ``collapsed``, for every row of ``docs``.

    Words are what lies between white space (six ASCII characters), compared as they are. A run is a stretch of words with
    smallest period q, at least 4 q and at least 6 words long, that no neighbouring word extends; ``runs`` is an
    array<struct<start, length, period>> in words, by start and period. ``collapsed`` is the text without what follows the
    first period of any run, words joined by one space. A null or empty text has no words, no runs and an empty collapsed
    text. Rows that repeat are treated alike. Other columns are not returned, whatever their names.

    The work for a text grows with n log n; the automaton takes about 1 KB a word of the repetitive stretch at hand.
    """
    plain = docs.select(*keep, F.col("text").alias("__text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(_find, f"{types}n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
