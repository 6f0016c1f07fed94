"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A leaf stands for a run of up to LEAF pre-tokens and holds their characters and tokens; inner nodes hold sums. The tree is
two arrays in heap order (children of node i: 2i and 2i + 1; leaves from the middle on), so it is an ordinary row. An edit
is located by descending the character sums. Only the leaves it touches are cut into pre-tokens and encoded again,
with enough text before them that no earlier boundary can depend on the edit, and after them up to the first place where
a new boundary meets an old leaf boundary: from there on the text is the same, and so are its pre-tokens. Then the sums
on the paths to the root are updated. Everything is local to a row; nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts texts into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 16
#: A leaf that grows beyond this many pre-tokens makes the tree be laid out anew (nothing is encoded for that).
LARGEST_LEAF = 4 * LEAF
#: Most characters that the pattern looks at beyond a pre-token, white space apart.
AHEAD = 3
#: Counts remembered by a task; beyond that it forgets them all and begins again.
REMEMBERED = 1 << 18


class Counter:
    """Cuts texts into pre-tokens and counts their tokens, remembering counts of pre-tokens."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Tree:
    """Character and token sums in heap order. ``size`` is the number of leaf places, a power of two."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray, pieces: np.ndarray) -> None:
        self.chars, self.tokens, self.pieces, self.size = chars, tokens, pieces, len(chars) // 2

    @classmethod
    def of(cls, chars: list[int] | np.ndarray, tokens: list[int] | np.ndarray, pieces: list[int] | np.ndarray) -> Tree:
        size = 1 << max(0, len(chars) - 1).bit_length()
        heaps = []
        for leaves in (chars, tokens, pieces):
            heap = np.zeros(2 * size, np.int64)
            heap[size : size + len(leaves)] = leaves
            level = size
            while level > 1:
                heap[level // 2 : level] = heap[level : 2 * level : 2] + heap[level + 1 : 2 * level : 2]
                level //= 2
            heaps.append(heap)
        return cls(*heaps)

    def find(self, position: int) -> tuple[int, int]:
        """Number and start of the leaf that holds a character; the last leaf with characters if there is none."""
        node, start = 1, 0
        while node < self.size:
            left = self.chars[2 * node]
            if position < start + left or self.chars[2 * node + 1] == 0:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.size, int(start)

    def put(self, leaf: int, chars: int, tokens: int, pieces: int) -> None:
        node = leaf + self.size
        for heap, value in ((self.chars, chars), (self.tokens, tokens), (self.pieces, pieces)):
            change, at = value - heap[node], node
            while at:
                heap[at] += change
                at //= 2

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        used = self.pieces[self.size :] > 0
        return self.chars[self.size :][used], self.tokens[self.size :][used], self.pieces[self.size :][used]


def build(text: str, counter: Counter) -> Tree:
    cut = counter.cut(text)
    if not cut:
        return Tree.of([0], [0], [0])
    at = np.arange(0, len(cut), LEAF)
    counts = np.fromiter(map(counter.count, cut), np.int64, len(cut))
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    return Tree.of(np.add.reduceat(lengths, at), np.add.reduceat(counts, at), np.diff(np.append(at, len(cut))))


def edit(text: str, tree: Tree, start: int, end: int, insert: str, counter: Counter) -> tuple[str, Tree, int]:
    """The text and tree after text[start:end] became ``insert``, and how many characters were encoded again."""
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    new, shift = text[:start] + insert + text[end:], len(insert) - (end - start)
    first, begin = tree.find(start)
    # No boundary up to ``begin`` may depend on what was edited: white space is looked through, and AHEAD more.
    while first > 0 and not text[begin : max(begin, start - AHEAD)].strip():
        first -= 1
        begin -= int(tree.chars[tree.size + first])
    last, stop = tree.find(max(start, end - 1))
    stop += int(tree.chars[tree.size + last])  # end of the leaf of the edit's last character
    settled = start + len(insert)
    cut, at = [], begin
    for m in counter.pattern.finditer(new, begin):
        cut.append(m.group())
        at = m.end()
        while stop + shift < at and stop < len(text):  # boundaries no longer agree here: take in the next leaf
            last += 1
            stop += int(tree.chars[tree.size + last])
        if at >= settled and at == stop + shift:
            break
    else:
        last = tree.size - 1
    counts, lengths = [counter.count(p) for p in cut], [len(p) for p in cut]
    places = last - first + 1
    used = int(np.count_nonzero(tree.pieces[tree.size + first : tree.size + last + 1])) or 1
    share = -(-len(cut) // used)
    if share > LARGEST_LEAF or len(new) == 0:
        before = [h[tree.size : tree.size + first] for h in (tree.chars, tree.tokens, tree.pieces)]
        after = [h[tree.size + last + 1 :] for h in (tree.chars, tree.tokens, tree.pieces)]
        runs = [range(i, min(i + LEAF, len(cut))) for i in range(0, len(cut), LEAF)]
        middle = [[sum(lengths[i] for i in r) for r in runs], [sum(counts[i] for i in r) for r in runs], [len(r) for r in runs]]
        whole = [np.concatenate([b, np.array(m, np.int64), a]) for b, m, a in zip(before, middle, after, strict=True)]
        filled = whole[2] > 0
        tree = Tree.of(*(w[filled] for w in whole)) if filled.any() else Tree.of([0], [0], [0])
    else:
        for k in range(places):  # empty leaves are allowed anywhere
            part = slice(k * share, (k + 1) * share) if share else slice(0, 0)
            tree.put(first + k, sum(lengths[part]), sum(counts[part]), len(cut[part]))
    return new, tree, at - begin if cut else 0


TREE = "chars array<bigint>, tokens array<bigint>, pieces array<bigint>"


def _counter(vocabulary: bytes) -> Callable[[], Counter]:
    made: list[Counter] = []

    def get() -> Counter:
        if not made:
            made.append(Counter(vocabulary))
        return made[0]

    return get


def _types(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def token_trees(docs: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep``, ``text``, the tree (``chars``, ``tokens``, ``pieces``) and ``n_tokens`` for every row.

    The root is element 1 of each array. A null or empty text has one leaf of zeros. ``vocabulary`` is a file that the
    driver reads; executors get its content.
    """
    with open(vocabulary, "rb") as f:
        counter = _counter(f.read())
    plain = docs.select(*keep, F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                trees = [build(t.as_py() or "", counter()) for t in part.column(part.num_columns - 1)]
                heaps = [_lists([getattr(t, k) for t in trees]) for k in ("chars", "tokens", "pieces")]
                total = pa.array([int(t.tokens[1]) for t in trees], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, *heaps, total], names=[*part.schema.names, "chars", "tokens", "pieces", "n_tokens"])

    return plain.mapInArrow(run, f"{_types(plain)}{TREE}, n_tokens bigint")


def apply_edits(trees: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of ``token_trees`` after their ``edits``: array<struct<start bigint, length bigint, insert string>>.

    Edits apply one after another, each in characters of the text as it is by then; places beyond the text mean its end,
    null parts mean 0 or nothing. A null text stays null and has no tokens whatever its edits. Null or no edits change
    nothing. Returned are ``keep``, text, the tree, n_tokens and ``encoded``, the characters that were encoded again.
    """
    with open(vocabulary, "rb") as f:
        counter = _counter(f.read())
    plain = trees.select(*keep, "edits", "chars", "tokens", "pieces", "text")
    kept = plain.select(*keep)
    names = [*kept.columns, "text", "chars", "tokens", "pieces", "n_tokens", "encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                edits, chars, tokens, pieces, texts = (batch.column(len(keep) + i) for i in range(5))
                out: list[tuple[str | None, Tree, int]] = []
                for i in range(batch.num_rows):
                    tree = Tree(*(np.array(x[i].values.to_numpy(zero_copy_only=False)) for x in (chars, tokens, pieces)))
                    text, encoded = texts[i].as_py(), 0
                    for e in (edits[i].as_py() or []) if text is not None else []:
                        if e is not None:
                            begin = e["start"] or 0
                            text, tree, n = edit(text, tree, begin, begin + (e["length"] or 0), e["insert"] or "", counter())
                            encoded += n
                    out.append((text, tree, encoded))
                heaps = [_lists([getattr(t, k) for _, t, _ in out]) for k in ("chars", "tokens", "pieces")]
                ends = [pa.array([int(t.tokens[1]) for _, t, _ in out], pa.int64()), pa.array([n for _, _, n in out], pa.int64())]
                columns = [*batch.columns[: len(keep)], pa.array([t for t, _, _ in out], pa.string()), *heaps, *ends]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return plain.mapInArrow(run, f"{_types(kept)}text string, {TREE}, n_tokens bigint, encoded bigint")
