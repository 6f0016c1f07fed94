"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from refmask.llm.spelling import boundaries, neighbours, spelling_variants, word_counts


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(counts, ratio=10):
    form, out = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best
        out[w] = len(near)
    rows = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, out[w], counts[form[w]] if w in form else None))
    return rows


def test_levels_end():
    assert boundaries(7, 9) == [3, 4, 5, 6, 7, 8, 10]
    assert len(boundaries(7, 100_000)) < 60


@pytest.mark.parametrize("least,letters,sizes", [(7, "ab", (7, 9)), (2, "abé", (2, 5)), (7, "abcd", (7, 30))])
def test_neighbours_are_all_pairs_one_edit_apart(spark, least, letters, sizes):
    random.seed(least)
    words = set()
    while len(words) < 250:
        w = "".join(random.choice(letters) for _ in range(random.randint(*sizes)))
        words.add(w)
        k = random.randrange(len(w))
        words |= {v for v in (w[:k] + w[k + 1 :], w[:k] + random.choice(letters) + w[k:]) if len(v) >= least}
    got = {tuple(r) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string"), least).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)} and len(got) > 100


def test_variants_equal_all_pairs(spark):
    random.seed(4)
    words = sorted({"".join(random.choice("ab") for _ in range(random.randint(7, 8))) for _ in range(150)})
    counts = {w: int(10 ** random.uniform(0.3, 6)) for w in words}
    rows = [(w, n) for w, n in counts.items()]
    rows += [("longword", 5), ("longword", 6), (None, 9), ("short", 9)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "word string, n long, form string, root int")
    got = spelling_variants(table)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(counts | {"longword": 11})
    assert {tuple(r) for r in got.collect()} == want
    assert sum(r[1] is not None for r in want) > 30 and sum(r[1] != r[2] for r in want if r[1]) > 3
    assert spelling_variants(table.limit(0)).count() == 0


def test_very_long_words(spark):
    long = "".join(random.Random(5).choice("abcdef") for _ in range(5000))
    words = [long, long[:2000] + long[2001:], "x" + long, long + "y", long[:-1] + "z", "a" * 300, "a" * 301, "a" * 302]
    got = {tuple(r) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_words_of_texts(documents):
    texts = ["Spelling spelling SPELLING spell", "spéllings×÷ÿ, spéllings×÷ÿ!", None, "", "Éspelling éspelling", "x" * 40_000, "spelling's-spelling_spelling"]
    docs = documents(*enumerate(texts), (1, texts[1]), (None, "spelling")).withColumn("run", F.lit("r")).withColumn("n", F.lit(1))
    runs = [(d, "".join(c.lower() if c < "a" else c for c in r)) for d, t in [*enumerate(texts), (1, texts[1]), (None, "spelling")] for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")]
    for every in (0, 1, 3):
        want = Counter()
        for d, r in runs:
            h = zlib.crc32(f"{d}:{r}".encode())
            if every and d is not None and h % every == 0:
                k = h % len(r)
                r = r[:k] + r[k + 1 :]
            want[r] += len(r) >= 7
        got = {r.word: r.n for r in word_counts(docs, every).collect()}
        assert got == {w: n for w, n in want.items() if n >= 2}
        assert every or got["spelling"] == 7
    assert word_counts(docs.limit(0)).count() == 0
