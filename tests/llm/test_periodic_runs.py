"""Periodic runs against a plain version that tries every period."""

import random

from pyspark.sql import functions as F

from refmask.llm.periodic_runs import LastSeen, periodic_runs, runs_of, suffix_automaton


def brute(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                size = j + q - i
                if size >= max(6, 4 * q) and not any(s <= i and i + size <= s + k for s, k, p in out if p < q):
                    out.append((i, size, q))
                i = j
            i += 1
    return sorted(out)


def periodic(letters):
    w = []
    for _ in range(random.randrange(6)):
        b = [random.randrange(letters) for _ in range(random.randrange(1, 7))]
        w += (b * random.randrange(1, 9))[: random.randrange(1, 50)]
    return w


def test_runs_equal_a_plain_version():
    random.seed(1)
    found = 0
    for _ in range(1500):
        w = periodic(random.choice([1, 2, 2, 3]))
        assert runs_of(w) == brute(w)
        found += len(brute(w))
    assert found > 1000
    assert runs_of([0] * 5) == [] and runs_of([0] * 6) == [(0, 6, 1)] and runs_of([0, 1] * 4) == [(0, 8, 2)] and runs_of([0, 1, 0, 1, 0, 1, 0]) == []


def test_segments_name_the_last_place():
    """Every string on the path of a prefix lies in the segment of the place where it was last seen."""
    random.seed(2)
    for _ in range(200):
        w = [random.randrange(2) for _ in range(random.randrange(1, 30))]
        link, longest, prefix = suffix_automaton(w)
        paths = LastSeen(link)
        for r, x in enumerate(prefix):
            got = [(longest[s], seen) for s, seen in paths.access(x, r)]
            assert got[0][0] == r + 1 and [k for k, _ in got] == sorted((k for k, _ in got), reverse=True)
            upto = [k for k, _ in got[1:]] + [0]
            for (k, seen), below in zip(got, upto, strict=True):
                for size in range(below + 1, k + 1):
                    last = max((e for e in range(size - 1, r) if w[e - size + 1 : e + 1] == w[r - size + 1 : r + 1]), default=-1)
                    assert last == seen


def test_whole_texts(documents):
    random.seed(3)
    texts = [None, "", "  ", "a", "a a a a a a", " a\na\ta a  a a b", "x y " * 20_000, " ".join(f"w{i}" for i in range(300)), "é\xa0 é\xa0 " * 3]
    texts += [" ".join("abc"[k] for k in periodic(3)) for _ in range(200)]
    texts += [" ".join(f"w{k}" for k in range(90)) * 5 + " " + "tail " * 7]
    docs = documents(*enumerate(texts), (900, "a a a a a a"), (900, "a a a a a a"), (None, "b b b b b b b")).withColumn("runs", F.lit("x")).withColumn("n_words", F.lit(0))
    out = periodic_runs(docs.repartition(3), "doc_id", "lang")
    assert out.columns == ["doc_id", "lang", "n_words", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == len(texts) + 3
    got = {r.doc_id: r for r in rows}
    for i, text in [*enumerate(texts), (900, "a a a a a a"), (None, "b b b b b b b")]:
        words = (text or "").encode().split()
        want = [(0, 40_000, 2)] if i == 6 else brute(words)
        assert [tuple(x) for x in got[i].runs] == want and got[i].n_words == len(words)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert got[i].collapsed == b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    assert periodic_runs(docs.limit(0), "doc_id").count() == 0
