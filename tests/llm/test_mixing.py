import random
from collections import defaultdict

import duckdb
import pytest

from refmask.llm import queries, source_mixing
from refmask.llm.source_mixing import mix_sources, source_targets


def poured(sizes, weights=(1, 2, 3), most=3):
    """Targets by pouring what is above a source's limit over the others, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, g in give.items():
            room = most * sizes[s] - target[s]
            target[s] += min(g, room)
            left += max(0.0, g - room)
        open_ = {s for s in open_ if target[s] < most * sizes[s] - 1e-9}
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_pouring(spark, seed):
    random.seed(seed)
    sizes = {f"s{i}": random.choice([0, 1, 10, 1000, random.randrange(5000)]) for i in range(random.randrange(1, 12))}
    if seed % 2:
        sizes[None] = 70
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, source_rows bigint")
    got = {r.source: r.target for r in source_targets(table).collect()}
    assert got == pytest.approx(poured(sizes), abs=1e-6)


def corpus(n, seed=1):
    random.seed(seed)
    size = lambda: random.choice([0, 1, 5, 20, 20, 20, 60])
    rows = [(i, " ".join(["w"] * size()), "en", random.choice(["a", "b", "b", "b", "c", None])) for i in range(n)]
    return [*rows, (None, "x y z", "en", "a"), (1, "again and again", "en", "a"), (1, "again and again", "en", "a"), (n, None, "en", "z")]


@pytest.mark.parametrize("bucket_rows", [2000, 25])
def test_sources_come_near_their_targets_and_reruns_agree(spark, documents, monkeypatch, bucket_rows):
    monkeypatch.setattr(source_mixing, "BUCKET_ROWS", bucket_rows)
    rows = corpus(900)
    docs = documents(*rows).withColumnRenamed("n_chars", "target")
    out = [tuple(r) for r in mix_sources(docs).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(out, key=key) == sorted((tuple(r) for r in mix_sources(docs.repartition(5)).collect()), key=key)
    assert sorted((str(r[0]), r[2]) for r in out) == sorted((str(i), len((t or "").split())) for i, t, *_ in rows)
    taken, target = defaultdict(int), {}
    for _, source, size, _, goal, copies, words in out:
        assert words == copies * size and 0 <= copies <= 3
        taken[source] += words
        target[source] = goal
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 30 if goal else taken[source] == 0
    assert sum(target.values()) == pytest.approx(sum(r[2] for r in out))


def test_inclusion_follows_the_odds(spark, documents):
    """Of equal documents in one source each is drawn about equally often; sources of one document take it whole."""
    docs = documents(*((i, "a b", "en", "a") for i in range(300)), *((i, "a b", "en", "b") for i in range(300, 400)))
    out = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    a, b = [out[i] for i in range(300)], [out[i] for i in range(300, 400)]
    assert sum(a) == 133 and set(a) == {0, 1} and sum(b) == 267 and set(b) == {2, 3}
    one = mix_sources(documents((1, "a b c", "en", None))).collect()
    assert [(r.copies, r.taken) for r in one] == [(1, 3)]


def test_empty_and_wordless(documents):
    assert mix_sources(documents((1, "x")).limit(0)).count() == 0
    assert [r.taken for r in mix_sources(documents((1, None), (2, ""), (2, ""))).collect()] == [0, 0, 0]


def test_against_the_oracle_with_many_buckets(spark, documents, monkeypatch):
    monkeypatch.setattr(source_mixing, "BUCKET_ROWS", 20)
    docs = documents(*corpus(700, seed=8))
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = con.execute(queries._mix_oracle()).fetchall()
    got = mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    plain = lambda rows: sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in rows)
    assert plain(map(tuple, got)) == plain(want)
