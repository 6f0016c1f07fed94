"""Personal data: the fixed patterns as written, the dynamic programme against all segmentations, and unseen forms."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refmask.llm import kernels as K
from refmask.llm import personal_data as P
from refmask.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return P.fit()


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, *m.span()) for k, (pattern, good) in enumerate(rules) for m in re.finditer(pattern, text) if good(m)]


def test_fixed_patterns_equal_the_plain_ones():
    random.seed(1)
    bits = ["a", "b.", "@", "x@y.z", "1", "12", "255", "256", ".", "-", " ", "+", "+1", "(", ")", "é", "4111 1111 1111 1111", "4111111111111111", "@@", "1.2.3.4", "007.0.0.1", "\n", "%"]
    found = 0
    for _ in range(20_000):
        text = "".join(random.choice(bits) for _ in range(random.randrange(14)))
        assert P.base_spans(text) == plain(text)
        found += len(plain(text))
    assert found > 5000
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000, "+1(" * 50_000, "1 " * 100_000):
        assert len(P.base_spans(text)) < 30_000  # in time that grows with the text


def test_best_choice_equals_all_choices():
    random.seed(2)
    for _ in range(400):
        n, again = random.randrange(1, 7), random.choice([0.0, -0.7, 0.4])
        segments = [(random.randrange(4), i, j, random.choice([-1.0, 0.5, 1.0, 2.5])) for i in range(n) for j in range(i + 1, n + 1) if random.random() < 0.5]

        def value(chosen):
            chosen = sorted(chosen, key=lambda s: s[1])
            if any(a[2] > b[1] for a, b in itertools.pairwise(chosen)):
                return -np.inf
            return sum(s[3] for s in chosen) + again * sum(a[2] == b[1] for a, b in itertools.pairwise(chosen))  # noqa: B023

        want = max(value(c) for k in range(min(len(segments), n) + 1) for c in itertools.combinations(segments, k))
        got = P.viterbi(n, segments, again)
        scores = {s[:3]: max(x[3] for x in segments if x[:3] == s[:3]) for s in segments}
        total = value([(*s, scores[s]) for s in got])
        assert abs(total - want) < 1e-9


def test_sums_over_all_segmentations_are_exact():
    random.seed(4)
    for again in (0.0, -0.8, 0.6):
        n = 5
        segments = [(random.randrange(4), i, j, random.uniform(-1, 1)) for i in range(n) for j in range(i + 1, n + 1) if random.random() < 0.4]
        score = np.full((1, n + 1, P.MAX_TOKENS, 4), -np.inf)
        segments = list({s[:3]: s for s in segments}.values())
        place = np.array([(0, j, j - i - 1, k) for k, i, j, _ in segments])
        for k, i, j, x in segments:
            score[0, j, j - i - 1, k] = x
        first, second, total = P.posterior(score, place, again)
        sums = np.zeros((len(segments), 2))
        whole = 0.0
        for size in range(n + 1):
            for chosen in itertools.combinations(range(len(segments)), size):
                row = sorted(chosen, key=lambda c: segments[c][1])
                if any(segments[a][2] > segments[b][1] for a, b in itertools.pairwise(row)):
                    continue
                after = [b for a, b in itertools.pairwise(row) if segments[a][2] == segments[b][1]]
                weight = np.exp(sum(segments[c][3] for c in row) + again * len(after))
                whole += weight
                for c in row:
                    sums[c, int(c in after)] += weight
        assert np.allclose(total, np.log(whole)) and np.allclose(np.stack([first, second], 1), sums / whole)


def test_nothing_to_learn_from():
    assert P.train([], 5).spans("call 030/1234567") == [] and P.train([("no numbers here", [])]).spans("1 2") == []


def test_forms_that_were_not_seen(model):
    found = wanted = wrong = 0
    for text, spans in P.labelled_sentences(800, seed=11):
        got = set(model.spans(text))
        found, wanted, wrong = found + len(got & set(spans)), wanted + len(spans), wrong + len(got - set(spans))
    assert found >= 0.98 * wanted and wrong <= 0.02 * wanted > 5


def test_what_the_field_adds(model):
    for text, kind, span in (
        ("write to jane dot doe at example dot org now", 0, "jane dot doe at example dot org"),
        ("Kontakt: jane.doe (at) example (dot) com.", 0, "jane.doe (at) example (dot) com"),
        ("call (212) 867-5309 today", 3, "(212) 867-5309"),
        ("the host 10[.]20[.]30[.]40 is down", 1, "10[.]20[.]30[.]40"),
        ("card 4111.1111.1111.1111 was used", 2, "4111.1111.1111.1111"),
        ("numbers 7536784127813050 4845168114407329 in a row", 2, "4845168114407329"),
    ):
        base, spans = P.all_spans(text, model)
        assert (kind, text.index(span), text.index(span) + len(span)) in spans and set(base) <= set(spans)
    for text in ("on 2024-05-01 at noon.", "version 1.2.3", "pages 12-15 of 300", "at home at last", "it cost 1,234.50", "sha 5f3759df0123456789abcdef01234567", "order 1234567812345678"):
        assert P.all_spans(text, model) == ([], [])


def test_whole_texts(documents, model):
    random.seed(3)
    mail = "x@y.org"
    texts = [None, "", "é" * 9 + mail, "word " * 50_000 + mail, "1 2 3 " * 5_000, "a" * 100_000, "nothing here", " at ", "at", "a", "t at x.y"]
    texts += [t for t, _ in P.labelled_sentences(80, seed=5)]
    docs = documents(*enumerate(texts), (2, texts[2]), (None, mail)).withColumn("base", F.lit("b")).withColumn("spans", F.lit("s"))
    out = P.find_personal_data(docs.repartition(3), model, "doc_id", "source")
    assert out.columns == ["doc_id", "source", "base", "spans"]
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        base, spans = P.all_spans((mail if r.doc_id is None else texts[r.doc_id]) or "", model)
        assert [(P.KINDS.index(x.kind), x.start, x.end) for x in r.base] == base and [(P.KINDS.index(x.kind), x.start, x.end) for x in r.spans] == spans
    assert P.find_personal_data(docs.limit(0), model, "doc_id").count() == 0
    for lo, _, data, at in K.pieces(pa.array([t or "" for t in texts])):
        for k, some in enumerate(P.may_hold(data, at)):
            assert some or P.all_spans(texts[lo + k] or "", model) == ([], [])


def test_registered_columns(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op11_personal_data"](spark, sf).collect():
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
