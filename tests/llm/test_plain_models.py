"""Language, quality and toxicity models against plain versions: dictionaries and loops, one text at a time."""

import math
import random
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from refmask.llm import language_id, quality_classifier, toxicity


def low(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def grams(text):
    """Buckets of all runs of one to four bytes; ASCII other than letters is a space."""
    data = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in low(text))
    out = Counter()
    for order in (1, 2, 3, 4):
        for i in range(len(data) - order + 1):
            key = int.from_bytes(data[i : i + order], "big") + (order << 40)
            out[(key * 0x9E3779B97F4A7C15) % (1 << 64) >> 51] += 1
    return out


def test_languages_equal_a_plain_bayes(documents):
    random.seed(1)
    stock = {"en": "the cat and dog of house", "de": "der hund und die katze vom haus", "fr": "le chat et la maison du chien"}
    rows = [(i, " ".join(random.choice(stock[x].split()) for _ in range(8)), x) for i, x in enumerate(["en", "de", "fr"] * 10)]
    test = [(100 + i, " ".join(random.choice(" ".join(stock.values()).split()) for _ in range(5)), None) for i in range(40)]
    got = {r.doc_id: r for r in language_id.identify(documents(*test), language_id.fit(documents(*rows))).collect()}

    names = sorted(stock)
    share = []
    for x in names:
        total = Counter()
        for _, text, lang in rows:
            if lang == x:
                total.update(grams(text))
        whole = sum(total.values()) + 0.5 * 8192
        share.append([(total[b] + 0.5) / whole for b in range(8192)])
    code = language_id.codewords(3)
    bits = range(code.shape[1])
    weight = []
    for k in bits:
        sides = [[share[i] for i in range(3) if code[i][k] == s] for s in (1, -1)]
        one, zero = ([sum(c) / len(side) for c in zip(*side, strict=True)] for side in sides)
        weight.append([math.log(a) - math.log(b) for a, b in zip(one, zero, strict=True)])
    expected = [[sum(a * b for a, b in zip(share[i], weight[k], strict=True)) for k in bits] for i in range(3)]
    least = [min(expected[i][k] for i in range(3) if code[i][k] == 1) for k in bits]
    most = [max(expected[i][k] for i in range(3) if code[i][k] == -1) for k in bits]
    half = [max((a - b) / 2, 1e-3) for a, b in zip(least, most, strict=True)]
    for d, text, _ in test:
        count = grams(text)
        margin = [(sum(n * weight[k][b] for b, n in count.items()) / sum(count.values()) - (least[k] + most[k]) / 2) / half[k] for k in bits]
        loss = [sum(math.log1p(math.exp(-3 * code[i][k] * margin[k])) * half[k] / sum(half) for k in bits) for i in range(3)]
        odds = [math.exp(-3 * (x - min(loss))) for x in loss]
        assert got[d].lang_pred == names[loss.index(min(loss))] and abs(got[d].score - max(odds) / sum(odds)) < 1e-3


def test_quality_equals_a_plain_loop(documents, labels):
    random.seed(2)
    good = lambda: " ".join(random.choice("plain good words that go on and tell something here".split()) for _ in range(300))
    bad = lambda: "".join(random.choice("#$%&!! ZZ QQ") for _ in range(1500))
    rows = [(i, good() if i % 2 else bad()) for i in range(60)] + [(900, None), (901, ""), (902, "é" * 3000), (903, good() + bad())]
    docs = documents(*rows)
    model = quality_classifier.fit(docs, labels(*((i, i % 2, None) for i in range(60))), F.lit(True))
    got = {r.doc_id: r for r in quality_classifier.score_texts(docs, model, "doc_id").collect()}
    for d, text in rows:
        data, saved = (text or "").encode(), 0
        for i in range(0, len(data), 1024):
            size = [
                len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(x), write_checksum=False, write_content_size=False, write_dict_id=False).compress(data[i : i + 1024]))
                for x in (model.good, model.bad)
            ]
            saved += size[1] - size[0]
        margin = saved / len(data) if data else 0.0
        assert abs(got[d].margin - margin) < 0.01 and abs(got[d].score - np.interp(got[d].margin, model.margins, model.scores)) < 1e-9
    assert got[1].score > 0.5 > got[0].score


def features(text):
    words, word = [], b""
    for b in low(text) + b" ":
        if b >= 128 or chr(b).isalnum():
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    out = {("word", w) for w in words}
    out |= {(gap, a, b) for gap in (1, 2) for a, b in zip(words, words[gap:], strict=False)}
    return out | {("stem", n, w[:n]) for n in (4, 5, 6) for w in words if len(w) > n}


def test_toxicity_equals_a_plain_loop(documents, labels):
    random.seed(3)
    stock = "some plain words here and there with others that moron idiots stupidly say".split()
    sample = [(" ".join(random.choice(stock) for _ in range(random.randrange(2, 12))), 0) for _ in range(150)]
    sample = [(t, int("moron" in t or "idiots" in t)) for t, _ in sample]
    model = toxicity.train(sample)
    z, n, bias = Counter(), Counter(), ("bias",)
    shrink = toxicity.L1 * math.sqrt(len(sample) / toxicity.L1_ROWS)

    def weight(f):
        cut = 0.0 if f == bias else shrink
        return 0.0 if abs(z[f]) <= cut else (math.copysign(cut, z[f]) - z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA)

    for _ in range(20):
        for text, label in sample:
            active = [*features(text), bias]
            w = {f: weight(f) for f in active}
            g = (1 / (1 + math.exp(-sum(w.values()))) - label) * (toxicity.TOXIC_WEIGHT if label else 1)
            for f in active:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    texts = [(i, t) for i, (t, _) in enumerate(sample)] + [(500, None), (501, ""), (502, "MORON"), (503, "a moronic idiot says")]
    got = {r.doc_id: r.score for r in toxicity.score_texts(documents(*texts), model, "doc_id").collect()}
    for d, text in texts:
        assert abs(got[d] - 1 / (1 + math.exp(-sum(weight(f) for f in [*features(text), bias])))) < 1e-6
