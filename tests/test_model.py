"""The library against the plain-Python model on random texts made of awkward pieces."""

import random

import pytest
from pyspark.sql import functions as F

from refmask.functions import redact as rd
from refmask.functions.typos import find_typos, fix_typos
from refmask.functions import lexicon as lx
from tests import model

PIECES = (
    "FROM from Join UPDATE into MERGE DELETE TRUNCATE TABLE ONLY only AS as import where SET GROUP BY "
    "ORDER on a b T1 x$ $y #z a.b c . d . .e f.g.h.i.j [my_t] [a]b] \"q\" \"q\"\"r\" \"\" `k` `k``l` [ ] ' '' "
    "-- /* */ * / - , ; ) ( ' \" ` redacted.Table_1 REDACTED.table_2 redacted.Col_1 redacted . x t.Table_3 "
    "2a.b éa.b 1.5 é \ufdd0 FROMM"
).split(" ")
PIECES += "FROM JOIN update into a.b c.D x y t where ; [my_t] \"q\" f . g".split(" ") * 4
GAPS = ["", " ", " ", " ", "\n", "\t ", "\u00a0", "\u3000 ", "  \n"]


def soup(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(PIECES) + rng.choice(GAPS) for _ in range(rng.randint(1, n)))


TEXTS = [soup(seed, 8) for seed in range(2500)] + [soup(seed, 40) for seed in range(2500, 4000)]
# Without unbalanced quotes, so that more of each text is read.
CALM = [p for p in PIECES if p not in ("'", '"', "`", "[", "/*", "''", '""', "[a]b]")]
TEXTS += [
    "".join(rng.choice(CALM) + rng.choice(GAPS[1:]) for _ in range(25))
    for rng in map(random.Random, range(4000, 6000))
]


@pytest.fixture(scope="module")
def soups(scripts):
    return scripts(*TEXTS).repartition(8).cache()


def rows(table):
    return {row.script_id: row for row in table.collect()}


def test_table_redaction_equals_the_model(soups):
    got = rows(soups.select("script_id", F.expr(rd.redact_sql_tables("text")).alias("r")))
    hits = 0
    for i, text in enumerate(TEXTS):
        expected, mapping = model.redact_tables(text)
        assert got[i].r.text == expected, repr(text)
        assert {e.placeholder: e.original for e in got[i].r.entries} == mapping, repr(text)
        hits += len(mapping)
    assert hits > 3000


def test_table_references_equal_the_model(soups):
    got = rows(soups.select("script_id", F.expr(rd.sql_table_refs("text")).alias("refs")))
    for i, text in enumerate(TEXTS):
        expected = [
            (n, text[start:end], model.canonical(text[start:end]), ok)
            for n, (start, end, ok) in enumerate(model.table_refs(text), 1)
        ]
        assert [tuple(r) for r in got[i].refs] == expected, repr(text)


def test_column_redaction_equals_the_model(soups):
    got = rows(soups.select("script_id", F.expr(rd.redact_sql_columns("text")).alias("r")))
    hits = 0
    for i, text in enumerate(TEXTS):
        expected, mapping = model.redact_columns(text)
        assert got[i].r.text == expected, repr(text)
        assert {e.placeholder: e.original for e in got[i].r.entries} == mapping, repr(text)
        hits += len(mapping)
    assert hits > 3000


WRONG_WORDS = [w for bad, _ in lx.TYPO_RULES for w in bad.split()] + ["x", "FROM", "merge", "é", "1"]
WRONG_TEXTS = [
    "".join(
        (w.lower() if rng.random() < 0.3 else w) + rng.choice([" ", " ", "\n", "", "_", " \n "])
        for w in rng.choices(WRONG_WORDS, k=rng.randint(1, 30))
    )
    for rng in map(random.Random, range(3000))
]


def phrase_hits(text, phrase):
    i, words = 0, phrase.split()
    while i < len(text):
        end = model.phrase_at(text, i, words)
        if end:
            yield i, end
            i = end
        else:
            i += 1


def test_findings_and_repairs_equal_one_pass_per_rule(scripts):
    table = scripts(*WRONG_TEXTS).repartition(8)
    got = rows(
        table.select(
            "script_id",
            F.expr(find_typos("text")).alias("all"),
            F.expr(find_typos("text", 8)).alias("capped"),
            F.expr(fix_typos("text")).alias("fixed"),
        )
    )
    for i, text in enumerate(WRONG_TEXTS):
        findings, fixed, count = [], text, 0
        for rule, (bad, fix) in enumerate(lx.TYPO_RULES, 1):
            for start, end in phrase_hits(text, bad):
                findings.append((rule, 1 + text[:start].count("\n"), text[start:end], fix))
            for start, end in reversed(list(phrase_hits(fixed, bad))):
                fixed = fixed[:start] + fix + fixed[end:]
                count += 1
        assert [tuple(f) for f in got[i].all] == findings, repr(text)
        assert [tuple(f) for f in got[i].capped] == findings[:8], repr(text)
        assert tuple(got[i].fixed) == (fixed, count), repr(text)
