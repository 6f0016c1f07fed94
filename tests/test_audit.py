import pytest

from refmask import redact_corpus
from refmask.operators import audit
from refmask.operators.audit import leak_audit, leak_audit_corpus, restore_coverage
from refmask.operators.mapping import mapping_table


def leaks(table):
    return sorted((r.script_id, r.canon, r.times) for r in leak_audit(redact_corpus(table).annotated).collect())


def corpus_leaks(table):
    annotated = redact_corpus(table).annotated
    return sorted((r.script_id, r.kind, r.canon, r.times) for r in leak_audit_corpus(annotated, mapping_table(annotated)).collect())


def test_fronts_of_longer_paths_are_leaks(scripts):
    texts = ("SELECT Sales.Orders.id FROM Sales.Orders", "SELECT sales . orders . id.x, other.orders FROM Sales.Orders")
    assert leaks(scripts(*texts)) == [(0, "sales.orders", 1), (1, "sales.orders", 1)]


def test_double_quoted_originals_are_found(scripts):
    texts = (
        'SELECT 1 FROM "S"."T" x, "s" . "t" y -- "S"."T".id',
        """SELECT '5" of "s"."t"' FROM "S"."T" x""",
        'SELECT 1 FROM s."T" x, s."T" y, z.s."T" w',
        'SELECT "sales.orders" FROM Sales.Orders x',
    )
    assert leaks(scripts(*texts)) == [(0, '"s"."t"', 2), (1, '"s"."t"', 1), (2, 's."t"', 1), (3, "sales.orders", 1)]


def test_wide_gaps_do_not_start_a_path(scripts):
    gap = " " * 12
    texts = (f'SELECT 1 FROM "T" x -- s.{gap}"T", s .{gap}"T" and "T"', f'SELECT 1 FROM s."T" x -- s.{gap}"T".id or s."T"')
    assert leaks(scripts(*texts)) == [(0, '"t"', 1), (1, 's."t"', 2)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_names_of_other_scripts_are_leaks_of_the_corpus(scripts, monkeypatch, limit):
    monkeypatch.setattr(audit, "BROADCAST_NAMES", limit)
    texts = (
        "SELECT 1 FROM Sales.Orders x",
        "SELECT 1 FROM other.t x -- sales.orders.id, SALES . orders and sales.nothing",
        'SELECT "S"."T" FROM "S"."T" y -- [a].b',
        "SELECT 1 FROM [a].b x -- \"s\".\"t\"",
        "nothing here",
        None,
    )
    want = [(1, "table", "sales.orders", 2), (2, "table", '"s"."t"', 1), (2, "table", "[a].b", 1), (3, "table", '"s"."t"', 1)]
    assert corpus_leaks(scripts(*texts)) == want
    assert corpus_leaks(scripts("no names")) == []


def test_a_corpus_with_many_first_parts(scripts):
    texts = [f"SELECT 1 FROM db{i}.t{i} x -- db{(i + 1) % 300}.t{(i + 1) % 300}, db{i}.u, dbx{i}.t{i}" for i in range(300)]
    assert corpus_leaks(scripts(*texts)) == sorted((i, "table", f"db{(i + 1) % 300}.t{(i + 1) % 300}", 1) for i in range(300))


def test_coverage_moves_no_texts(spark, scripts):
    packed = redact_corpus(scripts("SELECT 1 FROM a.b JOIN c.d ON 1 = 1")).annotated
    edited = scripts("redacted.Table_1 redacted.Table_1 redacted.Table_9 REDACTED.TABLE_1", "redacted.Table_1")
    got = restore_coverage(edited, packed)
    assert sorted(map(tuple, got.collect())) == [(0, 2, 1, 1, 2), (1, 0, 0, 0, 1)]
