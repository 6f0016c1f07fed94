import random

from refmask import redact_corpus
from refmask.operators import corpus, ranking
from refmask.operators.corpus import (
    around_taken,
    corpus_dictionary,
    dictionary_clashes,
    grow_dictionary,
    redact_annotated_with_dictionary,
    redact_with_dictionary,
    taken_numbers,
)

T = "redacted.Table_"


def numbers(dictionary):
    return {(r.kind, r.canon): r.n for r in dictionary.collect()}


def test_running_totals_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE", 4)
    random.seed(4)
    rows = [(random.choice("ab"), random.randrange(30), random.randrange(5)) for _ in range(200)]
    table = spark.createDataFrame(rows, "kind STRING, at BIGINT, by BIGINT")
    got = sorted(tuple(r) for r in ranking.running_total(table, "kind", "at", "by", "total").collect())
    assert got == sorted((k, p, w, sum(x for j, q, x in rows if j == k and q <= p)) for k, p, w in rows)


def test_ranks_go_around_taken_numbers(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE", 7)
    random.seed(7)
    holes = {"a": [], "b": [1], "c": list(range(1, 30)), "d": [2, 3, 9, 10, 11, 40, 10**15], "e": random.sample(range(1, 60), 25)}
    ranked = spark.createDataFrame([(kind, k, f"c{k}") for kind in holes for k in range(1, 21)], "kind STRING, k BIGINT, canon STRING")
    taken = spark.createDataFrame([(kind, n) for kind in holes for n in holes[kind]] + [("other", 1)], "kind STRING, n BIGINT")
    got = {(r.kind, r.k): r.n for r in around_taken(ranked, taken).collect()}
    free = {kind: [n for n in range(1, 100) if n not in holes[kind]] for kind in holes}
    assert got == {(kind, k): free[kind][k - 1] for kind in holes for k in range(1, 21)}


def test_numbers_of_literal_placeholders(scripts):
    table = scripts(f"x {T}1 {T}1 y{T}5 {T}6z", f"-- {T}02 {T}7 redacted.Col_3 REDACTED.TABLE_8", None, "", f"{T}99999999999999999999 {T}0")
    assert sorted(map(tuple, taken_numbers(table).collect())) == [("column", 3), ("table", 1), ("table", 7)]


def test_a_literal_placeholder_is_not_given_to_a_name(scripts):
    """The script with a.b must not come out with the number that another script already holds."""
    table = scripts(f"SELECT 1 FROM {T}1", "SELECT 1 FROM a.b", f"SELECT 1 FROM a.b JOIN c.d ON 1 = 1 -- {T}2")
    job = redact_corpus(table)
    dictionary = corpus_dictionary(job.mapping, taken=taken_numbers(table))
    assert sorted(numbers(dictionary).values()) == [3, 4]
    texts = {r.script_id: r.text for r in redact_with_dictionary(job.redacted, job.mapping, dictionary).collect()}
    n = numbers(dictionary)
    assert texts[0] == f"SELECT 1 FROM {T}1"
    assert texts[1] == f"SELECT 1 FROM {T}{n['table', 'a.b']}"
    assert texts[2] == f"SELECT 1 FROM {T}{n['table', 'a.b']} JOIN {T}{n['table', 'c.d']} ON 1 = 1 -- {T}2"


def test_numbers_stay_when_the_dictionary_grows(scripts):
    old = scripts(*(f"SELECT x{i}.y FROM a.t{i} x{i}" for i in range(30)))
    one = corpus_dictionary(redact_corpus(old).mapping)
    new = scripts(*(f"SELECT 1 FROM a.t{i} JOIN b.t{i} ON 1 = 1 -- {T}{31 + i % 3} {T}5" for i in range(40)))
    taken = taken_numbers(new)
    two = grow_dictionary(one, redact_corpus(new).mapping, taken=taken)
    before, added = numbers(one), numbers(two)
    assert not before.keys() & added.keys() and len(added) == 50
    assert sorted(added.values()) == list(range(34, 84))
    assert sorted(numbers(grow_dictionary(one, redact_corpus(new).mapping)).values()) == list(range(31, 81))
    assert grow_dictionary(one.unionByName(two), redact_corpus(new).mapping, taken=taken).isEmpty()
    assert numbers(grow_dictionary(one.limit(0), redact_corpus(old).mapping)) == before
    assert [r.n for r in dictionary_clashes(one, taken).collect()] == [5]


def test_names_are_looked_up_in_the_row(spark, monkeypatch):
    """the rows of the join, also with keys that several scripts or none have and names that the dictionary lacks."""
    texts = [(i, f"SELECT x.id FROM a.t{i % 7} x JOIN b.t{i % 5} ON 1 = 1 -- {T}{i}") for i in range(40)]
    odd = [(3, "SELECT 1 FROM a.t6 x"), (4, texts[4][1]), (None, "SELECT 1 FROM a.t1 x"), (None, "SELECT 1 FROM a.t2 x"), (50, None), (51, ""), (52, "none"), (53, "SELECT 1 FROM not.there x")]
    for rows in (texts, texts + odd, []):
        job = redact_corpus(spark.createDataFrame(rows, "script_id BIGINT, text STRING"))
        dictionary = corpus_dictionary(job.mapping.filter("canon <> 'not.there'"))
        want = sorted(map(str, redact_with_dictionary(job.redacted, job.mapping, dictionary).collect()))
        found = redact_annotated_with_dictionary(job.annotated, dictionary)
        assert sorted(map(str, found.collect())) == want and len(want) == len(rows)
        leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves().size()
        assert (leaves > 1) == (len(rows) > 40)  # nothing is joined where no key repeats
    monkeypatch.setattr(corpus, "ROW_NAMES", 3)
    job = redact_corpus(spark.createDataFrame(texts + odd, "script_id BIGINT, text STRING"))
    dictionary = corpus_dictionary(job.mapping)
    want = sorted(map(str, redact_with_dictionary(job.redacted, job.mapping, dictionary).collect()))
    assert sorted(map(str, redact_annotated_with_dictionary(job.annotated, dictionary).collect())) == want
