import random

from pyspark.sql import functions as F

from refmask.llm.token_counts import VOCABULARY, Counter, apply_edits, build, edit, token_trees

BITS = ["a", "b", "'l", "l", "'s", " ", "  ", "\n", "\t", "1", "23", ".", "!!", "é", "ß", "don't", "we'll", " ", "word ", "the "]


def counter():
    with open(VOCABULARY, "rb") as f:
        return Counter(f.read())


def text_of(n):
    return "".join(random.choice(BITS) for _ in range(n))


def test_edited_trees_count_like_whole_texts():
    random.seed(11)
    c = counter()
    for _ in range(600):
        text = text_of(random.choice([0, 1, 5, 50, 300, 900]))
        tree = build(text, c)
        for _ in range(4):
            start = random.randrange(len(text) + 1)
            end = min(len(text), start + random.choice([0, 0, 1, 3, 50, 400]))
            insert = text_of(random.choice([0, 1, 2, 20, 20, 3000]))
            want = text[:start] + insert + text[end:]
            text, tree, encoded = edit(text, tree, start, end, insert, c)
            assert text == want and encoded <= len(text)
            assert tree.tokens[1] == len(c.encoding.encode_ordinary(text))
            assert tree.chars[1] == len(text) and tree.pieces[1] == len(c.cut(text))
            size = tree.size
            for heap in (tree.chars, tree.tokens, tree.pieces):
                assert all(heap[i] == heap[2 * i] + heap[2 * i + 1] for i in range(1, size))


def test_a_small_edit_of_a_long_text_encodes_little():
    random.seed(2)
    c = counter()
    text = " ".join(random.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(60_000))
    tree = build(text, c)
    new, tree, encoded = edit(text, tree, 200_000, 200_003, "xyz", c)
    assert encoded < 500 and tree.tokens[1] == len(c.encoding.encode_ordinary(new))


def test_tables(spark, documents):
    docs = documents((1, "one two three"), (2, None), (3, ""), (4, "x" * 5000), (None, "one two"), (1, "one two three")).withColumn("n_tokens", F.lit("mine"))
    edits = "array(named_struct('start', 4L, 'length', 3L, 'insert', 'four'), named_struct('start', 99999L, 'length', null, 'insert', '!'), null, named_struct('start', null, 'length', 1L, 'insert', null))"
    trees = token_trees(docs.withColumn("edits", F.expr(edits)), "doc_id", "edits")
    got = {r.doc_id: r for r in apply_edits(trees, "doc_id").collect()}
    c = counter()
    for i, want in ((1, "ne four three!"), (2, None), (3, "our!"), (4, "x" * 3 + "four" + "x" * (5000 - 7) + "!"), (None, "ne four!")):
        assert got[i].text == want and got[i].n_tokens == (len(c.encoding.encode_ordinary(want)) if want else 0)
    none = apply_edits(trees.withColumn("edits", F.lit(None).cast(trees.schema["edits"].dataType)), "doc_id")
    assert {r.doc_id: (r.text, r.encoded) for r in none.collect()}[1] == ("one two three", 0) and none.count() == 6
    assert apply_edits(trees.limit(0), "doc_id").count() == 0
