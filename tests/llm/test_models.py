"""Language, quality and toxicity models: held-out accuracy, and rows that teach or say nothing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refmask.llm import kernels as K
from refmask.llm import language_id, quality_classifier, toxicity
from refmask.llm.common import held_out, labelled_sample
from refmask.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_words_are_those_of_the_byte_rule():
    texts = ["ab  cd e", None, "", "x\ny é", "  lead\ttrail\x0b\x0c\r ", "a" * 5000]
    for most in (3, 1 << 20):
        found = []
        for lo, _, data, at in K.pieces(pa.array(texts), most):
            starts, ends, row = K.spans(data, at, K.separators("spaces"))
            found += [(int(r) + lo, bytes(data[a:b])) for a, b, r in zip(starts, ends, row, strict=True)]
            assert len(set(K.span_hashes(data, starts, ends).tolist())) == len({bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)})
        assert found == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]


def test_run_hashes_depend_on_words_and_their_order():
    data = np.frombuffer(b"a b a b a c", np.uint8)
    starts, ends, row = K.spans(data, np.array([0, len(data)]), K.separators("spaces"))
    two, begin = K.runs(K.span_hashes(data, starts, ends), row, 2)
    assert begin.tolist() == [0, 1, 2, 3, 4] and two[0] == two[2] and two[0] != two[1] and two[1] == two[3] and two[4] not in two[:4]


def test_codewords_differ_and_bits_split():
    for n in (2, 3, 4, 6, 7, 20):
        code = language_id.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (code.shape[1] + 1) // 4 and (np.abs(code.sum(0)) < n).all()


def test_languages_of_held_out_documents(spark):
    out = QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out and n_chars > 200")
    right, n, low, high = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right > 0.97 and 0 <= low and high <= 1


def test_language_edge_cases(documents):
    docs = documents((1, "the cat and the dog and the house", "en"), (2, "der hund und die katze und das haus", "de"), (3, None, "en"), (4, "123 !!", None), (5, "", "de"), (None, "und das", None))
    model = language_id.fit(docs)
    out = language_id.identify(docs.withColumn("score", F.lit("mine")), model)
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["en", "de", "und", "und", "und", "de"]
    assert got[3].score == 0 and got[3].ambiguous
    none = language_id.identify(docs, language_id.fit(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    one = language_id.identify(docs, language_id.fit(docs.where("lang = 'en'")))
    assert {r.lang_pred for r in one.where("doc_id <= 2").collect()} == {"en"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_quality_of_held_out_documents(spark):
    out = QUERIES["op6_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    rows = out.select("score", "quality", "predicted").collect()
    assert len(rows) > 50 and np.mean([r.quality == r.predicted for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_isotonic_is_monotone_and_pools():
    x, y = quality_classifier.isotonic([1, 2, 3, 4], [0, 1, 0, 1])
    assert x == [1, 2, 3, 4] and y == sorted(y) and y[1] == y[2] == 0.5
    assert quality_classifier.isotonic([], []) == ([], [])


@pytest.mark.parametrize("kinds", [(), (0,), (1,), (0, 1)])
def test_quality_with_few_labels(documents, labels, kinds):
    docs = documents((0, "x y z ### ###"), (1, "plain words that go on"), (2, None), (3, ""), (None, "x"), (5, "é" * 3000))
    model = quality_classifier.fit(docs, labels(*((k, k, None) for k in kinds), (9, 1, 1), (None, 1, 1)), ~held_out("doc_id", 5, 0))
    rows = quality_classifier.score_texts(docs.withColumn("score", F.lit(7)), model, "doc_id").collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.score_texts(docs.limit(0), model, "doc_id").count() == 0


def test_toxic_words_are_learned(documents, labels, spark):
    plain = [f"some plain words {i} {i % 7} here and there {'abcdefgh'[i % 8]}" for i in range(200)]
    rows = [(i, t + (" you moron, go" if i % 4 == 0 else "")) for i, t in enumerate(plain)]
    docs = documents(*rows, (900, "what a MORON!"), (901, "what a day"), (902, None), (903, ""), (None, "moron"))
    known = labels(*((i, 1, int(i % 4 == 0)) for i in range(200)), (901, 1, None), (902, 1, 1), (None, 1, 1))
    model = toxicity.fit(docs, known, F.col("doc_id") < 500)
    assert 0 < len(model.buckets) < 60
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs.withColumn("score", F.lit(1)), model, "doc_id").collect()}
    assert got[900] > 0.5 > got[901] and got[902] == got[903] < 0.5 < got[None]
    assert toxicity.score_texts(docs.limit(0), model, "doc_id").count() == 0
    empty = toxicity.fit(docs, known.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score_texts(docs, empty, "doc_id").collect()} == {0.5}


def test_toxicity_leaves_clean_documents_alone(spark):
    out = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    rows = out.select("toxic", "predicted").collect()
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.85
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.01


def test_samples_are_bounded_and_keep_the_held_out_fold_out(documents, labels):
    docs = documents(*((i, f"t{i}") for i in range(100)), (3, "again"))
    known = labels(*((i, i % 2, 0) for i in range(100)), (4, 1, 0), (4, 0, 0))
    sample = labelled_sample(docs, known, "quality", ~held_out("doc_id", 5, 0), 30)
    assert len(sample) == 30 and sample == labelled_sample(docs.repartition(7), known, "quality", ~held_out("doc_id", 5, 0), 30)
    every = labelled_sample(docs, known, "quality", ~held_out("doc_id", 5, 0), 1000)
    import zlib

    want = sorted((t, i % 2) for i, t in [*((i, f"t{i}") for i in range(100)), (3, "again")] if zlib.crc32(str(i).encode()) % 5 and i != 4)
    assert sorted(every) == want


def test_many_short_and_one_very_long_text(documents):
    """A batch of many short texts takes a bounded table of counts; a long text is handled alone."""
    rows = [(i, "der hund" if i % 2 else "the cat", "de" if i % 2 else "en") for i in range(3000)] + [(9000, "the cat and " * 100_000, "en")]
    model = language_id.fit(documents(*rows[:200]))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(documents(*rows).coalesce(1), model).collect()}
    assert got == {i: lang for i, _, lang in rows}
    assert max(hi - lo for lo, hi, _, _ in K.pieces(pa.array([t for _, t, _ in rows]), 1 << 20, language_id.PIECE_ROWS)) == language_id.PIECE_ROWS


def test_sampled_texts_are_bounded_in_bytes(documents, labels):
    docs = documents(*((i, "x" * 1000) for i in range(50)), (60, "y" * 100_000))
    known = labels(*((i, 1, 0) for i in range(50)), (60, 1, 0))
    sample = labelled_sample(docs, known, "quality", F.lit(True), 100, most_bytes=20_000)
    assert 0 < sum(len(t) for t, _ in sample) <= 20_000
    assert len(labelled_sample(docs, known, "quality", F.lit(True), 100)) == 51
