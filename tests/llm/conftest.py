import pytest

from refmask.llm import common

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """``documents((id, text), …)``: a table of documents; a row may go on with lang and source."""

    def frame(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return frame


@pytest.fixture(scope="session")
def labels(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """Intermediate tables of these tests go to a folder of the test run."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return common.shared_folder(spark)
