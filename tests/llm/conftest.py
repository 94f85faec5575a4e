import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs([(id, text, lang, source)], extra=...) -> a documents table."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), *r[4:]) for r in rows]
        return spark.createDataFrame(full, DOCS + extra)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
