import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, langs=None, extra=None):
        rows = [(i, t, (langs or {}).get(i, "en"), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.withColumns(extra) if extra else df

    return make
