import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, fp long, score double, removed string, `odd.name x` int"


@pytest.fixture()
def make(spark):
    """Documents with the columns of the table and some whose names operators use themselves."""

    def of(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "k", 1, 0.5, "r", 3) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return of
