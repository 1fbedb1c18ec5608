import pytest

#: Extra columns with names that operators use inside.
CLASH = "key string, size long, bucket string, place long, doc string, kept string, score string"


@pytest.fixture
def documents(spark):
    def make(rows):
        full = [(i, t, "en", s, len(t or ""), "k", 1, "b", 2, "d", "no", "s") for i, t, s in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")

    return make
