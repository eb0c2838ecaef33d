import pytest

pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, owner string, body string, kind string, `row` int"


@pytest.fixture(scope="session")
def table(spark):
    """``documents`` of (id, text[, source]) rows, with extra columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "o", None, "k", 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
