import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, component_id string, n double"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (id, text[, source]) with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "k", "c", 0.5) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
