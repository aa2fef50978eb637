import pytest


@pytest.fixture()
def documents(spark):
    """A documents table from texts, with extra columns whose names clash with those of operators."""
    def build(texts, ids=None):
        rows = [(i, t, "en", "s", 0, 1.0, "x", 7) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, shard int")

    return build
