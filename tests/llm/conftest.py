import pytest


@pytest.fixture(scope="session")
def texts(spark):
    """Documents from texts; ids count from 0 unless given. Other columns clash in
    name with those the operators use inside."""

    def make(values, ids=None, parts=3):
        rows = [(i, t, "en", "src", 0, "x", 1, None) for i, t in zip(ids or range(len(values)), values)]
        kind = "doc_id long, text string, lang string, source string, part int, digest string, fp long, row string"
        return spark.createDataFrame(rows, kind).repartition(parts) if rows else spark.createDataFrame([], kind)

    return make
