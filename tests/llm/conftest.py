import pytest


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    from folioquery.plans.deploy import ship

    ship(spark)


@pytest.fixture(scope="session")
def rows(spark):
    """documents from (doc_id, text), with columns whose names clash with those of the operators."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, 3) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, line int, salt int")

    return make


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "The same text, twice."), (5, "The same text, twice."), (6, "the SAME text, twice."), (None, "no id"), (7, "É " * 50_000), (8, "a" * 100_000)]


@pytest.fixture(scope="session")
def odd(rows):
    return rows(ODD)


@pytest.fixture(scope="session")
def none(rows):
    return rows([])
