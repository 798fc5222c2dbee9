import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table; rows are texts, or (doc_id, text)."""

    def build(rows, parts=2, extra=True):
        full = [(r if isinstance(r, tuple) else (i, r)) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in full], DOCS).repartition(parts)
        # Columns whose names clash with those that operators make on the way.
        return df.selectExpr("*", "'x' as root", "1 as key", "2 as shard", "3 as ids", "4 as block", "5 as score") if extra else df

    return build


@pytest.fixture(scope="session")
def scratch(spark):
    from verdikt.llm.common import Scratch

    return lambda: Scratch(spark, "test")


AWKWARD = [None, "", " ", "\n", "a", "same words here and there again", "same words here and there again", "é漢\U0001f600 x", "x" * 60_000, "word " * 20_000, "\x00\x1f\t"]


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls, empty and very long texts, ties, repeated rows, a null id, extra columns."""
    return documents([*[(i, t) for i, t in enumerate(AWKWARD)], (5, AWKWARD[5]), (None, "no id"), (-7, "negative id")])
