import pytest

from twinfold.llm.frames import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls anywhere, empty and long texts, repeated rows, a clashing column."""
    rows = [
        (1, "", "en"),
        (2, None, None),
        (3, "word " * 30_000, "en"),
        (4, "the same words here again and again", "en"),
        (4, "the same words here again and again", "en"),
        (None, "the same words here again and again", None),
        (5, "  \n\t ", "de"),
        (6, "1234 5678 !?", "de"),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
