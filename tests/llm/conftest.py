import pytest


@pytest.fixture(scope="session")
def table(spark):
    """DataFrame from rows and a DDL string; no rows give an empty table."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with null ids and texts, empty texts, repeats, ties, a very long text and a clashing column."""
    rows = [
        (1, "the cat sat on the mat and the dog sat too", "x"), (1, "the cat sat on the mat and the dog sat too", "x"),
        (2, None, "y"), (3, "", "y"), (4, "   \n\t ", None), (None, "no id here at all", "z"), (None, None, None),
        (5, "very long words " * 20_000, "x"), (6, "x" * 100_000, "x"), (7, "The CAT sat on the mat and the dog sat too", "x"),
        (8, "日本語 テキスト <|endoftext|> é　ü 's 're", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")
