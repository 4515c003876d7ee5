import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, repeated ids, a very long text, and columns whose
    names clash with what operators make."""
    long = " ".join(f"word{i % 977} the of" for i in range(60_000))
    rows = [
        (1, "The quick brown fox of the north jumps over a lazy dog", "en", "a", 54),
        (1, "The quick brown fox of the north jumps over a lazy dog", "en", "a", 54),
        (2, "The quick brown fox of the north jumps over a lazy dog", "en", "a", 54),
        (2, "another text under the same id, with 10.0.0.1 in it", None, None, None),
        (3, "", "en", "a", 0),
        (4, None, None, None, None),
        (5, " \t\n ", "de", "b", 4),
        (None, "no id here", "en", "b", 10),
        (None, None, None, None, None),
        (6, long, "en", "c", len(long)),
        (7, "\U0001f600 ünïcode straße 東京 <|endoftext|> and <s>", "de", "c", 30),
        (8, "a", "xx", "c", 1),
        (9, "12345", "xx", "c", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    names = ("id", "fp", "row", "h", "k", "b", "u", "v", "root", "score", "lead", "terms", "component_id", "__rank")
    return df.selectExpr("*", *[f"'clash' AS `{n}`" for n in names])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
