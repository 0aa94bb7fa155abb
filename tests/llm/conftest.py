import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def prose(seed: int, n: int) -> str:
    """*n* words in an order that depends on *seed* alone."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def text_of():
    return prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with NULLs in every column, empty and very long texts, ties, repeated rows and clashing column names."""
    long_text = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "en", "a", 0, 1.5, "x"), (1, prose(2, 120), "en", "a", 0, 1.5, "x"),
        (2, prose(2, 119) + " end", "en", "b", 0, None, None), (None, prose(3, 80), None, None, None, None, None),
        (None, None, None, None, None, None, None), (3, "", "fr", "a", 0, 0.0, ""), (4, None, "fr", None, None, 0.0, "y"),
        (5, long_text, "de", "c", 0, 2.0, "z"), (6, long_text, "de", "c", 0, 2.0, "z"),
        (7, " \t\n ", "de", "b", 0, 2.0, "z"), (8, "12345 é中\U0001f600 +1 (042) 555-7845", None, "a", 0, 2.0, "z"),
        (9, "é" * 700, "fr", "a", 0, 2.0, "z"),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string"
    ).selectExpr("*", "score as id", "row as n", "score as size", "row as part", "row as h1", "row as target")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
