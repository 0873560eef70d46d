import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and names like internal ones."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
    base = " ".join(words * 3)
    near = base + " omega"
    texts = [
        (1, base, "en", "s0"), (2, base.upper(), "en", "s0"), (3, near, None, None), (4, None, "en", "s1"), (5, "", "fr", "s1"),
        (6, " \n\t ", "fr", "s2"), (None, "nobody has this id", None, "s2"), (None, base, "en", "s2"), (7, LONG, "de", "s0"),
        (8, "Été où — naïve 😀 <|endoftext|> don't", "fr", "s1"), (9, "one two three", "en", "s1"), (9, "one two three", "en", "s1"),
        (10, "one two three", "en", "s3"), (11, "one two  three", "en", "s3"), (12, "12 34", "en", "s3"),
    ]
    rows = [(i, t, lang, s, len(t or ""), i, "x", 1.5, n) for n, (i, t, lang, s) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, tag string, score double, n long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("n < 0")
