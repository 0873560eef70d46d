"""Tokens, term counts and fixed-size chunks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
KEYWORD_SEPARATOR = " AND "
DEFAULT_CHUNK_CHARS = 3000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def has_token(text: Column, token: str) -> Column:
    """True where ``token`` (one lower-case token) occurs in ``text``.

    The substring test is far cheaper than the regular expression and rejects most rows first;
    no token array is built.
    """
    lowered = F.lower(text)
    edge = r"[^\p{L}\p{N}]"
    return F.contains(lowered, F.lit(token)) & lowered.rlike(f"(?:^|{edge}){token}(?:{edge}|$)")


def keyword_tokens(keyword: Column) -> Column:
    """Distinct tokens that a keyword such as ``'lung cancer AND aging'`` requires."""
    return F.array_distinct(tokens(F.replace(keyword, F.lit(KEYWORD_SEPARATOR), F.lit(" "))))


def strip_question_marks(question: Column) -> Column:
    return F.regexp_replace(question, r"\?+$", "")


def with_terms(df: DataFrame, text: str = "text", out: str = "terms") -> DataFrame:
    """Add ``out``: ``array<struct<tok, tf>>``, the term counts of each row.

    Counting is done inside the row, on the sorted token array (a term ends where the next token
    differs), so no shuffle is needed to learn the counts of one text.
    """
    words, ends = "__words", "__ends"
    df = df.withColumn(words, F.sort_array(tokens(F.col(text))))
    df = df.withColumn(
        ends,
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
            lambda i: ~F.get(F.col(words), i - 1).eqNullSafe(F.get(F.col(words), i)),
        ),
    )
    return df.withColumn(
        out,
        F.transform(
            ends,
            lambda end, i: F.struct(
                F.get(F.col(words), end - 1).alias("tok"),
                (end - F.coalesce(F.get(F.col(ends), i - 1), F.lit(0))).alias("tf"),
            ),
        ),
    ).drop(words, ends)


def chunk_list(text: Column, size: int = DEFAULT_CHUNK_CHARS, overlap: int = 0) -> Column:
    """Windows of ``size`` code points, each starting ``size - overlap`` after the one before.

    One linear pass of a regular expression; repeated ``substr`` would walk the text from its start
    for every chunk. A tail that would hold nothing but overlap is not emitted, and empty text
    gives an empty array.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")
    if overlap == 0:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    has_more = f"(?:\\A|(?=.{{{overlap + 1}}}))"
    pattern = f"(?s){has_more}(?=(.{{1,{size}}})).{{1,{size - overlap}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
