"""Finding documents by keyword, type and date."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.functions.arrays import unnest
from scholium.operators import weighting
from scholium.plans import skew
from scholium.plans.storage import materialize

# Fixed values.
DEFAULT_RETMAX = 10_000
DATE_RANGE_FORMAT = "yyyy/MM/dd"

# Largest query set that is broadcast.
BROADCAST_QUERIES = 100_000
SALTS = 32


def _needed(keyword: str) -> list[str]:
    """Tokens of a keyword that the caller typed."""
    words = keyword.replace(tx.KEYWORD_SEPARATOR, " ").lower()
    tokens = "".join(ch if ch.isalpha() or ch.isnumeric() else " " for ch in words).split()
    if not tokens:
        raise ValueError("a keyword needs at least one letter or digit")
    return list(dict.fromkeys(tokens))


def boolean_keywords(df: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    """Rows whose text holds every token of every part of ``'a AND b'``."""
    for token in _needed(keyword):
        df = df.filter(tx.has_token(F.col(text), token))
    return df


def date_range(span: str) -> tuple[Column, Column]:
    """Both ends of ``'YYYY/MM/DD:YYYY/MM/DD'``."""
    start, _, end = span.partition(":")
    return tuple(F.to_date(F.lit(part.strip()), DATE_RANGE_FORMAT) for part in (start, end))


def fielded_search(
    df: DataFrame,
    tw: str | None = None,
    pt: str | None = None,
    dp: str | tuple[date, date] | None = None,
    text: str = "text",
    kind: str = "source",
    day: str = "date",
) -> DataFrame:
    """Rows that meet all given conditions: text word, publication type, date range (inclusive).

    Type and date are plain comparisons with literals, which reach the Parquet scan as filters.
    """
    if dp is not None:
        start, end = date_range(dp) if isinstance(dp, str) else map(F.lit, dp)
        # The end day counts in full, whether the column holds dates or timestamps.
        df = df.filter((F.col(day) >= start) & (F.col(day) < F.date_add(end, 1)))
    if pt is not None:
        df = df.filter(F.col(kind) == pt)
    return df if tw is None else boolean_keywords(df, tw, text)


def batch_search(
    queries: DataFrame,
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_queries: int = BROADCAST_QUERIES,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """``(qid, doc_id)`` for every document that holds all tokens of ``queries(qid, keyword)``.

    A query is looked up by one of its tokens only, the longest, which is likely rare; the others
    are then tested on the document itself. So a common word does not pair all of its queries with
    all of its documents. Queries within the bound are broadcast and documents are not shuffled.
    Beyond it the lookup is a salted shuffle join of narrow rows, so that a hot token is spread; a bitmap leaves
    out most words that no query is looked up by, and a query of one word is answered by the lookup.
    The bound is checked by counting the queries; pass them materialized if they are costly. With ``frequencies(tok, df)`` of
    the documents, queries beyond the bound whose token is frequent, see ``hot_keys``, are still broadcast, if they are
    within it; then no word of a document is shuffled but the seldom ones.
    """
    need = tx.keyword_tokens(F.col("keyword"))
    longest = F.array_max(F.transform("need", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    asked = queries.select("qid", need.alias("need")).filter(F.size("need") > 0)
    asked = asked.select("qid", longest["t"].alias("tok"), "need")
    asked = asked.select("qid", "tok", F.array_remove("need", F.col("tok")).alias("others"))
    words = docs.select(doc_id, F.array_distinct(tx.tokens(F.col(text))).alias("words"))
    # Not ``forall``: a join condition with a lambda keeps the join out of generated code, and every
    # unnested row would then be written out together with its array of words.
    holds_all = F.size(F.array_intersect("words", "others")) == F.size("others")

    def where_they_lie(some: DataFrame) -> DataFrame:
        found = unnest(words, ["*"], F.col("words"), "tok").join(F.broadcast(some), "tok")
        return found.filter(holds_all).select("qid", doc_id)

    if asked.limit(broadcast_queries + 1).count() <= broadcast_queries:
        return where_they_lie(asked)

    often = None
    if frequencies is not None:
        hot = F.broadcast(skew.hot_keys(frequencies, "df").select("tok"))
        often = asked.join(hot, "tok", "left_semi")
        if often.limit(broadcast_queries + 1).count() <= broadcast_queries:
            asked = asked.join(hot, "tok", "left_anti").select(*asked.columns)
        else:
            often = None

    salt = F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    posts = skew.may_match(unnest(words, [doc_id, salt.alias("salt")], F.col("words"), "tok"), asked, "tok")
    # Never broadcast: the planner goes by the size of the queries before they are repeated for each salt.
    candidates = posts.join(asked.select("*", copies.alias("salt")).hint("merge"), ["tok", "salt"])
    if not asked.filter(F.size("others") > 0).isEmpty():
        candidates = candidates.join(words, doc_id).filter(holds_all)
    found = candidates.select("qid", doc_id)
    return found if often is None else found.unionByName(where_they_lie(often))


def limit_per_query(hits: DataFrame, retmax: int = DEFAULT_RETMAX, doc_id: str = "doc_id") -> DataFrame:
    """The ``retmax`` lowest ids of each query, numbered from 1."""
    return skew.top_n_per_key(hits, ["qid"], [F.col(doc_id)], retmax, [doc_id])


def merge_id_lists(old: DataFrame, new: DataFrame, mode: str = "overwrite") -> DataFrame:
    """What an id list holds after a write: ``overwrite``, ``add`` or ``add_distinct``."""
    if mode == "overwrite":
        return new
    both = old.unionByName(new)
    if mode == "add":
        return both
    if mode == "add_distinct":
        return both.distinct()
    raise ValueError(f"unknown mode {mode!r}")


def keyword_hit_counts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``(qid, keyword, n_hits)``, also for queries without a hit."""
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"))
    return queries.join(counts, "qid", "left").select(
        "qid", "keyword", F.coalesce("n_hits", F.lit(0)).alias("n_hits")
    )


def question_keywords(
    questions: DataFrame, corpus: DataFrame, n: int = 5, text: str = "text", frequencies: DataFrame | None = None
) -> DataFrame:
    """``(qid, rank, keyword, weight)``: the ``n`` tokens of each question that tell most, by ``frequencies`` if they are there."""
    posts = _question_postings(questions)
    if frequencies is None:
        frequencies = weighting.frequencies_for(posts, corpus.select(F.col(text).alias("text")))
    weights = weighting.weighted_foreign(posts, frequencies, ["qid"])
    ranked = skew.top_n_per_key(
        weights.select("qid", F.col("tok").alias("keyword"), F.round("w", 6).alias("weight")),
        ["qid"],
        [F.col("weight").desc(), F.col("keyword")],
        n,
        ["keyword"],
    )
    return ranked.select("qid", "rank", "keyword", "weight")


def search_by_question(questions: DataFrame, corpus: DataFrame, n: int = 5, doc_id: str = "doc_id") -> DataFrame:
    """``(keyword, doc_id)``: what each generated keyword finds."""
    frequencies = weighting.frequencies_for(_question_postings(questions), corpus.select("text"))
    keywords = question_keywords(questions, corpus, n, frequencies=frequencies).select("keyword").distinct()
    keywords = materialize(keywords, "keywords")
    queries = keywords.select(F.col("keyword").alias("qid"), "keyword")
    real = frequencies.filter(F.col("tok") != weighting.EVERY_TEXT)
    return batch_search(queries, corpus, doc_id, frequencies=real).withColumnRenamed("qid", "keyword")


def _question_postings(questions: DataFrame) -> DataFrame:
    return weighting.postings(questions.select("qid", tx.strip_question_marks(F.col("text")).alias("text")), ["qid"])
