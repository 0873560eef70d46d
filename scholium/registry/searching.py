"""Search over the documents and orders tables."""

from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.operators import search
from scholium.registry.tables import TOKENS_SQL, TURN_ID_SQL, questions, table, texts

KEYWORD = "The AND of AND and"
RETMAX = 25
TOP_KEYWORDS = 5


def _queries(spark, sf):
    """All words of each benchmark item as a query."""
    words = tx.tokens(F.col("text"))
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.array_join(words, " AND ").alias("keyword")
    )


def _hits(spark, sf):
    return search.batch_search(_queries(spark, sf), texts(spark, sf, "documents"))


def fielded_search(spark, sf):
    d = texts(spark, sf, "documents")
    return search.fielded_search(d, tw="the", pt="src3").select("doc_id", "source")


def fielded_search_dates(spark, sf):
    orders = table(spark, sf, "orders")
    hits = search.fielded_search(orders, pt="F", dp="1996/01/01:1997/06/30", kind="o_orderstatus", day="o_orderdate")
    return hits.select("o_orderkey", "o_orderstatus")


def boolean_keywords(spark, sf):
    return search.boolean_keywords(texts(spark, sf, "documents"), KEYWORD).select("doc_id")


def limit_per_query(spark, sf):
    return search.limit_per_query(_hits(spark, sf), RETMAX)


def merge_id_lists(spark, sf):
    d = table(spark, sf, "documents")
    old = d.filter("lang = 'en'").select("doc_id")
    new = d.filter("n_chars > 1000").select("doc_id")
    modes = ("overwrite", "add", "add_distinct")
    lists = [search.merge_id_lists(old, new, mode).select(F.lit(mode).alias("mode"), "doc_id") for mode in modes]
    every = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return every.groupBy("mode", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def keyword_hit_counts(spark, sf):
    return search.keyword_hit_counts(_queries(spark, sf), _hits(spark, sf))


def question_keywords(spark, sf):
    asked = questions(spark, sf).withColumn("text", F.concat("text", F.lit("??")))
    return search.question_keywords(asked, texts(spark, sf, "documents"), TOP_KEYWORDS)


def search_by_question(spark, sf):
    found = search.search_by_question(questions(spark, sf), texts(spark, sf, "documents"), TOP_KEYWORDS)
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


QUERIES = {
    "fielded_search": fielded_search,
    "fielded_search_dates": fielded_search_dates,
    "boolean_keywords": boolean_keywords,
    "batch_search": _hits,
    "limit_per_query": limit_per_query,
    "merge_id_lists": merge_id_lists,
    "keyword_hit_counts": keyword_hit_counts,
    "question_keywords": question_keywords,
    "search_by_question": search_by_question,
}

_HITS = f"""
q AS (
  SELECT item_id AS qid, {TOKENS_SQL.format('text')} AS words FROM benchmark),
d AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS words FROM documents),
hits AS (SELECT qid, doc_id FROM q JOIN d ON list_has_all(d.words, q.words))"""

_KEYWORDS = f"""
posts AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL.format('text')}) AS tok FROM documents),
freq AS (SELECT tok, count(*) AS df FROM posts GROUP BY tok),
total AS (SELECT count(*) AS n FROM documents),
qposts AS (
  SELECT qid, tok, count(*) AS tf FROM (
    SELECT {TURN_ID_SQL} AS qid, unnest({TOKENS_SQL.format('text')}) AS tok
    FROM conversations WHERE role = 'user') GROUP BY ALL),
weights AS (
  SELECT qid, tok AS keyword, round(tf * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1), 6) AS weight
  FROM qposts LEFT JOIN freq USING (tok) CROSS JOIN total),
keywords AS (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY weight DESC, keyword) AS INTEGER) AS rank,
         keyword, weight
  FROM weights QUALIFY rank <= {TOP_KEYWORDS})"""

ORACLES = {
    "fielded_search": f"""
SELECT doc_id, source FROM documents
WHERE source = 'src3' AND list_contains({TOKENS_SQL.format('text')}, 'the')""",
    "fielded_search_dates": """
SELECT o_orderkey, o_orderstatus FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'""",
    "boolean_keywords": f"""
SELECT doc_id FROM documents WHERE list_has_all({TOKENS_SQL.format('text')}, ['the', 'of', 'and'])""",
    "batch_search": f"WITH {_HITS} SELECT qid, doc_id FROM hits",
    "limit_per_query": f"""
WITH {_HITS}
SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS INTEGER) AS rank
FROM hits QUALIFY rank <= {RETMAX}""",
    "merge_id_lists": """
WITH old AS (SELECT doc_id FROM documents WHERE lang = 'en'), new AS (SELECT doc_id FROM documents WHERE n_chars > 1000)
SELECT mode, doc_id, count(*) AS n FROM (
  SELECT 'overwrite' AS mode, doc_id FROM new
  UNION ALL SELECT 'add', doc_id FROM old UNION ALL SELECT 'add', doc_id FROM new
  UNION ALL SELECT 'add_distinct', doc_id FROM (SELECT doc_id FROM old UNION SELECT doc_id FROM new))
GROUP BY mode, doc_id""",
    "keyword_hit_counts": f"""
WITH {_HITS}
SELECT qid, array_to_string(words, ' AND ') AS keyword, count(doc_id) AS n_hits
FROM q LEFT JOIN hits USING (qid) GROUP BY ALL""",
    "question_keywords": f"WITH {_KEYWORDS} SELECT qid, rank, keyword, weight FROM keywords",
    "search_by_question": f"""
WITH {_KEYWORDS}
SELECT keyword, count(*) AS n_docs, min(doc_id) AS first_doc
FROM (SELECT DISTINCT keyword FROM keywords) k JOIN posts ON tok = keyword GROUP BY keyword""",
}
