"""The given tables in the shapes that the operators take, and shared SQL fragments."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.sources import corpus

TOKENS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

# One id for each turn of each conversation.
TURN_ID_SQL = "conv_id * 1000000 + turn"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose long texts are worked on."""
    return corpus.read_table(spark, f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select(F.col("doc_id").alias("source"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every question of every conversation."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    return turns.select(F.expr(TURN_ID_SQL).alias("qid"), "text")


def ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("pmid"), F.col("doc_id").alias("ord"))


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """A stored artifact per labelled document, its kind given by the labels."""
    kind = F.expr("CASE WHEN quality = 1 THEN 'pdf' WHEN toxic = 1 THEN 'txt' ELSE 'html' END")
    return table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("pmid"), kind.alias("kind"))


ARTIFACTS_SQL = """
artifacts AS (
  SELECT CAST(doc_id AS VARCHAR) AS pmid,
         CASE WHEN quality = 1 THEN 'pdf' WHEN toxic = 1 THEN 'txt' ELSE 'html' END AS kind
  FROM labels)"""

UNIQUE_SQL = """
uniq AS (
  SELECT source, text FROM (
    SELECT doc_id AS source, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn
    FROM documents) WHERE rn = 1)"""

CHUNKS_SQL = """
chunks AS (
  SELECT source, CAST(i AS INTEGER) AS chunk_no, substr(text, (i - 1) * 3000 + 1, 3000) AS text
  FROM (SELECT source, text, unnest(range(1, CAST(ceil(length(text) / 3000.0) AS BIGINT) + 1)) AS i FROM {0}))"""

WEIGHTS_SQL = f"""
posts AS (
  SELECT source, chunk_no, tok, count(*) AS tf
  FROM (SELECT source, chunk_no, unnest({TOKENS_SQL.format('text')}) AS tok FROM chunks)
  GROUP BY ALL),
freq AS (SELECT tok, count(*) AS df FROM posts GROUP BY tok),
total AS (SELECT count(*) AS n FROM chunks),
raw AS (
  SELECT source, chunk_no, tok, tf * (ln((n + 1.0) / (df + 1.0)) + 1) AS w
  FROM posts JOIN freq USING (tok) CROSS JOIN total),
weights AS (
  SELECT source, chunk_no, tok, w / sqrt(sum(w * w) OVER (PARTITION BY source, chunk_no)) AS w FROM raw)"""

HITS_SQL = f"""
questions AS (SELECT {TURN_ID_SQL} AS qid, text FROM conversations WHERE role = 'user'),
qposts AS (
  SELECT qid, tok, count(*) AS tf
  FROM (SELECT qid, unnest({TOKENS_SQL.format('text')}) AS tok FROM questions) GROUP BY ALL),
qraw AS (
  SELECT qid, tok, tf * (ln((n + 1.0) / (df + 1.0)) + 1) AS w FROM qposts JOIN freq USING (tok) CROSS JOIN total),
qweights AS (SELECT qid, tok, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM qraw),
scores AS (
  SELECT qid, source, chunk_no, round(sum(q.w * c.w), 6) AS score
  FROM qweights q JOIN weights c USING (tok) GROUP BY ALL),
hits AS (
  SELECT qid, source, chunk_no, score,
         CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, chunk_no) AS INTEGER) AS rank
  FROM scores WHERE score > 0 QUALIFY rank <= 10)"""

RETRIEVAL_SQL = ",".join([UNIQUE_SQL, CHUNKS_SQL.format("uniq"), WEIGHTS_SQL, HITS_SQL])
