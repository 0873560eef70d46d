"""Building a library from the documents table."""

from pyspark.sql import functions as F

from scholium.functions.arrays import unnest
from scholium.operators import library
from scholium.plans.storage import scratch_path
from scholium.registry.tables import CHUNKS_SQL, UNIQUE_SQL, WEIGHTS_SQL, docs, table, texts
from scholium.sources import library_table

OVERLAP = 100


def chunk_texts(spark, sf):
    return library.chunk_texts(docs(spark, sf))


def chunk_texts_with_source(spark, sf):
    return library.chunk_texts_with_source(docs(spark, sf))


def chunk_texts_overlap(spark, sf):
    return library.chunk_texts_with_source(docs(spark, sf), overlap=OVERLAP)


def _chunks(spark, sf):
    return library.chunk_texts_with_source(library.dedup_by_content(docs(spark, sf)))


def embed_chunks(spark, sf):
    vectors = library.embed_chunks(_chunks(spark, sf))
    terms = unnest(vectors.withColumn("n_terms", F.size("embedding")), ["n_terms"], F.col("embedding"), "t")
    return terms.groupBy("n_terms", "t.tok").agg(F.round(F.sum("t.w"), 5).alias("w"))


def embed_chunks_with_source(spark, sf):
    vectors = library.embed_chunks_with_source(_chunks(spark, sf))
    terms = unnest(vectors, ["source", "chunk_no"], F.col("embedding"), "t")
    return terms.select("source", "chunk_no", "t.tok", F.round("t.w", 6).alias("w"))


def normalize_embeddings(spark, sf):
    scaled = table(spark, sf, "embeddings").withColumn("embedding", F.expr("transform(embedding, x -> cast(x as double) * (label + 1))"))
    unit = library.normalize_embeddings(scaled)
    parts = unnest(unit, ["vec_id"], F.col("embedding"), "x", "pos")
    return parts.select("vec_id", "pos", F.round("x", 6).alias("x"))


def _damaged(spark, sf):
    """Documents of which some short ones cannot be read or are empty."""
    text = F.expr("CASE WHEN n_chars < 300 AND lang = 'fr' THEN NULL WHEN n_chars < 300 AND lang = 'de' THEN '' ELSE text END")
    return texts(spark, sf, "documents").select(F.col("doc_id").alias("source"), text.alias("text"))


def quarantine_failures(spark, sf):
    good, rejects = library.quarantine_failures(_damaged(spark, sf))
    return good.select("source", F.lit("ok").alias("reason")).unionByName(rejects)


def library_add(spark, sf):
    root = scratch_path(spark, "library")
    d = table(spark, sf, "documents")
    every = _damaged(spark, sf).join(d.select(F.col("doc_id").alias("source"), "lang"), "source")
    every = every.withColumn("source", F.concat(F.lit("papers/"), F.col("source"), F.lit(".txt")))
    library_table.library_add(every.filter("lang IN ('en', 'fr')"), root, "lib")
    library_table.library_add(every, root, "lib")
    _, chunks = library_table.load_library(spark, root, "lib")
    return chunks.select("source", "chunk_no", F.md5("text").alias("digest"), F.size("terms").alias("n_terms"))


def assign_citations(spark, sf):
    path = F.expr("concat('papers/', lang, '/', doc_id, CASE WHEN n_chars > 500 THEN '.txt' ELSE '.pdf' END)")
    d = table(spark, sf, "documents").select(path.alias("source"))
    return library.assign_citations(d)


def dedup_by_content(spark, sf):
    return library.dedup_by_content(docs(spark, sf)).select("source", F.md5("text").alias("dockey"))


def content_keys(spark, sf):
    return library.content_keys(docs(spark, sf))


QUERIES = {
    "chunk_texts": chunk_texts,
    "chunk_texts_with_source": chunk_texts_with_source,
    "chunk_texts_overlap": chunk_texts_overlap,
    "embed_chunks": embed_chunks,
    "embed_chunks_with_source": embed_chunks_with_source,
    "normalize_embeddings": normalize_embeddings,
    "quarantine_failures": quarantine_failures,
    "library_add": library_add,
    "assign_citations": assign_citations,
    "dedup_by_content": dedup_by_content,
    "content_keys": content_keys,
}

_ALL_CHUNKS = f"WITH d AS (SELECT doc_id AS source, text FROM documents), {CHUNKS_SQL.format('d')}"
_WEIGHTS = ",".join([UNIQUE_SQL, CHUNKS_SQL.format("uniq"), WEIGHTS_SQL])
_DAMAGED = """
damaged AS (
  SELECT doc_id, lang, CASE WHEN n_chars < 300 AND lang = 'fr' THEN NULL
                            WHEN n_chars < 300 AND lang = 'de' THEN '' ELSE text END AS text
  FROM documents)"""

ORACLES = {
    "chunk_texts": f"{_ALL_CHUNKS} SELECT text FROM chunks",
    "chunk_texts_with_source": f"{_ALL_CHUNKS} SELECT source, chunk_no, text FROM chunks",
    "chunk_texts_overlap": f"""
SELECT doc_id AS source, CAST((p - 1) // {3000 - OVERLAP} + 1 AS INTEGER) AS chunk_no, substr(text, p, 3000) AS text
FROM (SELECT doc_id, text,
             unnest(range(1, greatest(1, length(text) - {OVERLAP}) + 1, {3000 - OVERLAP})) AS p
      FROM documents WHERE length(text) > 0)""",
    "embed_chunks": f"""
WITH {_WEIGHTS}, sized AS (SELECT *, CAST(count(*) OVER (PARTITION BY source, chunk_no) AS INTEGER) AS n_terms FROM weights)
SELECT n_terms, tok, round(sum(w), 5) AS w FROM sized GROUP BY n_terms, tok""",
    "embed_chunks_with_source": f"WITH {_WEIGHTS} SELECT source, chunk_no, tok, round(w, 6) AS w FROM weights",
    "normalize_embeddings": """
WITH v AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
                  CAST(unnest(embedding) AS DOUBLE) * (label + 1) AS x FROM embeddings)
SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM v""",
    "quarantine_failures": f"""
WITH {_DAMAGED}
SELECT doc_id AS source, CASE WHEN text IS NULL THEN 'unreadable' WHEN text = '' THEN 'empty' ELSE 'ok' END AS reason
FROM damaged""",
    "library_add": f"""
WITH {_DAMAGED}, d AS (
  SELECT 'papers/' || doc_id || '.txt' AS source, text FROM damaged WHERE length(text) > 0), {CHUNKS_SQL.format("d")}
SELECT c.source, c.chunk_no, md5(c.text) AS digest,
       CAST(len(list_distinct(regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}]+'))) AS INTEGER) AS n_terms
FROM chunks c""",
    "assign_citations": """
WITH d AS (SELECT doc_id, lang, n_chars > 500 AS is_text FROM documents)
SELECT 'papers/' || lang || '/' || doc_id || CASE WHEN is_text THEN '.txt' ELSE '.pdf' END AS source,
       CASE WHEN is_text THEN doc_id || '.txt' END AS docname,
       CASE WHEN is_text THEN 'Chunk file ' || doc_id || '.txt' END AS citation
FROM d""",
    "dedup_by_content": "SELECT min(doc_id) AS source, md5(text) AS dockey FROM documents GROUP BY md5(text)",
    "content_keys": "SELECT md5(text) AS dockey, min(doc_id) AS source, count(*) AS copies FROM documents GROUP BY md5(text)",
}
