"""Sources and sinks. The files read here are written from the given tables first."""

from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.operators import library
from scholium.plans.storage import scratch_path
from scholium.registry.tables import CHUNKS_SQL, docs, table
from scholium.sources import corpus, id_lists, library_table


def read_id_list(spark, sf):
    d = table(spark, sf, "documents")
    two = F.concat(F.lit(" "), F.col("doc_id"), F.lit("\t"), F.col("source"), F.lit("  "))
    lines = d.select(F.when(F.col("lang").isin("fr", "de"), two).otherwise(F.col("doc_id").cast("string")).alias("value"))
    blank = d.filter("lang = 'es'").select(F.lit("  ").alias("value"))
    path = scratch_path(spark, "id_list")
    lines.unionByName(blank).write.text(path)
    return id_lists.read_id_list(spark, path).select("pmid", "name")


def explode_id_list(spark, sf):
    lists = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("doc_id"), F.lit(" , "), F.col("source"), F.lit(","), F.col("lang")).alias("list")
    )
    return id_lists.explode_id_list(lists, "list").select("doc_id", "pos", "pmid")


def _lines(content):
    text = F.decode(content, "utf-8")
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def scan_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    table(spark, sf, "documents").select("source", "text").write.option("maxRecordsPerFile", 1000).partitionBy("source").text(path)
    files = corpus.scan_corpus(spark, f"{path}/*")
    folder = F.substring_index(F.substring_index("source", "/", -2), "/", 1)
    return files.groupBy(F.replace(folder, F.lit("source="), F.lit("")).alias("folder")).agg(
        F.sum("length").alias("n_bytes"), F.sum(_lines(F.col("content"))).alias("n_lines")
    )


def scan_table(spark, sf):
    cut = F.when(F.col("n_chars") < 100, F.lit("")).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("source"), cut.alias("text"))
    return corpus.scan_table(d).select("source", F.length("text").alias("n"))


def write_id_list(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pmid"), "lang", "source")
    path = scratch_path(spark, "ids")
    id_lists.write_id_list(d, path)
    id_lists.write_id_list(d.filter("lang = 'en'"), path)
    id_lists.write_id_list(d.filter("source = 'src1'"), path, "append")
    return id_lists.read_id_list(spark, path).groupBy("pmid").agg(F.count(F.lit(1)).alias("n"))


def write_artifacts(spark, sf):
    d = table(spark, sf, "documents")
    start = F.when(F.col("source").isin("src0", "src1", "src2"), F.lit("%PDF-1.4 ")).otherwise(F.lit(""))
    declared = F.when(F.col("lang") == "fr", "text/plain").otherwise("text/html")
    path = scratch_path(spark, "artifacts")
    corpus.write_artifacts(
        d.select(
            F.col("doc_id").cast("string").alias("pmid"),
            "source",
            F.concat(start, "text").cast("binary").alias("content"),
            declared.alias("declared"),
        ),
        path,
    )
    return corpus.read_artifacts(spark, path).select("pmid", "kind", F.md5("content").alias("digest"))


def save_library(spark, sf):
    root = scratch_path(spark, "library")
    every = docs(spark, sf).select(F.col("source").cast("string").alias("source"), "text")
    for part in (F.length("text") < 1000, F.length("text") >= 1000):
        some = library.assign_citations(every.filter(part))
        chunks = tx.with_terms(library.chunk_texts_with_source(some))
        library_table.save_library(some, chunks, root, "all papers")
    papers, chunks = library_table.load_library(spark, root, "all papers")
    return (
        chunks.join(papers.select("source", "dockey", "encoder"), "source")
        .select("source", "chunk_no", F.md5("text").alias("digest"), "dockey", "encoder", "lib")
    )


QUERIES = {
    "read_id_list": read_id_list,
    "explode_id_list": explode_id_list,
    "scan_corpus": scan_corpus,
    "scan_corpus_table": scan_table,
    "write_id_list": write_id_list,
    "write_artifacts": write_artifacts,
    "save_library": save_library,
}

ORACLES = {
    "read_id_list": """
SELECT CAST(doc_id AS VARCHAR) AS pmid,
       CASE WHEN lang IN ('fr', 'de') THEN source ELSE CAST(doc_id AS VARCHAR) END AS name
FROM documents""",
    "explode_id_list": """
SELECT doc_id, 0 AS pos, CAST(doc_id AS VARCHAR) AS pmid FROM documents
UNION ALL SELECT doc_id, 1, source FROM documents
UNION ALL SELECT doc_id, 2, lang FROM documents""",
    "scan_corpus": """
SELECT source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes,
       CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines
FROM documents GROUP BY source""",
    "scan_corpus_table": """
SELECT doc_id AS source, CAST(length(text) AS INTEGER) AS n FROM documents WHERE n_chars >= 100 AND length(text) > 0""",
    "write_id_list": """
SELECT pmid, count(*) AS n FROM (
  SELECT CAST(doc_id AS VARCHAR) AS pmid FROM documents WHERE lang = 'en'
  UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE source = 'src1') GROUP BY pmid""",
    "write_artifacts": """
SELECT CAST(doc_id AS VARCHAR) AS pmid,
       CASE WHEN source IN ('src0', 'src1', 'src2') OR starts_with(text, '%PDF') THEN 'pdf'
            WHEN lang = 'fr' THEN 'txt' ELSE 'html' END AS kind,
       md5(CASE WHEN source IN ('src0', 'src1', 'src2') THEN '%PDF-1.4 ' || text ELSE text END) AS digest
FROM documents""",
    "save_library": f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS source, text FROM documents), {CHUNKS_SQL.format("d")}
SELECT c.source, c.chunk_no, md5(c.text) AS digest, md5(d.text) AS dockey, 'tfidf' AS encoder, 'all_papers' AS lib
FROM chunks c JOIN d USING (source)""",
}
