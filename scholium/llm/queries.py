"""One query per operator over the given tables, and the SQL where it can express one."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import alignment, conversations, decontamination, exact_dedup, fingerprints, language, language_model, mixing, ngram_join, packing, sharding, token_counts, toxicity
from scholium.llm.shared import id_hash_mod
from scholium.plans.storage import discard


def vocabulary(name: str) -> str:
    """Where the executors have a public tokenizer; the package is installed with Python on all of them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    made = fingerprints.fingerprint_with_next(_documents(spark, sf))
    sketch, edited = F.col("sketch"), F.col("edited_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(sketch).alias("fingerprint"),
        fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(sketch, edited).alias("near_edited"),
        fingerprints.resemblance(sketch, F.col("next_sketch")).alias("near_next"),
        fingerprints.containment(edited, sketch).alias("edited_contained"),
        fingerprints.distinct_shingles(sketch).alias("n_shingles"),
    )


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.find_copies(_documents(spark, sf)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes"
    )


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).withColumn("held_out", id_hash_mod("doc_id", 4) == 2)
    sample = language.labelled_sample(docs.filter("NOT held_out"))
    network = language.fit(sample)
    discard(sample)
    found = language.predict(docs.select("doc_id", "held_out", "text"), network)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.link_documents(_documents(spark, sf)).select("doc_id", "n_shingles", "component_id")


def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_documents(spark, sf), 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_documents(_documents(spark, sf), (1, 2, 3), 3.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def toxicity_model(spark: SparkSession, sf: str, docs: DataFrame):
    """Fitted on labelled rows whose id hashes to 1 to 4 modulo 5."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(id_hash_mod("doc_id", 5) != 0)
    labels = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    sample = toxicity.labelled_sample(docs, labels, toxicity.SAMPLE_PER_CLASS)
    model = toxicity.fit(sample)
    discard(sample)
    return model


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    rows = docs.select("doc_id", (id_hash_mod("doc_id", 5) == 0).alias("held_out"), "text")
    scored = toxicity.score(rows, toxicity_model(spark, sf, docs))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf), vocabulary("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.count_tokens(_documents(spark, sf), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_language_model(spark: SparkSession, sf: str) -> DataFrame:
    held_out = id_hash_mod("doc_id", 7) == 2
    docs = _documents(spark, sf).withColumn("held_out", held_out)
    scored = language_model.train_and_score(docs, "NOT held_out")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    scored = alignment.align_and_score(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return scored.select(
        "doc_id",
        "aligned.n_a",
        "aligned.n_b",
        "aligned.n_groups",
        F.col("aligned.n_groups").alias("n_links"),
        "n_best",
        "count_sum",
        "aligned.groups_sha256",
    )


def damaged_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``conversations``, each with one kind of damage or none. Rows that the damage drops
    stay with ``present`` false and without their text."""
    blank = F.lit(" ")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = shown("text")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")


def op12_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair_report(damaged_conversations(spark, sf), F.col("present"))


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontamination.find_matches(_documents(spark, sf).select("doc_id", "text"), items)
    return found.select(
        "doc_id",
        "match.n_words",
        "match.n_hit",
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("match.n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language": op3_language,
    "op4_ngram_join": op4_ngram_join,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_language_model": op10_language_model,
    "op11_alignment": op11_alignment,
    "op12_conversations": op12_conversations,
    "op13_decontamination": op13_decontamination,
}

# Without SQL, and tested against plain Python instead: hashes or checksums that SQL lacks (1, 5),
# learned or random results (3, 6, 7, 10), tokenizer libraries (8, 9).
ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        WITH t AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
          FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(s) AS text_sha256, CAST(strlen(s) AS BIGINT) AS n_bytes
        FROM t WINDOW g AS (PARTITION BY s)""",
    "op4_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x20\x09-\x0D]+') AS ws
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_in AS (
          SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (
          SELECT a, b FROM both_in JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        ties AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(doc_id, other) AS (
          SELECT doc_id, doc_id FROM w UNION SELECT reached.doc_id, ties.b FROM reached JOIN ties ON ties.a = reached.other)
        SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
        FROM w JOIN reached USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id""",
    "op13_decontamination": r"""
        WITH w AS (
          SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
          FROM documents),
        b AS (
          SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
          FROM benchmark),
        windows AS (
          SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS s
          FROM (SELECT item, ws, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
        grams AS (
          SELECT id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS s
          FROM (SELECT id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i
                FROM w, (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k)),
        found AS (SELECT DISTINCT id, i, grams.k, item FROM grams JOIN windows USING (k, s)),
        hit AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest(generate_series(i, i + k - 1)) AS j FROM found) GROUP BY id),
        named AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM found) GROUP BY id)
        SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(named.items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
        FROM w LEFT JOIN hit USING (id) LEFT JOIN named USING (id)""",
}
