"""A corpus made ready for training: five stages over the documents table.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that the one before kept, and
returns the columns of documents; the last returns packed pieces. Rows of any shape pass: texts may
be null, empty or very long, ids null or repeated, and further columns are carried along. A stage
that gets an empty table returns one.
"""

from pyspark.sql import DataFrame, SparkSession

from scholium.llm import exact_dedup, mixing, ngram_join, packing, queries, toxicity
from scholium.llm.shared import free_name
from scholium.plans.storage import discard, materialize

# Words whose token ids a packing worker remembers; rows do not depend on it.
REMEMBERED_WORDS = 50_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 1/2. The classifier is fitted on their labelled rows, see ``toxicity_model``."""
    score = free_name("toxic_score", docs.columns)
    scored = toxicity.score(docs, queries.toxicity_model(spark, sf_dir, docs), score)
    return scored.filter(f"{score} < 0.5").drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts differ in the case of A-Z at most, the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by links of 0.8 or more on five-word shingles, the one with the smallest id."""
    return ngram_join.keep_first_of_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 1, 2, 3 in turn, at most 3 copies."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4,096 tokens. The stages before have left the executors' heaps grown, so
    workers remember fewer words than the operator would alone."""
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"), remembered=REMEMBERED_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Learned scores, random odds and a tokenizer library are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written as Parquet and read again for the next. A stage's
    table goes once the next one has been written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*held)
        held = [docs]
    return docs
