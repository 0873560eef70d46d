"""From documents to an encoded library."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.functions import urls
from scholium.functions.arrays import unnest
from scholium.operators import weighting

# Encoders whose vectors are scaled to unit length.
UNIT_LENGTH_ENCODERS = ("hkunlp/instructor-large", "hkunlp/instructor-xl")
# Fixed value: how the citation of a text file starts.
TEXT_CITATION_PREFIX = "Chunk file "


def quarantine_failures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split documents into usable ones and ``rejects(source, reason)``."""
    reason = F.when(F.col("text").isNull(), "unreadable").when(F.length("text") == 0, "empty")
    marked = docs.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull()).drop("reason")
    return good, marked.filter(F.col("reason").isNotNull()).select("source", "reason")


def content_keys(docs: DataFrame, id_col: str = "source") -> DataFrame:
    """``(dockey, <id>, copies)``: the lowest id of each distinct text.

    Only the digest and the id are shuffled, after a map-side aggregation, so a text that has very
    many copies arrives as one row per task.
    """
    return docs.groupBy(F.md5("text").alias("dockey")).agg(
        F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies")
    )


def dedup_by_content(docs: DataFrame, id_col: str = "source") -> DataFrame:
    """One document per distinct text: the one with the lowest id.

    Ids may repeat with other texts. A row that repeats as a whole stays as often as it comes.
    """
    first = content_keys(docs, id_col).select(F.col(id_col).alias("__id"), F.col("dockey").alias("__key"))
    return docs.join(first, (F.col(id_col) == F.col("__id")) & (F.md5("text") == F.col("__key")), "left_semi")


def assign_citations(docs: DataFrame) -> DataFrame:
    """Citation and name of ``.txt`` documents; null for all others."""
    base = urls.last_segment(F.col("source"))
    is_text = F.col("source").endswith(".txt")
    return docs.withColumns(
        {
            "docname": F.when(is_text, base),
            "citation": F.when(is_text, F.concat(F.lit(TEXT_CITATION_PREFIX), base)),
        }
    )


def chunk_texts_with_source(
    docs: DataFrame, chunk_chars: int = tx.DEFAULT_CHUNK_CHARS, overlap: int = 0
) -> DataFrame:
    """``(source, chunk_no, text)``, chunks numbered from 1."""
    chunks = unnest(docs, ["source"], tx.chunk_list(F.col("text"), chunk_chars, overlap), "text", "pos")
    return chunks.select("source", (F.col("pos") + 1).alias("chunk_no"), "text")


def chunk_texts(docs: DataFrame, chunk_chars: int = tx.DEFAULT_CHUNK_CHARS, overlap: int = 0) -> DataFrame:
    """The chunk texts alone."""
    return chunk_texts_with_source(docs, chunk_chars, overlap).select("text")


Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


def embed_chunks_with_source(
    chunks: DataFrame, encoder: Encoder | str | None = "tfidf", keys: Sequence[str] = ("source", "chunk_no")
) -> DataFrame:
    """Add an ``embedding`` to each chunk.

    ``"tfidf"`` is the built-in sparse encoder: ``array<struct<tok, w>>`` of unit length, as
    ``(keys, embedding)``. A callable maps a list of texts to dense vectors and runs on Arrow batches
    in the Python workers. No encoder gives a null column.
    """
    if encoder is None or encoder == "":
        return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    if encoder == "tfidf":
        return weighting.tfidf_vectors(chunks, keys)
    if isinstance(encoder, str):
        raise ValueError(f"unknown encoder {encoder!r}")

    columns = [f"`{name}` {kind}" for name, kind in chunks.dtypes]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.asarray(encoder(batch["text"].tolist()), dtype=np.float32)
            yield batch.assign(embedding=list(vectors))

    return chunks.mapInPandas(encode, ", ".join([*columns, "embedding array<float>"]))


def embed_chunks(
    chunks: DataFrame, encoder: Encoder | str | None = "tfidf", keys: Sequence[str] = ("source", "chunk_no")
) -> DataFrame:
    """The vectors without their sources."""
    return embed_chunks_with_source(chunks, encoder, keys).select("embedding")


def unit_vector(vector: Column) -> Column:
    """``vector`` as doubles of unit length; null for a zero vector."""
    doubles = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(doubles, lambda x: x / norm))


def normalize_embeddings(df: DataFrame, encoder: str | None = None, col: str = "embedding") -> DataFrame:
    """Scale vectors to unit length; with an encoder name, only for those that ask for it."""
    if encoder is not None and encoder not in UNIT_LENGTH_ENCODERS:
        return df
    return df.withColumn(col, unit_vector(F.col(col)))
