"""Tokens, term counts, chunks."""

from collections import Counter

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholium.functions import text as tx
from scholium.operators import library

TEXTS = st.lists(st.text(alphabet="ab é\n😀ü9_'", max_size=40), min_size=1, max_size=12)
RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "source long, text string")


def _windows(text, size, overlap):
    step = size - overlap
    return [text[p : p + size] for p in range(0, max(1, len(text) - overlap), step)] if text else []


@RELAXED
@given(texts=TEXTS, size=st.integers(2, 9), overlap=st.integers(0, 8))
def test_chunks_are_windows(spark, texts, size, overlap):
    overlap = min(overlap, size - 1)
    got = {}
    chunks = library.chunk_texts_with_source(_docs(spark, texts), size, overlap)
    for r in sorted(chunks.collect(), key=lambda r: (r.source, r.chunk_no)):
        got.setdefault(r.source, []).append(r.text)
    assert got == {i: w for i, t in enumerate(texts) if (w := _windows(t, size, overlap))}
    if overlap == 0:
        assert all("".join(parts) == texts[i] for i, parts in got.items())


@pytest.mark.parametrize("length,overlap,count", [(3000, 0, 1), (6000, 0, 2), (6001, 0, 3), (2950, 100, 1), (3050, 100, 2), (3000, 100, 1)])
def test_chunk_edges(spark, length, overlap, count):
    text = "é" * length
    assert library.chunk_texts_with_source(_docs(spark, [text]), overlap=overlap).count() == count


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        tx.chunk_list(F.lit("x"), 10, 10)


@RELAXED
@given(texts=TEXTS)
def test_term_counts(spark, texts):
    got = {r.source: {t.tok: t.tf for t in r.terms} for r in tx.with_terms(_docs(spark, texts)).collect()}
    assert got == {i: dict(Counter(regex.findall(r"[\p{L}\p{N}]+", t.lower()))) for i, t in enumerate(texts)}


def test_terms_of_null(spark):
    assert tx.with_terms(_docs(spark, [None])).head().terms == []


def test_question_marks(spark):
    df = spark.createDataFrame([("why??",), ("a? b?",), ("?",), ("no",)], "q string")
    assert [r[0] for r in df.select(tx.strip_question_marks(F.col("q"))).collect()] == ["why", "a? b", "", "no"]
