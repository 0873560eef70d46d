"""Libraries, encoders and skewed lookups."""

import os

import pytest
from pyspark.sql import functions as F

from scholium.operators import library
from scholium.plans import skew
from scholium.plans.storage import scratch_path
from scholium.sources import corpus, id_lists, library_table


def _docs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, text string")


def test_adding_twice_is_adding_once(spark, rows):
    root = scratch_path(spark, "lib")
    docs = _docs(spark, ("p/a.txt", "alpha beta"), ("p/b.pdf", "x" * 3001), ("p/c.txt", ""), ("p/d.txt", None))
    rejects = library_table.library_add(docs.limit(1), root, "my lib!", 0)
    assert rejects.count() == 0
    rejects = library_table.library_add(docs, root, "my lib", 1)
    assert rows(rejects) == [("p/c.txt", "empty"), ("p/d.txt", "unreadable")]
    library_table.library_add(docs, root, "my lib", 2)
    library_table.library_add(docs, root, "my lib", 1)  # a batch that runs again
    papers, chunks = library_table.load_library(spark, root, "my_lib")
    assert rows(papers.select("source", "docname", "citation", "lib")) == [
        ("p/a.txt", "a.txt", "Chunk file a.txt", "my_lib"), ("p/b.pdf", None, None, "my_lib"),
    ]
    assert rows(chunks.select("source", "chunk_no")) == [("p/a.txt", 1), ("p/b.pdf", 1), ("p/b.pdf", 2)]
    with pytest.raises(ValueError, match="encoder"):
        library_table.library_add(docs, root, "my lib", 3, encoder="other")
    assert library_table.load_library(spark, root, "another")[0].count() == 0


def test_calls_without_a_key_add(spark, rows):
    root = scratch_path(spark, "lib")
    library_table.library_add(_docs(spark, ("a.txt", "one"), ("b.txt", "two"), ("a.txt", "more")), root, "l")
    library_table.library_add(_docs(spark, ("b.txt", "two"), ("c.txt", "three")), root, "l")
    papers, chunks = library_table.load_library(spark, root, "l")
    assert rows(papers.select("source")) == [("a.txt",), ("b.txt",), ("c.txt",)]
    assert rows(chunks.select("source", "chunk_no", "text")) == [("a.txt", 1, "more"), ("b.txt", 1, "two"), ("c.txt", 1, "three")]


def test_first_of_equal_texts_with_repeated_ids(spark, rows):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "source long, text string")
    assert rows(library.dedup_by_content(docs)) == [(1, "x"), (2, "y")]


@pytest.mark.parametrize("name,want", [("a b/c", "a_bc"), ("x-1.(2)", "x-1.(2)"), ("é9", "9")])
def test_names(name, want):
    assert library_table.clean_name(name) == want


def test_bad_name():
    with pytest.raises(ValueError):
        library_table.clean_name("_-é")


def test_encoders(spark):
    chunks = spark.createDataFrame([("a", 1, "xx"), ("b", 1, "yyy")], "source string, chunk_no int, text string")
    own = library.embed_chunks_with_source(chunks, lambda texts: [[len(t), 1.0] for t in texts])
    assert {r.source: r.embedding for r in own.collect()} == {"a": [2.0, 1.0], "b": [3.0, 1.0]}
    assert {r.embedding for r in library.embed_chunks_with_source(chunks, "").collect()} == {None}
    with pytest.raises(ValueError):
        library.embed_chunks_with_source(chunks, "no such encoder")


def test_unit_length_only_where_asked(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "id int, embedding array<float>")
    assert [r.embedding for r in library.normalize_embeddings(df).orderBy("id").collect()] == [[0.6, 0.8], None]
    assert library.normalize_embeddings(df, "other").head().embedding == [3.0, 4.0]
    assert library.normalize_embeddings(df, "hkunlp/instructor-xl").head().embedding == [0.6, 0.8]


def test_membership_equals_join(spark, rows):
    keys = F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    data = spark.range(600).select("id", keys.alias("k"))
    for members in (["hot"] + [f"k{i}" for i in range(0, 50, 2)], ["k1", "k2"]):
        table = spark.createDataFrame([(k,) for k in members], "k string")
        for how in ("left_semi", "left_anti"):
            assert rows(skew.membership(data, table, "k", how)) == rows(data.join(table, "k", how).select("k", "id"))
    frequent = rows(skew.frequent_keys(data, "k", 0.25))
    assert ("hot",) in frequent and len(frequent) <= 4


@pytest.mark.parametrize("share", [2, 20_000])
def test_lookup_equals_left_join(spark, rows, monkeypatch, share):
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    keys = F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    data = spark.range(600).select("id", keys.alias("k"))
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    counts = data.filter("k IS NOT NULL").groupBy("k").count()
    hot = table.join(skew.hot_keys(counts, "count").select("k"), "k")
    want = rows(data.join(table, "k", "left").select("id", "k", "v"))
    assert rows(skew.lookup(data, table, hot, "k")) == want
    matched = [r for r in want if r[2] is not None]
    assert rows(skew.salted_lookup(data, table, "k", ["id"]).select("id", "k", "v")) == matched


def test_the_repeated_table_is_not_broadcast(spark):
    data = spark.range(600).selectExpr("id", "concat('k', id % 50) AS k")
    table = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    plan = skew.salted_lookup(data, table, "k", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_scan_reads_direct_children(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("a.txt", "abc"), ("empty.txt", ""), ("sub/b.txt", "deep")):
        (tmp_path / name).write_text(content)
    files = corpus.scan_corpus(spark, str(tmp_path)).select("source", "length").collect()
    assert [(os.path.basename(r.source), r.length) for r in files] == [("a.txt", 3)]
    assert corpus.scan_corpus(spark, str(tmp_path / "a.txt")).count() == 1


def test_id_list_layouts(spark, rows, tmp_path):
    (tmp_path / "ids.txt").write_text("1\n 2\tname2  \n\n   \n3 name3 extra\r\n")
    got = id_lists.read_id_list(spark, str(tmp_path / "ids.txt"))
    assert rows(got.select("pmid", "name")) == [("1", "1"), ("2", "name2"), ("3", "name3")]
    assert [r.pmid for r in got.orderBy("ord").collect()] == ["1", "2", "3"]
    lists = spark.createDataFrame([("1, 2 ,3",)], "l string")
    assert rows(id_lists.explode_id_list(lists, "l").select("pos", "pmid")) == [(0, "1"), (1, "2"), (2, "3")]


def test_artifact_kinds(spark, rows):
    path = scratch_path(spark, "artifacts")
    df = spark.createDataFrame(
        [("1", "s", b"%PDF-1.7 x", "text/plain"), ("2", "s", b"abc", "text/plain"), ("3", "s", b"<html>", "text/html"), ("4", "s", b"%P", None)],
        "pmid string, source string, content binary, declared string",
    )
    corpus.write_artifacts(df, path)
    assert rows(corpus.read_artifacts(spark, path).select("pmid", "kind")) == [("1", "pdf"), ("2", "txt"), ("3", "html"), ("4", "html")]
