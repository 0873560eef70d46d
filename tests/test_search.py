"""Keyword search: both ways of a batch, caps, lists."""

import pytest

from scholium.operators import search, weighting
from scholium.plans import jobs, skew
from scholium.registry import searching

DOCS = [(0, "The aging of cells"), (1, "lung cancer and AGING"), (2, "cancer of the lung"), (3, "agings"), (4, ""), (5, None)]
QUERIES = [(0, "aging"), (1, "aging AND lung cancer"), (2, "the"), (3, "nothing here"), (4, "?!"), (5, "the AND of")]
HITS = [(0, 0), (0, 1), (1, 1), (2, 0), (2, 2), (5, 0), (5, 2)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture
def queries(spark):
    return spark.createDataFrame(QUERIES, "qid long, keyword string")


@pytest.mark.parametrize("bound", [0, 1000])
def test_batch_search(docs, queries, rows, bound):
    assert rows(search.batch_search(queries, docs, broadcast_queries=bound)) == HITS


def test_single_keyword(docs, rows):
    assert rows(search.boolean_keywords(docs, "Lung AND cancer").select("doc_id")) == [(1,), (2,)]
    with pytest.raises(ValueError):
        search.boolean_keywords(docs, " AND ")


def test_counts_show_zero(docs, queries, rows):
    hits, counts = jobs.run_searches(queries, docs)
    assert rows(hits) == HITS
    assert {r.qid: r.n_hits for r in counts.collect()} == {0: 2, 1: 1, 2: 2, 3: 0, 4: 0, 5: 2}


@pytest.mark.parametrize("n", [3, 150])
def test_cap(spark, n):
    hits = spark.range(1000).selectExpr("id % 2 AS qid", "id AS doc_id").unionAll(spark.range(5).selectExpr("9", "id"))
    got = search.limit_per_query(hits, n).collect()
    want = {q: sorted(i for i in range(1000) if i % 2 == q)[:n] for q in (0, 1)} | {9: list(range(5))[:n]}
    for q, ids in want.items():
        assert [r.doc_id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == ids


def test_dates_include_both_ends(spark, rows):
    days = ["2020-01-01 00:00:00", "2020-02-03 23:59:59", "2020-02-04 00:00:00", "2019-12-31 23:00:00"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, d string").selectExpr("id", "to_timestamp_ntz(d) AS date")
    assert rows(search.fielded_search(df, dp="2020/01/01:2020/02/03").select("id")) == [(0,), (1,)]


def test_merge(spark, rows):
    old, new = (spark.createDataFrame([(i,) for i in ids], "id long") for ids in ([1, 2, 2], [2, 3]))
    assert rows(search.merge_id_lists(old, new)) == [(2,), (3,)]
    assert rows(search.merge_id_lists(old, new, "add")) == [(1,), (2,), (2,), (2,), (3,)]
    assert rows(search.merge_id_lists(old, new, "add_distinct")) == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        search.merge_id_lists(old, new, "other")


def test_conditions_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = search.fielded_search(orders, pt="F", dp="1996/01/01:1996/12/31", kind="o_orderstatus", day="o_orderdate")
    plan = found.select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(o_orderstatus,F)" in pushed and "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed


def test_limited_queries_need_all_words(spark, tmp_path, rows):
    texts = [(0, "red"), (1, "red fox"), (2, "the fox is red"), (3, "fox")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Red fox!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(searching.limit_per_query(spark, str(tmp_path))) == [(7, 1, 1), (7, 2, 2)]


def test_one_word_queries_beyond_the_bound(spark, rows):
    docs = spark.createDataFrame([(7, "red fox"), (7, "red"), (8, "blue"), (None, "fox")], "doc_id long, text string")
    asked = spark.createDataFrame([("red", "red"), ("fox", "fox")], "qid string, keyword string")
    far = search.batch_search(asked, docs, broadcast_queries=0)
    assert rows(far) == rows(search.batch_search(asked, docs)) and far.count() == 4
    plan = far._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1  # words are not fetched again


def test_asked_tokens_are_not_broadcast(spark, rows, monkeypatch):
    plans, keep = [], weighting.materialize
    monkeypatch.setattr(weighting, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or keep(df, name))
    corpus = spark.createDataFrame([(1, "red fox"), (2, "red")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red dog?"), (2, "fox red red")], "qid long, text string")
    got = rows(search.question_keywords(asked, corpus, 2).select("qid", "rank", "keyword"))
    assert got == [(1, 1, "dog"), (1, 2, "red"), (2, 1, "red"), (2, 2, "fox")]
    assert plans and not any("LeftSemi" in plan for plan in plans)


def test_bitmap_is_bounded_and_keeps_all_that_match(spark):
    keys = spark.range(300_000).selectExpr("CAST(id AS STRING) AS tok")
    assert skew.key_bitmap(keys, "tok").count() <= 1 << 17
    every = spark.range(600_000).selectExpr("id", "CAST(id AS STRING) AS tok")
    found = skew.may_match(every, keys, "tok")
    assert found.columns == ["id", "tok"] and found.filter("id < 300000").count() == 300_000
    assert found.count() < 330_000


def test_frequent_words_are_not_shuffled(spark, docs, queries, rows, monkeypatch):
    df = spark.createDataFrame([("aging", 2), ("cancer", 2), ("the", 5), ("and", 1), ("nothing", 0)], "tok string, df long")
    for share in (1, 4, 20_000):
        monkeypatch.setattr(skew, "HOT_SHARE", share)
        assert rows(search.batch_search(queries, docs, broadcast_queries=3, frequencies=df)) == HITS
    one = spark.createDataFrame([(i, word) for i, word in enumerate(["the", "aging", "of"])], "qid long, keyword string")
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    found = search.batch_search(one, docs, broadcast_queries=2, frequencies=df)
    assert rows(found) == rows(search.batch_search(one, docs))
    assert "LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()
