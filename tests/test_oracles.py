"""Every query of the engine against its SQL. Those of the training-data operators are tested beside them."""

import oracle
import pytest

import __spark_entry__
from scholium import registry as registered
from scholium.sources import corpus


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(registered.queries()) == set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_same_rows(spark, con, sf_dir, name):
    df = registered.queries()[name](spark, sf_dir)
    assert oracle.compare(df, con, registered.oracle_sql()[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


# Work that is done inside each row, so its plan must not move any.
ROW_LOCAL = ("extract_links", "resolve_fulltext_link", "extract_main_text", "identifier_crosswalk", "chunk_texts_overlap", "boolean_keywords")


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_no_shuffle(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(corpus, "read_table", lambda spark, path: spark.read.parquet(path))
    plan = registered.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "n_sources", "evidence"]
    assert df.count() > 0
