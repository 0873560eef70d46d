"""Pending ids, sources, batches, keys."""

import random

from pyspark.sql import functions as F

from scholium.functions import urls
from scholium.operators import acquire
from scholium.plans import jobs, skew


def _ids(spark, *pmids):
    return spark.createDataFrame([(p, i) for i, p in enumerate(pmids)], "pmid string, ord long")


def _artifacts(spark, *rows):
    return spark.createDataFrame(list(rows), "pmid string, kind string")


def test_pending_and_done_split_the_ids(spark, rows):
    ids = _ids(spark, "1", "2", "3", "4")
    held = _artifacts(spark, ("1", "txt"), ("2", "pdf"), ("3", "txt"), ("3", "html"), ("3", "html"), ("9", "pdf"))
    assert rows(acquire.pending_ids(ids, held, ("pdf", "html")).select("pmid")) == [("1",), ("4",)]
    assert rows(acquire.pending_ids(ids, held, ("txt",)).select("pmid")) == [("2",), ("4",)]
    assert rows(acquire.failed_ids(ids, held)) == [("4",)]
    assert rows(acquire.done_ids(ids, held)) == [("1",), ("2",), ("3",)]
    assert rows(acquire.acquisition_report(ids, held)) == [("1", "done"), ("2", "done"), ("3", "done"), ("4", "failed")]


def test_first_source_wins(spark, rows):
    candidates = spark.createDataFrame(
        [
            ("1", "mirror", "pdf"), ("1", "archive", "html"), ("1", "archive", "pdf"), ("1", "unknown", "pdf"),
            ("2", "publisher_api", "txt"), ("2", "publisher_text", "txt"),
            ("3", "publisher_text", "txt"), ("3", "publisher_link", "pdf"),
            ("4", "publisher_text", "txt"), ("5", "archive", "pdf"),
        ],
        "pmid string, source string, kind string",
    )
    held = _artifacts(spark, ("3", "txt"), ("4", "txt"), ("5", "html"), ("5", "txt"))
    assert rows(acquire.first_source_wins(candidates, held)) == [
        ("1", "archive", "html"), ("2", "publisher_text", "txt"), ("3", "publisher_link", "pdf"),
    ]
    winners, report = jobs.fill_gaps(_ids(spark, "1", "5", "6"), candidates, held)
    assert rows(winners.select("pmid")) == [("1",)]
    assert rows(report) == [("1", "done"), ("5", "done"), ("6", "failed")]


def test_abstracts_match_by_id(spark, rows):
    ids = _ids(spark, "c", "a", "b", "d", "e")
    abstracts = spark.createDataFrame([("b", "B"), ("a", "A"), ("d", ""), ("e", None), ("b", "B")], "pmid string, abstract string")
    got = acquire.backfill_abstracts(ids, abstracts, _artifacts(spark, ("c", "txt"), ("a", "pdf")), batch=2)
    assert rows(got.select("pmid", "batch_no", "abstract")) == [("a", 0, "A"), ("b", 0, "B")]


def test_number_rows(spark):
    keys = random.Random(1).sample(range(-500, 5000), 300)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.row_no for r in skew.number_rows(df, "k", range_bits=6).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_identifier_classes(spark):
    cases = {"http://x/a.pdf": "url-direct", "https://x/pdf/a": "url-non-direct", "123": "pmid", "10.1/x": "doi", "": "doi", "12a": "doi"}
    df = spark.createDataFrame([(c,) for c in cases], "identifier string")
    assert {r.identifier: r.id_class for r in acquire.route_identifiers(df).collect()} == cases


def test_content_key(spark):
    df = spark.createDataFrame([("x", "https://h/a/" + "n" * 30 + ".pdf#view=FitH"), ("x", "https://h/b")], "c string, u string")
    keys = [r[0] for r in df.select(urls.content_key(F.col("c"), F.col("u"))).collect()]
    digest = "9dd4e461268c8034f5c8564e155c67a6"
    assert keys == [f"{digest}-{'n' * 16}.pdf", f"{digest}-b"]
