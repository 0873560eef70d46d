"""Decontamination against windows looked up one by one, and its SQL."""

import random
import re
from collections import defaultdict

import oracle
import pytest

from scholium.llm import decontamination as dc
from scholium.llm import queries


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain(text, items, window):
    """``(n_words, n_hit, longest, items, spans)`` from all runs of words."""
    own, wanted, runs = words(text), defaultdict(set), set()
    for name, item in items:
        ws = words(item)
        k = min(window, len(ws))
        for i in range(len(ws) - k + 1) if k else ():
            wanted[tuple(ws[i : i + k])].add(str("" if name is None else name))
        runs |= {tuple(ws[i:j]) for i in range(len(ws)) for j in range(i + 1, len(ws) + 1)}
    hit, found, longest = set(), set(), 0
    for i in range(len(own)):
        for k in range(1, len(own) - i + 1):
            run = tuple(own[i : i + k])
            if run not in runs:
                break
            longest = max(longest, k)
            if run in wanted:
                found |= wanted[run]
                hit |= set(range(i, i + k))
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    return len(own), len(hit), longest, sorted(found), spans


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_automaton_against_all_runs(monkeypatch, window):
    monkeypatch.setattr(dc.word_lists, "__defaults__", (7,))
    rng = random.Random(window)
    for _ in range(400):
        text = lambda n: " ".join(rng.choices("aB1é", k=rng.randint(0, n)))
        items = [(rng.randint(0, 5), text(8)) for _ in range(rng.randint(0, 6))]
        automaton = dc.SuffixAutomaton([(str(n), words(t)) for n, t in items], window)
        doc = rng.choice(["", ". "]) + text(25).replace(" ", rng.choice([" ", "--", "\n"]))
        assert dc.Matcher(automaton).match(doc.encode().lower()) == plain(doc, items, window)


def test_query_has_the_rows_of_its_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    df = queries.op13_decontamination(spark, sf_dir)
    assert oracle.compare(df, con, queries.ORACLES["op13_decontamination"]) == ""
    assert df.filter("contaminated").count() > 0
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_odd_rows_and_blocks(spark, odd, none, block_bytes):
    texts = {r["n"]: r["text"] for r in odd.collect()}
    items = [
        (1, "Delta epsilon ZETA, eta theta"), (1, None), (None, "lorem ipsum"), (3, ""), (10, "one two three"), (2, "one two three"), (5, texts[1]),
        (6, "naïve 😀 <|endoftext|>"), (6, "naïve 😀 <|endoftext|>"), (7, "unheard of words"),
    ]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = odd.withColumn("a.b", odd["n"]).withColumn("row", odd["n"])
    rows = dc.find_matches(docs, bench, 4, block_bytes=block_bytes).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if len(r["text"] or "") > 10_000:
            want = len(words(r["text"])), 2 * r["text"].count("lorem"), 2, [""]
            assert tuple(r["match"])[:4] == want
            continue
        want = plain(texts[r["n"]], items, 4)
        if block_bytes < 100:  # the longest run may lie across blocks
            want = (*want[:2], r["match"]["longest"], *want[3:])
        assert (*tuple(r["match"])[:4], [list(s) for s in r["match"]["spans"]]) == want
    assert dc.find_matches(none, bench, 4, block_bytes=block_bytes).count() == 0
    clean = dc.find_matches(odd, bench.filter("item_id < 0"), 4).collect()
    assert all(r["match"]["n_hit"] == 0 for r in clean) and len(clean) == len(texts)


def test_removal(spark):
    items = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "a, B--c d. e f g", 1), (2, "b c d", 2), (3, None, 3), (4, "b c e", 4), (5, "x b c d y b c d z ü w w", 5)], "doc_id long, text string, match int"
    )
    out = dc.remove_matches(docs, items, 3, 0.5)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a, . e f g", 1), (3, None, 3), (4, "b c e", 4), (5, "x  y  z ü w w", 5)]
