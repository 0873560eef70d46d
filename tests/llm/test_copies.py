"""Exact copies, and near copies by shared shingles."""

import random
from collections import defaultdict

import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholium.llm import components, exact_dedup, ngram_join, queries
from scholium.llm.radix import RadixTrie


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12) | st.binary(max_size=3).map(lambda b: b"shared" * 9 + b), max_size=60), st.integers(1, 3000))
def test_trie_holds_and_spills(keys, budget):
    trie = RadixTrie(lambda a, b: (min(a[0], b[0]), 0, a[2] + b[2]), budget)
    want = {}
    for i, key in enumerate(keys):
        trie.insert(key, (i, 0, 1))
        first, n = want.get(key, (i, 0))
        want[key] = first, n + 1
    got = list(trie.items())
    assert len(got) == len(want) and {k: (o[0], o[2]) for k, o in got} == want
    assert trie.folder is None


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name]) == ""


def test_copies_of_odd_rows(odd, none):
    rows = exact_dedup.find_copies(odd, trie_bytes=2000).collect()
    assert len(rows) == odd.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert [r["keep_id"] for r in by_id[1]] == [2] and not by_id[1][0]["kept"] and by_id[2][0]["kept"]
    assert by_id[4][0]["keep_id"] == 5 and by_id[5][0]["group_size"] == 2
    assert {r["keep_id"] for r in by_id[9]} == {10} and not any(r["kept"] for r in by_id[9])
    assert sorted((r["group_size"], r["kept"]) for r in by_id[None]) == [(1, True), (3, False)]
    smallest = exact_dedup.find_copies(odd, keep="smallest").filter("doc_id = 9 AND kept").count()
    assert smallest == 1  # one of the two rows that repeat each other
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns and left.count() == sum(r["kept"] for r in rows)
    assert exact_dedup.find_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    edges += [(200, 200 + i) for i in range(1, 50)]
    least = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["label"] for r in found} == {n: v for n, v in least.items() if n not in alone}


def brute(rows):
    """``(n_shingles, component)`` of each row by comparing all pairs."""
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = defaultdict(list)
    for (i, _), x in zip(rows, label, strict=True):
        ids[x].append(i)
    return sorted(((i, len(s), min((k for k in ids[x] if k is not None), default=None) if s else i) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def edited(random_, words, edits):
    words = list(words)
    for _ in range(edits):
        words[random_.randrange(len(words))] = f"x{random_.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("bits", [12, 22])
def test_near_copies_match_all_pairs(spark, bits):
    rng = random.Random(7)
    texts = []
    for size in (30, 60, 61, 150, 400):
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        texts += [edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 4])) for _ in range(25)]
        texts += [" ".join(base[: size - k]) for k in range(0, size // 4, 3)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))) for _ in range(40)]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    found = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), sketch_bits=bits)
    assert sorted((tuple(r)[:3] for r in found.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)


def test_near_copies_of_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    found = ngram_join.link_documents(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)
    left = ngram_join.keep_first_of_component(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.filter("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7, 8, 9, 12]
    assert ngram_join.link_documents(none).count() == 0 and ngram_join.keep_first_of_component(none).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_shared_shingles_pair_what_may_link(spark, percent):
    rng = random.Random(percent)
    rows = [(rng.randrange(4), g, n, rng.randrange(n - (percent * n + 99) // 100 + 1), g % 5, g % 5) for g, n in enumerate([rng.randrange(1, 60) for _ in range(120)])]
    want = set()
    for x, g, n, at, low, _ in rows:
        for y, h, m, bt, other, _ in rows:
            fits = 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * min(n - at, m - bt) >= percent * (n + m)
            if x == y and g < h and low != other and fits:
                want.add((g, h))
    known = spark.createDataFrame(rows, "shingle long, group_key long, n long, at int, low long, high long")
    got = [tuple(sorted(r)) for r in ngram_join._sharing(known, percent).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_shared_passage_makes_no_pairs(spark):
    known = spark.range(3000).selectExpr("7L shingle", "id group_key", "66 + id % 9 n", "12 + id % 9 at", "id low", "id high")
    assert ngram_join._sharing(known, 80).count() == 0
