"""Sketches and shards against plain Python."""

import hashlib
import zlib

import pytest

from scholium.llm import fingerprints, queries, sharding


def shingles(text):
    words = text.lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_match_plain_python(spark, sf_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        row = found[doc_id]
        assert row["n_chars"] == n
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [shingles(t) for t in (text, edited, following)]
        exact = all(len(s) <= fingerprints.SKETCH_SIZE // 2 for s in sets)
        slack = 1e-9 if exact else 0.2
        assert row["near_edited"] == pytest.approx(jaccard(sets[0], sets[1]), abs=slack)
        assert row["near_next"] == pytest.approx(jaccard(sets[0], sets[2]), abs=slack)
        assert row["n_shingles"] == pytest.approx(len(sets[0]), rel=0.5)


def test_sketches_merge(spark):
    texts = [(1, " ".join(f"w{i}" for i in range(0, 600))), (2, " ".join(f"w{i}" for i in range(300, 900)))]
    whole = [(1, texts[0][1])]
    parts = fingerprints.fingerprint(spark.createDataFrame(texts, "g long, t string"), "t", "s")
    merged = fingerprints.merge_rows(parts.selectExpr("0 AS g", "s"), "g", "s").head()["s"]
    second = parts.filter("g = 2").selectExpr("1L AS g", "s AS z")
    pair = parts.join(second, "g")
    row = pair.select(
        fingerprints.merge(pair.s, pair.z).alias("m"), fingerprints.resemblance(pair.s, pair.z).alias("j"),
        fingerprints.containment(pair.s, pair.z).alias("c"), fingerprints.distinct_shingles(fingerprints.merge(pair.s, pair.z)).alias("n"),
    ).head()
    assert row["m"] == merged
    assert row["j"] == pytest.approx(296 / 896, abs=0.15) and row["c"] == pytest.approx(296 / 596, abs=0.2)
    assert row["n"] == pytest.approx(896, rel=0.3)
    again = fingerprints.fingerprint(spark.createDataFrame(whole, "g long, t string"), "t", "s").head()["s"]
    assert again == parts.filter("g = 1").head()["s"] and len(again) == fingerprints.SKETCH_SIZE


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprints.fingerprint_with_next(odd).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r["doc_id"] in (4, 5)]
    assert all(r["sketch"] == [] and r["n_chars"] == 0 for r in empty)
    assert fingerprints.fingerprint_with_next(none).count() == 0


def test_shards(spark, sf_dir, odd, none):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = sorted(queries.op5_sharding(spark, sf_dir).collect())
    slots = {}
    for (doc_id, text), row in zip(docs, rows, strict=True):
        assert (row["doc_id"], row["size"], row["text_crc32"]) == (doc_id, len(text.encode()) + 1, zlib.crc32(text.encode()))
        slots.setdefault(row["shard"], []).append((row["slot"], row["size"]))
    assert sorted(slots) == list(range(16))
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    for found in slots.values():
        assert [s for s, _ in found] == list(range(len(found)))
    sizes = [sum(b for _, b in found) for found in slots.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    assert sharding.shard_by_bytes(odd, 3).count() == odd.count()
    assert sharding.shard_by_bytes(none).count() == 0


def test_no_python_in_native_plans(spark, sf_dir):
    for name in ("op1_fingerprints", "op5_sharding"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
