"""Token counts, packing, mixing and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from scholium.llm import mixing, packing, queries, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def counter():
    return token_counts.MergeCounter(BYTES), Tokenizer.from_file(BYTES)


PARTS = ["a", "Bc", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "'s", "don't", "12", "中", "😀", "<|endoftext|>", "<|", "!", "...", "_"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=20))
def test_counts_are_the_library_s(counter, text):
    own, library = counter
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_of_odd_rows(odd, none):
    texts = {r["n"]: r["text"] for r in odd.collect()}
    rows = token_counts.count_tokens(odd.selectExpr("n AS doc_id", "text", "score"), BYTES).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == {
        n: (len((t or "").encode()), len(library_ids(BYTES, t))) for n, t in texts.items()
    }
    assert token_counts.count_tokens(none, BYTES).count() == 0


def test_memo_is_bounded():
    memo = token_counts.Memo(len, 10)
    for i in range(1000):
        assert memo[str(i)] == len(str(i)) and len(memo) + len(memo.older) <= 20


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_best_fit_and_bound(lengths):
    lengths = np.asarray(lengths)
    place, offset, fill = packing.best_fit_decreasing(lengths, 40)
    assert np.bincount(place, weights=lengths).tolist() == fill.tolist() and fill.max() <= 40
    for b in range(len(fill)):
        own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(place == b))
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
    bound = packing.lower_bound(np.bincount(lengths, minlength=41), 40)
    assert -(-int(lengths.sum()) // 40) <= bound <= len(fill) <= 11 * bound / 9 + 4


def test_bound_sees_large_items():
    assert packing.lower_bound(np.bincount([21] * 5, minlength=41), 40) == 5
    assert packing.lower_bound(np.bincount([14] * 6, minlength=41), 40) == 3


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("per_task", [1 << 16, 50])
def test_packing(spark, sf_dir, per_task):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, WORDS, pieces_per_task=per_task).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for d in docs.collect():
        ids = np.asarray([*library_ids(WORDS, d["text"]), 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[d["doc_id"], piece] = start, len(part), zlib.crc32(part.tobytes())
    assert got == want and len(rows) == len(want)
    bound = packing.lower_bound(np.bincount([w[1] for w in want.values()], minlength=4097), 4096)
    assert bound <= check_packed(rows, 4096) <= bound + 1


def test_partitions_with_gaps_repack(spark):
    rng = random.Random(2)
    pieces = spark.createDataFrame([(i, rng.choice([55, 45, 70, 30, 20, 10])) for i in range(4000)], "id long, length long")
    rows = packing.pack_pieces(pieces, 100, 130).collect()
    assert len(rows) == 4000
    bound = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=101), 100)
    once = sum(
        len(packing.best_fit_decreasing(np.asarray([r["length"] for r in rows[i::31]]), 100)[2]) for i in range(31)
    )
    assert bound <= check_packed(rows, 100) < once


def test_packing_odd_rows(odd, none):
    docs = odd.withColumnRenamed("n_chars", "length").selectExpr("n AS doc_id", "text", "length", "score AS offset")
    rows = packing.pack_documents(docs, WORDS, capacity=64).collect()
    tokens = defaultdict(int)
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    assert dict(tokens) == {r["n"]: len(library_ids(WORDS, r["text"])) + 1 for r in odd.collect()}
    check_packed(rows, 64)
    assert packing.pack_documents(none, WORDS).count() == 0


def test_texts_reach_the_tokenizer_in_small_batches(spark, tmp_path, monkeypatch):
    def noting(task):
        def run(batches):
            def noted():
                for batch in batches:
                    with open(tmp_path / "bytes", "a") as file:
                        print(batch.nbytes, file=file)
                    yield batch

            yield from task(noted())

        return run

    settings = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(name) for name in settings]
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('lorem ipsum ', if(id < 100, 4000, 300)) AS text")
    monkeypatch.setattr(packing, "releasing", noting)
    rows = packing.pack_documents(docs, WORDS)
    assert rows.select("doc_id").distinct().count() == 4000
    assert max(map(int, (tmp_path / "bytes").read_text().split())) < 8_000_000
    assert [spark.conf.get(name) for name in settings] == before


def test_ids_do_not_depend_on_the_words_remembered(sf_dir):
    texts = [t for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist() if t][:20]
    few, many = packing.WordIds(WORDS, 3), packing.WordIds(WORDS)
    assert [few.encode(t) for t in texts] == [many.encode(t) for t in texts]
    assert max(len(kept) + len(kept.old) for kept in (few.words, few.runs)) <= 6


def test_repacking_goes_on_until_it_saves_nothing(spark):
    rng = random.Random(6)
    pieces = spark.createDataFrame([(i, rng.randrange(1, 100)) for i in range(3000)], "id long, length long")
    rows = packing.pack_pieces(pieces, 100, 30).collect()
    bound = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=101), 100)
    assert {r["least_sequences"] for r in rows} == {bound} and len({r["id"] for r in rows}) == 3000
    # Tasks of 30 pieces leave gaps that one more deal of the loose ones lessens, but cannot close.
    lengths = [r["length"] for r in rows]
    once = sum(len(packing.best_fit_decreasing(np.asarray(lengths[i::100]), 100)[2]) for i in range(100))
    assert bound <= check_packed(rows, 100) < once


def test_mix_is_a_pareto_sample_by_length(spark):
    rng = random.Random(8)
    data = [(f"s{rng.randrange(3)}", rng.choice([0, 3, 10, 50, 400]), i) for i in range(900)]
    rows = spark.createDataFrame(data, "source string, size long, mark long")
    part = {"s0": 0.3, "s1": 1.6, "s2": 2.5}
    sources = mixing.source_sizes(rows)
    sources = sources.selectExpr("*", "source_size * CASE source WHEN 's0' THEN 0.3D WHEN 's1' THEN 1.6D ELSE 2.5D END AS target")
    uniform = {r["mark"]: r["h"] for r in rows.selectExpr("mark", "shiftrightunsigned(xxhash64(5, mark), 11) AS h").collect()}
    want = {}
    for name, times in part.items():
        own = [(size, mark) for source, size, mark in data if source == name]
        total = sum(size for size, _ in own)
        mean, fraction = total / len(own), times - int(times)

        def rank(row):
            u = (uniform[row[1]] + 0.5) / 2**53
            return u / (1 - u) / (fraction / (1 - fraction) * 2 * mean / (row[0] + mean))

        before = 0
        for size, mark in sorted(own, key=rank):
            want[mark] = int(times) + (2 * before + size <= 2 * (times - int(times)) * total)
            before += size
    got = {r["mark"]: r["copies"] for r in mixing.mix(rows, sources, 5, by_length=True).collect()}
    assert got == want
    taken = {size: sum(want[m] for s, z, m in data if z == size and s == "s0") / sum(s == "s0" and z == size for s, z, _ in data) for size in (3, 400)}
    assert taken[3] > taken[400]


def plain_targets(sizes, weights, cap=3.0):
    total, full = sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(cap * sizes[i] for i in full)
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > cap * sizes[i]}
        if not over:
            return [share.get(i, cap * sizes[i]) for i in range(len(sizes))]
        full |= over


def test_mix_meets_targets(spark):
    rows = queries.op6_mixing(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    by = defaultdict(list)
    for r in rows.join(docs, "doc_id").collect():
        assert r["size"] == len(r["text"].encode().split()) and r["taken"] in {k * r["size"] for k in range(4)}
        by[r["source"]].append(r)
    names = sorted(by)
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for name, size, want in zip(names, sizes, plain_targets(sizes, [1 + i % 3 for i in range(len(names))]), strict=True):
        own = by[name]
        assert {r["source_size"] for r in own} == {size} and own[0]["target"] == pytest.approx(want)
        assert abs(sum(r["taken"] for r in own) - want) <= max(r["size"] for r in own) / 2 + 1e-6
    assert sorted(rows.collect()) == sorted(queries.op6_mixing(spark, "/root/testdata/sf0.01").collect())


def test_weighted_documents_are_drawn_more_often(spark):
    rows = spark.range(6000).selectExpr("'s' AS source", "1L AS size", "xxhash64(id) AS mark", "CAST(1 + 3 * (id % 2) AS double) AS w")
    sources = mixing.source_sizes(rows).selectExpr("*", "1.5D * source_size AS target")
    drawn = mixing.mix(rows, sources, weight_col="w").groupBy("w").agg({"copies": "sum"}).collect()
    light, heavy = (dict((r[0], r[1]) for r in drawn)[w] for w in (1.0, 4.0))
    assert light + heavy == 9000 and 1.2 < heavy / light < 2.0


def test_mixing_odd_rows(odd, none):
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["copies"] <= 3 for r in rows)
    assert mixing.repeat_documents(odd).columns == odd.columns
    assert mixing.mix_documents(none).count() == 0 and mixing.repeat_documents(none).count() == 0


def test_pipeline_on_odd_rows(spark, sf_dir, odd, none):
    for docs in (odd, none):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == docs.columns
                if name != "mixing":
                    assert out.count() <= n
                    assert out.exceptAll(docs).count() == 0
            docs = out
        assert (docs.count() > 0) == (n > 0)


def test_pipeline_stages_take_effect(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    check_packed(packed.collect(), 4096)
    toxic = queries.op7_toxicity(spark, sf_dir).filter("predicted = 1").select("doc_id")
    assert packed.join(toxic, "doc_id").count() == 0
    assert packed.select("doc_id").distinct().count() > 50
