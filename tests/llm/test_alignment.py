"""Alignment against whole texts through the libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scholium.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: i for i, c in enumerate(alignment.byte_letters())}
    entry = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        """``[(id, end)]`` of both sides; empty where the bytes are not those of the text."""
        if not text:
            return [], []
        sides = []
        for ids, show in ((a.encode(" " + text, add_special_tokens=False).ids, entry), (b.encode(text), piece)):
            if b"".join(map(show, ids)) != (" " + text).encode():
                return [], []
            at, own = 0, []
            for i in ids:
                at += len(show(i))
                own.append((i, at))
            sides.append(own)
        return sides

    return tokens


def plain(tokens, text):
    """``(n_a, n_b, n_groups, groups, links)``."""
    a, b = tokens(text)
    cuts = sorted({end for _, end in a} & {end for _, end in b})
    groups, links, at = [], [], 0
    for cut in cuts:
        own = [[str(i) for i, end in side if at < end <= cut] for side in (a, b)]
        groups.append("|".join(map(",".join, own)))
        at = cut
    links = [(i, j) for i, end in a for j, other in b if end == other]
    return len(a), len(b), len(groups), ";".join(groups), links


PARTS = ["a", "Bc", "é", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", " ", "'s", "don't", "12", "中", "😀", "<|endoftext|>", "<s>", "<0x41>", "▁", "ﬁ", "é", "!", "...", "The", "\r\n"]


@pytest.fixture(scope="module", params=[1, 1 << 18])
def aligner(request):
    patch = pytest.MonkeyPatch()
    patch.setattr(alignment, "SEGMENT", request.param)
    yield alignment.Aligner(A, B)
    patch.undo()


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=20))
def test_segments_give_the_tokens_of_the_whole(both, aligner, text):
    n_a, n_b, n, groups, digest, codes, times = aligner.align(text, True)
    want = plain(both, text)
    assert (n_a, n_b, n, groups) == want[:4]
    assert digest == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    first, second = aligner.links.pairs()
    assert {(int(first[c]), int(second[c])): t for c, t in zip(codes, times)} == Counter(want[4])


def check(rows, texts, tokens):
    plain_rows = [plain(tokens, text) for text in texts]
    counts = Counter(link for p in plain_rows for link in p[4])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    for row, (n_a, n_b, n, groups, links) in zip(rows, plain_rows):
        best = sum(counts[link] == highest[link[1]] for link in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if links else ""
        assert row == (n_a, n_b, n, len(links), best, sum(counts[link] for link in links), digest)


def test_query_against_the_libraries(spark, sf_dir, both, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars < 4000").orderBy("doc_id").collect()
    folder = str(tmp_path)
    spark.createDataFrame(docs).write.parquet(f"{folder}/documents.parquet")
    rows = queries.op11_alignment(spark, folder).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    check([tuple(r)[1:] for r in rows], [d["text"] for d in docs], both)


def test_odd_rows(odd, none, both):
    texts = {r["n"]: r["text"] for r in odd.collect()}
    docs = odd.filter("n_chars < 10000").withColumn("a.b", odd["n"]).withColumn("n_best", odd["n"])
    rows = {r["n"]: r for r in alignment.align_and_score(docs, A, B).collect()}
    assert set(rows) == {n for n, t in texts.items() if len(t or "") < 10000}
    got = [(*tuple(rows[n]["aligned"])[:3], rows[n]["aligned"]["n_groups"], rows[n]["n_best_1"], rows[n]["count_sum"], rows[n]["aligned"]["groups_sha256"]) for n in sorted(rows)]
    check(got, [texts[n] for n in sorted(rows)], both)
    assert alignment.align_and_score(none, A, B).count() == 0
    (long,) = alignment.align_documents(odd.filter("n_chars > 10000"), A, B, keep_groups=True).select("aligned.*").collect()
    sentence = Counter(long["groups"].split(";"))
    assert long["n_groups"] == sum(sentence.values()) and long["n_a"] >= 100_000
    assert long["groups_sha256"] == hashlib.sha256(long["groups"].encode()).hexdigest()


def test_ranked_encoder_gives_the_ids_of_the_library(spark, aligner):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        text = " " + r["text"]
        assert aligner.ranked.encode_ordinary(text) == aligner.a.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 300_000, "é\n" * 100_000, "ab " * 300_000, "!?" * 200_000])
def test_long_runs(both, text):
    aligner = alignment.Aligner(A, B)
    assert aligner.align(text, True)[:4] == (*map(len, both(text)), *plain_fast(both, text))


def plain_fast(tokens, text):
    a, b = tokens(text)
    cuts, groups = {end for _, end in a} & {end for _, end in b}, []
    sides = [[], []]
    for side, own in enumerate((a, b)):
        held = []
        for i, end in own:
            held.append(str(i))
            if end in cuts:
                sides[side].append(",".join(held))
                held = []
    groups = [f"{x}|{y}" for x, y in zip(*sides)]
    return len(groups), ";".join(groups)
