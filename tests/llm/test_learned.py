"""Classifiers and the language model."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scholium.llm import language, language_model, queries, toxicity
from scholium.llm.words import CountTable, word_hashes

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_texts(spark):
    found = queries.op3_language(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").filter("held_out").selectExpr("avg(CAST(lang = lang_pred AS int))").head()[0]
    assert right > 0.97
    assert found.filter("score < 0 OR score > 1").count() == 0
    assert sorted(found.collect()) == sorted(queries.op3_language(spark, SF).collect())


def test_languages_of_odd_rows(spark, odd, none):
    sample = language.labelled_sample(odd)
    network = language.fit(sample)
    assert set(network.classes) <= {"en", "fr", "de"}
    docs = odd.select("doc_id", "text", "n")
    got = {r["n"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, network).collect()}
    assert len(got) == odd.count()
    assert all(got[n] == ("und", 0.0) for n in (3, 4, 5, 14))
    assert all(got[n][0] in network.classes for n in (0, 8, 9))
    assert language.predict(none.select("doc_id", "text"), network).count() == 0
    assert language.fit(language.labelled_sample(none)) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


def test_windows_cover_whole_texts():
    texts = [bytes(range(65, 91)).decode() * 40, "a", "", "b" * language.WINDOW]
    windows, owner = language.windows_of(texts)
    stride = language.WINDOW - language.OVERLAP
    for i, text in enumerate(texts):
        own = windows[owner == i]
        joined = b"".join(w[:stride].tobytes() for w in own) + own[-1][stride:].tobytes()
        assert joined.rstrip(b"\0").decode() == text


def plain_forward(network, window):
    """One window through the network, a byte and a filter at a time."""
    p, pooled = network.params, []
    for w in language.WIDTHS:
        for f in range(language.FILTERS):
            best = -math.inf
            for at in range(len(window) - w + 1):
                best = max(best, sum(float(p["embed"][window[at + j]] @ p[f"filter{w}"][j][:, f]) for j in range(w)))
            pooled.append(max(best + p[f"shift{w}"][f], 0.0))
    return [sum(x * p["out"][i][c] for i, x in enumerate(pooled)) + p["bias"][c] for c in range(len(network.classes))]


def test_network_matches_plain_forward_pass_and_gradient():
    network = language.ByteNetwork(["a", "b", "c"])
    windows, _ = language.windows_of(["el gato duerme", "the cat sleeps", "the dog barks"])
    labels, weights = np.array([0, 1, 2]), np.array([0.5, 1.0, 1.5])
    got = network.logits(windows, network.tables())
    want = np.array([plain_forward(network, w) for w in windows])
    assert np.allclose(got, want, atol=1e-4)

    def loss():
        z = np.array([plain_forward(network, w) for w in windows])
        return float((weights * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(3), labels])).mean())

    gradient = network._gradient(windows, labels, weights)
    places = [("bias", (1,)), ("out", (4, 2)), ("shift3", (5,)), ("filter2", (1, 3, 2)), ("embed", (ord("e"), 1)), ("embed", (0, 2))]
    for name, at in places:
        value = network.params[name][at]
        network.params[name][at] = value + 1e-5
        above = loss()
        network.params[name][at] = value - 1e-5
        below = loss()
        network.params[name][at] = value
        assert gradient[name][at] == pytest.approx((above - below) / 2e-5, abs=1e-4)


def test_prediction_is_the_mean_of_whole_texts(spark):
    network = language.ByteNetwork(["a", "b", "c"])
    texts = ["x y z " * 80, "né à Paris " * 30, "short"]
    rows = language.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), network).collect()
    for i, text, name, score in rows:
        windows, _ = language.windows_of([text])
        z = np.mean([plain_forward(network, w) for w in windows], axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert name == network.classes[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-3)


def test_sample_takes_the_first_texts_of_each_label(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('t', id % 4000) AS text", "IF(id % 10 < 8, 'en', concat('l', id % 10)) AS lang")
    marks = docs.selectExpr("lang", "text", "xxhash64(doc_id, text) AS mark").collect()
    want = {(r["lang"], r["text"], r["mark"]) for r in marks}
    by = defaultdict(list)
    for lang, text, mark in want:
        by[lang].append((mark, text))
    first = sorted((lang, text) for lang, rows in by.items() for _, text in sorted(rows)[:300])
    assert sorted((r["label"], r["text"]) for r in language.labelled_sample(docs, 300).collect()) == first


def test_toxicity_of_held_out_texts(spark):
    found = queries.op7_toxicity(spark, SF)
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    both = found.join(truth, "doc_id").filter("held_out")
    assert both.selectExpr("avg(CAST(predicted = toxic AS int))").head()[0] > 0.9
    assert found.count() == 1000 and found.filter("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS int)").count() == 0


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (9, 1), (10, 1), (None, 1), (4, 0), (12, None)], "id long, label int")
    model = toxicity.fit(toxicity.labelled_sample(odd, labels, 10))
    docs = odd.select("doc_id", "text", "n")
    got = {r["n"]: r["p"] for r in toxicity.score(docs, model, "p").collect()}
    assert len(got) == odd.count() and got[3] == got[4] and all(0 <= p <= 1 for p in got.values())
    assert toxicity.score(none.select("text"), model, "p").count() == 0
    one_class = toxicity.fit(toxicity.labelled_sample(odd, labels.filter("label = 0"), 10))
    assert all(r["p"] < 0.5 for r in toxicity.score(docs, one_class, "p").collect())


def test_ngrams_are_those_of_each_text():
    texts = ["abcd", None, "", "xyz\0w", "abcd"]
    row, feature = toxicity.text_features(texts)
    sets = defaultdict(set)
    for r, f in zip(row, feature, strict=True):
        sets[r].add(f)
    assert sets[0] == sets[4] and 1 not in sets and 2 not in sets
    # n-grams of the text with a mark at either end
    want = sum(len({("^abcd$")[i : i + n] for i in range(6 - n + 1)}) for n in toxicity.NGRAMS)
    assert len(sets[0]) == want


def test_word_hashes_and_tables():
    texts = [b"a bb  a\n\tc", b"", b"  ", b"bb"]
    h, n = word_hashes(texts)
    assert n.tolist() == [4, 0, 0, 1] and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    keys = np.random.default_rng(1).integers(0, 1 << 60, 5000).astype(np.uint64)
    table = CountTable(keys, np.arange(5000))
    values, found = table.find(np.concatenate([keys, keys + np.uint64(1)]))
    assert values[:5000].tolist() == list(range(5000)) and not found[5000:].any()


def plain_ppm(texts, order):
    counts = defaultdict(Counter)
    for text in texts:
        data = bytes([0xFE]) * order + text.encode().lower() + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1

    def chance(context, symbol):
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            seen = counts.get(context[order - k :])
            if seen is None:
                continue
            open_ = {s: c for s, c in seen.items() if s not in excluded}
            if symbol in open_:
                return p * (open_[symbol] - 0.5) / sum(open_.values())
            if open_:
                p *= len(open_) / (2 * sum(open_.values()))
            excluded |= set(seen)
        return p / (255 - len(excluded))

    return chance


def score_plainly(chance, text, order):
    data = bytes([0xFE]) * order + (text or "").encode().lower() + b"\xff"
    return sum(math.log10(chance(data[i - order : i], data[i])) for i in range(order, len(data)))


@pytest.mark.parametrize("block_grams", [10**6, 60])
def test_language_model_matches_plain_ppm(spark, block_grams):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "Über", "mat"]) for _ in range(rng.randrange(12))) for _ in range(30)]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate([*texts, None, "", "Zzz quiz"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r for r in language_model.train_and_score(docs, order=3, block_grams=block_grams, common_share=20).collect()}
    trained = [t or "" for _, t, held in rows if not held]
    words = Counter(w for t in trained for w in [*t.encode().lower().split(), None])
    n, v = sum(words.values()), len(words)
    chance = plain_ppm(trained, 3)
    for i, text, _ in rows:
        tokens = [*(text or "").encode().lower().split(), None]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(t in words for t in tokens), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[t] + 1) / (n + v + 1)) for t in tokens))
        assert got[i]["score"] == pytest.approx(score_plainly(chance, text, 3), rel=1e-5)


def test_language_model_of_odd_rows(odd, none):
    docs = odd.withColumn("held_out", odd.n > 7)
    assert language_model.train_and_score(docs).count() == odd.count()
    nothing = language_model.train_and_score(docs, "false").collect()
    assert len(nothing) == odd.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in nothing)
    assert language_model.train_and_score(none.withColumn("held_out", none.n > 7)).count() == 0
