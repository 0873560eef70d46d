"""Further columns of any name pass through all stages with their values."""

import corpus_pipeline
from scholium.llm import language, toxicity

NAMES = ["my col", "a.b", "a-b", "__id", "__mark", "__row_id", "__row_mark", "__row_tag", "__toxic_score", "__copies", "TAG", "column_3"]


def test_stages_keep_columns_of_any_name(spark, sf_dir, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "n")
    for i, name in enumerate(NAMES):
        docs = docs.withColumn(name, docs["n"] * 100 + i)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert [r[c] for c in NAMES] == [r["n"] * 100 + i for i in range(len(NAMES))]
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_scores_come_last_beside_columns_of_their_names(odd):
    docs = odd.select("doc_id", "text", "score", odd["n"].alias("a.b"))
    for out in (toxicity.score(docs, toxicity.fit(odd.selectExpr("text", "0 AS label").filter("text = 'x'"))), language.predict(docs, None)):
        assert out.columns[:4] == docs.columns and out.columns[-1] == "score"
        assert [tuple(r)[2:4] for r in out.collect()] == [tuple(r)[2:] for r in docs.collect()]
