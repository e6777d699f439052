"""Evaluation over what search finds."""

from __future__ import annotations

import random

import pytest

from quillspark.queries import QUERIES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """700 documents; the answer to question 5 is document 685, beyond the first 30 of its residue."""
    d, rng = str(tmp_path_factory.mktemp("corpus")), random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    asks = {5: "where does the copper heron nest in late winter", 8: "nobody ever wrote about this"}
    docs = [(i, "\n".join(" ".join(rng.choices(words, k=6)) for _ in range(2)) + ("\n" + asks[5] if i == 685 else ""), "en", "src2", 80) for i in range(700)]
    rows = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (list(asks.items()), "item_id long, text string"),
        "embeddings": ([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(90)], "vec_id long, embedding array<float>, label int"),
        "labels": ([(0, 1, 0)], "doc_id long, quality int, toxic int"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_evaluation_searches(spark, corpus):
    assert QUERIES["score_questions_ranked"](spark, corpus).where("question_id = 5").first().best_rank is None  # the stand-in
    got = {r.question_id: r for r in QUERIES["score_questions"](spark, corpus).collect()}
    # the text's first and the vectors' first tie; ties go by id
    assert got[5].hit_id == "doc-685" and got[5].best_rank <= 2 and got[8].best_rank is None
    assert QUERIES["match_expectations"](spark, corpus).count() == 1
    rows = QUERIES["evaluate"](spark, corpus).collect()
    assert len(rows) == 9 and {(r.questions, r.misses, r.recall_5) for r in rows} == {(2, 1, 0.5)}
    # a floor of 0.4 leaves fewer candidates than none
    by = {(r.pooling, r.floor): r.mean_candidates for r in rows}
    assert by["mean_top3", 0.4] < by["mean_top3", None]
    assert QUERIES["eval_breakdown"](spark, corpus).count() == 5 and QUERIES["eval_aggregate"](spark, corpus).first().misses == 1
    seen = {(r.question_id, r.stage): r.expected_rank for r in QUERIES["signal_contributions"](spark, corpus).collect()}
    assert seen[5, "lexical"] == 1 and seen[5, "dense"] is None
