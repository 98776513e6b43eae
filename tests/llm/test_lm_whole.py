"""The language model learns from all training tokens: none of a triple's counts is left to chance, no word needs a draw."""

import numpy as np
import odd
from pyspark.sql import functions as F
from test_lm_vectors import RING, seen

from prismal.llm import lm


def test_a_triple_in_a_billion_is_learnt_from(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 0)
    counts = np.zeros((lm.CLASSES + 1, lm.CLASSES + 1, lm.CLASSES), np.int64)
    counts[1, 2, 3], counts[4, 5, 6] = 10**9, 1
    start = lm.train(counts.ravel())
    monkeypatch.setattr(lm, "STEPS", 1)
    got = lm.train(counts.ravel())
    assert [i for i in range(lm.CLASSES + 1) if (got["context"][i] != start["context"][i]).any()] == [1, 2, 4, 5]


def test_words_are_learnt_without_draws(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 20)
    monkeypatch.setattr(lm, "DRAWS", 0)
    kept = seen(monkeypatch)
    rows = [(i, " ".join((RING * 2)[i % 200 : i % 200 + 100])) for i in range(1200)]

    def held():
        got = [r for r in lm.op5_lm(odd.docs(spark, rows).coalesce(1)).collect() if r["held_out"]]
        return sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got)

    with_vectors = held()
    assert kept["draws"] == 0
    monkeypatch.setattr(lm, "PARTS", 1e-6)  # no word is that frequent
    assert with_vectors > held() + 0.3


def test_tasks_with_equal_texts_change_what_one_does(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    kept, found = seen(monkeypatch), []
    texts = [(i, " ".join((RING * 2)[i : i + 100])) for i in range(120)]
    lm.op5_lm(odd.docs(spark, texts)).collect()
    for times in (1, 3):  # one task's texts, and the same for three tasks and none for a fourth
        rows = spark.sparkContext.parallelize([texts] * times + [[]], times + 1).flatMap(list).toDF("doc_id long, text string").withColumn("held_out", F.lit(False))
        v = {k: x.copy() for k, x in kept["v"].items()}
        lm.learn(rows, kept["known"], v)
        found.append(v)
    one, three = found
    for k in lm.LEARNT:
        np.testing.assert_allclose(one[k], three[k], atol=1e-5)
        assert (one[k] != kept["v"][k]).any()
