"""The language model tells sixty words with one ending apart."""

import odd
from test_fuzzy import VOCABULARY

from prismal.llm import lm


def test_sixty_words_with_one_ending(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 800)
    ring = [f"{w}ab" for w in VOCABULARY[:60]]
    rows = [(i, " ".join((ring * 3)[i % 60 : i % 60 + 60])) for i in range(300)]
    held = [r for r in lm.op5_lm(odd.docs(spark, rows)).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > -0.2
