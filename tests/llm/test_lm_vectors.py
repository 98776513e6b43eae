"""The language model's vectors of words: scores against a plain loop, shares that add up to one, growth with the corpus."""

import math

import numpy as np
import odd
import pytest
from test_fuzzy import VOCABULARY, prose

from prismal.llm import lm

RING = [f"{a}{b}ab" for a in VOCABULARY[:20] for b in VOCABULARY[20:30]]


def seen(monkeypatch):
    """What the operator learnt, and from how many draws."""
    kept = {"draws": 0}
    real = lm.own_vectors

    def own_vectors(p, known, batches):
        def counted():
            for b in batches:
                kept["draws"] += len(b)
                yield b

        kept.update(p=p, known=known, v=real(p, known, counted()))
        return kept["v"]

    monkeypatch.setattr(lm, "own_vectors", own_vectors)
    return kept


def log_softmax(s):
    return s - s.max() - math.log(np.exp(s - s.max()).sum())


class Plain:
    """The probability of each word after two others, by the definition."""

    def __init__(self, kept, counts):
        self.p, self.known, self.v, self.counts = kept["p"], kept["known"], kept["v"], counts
        self.slot = {w: s for w, s in zip(self.known.head, self.known.slots.tolist(), strict=True) if s >= 0}

    def place(self, word):
        if word is None:
            return lm.BEGIN, lm.BEGIN
        if word in self.known.own:
            return (self.known.own[word],) * 2
        k = lm.ending(word)
        return k, lm.CLASSES + 1 + self.slot.get(word, self.known.starts[k - lm.WORDS] - 1)

    def log(self, two, one, word):
        (c2, i2), (c1, i1), (k, _) = map(self.place, (two, one, word))
        q = self.p["context"][c1] * self.p["position"][0] + self.p["context"][c2] * self.p["position"][1]
        out = log_softmax(self.p["output"] @ q + self.p["bias"])[k]
        if word in self.known.own:
            return out
        low, high = self.known.starts[k - lm.WORDS - 1 : k - lm.WORDS + 1]
        q = self.v["input"][i1].astype(float) * self.v["position"][0] + self.v["input"][i2].astype(float) * self.v["position"][1]
        inner = log_softmax(self.v["output"][low:high] @ q + self.v["bias"][low:high])
        if word in self.slot:
            return out + inner[self.slot[word] - low]
        rest = [c for w, c in self.counts.items() if w not in self.known.own and w not in self.slot and lm.ending(w) == k]
        return out + inner[-1] + math.log((self.counts.get(word, 0) + 1) / (sum(rest) + len(rest) + 1))

    def score(self, text):
        all_ = [None, None, *lm.tokens(text)]
        return sum(self.log(*all_[i - 2 : i + 1]) for i in range(2, len(all_))) / math.log(10)


@pytest.mark.parametrize("bits", [20, 6])
def test_scores_against_a_plain_loop(spark, monkeypatch, bits):
    monkeypatch.setattr(lm, "STEPS", 50)
    monkeypatch.setattr(lm, "HEAD_BITS", bits)
    kept = seen(monkeypatch)
    rows = [(i, prose(i, 40) + f" Rare{i % 50} {' '.join(RING[i % 90 : i % 90 + 30])}") for i in range(200)]
    got = lm.op5_lm(odd.docs(spark, rows)).collect()
    counts = {}
    for r in got:
        if not r["held_out"]:
            for w in lm.tokens(dict(rows)[r["doc_id"]]):
                counts[w] = counts.get(w, 0) + 1
    plain = Plain(kept, counts)
    assert plain.slot or bits == 6
    for r in got[::7]:
        assert r["score"] == pytest.approx(plain.score(dict(rows)[r["doc_id"]]), rel=1e-4)
    here = RING[3].encode(), RING[4].encode()
    unknown = {lm.ending(w): w for w in (b"zq%d~%c" % (a, b) for a in range(100) for b in range(97, 123)) if w not in counts}  # one unknown word of each class stands for all of them
    unknown |= {lm.ending(w): w for w in (b"zq%c%c" % (a, b) for a in range(97, 123) for b in range(97, 123)) if w not in counts}
    assert len(unknown) == lm.ENDINGS
    every = [*counts, *([] if lm.END in counts else [lm.END]), *unknown.values()]
    empty = lm.WORDS + 1 - len(kept["known"].own)  # classes without a word keep a little
    assert sum(math.exp(plain.log(*here, w)) for w in every) == pytest.approx(1, abs=1e-3 if not empty else 0.01)


def test_two_hundred_words_with_one_ending(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 400)
    rows = [(i, " ".join((RING * 2)[i % 200 : i % 200 + 100])) for i in range(400)]

    def held():
        got = [r for r in lm.op5_lm(odd.docs(spark, rows)).collect() if r["held_out"]]
        return sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got)

    monkeypatch.setattr(lm, "DRAWS", 2000)
    with_vectors = held()
    monkeypatch.setattr(lm, "PARTS", 1e-6)  # no word is that frequent
    assert with_vectors > held() + 0.5


def test_what_is_gathered_grows(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    kept, found = seen(monkeypatch), []
    for times in (1, 4):
        kept["draws"] = 0
        rows = [(i, " ".join((RING * 2)[i % 200 : i % 200 + 100]) + f" word{i % (200 * times)}x") for i in range(300 * times)]
        lm.op5_lm(odd.docs(spark, rows)).collect()
        found.append(kept["draws"])
    assert 1.5 < found[1] / found[0] < 2.5


def test_no_words_with_vectors(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    kept = seen(monkeypatch)
    got = lm.op5_lm(odd.docs(spark, [(5, "a b"), (None, None)])).collect()
    assert len(got) == 2 and all(r["score"] < 0 for r in got) and kept["draws"] == 0
