"""Toxicity, language model, substring dedup, decontamination, near duplicates and the pipeline."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import odd
import pytest

from prismal.llm import decontam, lm, minhash, substring, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "ir", "olu", "upat")]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


# toxicity

RUDE = ["idiot", "moron", "trash", "loser", "scum"]


def toxic_corpus(n=400):
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        own = prose(i, 80).split()
        if bad:
            for j in range(6):
                own[5 + 11 * j] = RUDE[(i + j) % 5]
        docs.append((i, " ".join(own)))
        labels.append((i, 0, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus()
    lab = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.op2_toxicity(odd.docs(spark, [*docs, *((i and i + 1000, t) for i, t in odd.ROWS)]), lab).collect()
    assert len(got) == len(docs) + len(odd.ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    docs_df = odd.docs(spark, docs)
    kept = toxicity.without_toxic(docs_df, lab)
    assert kept.columns == docs_df.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, t in truth.items() if not t and i % 2}


def test_toxicity_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = toxic_corpus(200)
    turned = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    models = [toxicity.fit(odd.docs(spark, docs), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned)]
    assert models[0]["toxic"] == models[1]["toxic"] and np.array_equal(models[0]["weights"], models[1]["weights"])


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.op2_toxicity(odd.docs(spark), none).collect()} == {0.0}
    only = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.op2_toxicity(odd.docs(spark), only).collect()} <= {0.0, 1.0}
    docs, labels = toxic_corpus(60)
    assert toxicity.op2_toxicity(odd.empty(spark), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# language model


def base_rows(rows):
    toks = [[*(re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in (x.encode() for x in WORD.findall(t or ""))), b"\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for own, h in zip(toks, held, strict=True) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) for (i, _), own, h in zip(rows, toks, held, strict=True)]


@pytest.mark.parametrize("bits", [20, 4])
def test_lm_base(spark, monkeypatch, bits):
    monkeypatch.setattr(lm, "HEAD_BITS", bits)
    monkeypatch.setattr(lm, "STEPS", 50)
    rows = [*odd.ROWS, *((100 + i, prose(i, 30) + f" Rare{i % 50}") for i in range(100))]
    got = lm.op5_lm(odd.docs(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[5])
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=key), sorted(base_rows(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_lm_learns_context(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 1200)
    a, b = VOCABULARY[:30], VOCABULARY[30:]
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(a if i % 2 else b, 60))) for i in range(300)]
    got = lm.op5_lm(odd.docs(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)  # both are negative


def test_lm_is_normalised(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 20)
    rng = np.random.default_rng(0)
    counts = np.zeros((lm.CLASSES + 1) ** 2 * lm.CLASSES, np.int64)
    counts[rng.integers(0, len(counts), 500)] = 3
    table = lm.log_table(lm.train(counts))
    assert np.allclose((10.0**table).sum(1), 1, atol=1e-4)


def test_lm_empty(spark):
    assert lm.op5_lm(odd.empty(spark)).count() == 0


def test_lm_contexts():
    got = lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([3, 5]))
    b, k = lm.BEGIN, lm.CLASSES + 1
    assert got.tolist() == [b * k + b, b * k + 1, 1 * k + 2, b * k + b, b * k + 4]


# substring dedup


def removed(rows, length):
    low = {}
    last = 1 << 62
    for i, t in rows:
        own = WORD.findall(t or "")
        for j in range(len(own) - length + 1):
            k = tuple(own[j : j + length])
            low[k] = min(low.get(k, last), last if i is None else i)
    out = []
    for i, t in rows:
        own = WORD.findall(t or "")
        gone = [False] * len(own)
        for j in range(len(own) - length + 1):
            if low[tuple(own[j : j + length])] < (last if i is None else i):
                gone[j : j + length] = [True] * length
        kept = [w for w, g in zip(own, gone, strict=True) if not g]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def passages():
    shared = prose(1, 70)
    rows = [*odd.ROWS]
    rows += [(100 + i, f"{prose(50 + i, 30)} {shared} {prose(90 + i, 20)}") for i in range(6)]
    rows += [(200 + i, f"{prose(300, 40)} {prose(301 + i % 2, 15)} {shared[: 120 + 30 * i]}") for i in range(6)]
    rows += [(300, "la " * 400), (301, "la " * 70), (302, f"{shared} {shared}"), (99, prose(7, 49)), (98, prose(7, 49)), (97, prose(8, 50)), (96, prose(8, 50)), (96, prose(8, 51))]
    return rows


@pytest.mark.parametrize("heavy", [1 << 15, 7, 1])
def test_substring(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring, "HEAVY", heavy)
    rows = passages()
    got = substring.op6_substring_dedup(odd.docs(spark, rows)).collect()
    assert Counter(map(tuple, got)) == removed(rows, 50)


def test_substring_short_windows(spark, monkeypatch):
    monkeypatch.setattr(substring, "PER_PART", 20)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(list("abc"), int(rng.integers(0, 60))))) for i in range(60)]
    for heavy in (1 << 15, 4):
        monkeypatch.setattr(substring, "HEAVY", heavy)
        got = substring.op6_substring_dedup(odd.docs(spark, rows), length=9, grams=(4, 6)).collect()
        assert Counter(map(tuple, got)) == removed(rows, 9)
    assert substring.op6_substring_dedup(odd.empty(spark)).count() == 0


def test_anchor_is_the_least_gram():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    place, grams = substring.anchors(codes, 50, 8)
    for i in range(len(place)):
        own = grams[i : i + 43] >> np.uint64(24)
        assert place[i] == i + int(np.argmin(own))


def test_tree_nodes():
    text = "abcabcab|bcabca"
    codes = np.array([ord(c) for c in text.replace("|", "")], np.uint64)
    ends = np.array([8, 14])
    node = substring.tree_nodes(codes, ends, 3)
    own = [text.replace("|", "")[i : i + 3] if i + 3 <= (8 if i < 8 else 14) else None for i in range(14)]
    for (i, a), (j, b) in itertools.combinations(enumerate(own), 2):
        if a is not None and b is not None:
            assert (a == b) == (node[i] == node[j])
    assert all((a is None) == (n == -1) for a, n in zip(own, node, strict=True))


# decontamination

ITEMS = [
    (1, "Tom has 3 apples and Tom gives 2 kg of apples to Ann who walks away along the river"),
    (2, prose(500, 40)),
    (3, "too short"),
    (4, None),
]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    again = ITEMS[0][1].replace("Tom", "Bob").replace("3", "17").replace("Ann", "Eve").replace("kg", "lb")
    crossed = "Tom has 3 apples and Bob gives 2 kg of apples to Ann who walks away along the river".replace("3", "x").replace("apples", "pears")
    rows = [*odd.ROWS, (100, f"{prose(1, 30)} {ITEMS[1][1]} {prose(2, 30)}"), (101, f"He said: {again}, and left."), (102, prose(3, 200)), (103, crossed), (104, " ".join(ITEMS[1][1].split()[:20])), (105, ITEMS[1][1].upper())]
    got = {r["doc_id"]: r for r in decontam.op8_decontamination(odd.docs(spark, rows), bench).collect() if r["doc_id"] is not None}
    assert got[100]["item_ids"] == [2] and got[100]["coverage"] == 1 and got[101]["item_ids"] == [1]
    assert {i for i, r in got.items() if r["contaminated"]} == {100, 101, 105}
    df = odd.docs(spark, rows)
    clean = decontam.decontaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == len(rows) - 3
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminated(df, none).count() == len(rows)
    assert decontam.op8_decontamination(odd.empty(spark), bench).count() == 0


def test_decontamination_by_shuffle(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ways = []
    for n in (200_000, 0):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", n)
        ways.append(sorted((r["doc_id"], r["item_ids"]) for r in decontam.op8_decontamination(docs, bench).where("contaminated").collect()))
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    want = sorted((r["doc_id"], sorted(i for i, t in items.items() if t in r["text"])) for r in docs.collect() if any(t in r["text"] for t in items.values()))
    assert ways[0] == ways[1] == want


def test_slots_have_to_agree(spark):
    bench = spark.createDataFrame([(1, "Tom met Ann and Tom saw Ann and Tom left Ann and Tom wept")], "item_id long, text string")
    rows = [(1, "Bob met Eve and Bob saw Eve and Bob left Eve and Bob wept"), (2, "Bob met Eve and Joe saw Zed and Max left Liz and Sam wept")]
    got = {r["doc_id"]: r["contaminated"] for r in decontam.op8_decontamination(odd.docs(spark, rows), bench).collect()}
    assert got == {1: True, 2: False}


# near duplicates


def shingles(text):
    own = (text or "").lower().split()
    return frozenset(tuple(own[j : j + 5]) for j in range(max(1, len(own) - 4))) if own else frozenset()


def classes(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y and (not x or " ".join((rows[a][1] or "").lower().split()) == " ".join((rows[b][1] or "").lower().split())) or (x and y and len(x & y) / len(x | y) >= least):
            up[max(top(a), top(b))] = min(top(a), top(b))
    found = {}
    for i in range(len(rows)):
        found.setdefault(top(i), []).append(rows[i][0])
    return sorted(sorted(map(str, v)) for v in found.values())


def near_rows():
    rng = np.random.default_rng(5)
    rows = list(odd.ROWS)
    for g in range(6):
        first = prose(1000 + g, 120).split()
        for i in range(8):
            own = list(first)
            for _ in range(i % 4):
                own[int(rng.integers(0, 120))] = f"edit{rng.integers(0, 1000)}"
            rows.append((100 + 10 * g + i, " ".join(own)))
    chain = [f"w{i}" for i in range(60)]
    rows += [(300 + i, " ".join(chain[3 * i : 3 * i + 40])) for i in range(6)]  # neighbours are alike, ends are not
    return rows


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_near_duplicates(spark, monkeypatch, one_task):
    monkeypatch.setattr(minhash.components, "__defaults__", (one_task,))
    rows = near_rows()
    got = minhash.near_duplicates(odd.docs(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["class_id"], []).append(r)
    assert sorted(sorted(str(r["doc_id"]) for r in v) for v in by.values()) == classes(rows)
    for v in by.values():
        known = [r["doc_id"] for r in v if r["doc_id"] is not None]
        assert sum(r["kept"] for r in v) == 1 and {r["class_size"] for r in v} == {len(v)} and v[0]["class_id"] == (min(known) if known else None)


def test_near_duplicate_filter(spark):
    rows = near_rows()
    docs = odd.docs(spark, rows)
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(classes(rows))
    assert minhash.deduplicated(odd.empty(spark)).count() == 0


def test_star_rounds(spark):
    rng = np.random.default_rng(0)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))], "a long, b long")
    one = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    many = {r["node"]: r["component"] for r in minhash.star_rounds(links).collect()}
    assert {n: c for n, c in one.items() if n in many} == many


@pytest.mark.parametrize("size,same", [(3, 0.5), (30, 0.5), (400, 0.8), (5000, 0.9)])
def test_signatures_estimate_similarity(size, same):
    rng = np.random.default_rng(size)
    both = round(2 * size * same / (1 + same))
    a = rng.integers(0, 1 << 63, size).astype(np.uint64)
    b = np.concatenate([a[:both], rng.integers(0, 1 << 63, size - both).astype(np.uint64)])
    true = both / (2 * size - both)
    agree = np.mean([(minhash.signature(words.mix(a + np.uint64(s))) == minhash.signature(words.mix(b + np.uint64(s)))).mean() for s in range(12)])
    assert abs(agree - true) < 0.04


def test_weighted_signatures():
    a = np.arange(1, 40, dtype=np.uint64)
    x, y = np.full(39, 2.5), np.r_[np.full(20, 2.5), np.full(19, 0.5)]
    agree = np.mean([(minhash.signature(words.mix(a + np.uint64(99 * s)), weights=x) == minhash.signature(words.mix(a + np.uint64(99 * s)), weights=y)).mean() for s in range(30)])
    assert abs(agree - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05
    assert len(minhash.signature(np.zeros(0, np.uint64))) == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = out
        sizes.append(out.count())
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert len(classes(rows)) == len(rows)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(x in t for x in items for _, t in rows)
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {i for i, _ in rows}


def test_words_of_a_text():
    for t in ["a\x1cb c\xa0d e\x85f", " \n x  y\t", "", "日本　語 z"]:
        assert words.split(t) == WORD.findall(t)
