"""Exact dedup, personal data, licenses, sharding and packing."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismal.llm import exact_dedup, licenses, packing, pii, sharding, tokens

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_dedup_odd(spark):
    got = exact_dedup.exact_dedup(odd.docs(spark), least=2).collect()
    assert len(got) == len(odd.ROWS)
    groups = {}
    for i, t in odd.ROWS:
        groups.setdefault(BLANKS.sub(" ", t or ""), []).append(i)
    for text, ids in groups.items():
        h = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r["text_sha256"] == h]
        known = [i for i in ids if i is not None]
        assert Counter(r["doc_id"] for r in mine) == Counter(ids)
        assert {r["keep_id"] for r in mine} == {min(known) if known else None} and {r["group_size"] for r in mine} == {len(ids)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [min(known) if known else None]
    assert exact_dedup.exact_dedup(odd.empty(spark)).count() == 0


def test_exact_dedup_heavy_and_light_agree(spark):
    rows = [(i, f"text {i % 7 if i % 3 else 'hot'}") for i in range(600)]
    ways = [sorted(map(tuple, exact_dedup.exact_dedup(odd.docs(spark, rows), least=n).collect())) for n in (2, 100, 10_000)]
    assert ways[0] == ways[1] == ways[2]
    heavy = exact_dedup.heavy_hitters(exact_dedup.digests(odd.docs(spark, rows)), 100).collect()
    assert [r["group_size"] for r in heavy] == [200]


def test_exact_dedup_filter(spark):
    docs = odd.docs(spark)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert Counter(BLANKS.sub(" ", r["text"] or "") for r in out.collect()) == Counter({BLANKS.sub(" ", t or "") for _, t in odd.ROWS})


def test_exact_dedup_sql(spark, sf):
    from prismal.llm import queries

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op1_exact_dedup(spark, sf)
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op1_exact_dedup']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


PERSONAL = [
    "mail a.b@c.d.e_f@g.h, x@y, @z.z, a@b.c-d.e.", "ips 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.0255.0 1.2.3", "cards 4111 1111 1111 1111, 4111-1111-1111-1112, 5500000000000004 12345678901234567890",
    "call +1 (555) 010-9999 or +34 93.555.01.99x +1", "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE89370400440532013001", "ssn 123-45-6789 or just 123-45-6789",
    "\U0001f600 é a@b.co \U0001f600 1.1.1.1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "5" * 5000, "a." * 5000 + "@" + "b." * 5000, "+" * 100 + "1" * 12, "a@b.c@d.e a@b.c.@d.e",
]


def test_pii_base(spark):
    rows = [*odd.ROWS, *((100 + i, t) for i, t in enumerate(PERSONAL))]
    got = pii.op7_pii(odd.docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert "iban" in by[104]["spans"] and by[104]["spans"].count("iban") == 2
    assert by[105]["spans"].count("national") == 1, by[105]["spans"]
    assert pii.op7_pii(odd.empty(spark)).count() == 0


def test_pii_random(spark):
    rng = np.random.default_rng(0)
    alphabet = list("0123456789") * 3 + list(" .-+@()ab_%\n") * 2
    rows = [(i, "".join(rng.choice(alphabet, 200))) for i in range(400)]
    got = {r["doc_id"]: r["base_sha256"] for r in pii.op7_pii(odd.docs(spark, rows)).collect()}
    assert got == {i: hashlib.sha256(base_spans(t).encode()).hexdigest() for i, t in rows}


def test_pii_scores(spark):
    rows = [(1, "card 4111 1111 1111 1111"), (2, "4111 1111 1111 1111")]
    got = {r["doc_id"]: r["spans"][0] for r in pii.find_spans(odd.docs(spark, rows)).collect()}
    assert got[1]["score"] > got[2]["score"] and got[1]["found"] == "4111 1111 1111 1111"


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_row(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LICENSED = [
    "Under the MIT License! under-the/mit license", "CC BY NC cc by nc cc by nc", "apache license, VERSION 2 apache license version 3", "under the mit", "cc by", "cc by nc" * 3, "ünder the mit license under theé mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "redistribution and use in source and also binary forms with or without any modification are permitted provided that the following conditions are met",
]


def test_licenses(spark):
    rows = [*odd.ROWS, *((100 + i, t) for i, t in enumerate(LICENSED))]
    got = licenses.op10_licenses(odd.docs(spark, rows)).collect()
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in got) == Counter((i, *license_row(t or "")) for i, t in rows)
    by = {r["doc_id"]: r for r in got}
    assert by[107]["labels"] == "mit-text" and by[108]["labels"] == "bsd-text" and by[1]["labels"] == ""
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.op10_licenses(odd.empty(spark)).count() == 0


def test_differencing_is_balanced():
    rng = np.random.default_rng(1)
    sizes = rng.integers(16, 20_000, 2000)
    places = sharding.part_places(sizes, 8)
    sums = np.bincount(places, sizes, 8)
    assert np.ptp(sums) <= 40, sums
    assert set(sharding.part_places(np.array([5]), 3)) <= {0, 1, 2}


@pytest.mark.parametrize("per_part,fan", [(20_000, 2048), (12, 3)])
def test_sharding(spark, monkeypatch, per_part, fan):
    monkeypatch.setattr(sharding, "PER_PART", per_part)
    monkeypatch.setattr(sharding, "FAN", fan)
    rows = [*odd.ROWS, *((100 + i, f"text {i % 90} " * (i % 40)) for i in range(500))]
    got = sharding.op3_sharding(odd.docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    home, slots, sums = {}, {}, Counter()
    for r in got:
        assert home.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"] and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
        sums[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    greedy = [0] * 40  # largest first, each to the lightest shard
    for n in sorted(groups.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += n
    ours, theirs = sorted(sums[i] for i in range(40))[:36], sorted(greedy)[:36]  # four groups are large enough to fill a shard alone
    assert sum(sums.values()) == sum(groups.values()) and ours[-1] - ours[0] <= max(theirs[-1] - theirs[0], sorted(groups.values())[-5])
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.op3_sharding(odd.empty(spark)).count() == 0


@pytest.fixture(scope="module")
def tok():
    return tokens.WordTokenizer(tokens.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ's't're 've\n\t 0123.,!"), st.characters(max_codepoint=0x300), st.characters(codec="utf-8"))))
def test_tokens_by_pretoken(text):
    t = tokens.tokenizer(tokens.default_path())
    assert t.encode(text) == t._ids([text])[0]


def test_long_text_in_chunks(tok, monkeypatch):
    text = "it's a long   text, isn't it? " * 200
    whole = tok.encode(text)
    monkeypatch.setattr(tokens, "CHUNK", 100)
    assert tok.encode(text) == whole


def check_packing(got, rows, tok, length):
    pieces = Counter()
    n_tokens = 0
    for i, t in rows:
        ids = tok._ids([t or ""])[0] + b"\0\0\0\0"
        n_tokens += len(ids) // 4
        for piece, start in enumerate(range(0, len(ids) // 4, length)):
            part = ids[4 * start : 4 * (start + length)]
            pieces[i, piece, start, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seats in by.values():
        end = 0
        for offset, n in sorted(seats):
            assert offset == end
            end += n
        assert end <= length
    return len(by), -(-n_tokens // length)


def test_packing(spark, tok):
    rows = [*odd.ROWS, *((100 + i, "some words here. " * (i % 60)) for i in range(300))]
    n, least = check_packing(packing.pack(odd.docs(spark, rows), length=128).collect(), rows, tok, 128)
    assert n <= least * 1.03 + 1
    assert packing.pack(odd.empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_each_piece_once(lengths):
    histogram = np.bincount(lengths, minlength=65)
    made = np.zeros(65, int)
    for pattern, times in packing.plan(histogram, 64):
        assert times > 0 and sum(pattern) <= 64
        for x in pattern:
            made[x] += times
    assert (made == histogram).all()


def test_exact_complements():
    assert dict(packing.plan(np.bincount([60, 4, 4, 40, 20, 4, 30, 20, 10], minlength=65), 64)) == {(60, 4): 1, (40, 20, 4): 1, (30, 10, 4, 20): 1}


def test_seats():
    assert packing.seats([((60, 4), 2), ((4, 4), 1)]) == [(60, 0, 1, 0, 0), (4, 0, 1, 0, 60), (4, 2, 2, 2, 0), (4, 3, 3, 2, 4)]


def test_native_operators_run_no_python(spark, sf):
    from prismal.llm import queries

    for name in ("op1_exact_dedup", "op7_pii", "op10_licenses"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_text_size_column(spark):
    assert sharding.shard(odd.docs(spark, [(1, "é")])).select(F.col("size")).first()[0] == 18
