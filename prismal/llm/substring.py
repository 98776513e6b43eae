"""Removal of repeated passages with prefix-partitioned suffix trees.

A passage is a window of LENGTH consecutive words. Only windows that stand in two texts can matter, and each window has one
anchor, the least of its hashed word grams, which is the same wherever the window stands. So suffixes are taken at window starts
and grouped by the gram at their anchor, a prefix of the suffix that begins there: windows that are equal are in one group.
Groups whose gram is in one text only go at once, after a count that is combined before the shuffle. The other groups are packed by
hash into partitions of bounded size; there, names of the nodes at word depth 1, 2, 4 ... and LENGTH of the suffix tree are
built level by level from the pairs of names below, and the nodes at depth LENGTH with suffixes of several texts are its deep
internal nodes. Each keeps the least document id; a suffix under it of a later document is a window to remove.

The prefix is of variable length: where a gram stands in more than HEAVY texts, so that its group would not fit, its windows are
grouped anew by the least of their longer grams, from GRAMS[0] words to GRAMS[-1]. What is in too many texts even then is grouped
by the whole window. Those suffixes go as hashes of 128 bits, the least id of each is found with partial sums, and it is
joined back, which Spark can split by rows.

Copies of a whole text are one text with its least id; in the other copies each window stands in an earlier document.

Cases: a null text has no words; texts shorter than LENGTH words lose nothing; a null id comes after all others, and of two
null ids neither is earlier; rows with the same id are one document to each other and lose nothing by each other; no rows
give no rows; other columns are ignored. Ids have to be less than 2^63 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import buckets, text_of, worker, written

LENGTH, GRAMS = 50, (8, 16, 32)
#: Texts of a gram from which on its prefix is lengthened (their runs, of some 450 bytes, still fit a task); suffix runs of a partition.
HEAVY, PER_PART = 32_768, 8192
LAST = (1 << 63) - 1
_LOW = np.uint64((1 << 24) - 1)
#: Windows looked at together, fewer than the places that the packed numbers below can tell apart.
BLOCK = 1 << 22


def anchors(codes: np.ndarray, length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for each window of the codes, and the gram hashes."""
    grams = words.grams(codes, gram)
    n, span = len(codes) - length + 1, length - gram + 1
    out = np.zeros(max(0, n), np.int64)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        best = (grams[at : end + span - 1] & ~_LOW) | np.arange(end - at + span - 1, dtype=np.uint64)
        width = 1
        while 2 * width <= span:  # the least of 2, 4, 8 ... neighbours
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < span:
            best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
        out[at:end] = (best & _LOW).astype(np.int64) + at
    return out, grams


def _order():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _keys() -> list[Column]:
    """k1, k2: 128 bits of a text, as numbers."""
    text = text_of()
    return [F.xxhash64(text, F.length(text)).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


KEYS = ["k1", "k2"]


def pending(codes: np.ndarray, trail: list[list[int]], length: int, grams: tuple[int, ...]) -> np.ndarray:
    """Which windows of the codes had an anchor in the trail, the heavy places of each level so far, at all of these levels."""
    out = np.ones(max(0, len(codes) - length + 1), bool)
    for gram, heavy in zip(grams, trail, strict=False):
        out &= np.isin(anchors(codes, length, gram)[0], heavy)
    return out


def _anchor_rows(texts: DataFrame, length: int, grams: tuple[int, ...]) -> DataFrame:
    """gram, k1, k2, place of the anchors, at the last of the grams, of the windows of each text (k1, k2, text, trail) that are pending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, done = words.Codes(), set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for k1, k2, text, trail in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if (k1, k2) in done:
                    continue
                if len(done) < 200_000:
                    done.add((k1, k2))
                own = words.split(text)
                if len(own) < length:
                    continue
                found = codes.of(own)
                place, hashes = anchors(found, length, grams[-1])
                place = np.unique(place[pending(found, trail, length, grams)])
                for to, x in zip(out, (words.signed(hashes[place]), np.full(len(place), k1, np.int64), np.full(len(place), k2, np.int64), place), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["gram", *KEYS, "place"])

    return texts.select(*KEYS, "text", "trail").mapInArrow(worker(run), "gram long, k1 long, k2 long, place long")


RUNS = "gram long, k1 long, k2 long, first long, at long, n int, codes binary, h1 long, h2 long"


def _runs(texts: DataFrame, length: int, grams: tuple[int, ...], last: bool) -> DataFrame:
    """Runs of window starts with the same shared anchor and the 48-bit codes of their words; at the last level, windows by hash for heavy grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = words.Codes()
        names = [x.split()[0] for x in RUNS.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            size = 0
            for k1, k2, first, text, trail, shared in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                found = codes.of(words.split(text))
                place, hashes = anchors(found, length, grams[-1])
                heavy = {x["place"]: x["heavy"] for x in shared}
                here = np.where(pending(found, trail, length, grams), place, -1)
                starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                ends = np.r_[starts[1:], len(here)]
                narrow = np.ascontiguousarray(found).view(np.uint8).reshape(-1, 8)[:, :6]
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    p = int(here[a])
                    if p not in heavy:
                        continue
                    g = int(hashes[p].view(np.int64))
                    rows = []
                    if not heavy[p]:
                        rows = [(g, k1, k2, first, a, b - a, narrow[a : b + length - 1].tobytes(), None, None)]
                    elif last:
                        raw = found[a : b + length - 1].tobytes()
                        for i in range(a, b):
                            d = xxhash.xxh3_128_intdigest(raw[8 * (i - a) : 8 * (i - a + length)])
                            rows.append((g, k1, k2, first, i, 1, None, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)))
                    for row in rows:
                        for c, x in zip(cols, row, strict=True):
                            c.append(x)
                    size += len(rows)
                if size > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                    cols, size = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return texts.select(*KEYS, "first", "text", "trail", "shared").mapInArrow(worker(run), RUNS)


def tree_nodes(codes: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The node at depth length of the suffix at each place of the codes, -1 if its text (up to the next of ends) is shorter."""
    n = len(codes)
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)  # words up to the end of the own text
    _, name = np.unique(codes, return_inverse=True)
    name = name.astype(np.int64)
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        pair = np.full(n, -1, np.int64)
        whole = np.flatnonzero(left >= depth + step)
        pair[whole] = (name[whole] << 32) | name[whole + step]
        _, name = np.unique(pair, return_inverse=True)
        name = name.astype(np.int64)
        if len(whole) < n:
            name -= 1  # the first name is that of suffixes which are too short
        depth += step
        name[left < depth] = -1
    return name


def _removed(runs: DataFrame, length: int, parts: int) -> DataFrame:
    """k1, k2, at, n: runs of windows that stand in a document with a smaller id."""

    def own(group: pd.DataFrame) -> pd.DataFrame:
        raw = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in group["codes"]]
        sizes = np.array([len(x) for x in raw])
        wide = np.zeros((sizes.sum(), 8), np.uint8)
        wide[:, :6] = np.concatenate(raw)
        ends = np.cumsum(sizes)
        node = tree_nodes(wide.view(np.uint64).ravel(), ends, length)
        n = group["n"].to_numpy(np.int64)
        row = np.repeat(np.arange(len(group)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = node[np.repeat(ends - sizes, n) + offset]
        first = group["first"].to_numpy(np.int64)[row]
        least = np.full(at.max() + 1, LAST, np.int64)
        np.minimum.at(least, at, first)
        hit = np.flatnonzero(least[at] < first)
        if not len(hit):
            return pd.DataFrame({x: np.zeros(0, np.int64) for x in (*KEYS, "at", "n")})
        cut = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)])
        start, count = hit[cut], np.diff(np.r_[cut, len(hit)])
        return pd.DataFrame({**{x: group[x].to_numpy()[row[start]] for x in KEYS}, "at": group["at"].to_numpy()[row[start]] + offset[start], "n": count})

    dealt = runs.where("codes is not null").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts)))
    light = dealt.groupBy("part").applyInPandas(own, "k1 long, k2 long, at long, n long")
    single = runs.where("codes is null").select("h1", "h2", *KEYS, "first", "at")
    least = written(single.groupBy("h1", "h2").agg(F.min("first").alias("least")), "least")  # a table, so that a hot window's join can be split
    heavy = single.join(least, ["h1", "h2"]).where("least < first").select(*KEYS, "at", F.lit(1).cast("long").alias("n"))
    return light.unionByName(heavy)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (k1, k2, first and others) with their text, from the document that has it first."""
    own = docs.select(_order().alias("first"), *_keys(), text_of().alias("text"))
    own = words.probably_in(own, F.col("k1"), wanted, "k1", "hit").where("hit").drop("hit")
    return own.join(wanted, [*KEYS, "first"])


def repeated_windows(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> tuple[DataFrame, DataFrame]:
    """Texts (k1, k2, first: the least id, copies) that matter, and k1, k2, at, n of the windows to remove in their first document."""
    texts = written(docs.select(*_keys(), _order().alias("id")).groupBy(*KEYS).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "texts")
    none = F.expr("cast(array() as array<array<long>>)")
    now, removed = docs.select(*_keys(), text_of().alias("text"), none.alias("trail")), []
    pend = texts.select(*KEYS, "first", none.alias("trail"))
    for level in range(1, len(grams) + 1):
        rows = written(_anchor_rows(now, length, grams[:level]), "anchors")
        shared = rows.groupBy("gram").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.count(F.lit(1)).alias("n")).where("a != b").select("gram", (F.col("n") > HEAVY).alias("heavy"))
        shared = written(shared, "shared")  # a table, so that a hot gram's join can be split
        places = rows.join(shared, "gram").groupBy(*KEYS).agg(F.collect_set(F.struct("place", "heavy")).alias("shared"))
        wanted = written(places.join(pend, KEYS), "wanted")
        last = level == len(grams)
        runs = written(_runs(_texts(docs, wanted), length, grams[:level], last), "runs")
        parts = buckets(runs.where("codes is not null").count(), PER_PART)
        removed.append(written(_removed(runs, length, parts), "removed"))
        heavy = F.transform(F.filter("shared", lambda x: x["heavy"]), lambda x: x["place"])
        pend = wanted.where(F.size(heavy) > 0).select(*KEYS, "first", F.concat("trail", F.array(heavy)).alias("trail"))
        if last or pend.isEmpty():
            return texts, reduce(DataFrame.unionByName, removed)
        now = _texts(docs, pend)
    raise AssertionError


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(df: DataFrame, length: int) -> DataFrame:
    """OUT from doc_id, text, first (whether the text's first document), gone (windows to remove)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, first, gone in zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                own = words.split(text)
                n, removed = len(own), 0
                if not first and n >= length:
                    own, removed = [], n
                elif gone:
                    cover = np.zeros(n + 1, np.int64)
                    for x in gone:
                        cover[x["at"]] += 1
                        cover[x["at"] + x["n"] + length - 1] -= 1
                    keep = np.cumsum(cover[:-1]) == 0
                    own = [w for w, k in zip(own, keep.tolist(), strict=True) if k]
                    removed = n - len(own)
                n_words.append(n)
                n_removed.append(removed)
                digests.append(hashlib.sha256(" ".join(own).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return df.mapInArrow(worker(run), OUT)


def op6_substring_dedup(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    texts, removed = repeated_windows(docs, length, grams)
    gone = removed.groupBy(*KEYS).agg(F.collect_set(F.struct("at", "n")).alias("gone"))
    touched = texts.join(gone, KEYS, "left").where((F.col("copies") > 1) | F.col("gone").isNotNull())
    touched = written(touched.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("first").alias("least"), "gone"), "touched")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), _order().alias("id"), *_keys())
    rows = words.probably_in(rows, F.col("k1"), touched, "t1", "hit")
    same = (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    hit = rows.where("hit").join(touched, same, "left").select("doc_id", "text", (F.col("least").isNull() | (F.col("id") == F.col("least"))).alias("first"), "gone")
    miss = rows.where("not hit").select("doc_id", "text", F.lit(True).alias("first"), F.lit(None).cast(touched.schema["gone"].dataType).alias("gone"))
    return _kept(hit, length).unionByName(_kept(miss, length))
