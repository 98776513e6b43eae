"""Near-duplicate classes by DartMinHash and banding.

Texts with the same lower-case words are one node. A node's elements are its distinct shingles of five words (the whole word
sequence if it is shorter), of weight 1, so that the weighted Jaccard similarity is the plain one; counts or any
non-negative weights can be given instead. Darts are thrown at the plane of weight and rank of each element: cells of unit weight and bounded
rank hold a Poisson number of darts, and number, coordinate and rank of each come from a hash of the element and the cell, so that all
documents see the same darts. A signature keeps the dart of lowest rank in each coordinate; more ranks are thrown only until
no coordinate is empty. Two nodes agree in a coordinate with a probability that is their similarity.

Nodes that agree in a band of coordinates meet in a bucket. Pairs of a bucket are not all made: in a round, each bucket
compares its members with a few hubs, the members with least of their own first, which are the texts that the copies were
made from; the comparison is exact, on whole shingle sets. A member with too many shingles that no other member has can't be
similar enough to any and takes no part. Components of the links so far are found, and a bucket whose members are in one component is done;
the rest goes on with more hubs, until each pair of members in different components has been compared. The classes are thus those of all
candidate pairs. Components shrink by the large-star, small-star rounds, with tables in the shared folder between them.

Cases: a null text is empty; empty texts are one class; a class is named by its smallest doc_id, null ids come last; repeated
rows are in the same class, and one row of a class is kept; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import one_of_each, text_key, text_of, worker, written

K, LEAST, BANDS, ROWS = 5, 0.8, 32, 6
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Links that one task may join up, 16 bytes each; how many times more hubs each round has than the one before.
IN_ONE_TASK, MORE_HUBS = 1_000_000, 16
#: Members are pruned again as long as less than this share of them stays.
AGAIN = 0.75


def _cells(enough: float) -> Iterator[tuple[int, float, float, int]]:
    """Number of the first, lower rank, width and count of cells that are filled together, in order of rank: short ones first,
    for elements of long texts, then cells of width 1, as many as will be enough."""
    yield from ((0, 0.0, 0.125, 1), (1, 0.125, 0.125, 1), (2, 0.25, 0.25, 1), (3, 0.5, 0.5, 1))
    low = 1
    while True:
        count = max(1, min(math.ceil(enough) - low, 4096))
        yield 3 + low, float(low), 1.0, count
        low += count


_POISSON = {w: np.cumsum([math.exp(-w) * w**i / math.factorial(i) for i in range(24)]) for w in (0.125, 0.25, 0.5, 1.0)}


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def elements(hashes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of weight of each element, and how much of the cell its weight covers."""
    if weights is None:
        return hashes, np.ones(len(hashes))
    times = np.ceil(weights).astype(np.int64)
    layer = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return words.mix(np.repeat(hashes, times) + layer.astype(np.uint64) * GOLD), np.minimum(1.0, np.repeat(weights, times) - layer)


def signature(hashes: np.ndarray, k: int = BANDS * ROWS, weights: np.ndarray | None = None) -> np.ndarray:
    """The dart of lowest rank in each of k coordinates."""
    cells, share = elements(hashes, weights)
    total = share.sum()
    if not total:
        return np.zeros(0, np.uint64)
    ids, ranks = np.zeros(k, np.uint64), np.full(k, np.inf)
    enough = (k * math.log(k) + 2 * k) / total
    batch: list[tuple[np.ndarray, np.ndarray]] = []
    whole = bool((share >= 1).all())
    for n, low, width, count in _cells(enough):
        layers = np.arange(n + 1, n + 1 + count, dtype=np.uint64) * GOLD
        seed = words.mix((cells[None, :] + layers[:, None]).ravel())
        cdf = _POISSON[width]
        draw = _unit(seed)
        some = np.flatnonzero(draw > cdf[0])
        times = np.searchsorted(cdf, draw[some])
        first = seed[some]
        each = np.repeat(first, times)
        if len(each):
            own = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            dart = words.mix(each + (own.astype(np.uint64) + np.uint64(1)) * GOLD)
            rank = low + width * (np.repeat(some // len(cells), times) + _unit(words.mix(dart ^ GOLD)))
            if not whole:
                hit = _unit(words.mix(dart + GOLD)) < np.repeat(share[some % len(cells)], times)
                dart, rank = dart[hit], rank[hit]
            batch.append((dart, rank))
        if low + width * count >= enough and batch:
            darts, at = np.concatenate([x for x, _ in batch]), np.concatenate([x for _, x in batch])
            order = np.argsort(-at, kind="stable")
            darts, at = darts[order], at[order]
            place = ((darts >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            new, rank = np.zeros(k, np.uint64), np.full(k, np.inf)
            new[place], rank[place] = darts, at  # the last, of lowest rank, stays
            better = rank < ranks
            ids[better], ranks[better] = new[better], rank[better]
            if np.isfinite(ranks).all():
                return ids
            batch = []
    raise AssertionError


def bands(ids: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band, of its number too."""
    if not len(ids):
        return ids
    out = np.arange(n, dtype=np.uint64)
    for column in ids.reshape(n, rows).T:
        out = words.mix(out * GOLD + column)
    return out


def _texts(words_of: list[str], codes: words.Codes) -> np.ndarray:
    """Distinct shingle hashes of a text."""
    found = codes.of(words_of)
    return np.unique(words.grams(found, min(K, len(found)))) if len(found) else found


def _low(text: str) -> list[str]:
    return words.split(text.lower())


def _key(own: list[str]) -> bytes:
    return xxhash.xxh3_128_digest("\x00".join(own).encode("utf-8", "surrogatepass"))


def _short(keys: list[bytes]) -> np.ndarray:
    """64 bits of each key, for filters."""
    return np.frombuffer(b"".join(keys), "<i8")[::2]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row, text_key, key (of the words), short (64 bits of it) and the bands of each row's text."""
    schema = "doc_id long, row long, text_key binary, key binary, short long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, last = words.Codes(), {}
        for batch in batches:
            keys, made = [], []
            for text in batch.column(3).to_pylist():
                own = _low(text)
                key = _key(own)
                if key not in last:
                    if len(last) > 2000:
                        last.clear()
                    last[key] = words.signed(bands(signature(_texts(own, codes)))) if own else np.zeros(0, np.int64)
                keys.append(key)
                made.append(last[key])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(_short(keys)), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "row", "text_key", "key", "short", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_key(text_of()).alias("text_key"), text_of().alias("text"))
    return rows.mapInArrow(worker(run), schema)


def _shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes as bytes, of the nodes in wanted (node, key, short)."""
    seen = words.bitmap_array(wanted, "short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, done = words.Codes(), set()
        for batch in batches:
            keys, sets = [], []
            texts = batch.column(0).to_pylist()
            found = [_key(_low(text)) for text in texts]
            for text, key, here in zip(texts, found, words.passes(seen, _short(found).view(np.uint64)).tolist(), strict=True):
                if not here or key in done:
                    continue
                if len(done) < 200_000:
                    done.add(key)
                keys.append(key)
                sets.append(_texts(_low(text), codes).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    found = docs.select(text_of().alias("text")).mapInArrow(worker(run), "key binary, shingles binary")
    return found.join(wanted, "key").groupBy("key", "node").agg(F.first("shingles").alias("shingles")).select("node", "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs whose shingle sets are similar enough. Only sets that a pair needs are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if min(len(a), len(b)) < least * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def of(side: str, name: str) -> DataFrame:
        needed = pairs.select(F.xxhash64(side).alias("short"))
        return words.probably_in(sets, F.xxhash64("node"), needed, "short", "hit").where("hit").select(F.col("node").alias(side), F.col("shingles").alias(name))

    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(worker(run), "a long, b long")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            piece = batch.slice(part, 500)
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in piece.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(piece.column(0).to_numpy(), [len(x) for x in each])), pa.array(np.concatenate(each))], names=["node", "shingle"])


def _candidates(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """bucket, node, size, shared, members, before (its smaller buckets), place of the nodes that may be linked in a bucket.

    size: the node's shingles; shared: those that another node of a bucket has too. Two nodes have at most the lesser of their
    shared counts in common, which bounds their similarity: a node that is too much its own for the smallest node of a
    bucket has no link there. Without the members that went, others may have too much of their own, so that the bound is
    taken again as long as it takes many away. place orders the nodes: hubs are those with least of their own.

    What is known of a bucket is written before it is joined to the members, so that the join of a hot one can be split.
    """
    alive, own, n = members, sets, members.count()
    while True:
        stats = written(_shared(own), "shared")
        every = alive.select("bucket", "node").join(stats, "node")
        low = written(every.groupBy("bucket").agg(F.min("size").alias("smallest")), "smallest")
        may = written(every.join(low, "bucket").where(F.col("smallest") <= F.col("shared") * (1 + 1 / least) - F.col("size") + 1e-6).drop("smallest"), "may")
        there = written(may.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "there")
        alive = written(may.join(there, "bucket"), "alive")
        before, n = n, alive.count()
        if n >= AGAIN * before:
            break
        own = sets.join(alive.select("node").distinct(), "node", "left_semi")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    mine = alive.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # as many as there are bands at most
    place = F.struct((-F.col("shared") / F.col("size")).alias("own"), (-F.col("degree")).alias("degree"), "node").alias("place")
    return alive.join(degree, "node").join(mine, "node").select("bucket", "node", "size", "shared", "members", F.filter("buckets", lambda x: x < F.col("bucket")).alias("before"), place)


def _shared(sets: DataFrame) -> DataFrame:
    """node, size and how many of its shingles another of the nodes has."""
    alone = sets.select("node", "shingles").mapInArrow(worker(_unpacked), "node long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    own = alone.groupBy(F.col("node").alias("o_node")).agg(F.count(F.lit(1)).alias("own"))
    stats = sets.select("node", (F.length("shingles") / 8).cast("long").alias("size"))
    return stats.join(own, F.col("node") == F.col("o_node"), "left").select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))


def components(links: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """node, component (its smallest node) of the nodes of links (a, b).

    At most in_one_task links are joined up in one task, as that many fit there; more go through star_rounds.
    """
    if links.limit(in_one_task + 1).count() > in_one_task:
        return star_rounds(links)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in list(up)], pa.int64())], names=["node", "component"])

    return links.select("a", "b").coalesce(1).mapInArrow(worker(union), "node long, component long")


def star_rounds(links: DataFrame) -> DataFrame:
    """components() by alternating large-star and small-star rounds, for any number of links."""
    e = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").unionByName(low.select("u", "m"))
        e = written(small.where("u != m").select(F.col("m").alias("a"), F.col("u").alias("b")).distinct(), "links")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        state = now


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """A row per document: doc_id, class_id, class_size, kept, text_id (smallest id of the same words), text_key, kept_key (of the kept row)."""
    rows = written(_keyed(docs), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_key")
    nodes = rows.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.min("row").alias("node"))  # a node's number is a row's
    members = rows.join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    sizes = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")  # a bucket of one node links nothing
    members = written(members.join(sizes, "bucket"), "buckets")
    wanted = written(rows.select(F.col("row").alias("node"), "key", "short").join(members.select("node").distinct(), "node"), "wanted")
    sets = written(_shingles(docs, wanted), "shingles")
    candidates = written(_candidates(members, sets, least), "candidates")
    links = tested = found = now = None
    at, hubs = 0, 1
    while True:
        if found is None:
            now = candidates.withColumn("component", F.col("node"))
        else:
            each = candidates.where(F.col("members") > at + 1).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            spread = written(each.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket"), "spread")
            now = written(each.join(spread, "bucket", "left_semi"), "open", now if at > 1 else None)
        if now.isEmpty():
            break
        # the first ranks only, so that each task passes on that many rows of a bucket and no bucket meets in one task
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("place"))
        hub = now.select("bucket", *[F.col(x).alias(f"hub_{x}") for x in ("node", "component", "size", "shared", "before", "place")]).withColumnRenamed("hub_place", "place")
        hub = written(hub.withColumn("rank", rank).where(F.col("rank") <= at + hubs).where(F.col("rank") > at).withColumnRenamed("place", "hub_place").drop("rank"), "hubs")
        may = F.least("shared", "hub_shared") >= least / (1 + least) * (F.col("size") + F.col("hub_size")) - 1e-9
        new = now.join(hub, "bucket").where((F.col("place") > F.col("hub_place")) & (F.col("component") != F.col("hub_component")) & may & ~F.arrays_overlap("before", "hub_before"))  # a pair counts in its first bucket only
        new = new.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
        new = written(new if tested is None else new.join(tested, ["a", "b"], "left_anti"), "pairs")
        good = _similar(new, sets, least)
        links = written(good if links is None else good.unionByName(links), "good", links)
        tested = new if tested is None else tested.unionByName(new)
        found = written(components(links), "components", found)
        at, hubs = at + hubs, hubs * MORE_HUBS
    label = nodes if links is None else nodes.join(found, "node", "left")
    label = label.withColumn("component", F.col("node") if links is None else F.coalesce("component", "node"))
    classes = label.groupBy("component").agg(F.min("first").alias("head"), F.sum("n").alias("class_size"))
    named = written(label.join(classes, "component").select("key", "first", "head", "class_size"), "named")
    return rows.select("doc_id", "row", "text_key", "key").join(named, "key").select(
        "doc_id",
        F.col("head.doc_id").alias("class_id"),
        F.col("class_size").cast("long").alias("class_size"),
        (F.col("row") == F.col("head.row")).alias("kept"),
        F.col("first.doc_id").alias("text_id"),
        "text_key",
        F.col("head.text_key").alias("kept_key"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate class; columns unchanged."""
    same = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("kept_key"))
    gone = written(near_duplicates(docs).where(~same).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")), "gone")
    return one_of_each(words.without(docs, gone))
