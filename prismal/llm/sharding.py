"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that must not be split; a group's size is the sum of its rows' sizes, added up before any shuffle.
Groups are dealt by hash into parts of bounded size. In each part, k-way differencing starts from one partial partition for
each group and repeatedly combines the two with the largest spread, one in opposite order to the other, until one partial
partition of k sums is left. The parts' partial partitions are dealt into parts of FAN and combined by the same rule, level
by level, until FAN are left for the driver, k numbers each. Going back over the combinations gives each group its shard.

Slots are numbered without a task for each shard: counts by bucket and shard give offsets, and a rank in a bucket the rest;
there are as many buckets as a bucket has rows.

Cases: a null text has no bytes and is equal to an empty one; null ids and repeated rows are rows like any other; no rows
give no rows; other columns are ignored. A group larger than a k-th of all bytes fills its shard alone.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, rank_buckets, text_of, written

SHARDS, OVERHEAD = 40, 16
#: Groups of a part; partial partitions that are combined together.
PER_PART, FAN = 20_000, 2048


def differencing(sums: np.ndarray) -> np.ndarray:
    """sums: a row of k sums for each partial partition. Returns, row by row, the shard that each of its k places goes to."""
    n, k = sums.shape
    order0 = np.argsort(-sums, axis=1, kind="stable")
    live = dict(enumerate(np.take_along_axis(sums, order0, 1).astype(np.int64)))
    heap = [(-int(v[0] - v[-1]), i) for i, v in live.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = live.pop(a) + live.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]  # only differences count from here on
        made.append((a, b, order.astype(np.uint16)))
        new = n + len(made) - 1
        live[new] = both
        heapq.heappush(heap, (-int(both[0]), new))
    places = np.zeros((n, k), np.int32)
    rest = {heap[0][1]: np.arange(k, dtype=np.int32)} if heap else {}
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        own = rest.pop(n + i)
        left = np.empty(k, np.int32)
        left[order] = own
        for child, its in ((a, left), (b, left[::-1])):
            if child < n:
                places[child, order0[child]] = its
            else:
                rest[child] = its
    for i, own in rest.items():  # a single partial partition
        places[i, order0[i]] = own
    return places


def part_places(sizes: np.ndarray, k: int) -> np.ndarray:
    """The place, 0 to k-1, of each group in its part's partial partition."""
    sums = np.zeros((len(sizes), k), np.int64)
    sums[:, 0] = sizes
    return differencing(sums)[:, 0]


def _combined(sums: DataFrame, parts: int, shards: int) -> DataFrame:
    """part, place, up, up_place, bytes: where each sum of a part goes in the partial partition of up to FAN parts."""

    def own(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "place"], ignore_index=True)
        part, of = np.unique(group["part"].to_numpy(), return_inverse=True)
        place = group["place"].to_numpy()
        made = np.zeros((len(part), shards), np.int64)
        made[of, place] = group["bytes"].to_numpy()
        return group.assign(up_place=differencing(made)[of, place])[["part", "place", "up", "up_place", "bytes"]]

    dealt = sums.withColumn("up", F.pmod(F.xxhash64("part"), F.lit(buckets(parts, FAN))))
    return written(dealt.groupBy("up").applyInPandas(own, "part long, place int, up long, up_place int, bytes long"), "combined")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    text = F.encode(text_of(), "UTF-8")
    rows = written(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "rows")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = buckets(n_groups, PER_PART)

    def own(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "digest"], ascending=False, ignore_index=True)
        return pd.DataFrame({"digest": group["digest"], "part": group["part"], "place": part_places(group["bytes"].to_numpy(), shards).astype(np.int32), "bytes": group["bytes"]})

    dealt = groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts))).select("digest", "part", "bytes")
    placed = written(dealt.groupBy("part").applyInPandas(own, "digest binary, part long, place int, bytes long"), "placed")
    sums, levels = placed.groupBy("part", "place").agg(F.sum("bytes").alias("bytes")), []
    while parts > FAN:
        levels.append(_combined(sums, parts, shards))
        parts = buckets(parts, FAN)
        sums = levels[-1].groupBy(F.col("up").alias("part"), F.col("up_place").alias("place")).agg(F.sum("bytes").alias("bytes"))
    last = np.zeros((parts, shards), np.int64)
    for part, place, total in sums.collect():  # at most FAN * shards rows
        last[part, place] = total
    to = differencing(last)
    where = docs.sparkSession.createDataFrame([(p, s, int(to[p, s])) for p in range(parts) for s in range(shards)], "part long, place int, shard int")
    for level in reversed(levels):
        where = level.join(where.withColumnsRenamed({"part": "up", "place": "up_place"}), ["up", "up_place"]).select("part", "place", "shard")
    known = rows.join(placed.select("digest", "part", "place").join(where, ["part", "place"]).select("digest", "shard"), "digest")
    known = written(known.select("doc_id", "size", "text_crc32", "row", "shard"), "sharded")
    known = known.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(rank_buckets(n_rows))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = known.groupBy("bucket", "shard").count().select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row")) - 1
    return known.withColumn("rank", rank).join(offsets, ["bucket", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("base")).cast("long").alias("slot"))


def op3_sharding(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
