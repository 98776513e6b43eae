"""Best-fit packing of token sequences by exact complements.

Workers tokenize whole texts and cut only documents longer than a sequence. What is left to pack are lengths from 1 to the
sequence length, so their histogram, of fixed size, is all that planning needs. For each length, longest first, the plan
looks for one, two or three available lengths whose sum is exactly the gap (indexes of the sums of one and two lengths make
each look-up short), and takes each such combination as often as the counts allow. What finds no complement is packed best
fit, longest first, into the smallest gap that holds it. The plan is a list of patterns and how often each is used.

Pieces then find their seats without a driver: their rank among pieces of equal length (offsets by bucket, then a rank in
it; there are as many buckets as a bucket has rows) falls into the interval of one seat of one pattern, found by halving.
Each pattern uses up a length or a gap, so that their number follows the sequence length and not the data.

Cases: a null text is empty, and an empty text is the end token alone; a document with a null id or a repeated row is packed
like any other row; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import rank_buckets, text_of, worker, written

LENGTH, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
_RANK_BITS = 48


def cut(ids: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """piece, start, length and crc of the pieces of a document's ids."""
    n = len(ids) // 4
    for piece, start in enumerate(range(0, n, length)):
        part = ids[4 * start : 4 * (start + length)]
        yield piece, start, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece of each document."""
    end = np.array([END], "<u4").tobytes()
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(path)
        for batch in batches:
            rows = [(i, *p) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in cut(tok.encode(text) + end, length)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(worker(run), PIECES)


class _Sums:
    """Which gaps one, two or three available lengths fill."""

    def __init__(self, have: np.ndarray, most: int):
        self.have, self.most, self.stale = have, most, True

    def _index(self) -> None:
        self.one = self.have > 0
        self.lengths = np.flatnonzero(self.one)
        mask = reduce(lambda a, b: a | (1 << int(b)), self.lengths, 0)
        two = reduce(lambda a, b: a | (mask << int(b)), self.lengths, 0)
        bits = np.frombuffer((two & ((1 << (self.most + 1)) - 1)).to_bytes(self.most // 8 + 1, "little"), np.uint8)
        self.two = np.unpackbits(bits, bitorder="little")[: self.most + 1].astype(bool)
        self.stale = False

    def _pair(self, gap: int, less: dict[int, int]) -> tuple[int, ...] | None:
        for a in self.lengths[(self.lengths < gap) & (self.lengths >= (gap + 1) // 2)][::-1]:
            if self.one[b := gap - int(a)] and self._enough((int(a), b), less):
                return int(a), b
        return None

    def _enough(self, combination: tuple[int, ...], less: dict[int, int]) -> bool:
        return all(self.have[x] - less.get(x, 0) >= combination.count(x) for x in combination)

    def fill(self, length: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap next to a piece of this length."""
        if self.stale:
            self._index()
        less = {length: 1}
        if self.one[gap] and self._enough((gap,), less):
            return (gap,)
        if self.two[gap] and (found := self._pair(gap, less)):
            return found
        rest = self.lengths[self.lengths < gap][::-1]
        for c in rest[self.two[gap - rest]]:
            if found := self._pair(gap - int(c), {length: 1, int(c): less.get(int(c), 0) + 1}):
                if self._enough((*found, int(c)), less):
                    return (*found, int(c))
        return None


def plan(histogram: np.ndarray, length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how often each is used; histogram[n] pieces have n ids."""
    have, left, out = histogram.astype(np.int64).copy(), np.zeros(length + 1, np.int64), []
    sums = _Sums(have, length)

    def take(pattern: tuple[int, ...], times: int) -> None:
        out.append((pattern, times))
        for x in pattern:
            have[x] -= times
            sums.stale |= have[x] == 0

    for n in range(length, 0, -1):
        while have[n]:
            if n == length:
                take((n,), int(have[n]))
            elif found := sums.fill(n, length - n):
                pattern = (n, *found)
                take(pattern, min(int(have[x]) // pattern.count(x) for x in pattern))
            else:
                left[n], have[n], sums.stale = have[n], 0, True
    return out + best_fit(left, length)


def best_fit(left: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the smallest gap that holds it; sequences filled alike are handled together."""
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    there = np.zeros(length + 1, bool)

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            by_gap.setdefault(gap, []).append((pattern, times))
            there[gap] = True

    for n in range(length, 0, -1):
        more = int(left[n])
        while more:
            gaps = np.flatnonzero(there[n:])
            if not len(gaps):
                full, rest = divmod(more, length // n)
                put(length - n * (length // n), (n,) * (length // n), full)
                if rest:
                    put(length - n * rest, (n,) * rest, 1)
                break
            gap = n + int(gaps[0])
            pattern, times = by_gap[gap].pop()
            there[gap] = bool(by_gap[gap])
            used = min(times, more)
            put(gap, pattern, times - used)
            put(gap - n, (*pattern, n), used)
            more -= used
    return [x for own in by_gap.values() for x in own]


def seats(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """length, first rank, last rank, first sequence and offset of each seat of each pattern."""
    out, ranks, first = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            at = ranks.get(n, 0)
            out.append((n, at, at + times - 1, first, offset))
            ranks[n] = at + times
            offset += n
        first += times
    return out


def _seated(ranked: DataFrame, found: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """PACKED from PIECES and rank: the seat whose interval of ranks holds a piece's."""
    n, first, _, sequence, offset = np.array(sorted(found), np.int64).reshape(-1, 5).T
    seat = (n << _RANK_BITS) | first
    names = [x.split()[0] for x in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(seat, (batch.column(3).to_numpy() << _RANK_BITS) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names)

    return ranked.select(*names[:5], "rank").mapInArrow(worker(run), PACKED)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row for each piece: PIECES, sequence_id and offset."""
    rows = written(pieces(docs, path or tokens.default_path(), length).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(length + 1, np.int64)
    for n, count in rows.groupBy("length").count().collect():  # as many rows as there are lengths
        histogram[n] = count
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(rank_buckets(int(histogram.sum())))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("bucket", "length").count().select("bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("row")) - 1
    ranked = rows.withColumn("rank", rank).join(offsets, ["bucket", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return _seated(ranked, seats(plan(histogram, length)))
