"""Scores of texts by a log-bilinear neural language model.

Tokens are words with A-Z in lower case, and an end token. All training tokens are counted. The model predicts the class of
a token from the classes of the two before it: the most frequent words and the end are classes of their own, the others
fall into classes by their last letters. A context vector, the sum of the vectors of the two classes each scaled by the
weights of its position, meets the output vectors of the classes in a product. Training is noise-contrastive, so that no
normalisation is needed: the class triples of the training texts are told from noise of the class frequencies. Every step
goes over all triples by their counts, with the noise in expectation; nothing is drawn.

Within its class, a word with a count of at least a quarter of the root of all training tokens has vectors of its own, for
what it predicts and for being predicted, so that the vocabulary that is modelled grows with the corpus; one more output
vector stands for the other words of the class. These vectors learn from all tokens of all training texts, told from noise
of the words of the class in expectation: each task goes over its texts from the same start, and what the vectors change by
is averaged over tasks, each number by the squares of its steps. Only that start comes from draws, as many as DRAWS times
that root, which the driver reads batch by batch, from the vectors of the class and from the word's share of it; the pass
over all tokens learns without it as well.

For scoring, one batched matrix product gives all contexts' scores of the classes and one a class those of its words, and
softmaxes normalise them; a word without vectors has its share of the other words of its class, in which one share stands for all
unknown words.

Counts that every worker needs are those of head words, which have at least a 2^-HEAD_BITS share of all training tokens, so
that there are at most 2^HEAD_BITS of them, those with vectors included. All other words go to their counts in a join: a
row for each word and batch, with the documents that have it.

Cases: a null text is empty and has the end token alone; rows with a null id are training rows (their remainder is null); repeated rows
are scored each by itself; without training rows every count is 0 and the model is uniform over classes; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker, written

END = b"\n"
FOLDS, HELD = 7, 2
#: Words that are classes of their own besides the end, classes by last letters, and how many bytes those are.
WORDS, ENDINGS, LAST = 63, 128, 2
CLASSES = WORDS + 1 + ENDINGS
BEGIN = CLASSES
#: Head words have this share of the training tokens at least; words that a worker keeps numbered; texts that it takes at a time.
HEAD_BITS, CACHE, PIECE = 20, 150_000, 500
#: Size of vectors, noise for each triple, steps, rate.
DIM, NOISE, STEPS, RATE = 24, 64, 200, 0.03
#: The same for words in their class: a word with vectors occurs 1/PARTS of the root of all training tokens at least; the draws of the start are so many roots.
PARTS, DRAWS, OWN_NOISE, OWN_BATCH, OWN_RATE = 4, 500, 8, 1024, 0.1
#: Tokens of a step of a class in the pass over all training tokens; numbers of a block of these vectors, merged in a group; what is learnt there.
LESSON, BLOCK = 1024, 1536
LEARNT = ("input", "output", "bias")
SEED = 7


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))


def tokens(text: str) -> list[bytes]:
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def ending(word: bytes) -> int:
    return WORDS + 1 + zlib.crc32(word[-LAST:]) % ENDINGS


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("key"), held_out().alias("held_out"), text_of().alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """word, c of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
                if len(found) > 2 * CACHE:
                    yield out()
                    found = Counter()
        yield out()

    return rows.where("not held_out").select("text").mapInArrow(worker(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """Head words with their counts, words that are classes, and the words that have vectors, in slots.

    slots: of the head words, -1 where a word has none. Slots are in order of the classes by last letters; those of one class
    go from its start to the next, and the last of them stands for its other words. weights: counts of slots, one more for each
    word and for unknown ones.
    """

    head: list[bytes]
    counts: np.ndarray
    own: dict[bytes, int]
    slots: np.ndarray
    starts: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(head: list[bytes], counts: np.ndarray, own: dict[bytes, int], sums: np.ndarray, least: int) -> Lexicon:
        """sums: tokens and words of each class by last letters."""
        kind = np.array([-1 if w in own else ending(w) - WORDS - 1 for w in head], np.int64)
        some = np.flatnonzero((kind >= 0) & (counts >= least))
        some = some[np.argsort(kind[some], kind="stable")]
        sizes = np.bincount(kind[some], minlength=ENDINGS)
        starts = np.r_[0, np.cumsum(sizes + 1)]
        slots, weights = np.full(len(head), -1, np.int64), np.zeros(starts[-1])
        slots[some] = np.arange(len(some)) + kind[some]  # one slot of others before, for each class before
        weights[slots[some]] = counts[some] + 1
        weights[starts[1:] - 1] = sums.sum(1) + 1 - np.bincount(kind[some], counts[some] + 1.0, ENDINGS)
        return Lexicon(head, counts, own, slots, starts, weights)

    def wide(self) -> np.ndarray:
        """Whether a class has words with vectors, by number of the class."""
        return np.r_[np.zeros(WORDS + 1, bool), np.diff(self.starts) > 1]


class Classes(dict):
    """A number for each word seen: head words have the first ones; others are numbered as they come. classes, slots: by number."""

    def __init__(self, known: Lexicon):
        super().__init__({w: i for i, w in enumerate(known.head)})
        self.own, self.head, self.rest = known.own, len(known.head), []
        self.head_classes = np.array([self.own.get(w, -1) if w in self.own else ending(w) for w in known.head], np.int64)
        self.others = np.r_[np.full(WORDS + 1, -1), known.starts[1:] - 1]
        self.head_slots = np.where(known.slots >= 0, known.slots, self.others[self.head_classes])
        self.rest_classes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self.head + len(self.rest)
        self.rest.append(word)
        self.rest_classes.append(self.own[word] if word in self.own else ending(word))
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def classes(self) -> np.ndarray:
        return np.concatenate([self.head_classes, np.array(self.rest_classes, np.int64)])

    def slots(self) -> np.ndarray:
        return np.concatenate([self.head_slots, self.others[np.array(self.rest_classes, np.int64)]])

    def trim(self) -> None:
        if len(self.rest) > CACHE:
            for w in self.rest:
                del self[w]
            self.rest, self.rest_classes = [], []


def before(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is one and two before each token of texts that end at ends, BEGIN where nothing is."""
    one, two = np.r_[BEGIN, ids[:-1]], np.r_[BEGIN, BEGIN, ids[:-2]][: len(ids)]
    starts = np.r_[0, ends[:-1]]
    one[starts] = two[starts] = BEGIN
    second = starts + 1
    two[second[second < ends]] = BEGIN
    return one, two


def contexts(classes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of the context, of the two classes before, of each token of texts that end at ends."""
    one, two = before(classes, ends)
    return two * (CLASSES + 1) + one


def inputs(classes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Rows of the words' own input vectors: those of classes, then those of slots."""
    return np.where(slots >= 0, CLASSES + 1 + slots, classes)


def triples(rows: DataFrame, known: Lexicon, rate: float) -> DataFrame:
    """From the training texts: triple, n, how often each class follows each context; and draws, rows of what is two before,
    one before and in the slot, of rate draws a token, for words of classes that have words with vectors."""
    size = (CLASSES + 1) ** 2 * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, wide = Classes(known), known.wide()
        total = np.zeros(size, np.int64)
        drawn: list[np.ndarray] = []

        def out(mixed: np.random.Generator) -> pa.RecordBatch:
            found = np.concatenate(drawn) if drawn else np.zeros((0, 3), np.int32)
            found = found[mixed.permutation(len(found))]
            drawn.clear()
            packed = pa.array([found[i : i + OWN_BATCH].tobytes() for i in range(0, len(found), OWN_BATCH)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.nulls(len(packed), pa.int64()), pa.nulls(len(packed), pa.int64()), packed], names=["triple", "n", "draws"])

        rng = np.random.default_rng(SEED)
        for batch in batches:
            for part in range(0, batch.num_rows, PIECE):
                texts = batch.column(0).slice(part, PIECE).to_pylist()
                rng = np.random.default_rng([SEED, zlib.crc32(texts[0].encode("utf-8", "surrogatepass")), len(texts)])  # the same in another try
                ids = [numbers.of(tokens(t)) for t in texts]
                flat, ends = np.concatenate(ids), np.cumsum([len(x) for x in ids])
                classes, slots = numbers.classes()[flat], numbers.slots()[flat]
                numbers.trim()
                np.add.at(total, contexts(classes, ends) * CLASSES + classes, 1)
                at = rng.integers(0, len(flat), rng.poisson(rate * len(flat)))
                at = at[wide[classes[at]]]
                one, two = before(inputs(classes, slots), ends)
                drawn.append(np.stack([two[at], one[at], slots[at]], 1).astype(np.int32))
                if sum(map(len, drawn)) > 64 * OWN_BATCH:
                    yield out(rng)
        yield out(rng)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.nulls(len(some), pa.binary())], names=["triple", "n", "draws"])

    return rows.where("not held_out").select("text").mapInArrow(worker(run), "triple long, n long, draws binary")


def triple_counts(found: DataFrame) -> np.ndarray:
    """How often each class follows each context: (CLASSES + 1)^2 by CLASSES numbers whatever the data."""
    sums = found.where("triple is not null").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((CLASSES + 1) ** 2 * CLASSES, np.int64)
    out[sums["triple"].to_numpy()] = sums["n"].to_numpy()
    return out


def draws(found: DataFrame) -> Iterator[np.ndarray]:
    """The packed draws in an order of their own; a partition of them is on the driver at a time."""
    packed = found.where("draws is not null").select("draws").orderBy(F.xxhash64("draws"))
    for row in packed.toLocalIterator(prefetchPartitions=False):
        yield np.frombuffer(row[0], np.int32).reshape(-1, 3)


def train(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The model's parameters by noise-contrastive estimation: each step goes over all triples by their counts, and noise is its expectation."""
    rng = np.random.default_rng(SEED)
    counts = counts.reshape(CLASSES + 1, CLASSES + 1, CLASSES)
    unigram = (counts.sum((0, 1)) + 0.5) / (counts.sum() + 0.5 * CLASSES)
    p = {
        "context": rng.normal(0, 0.3, (CLASSES + 1, DIM)),
        "output": rng.normal(0, 0.3, (CLASSES, DIM)),
        "position": np.ones((2, DIM)),
        "bias": np.log(unigram),
    }
    total = counts.sum(2)
    some = np.flatnonzero(total.any(1))
    if not len(some):
        return p
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    every, noise = float(total.sum()), (NOISE * unigram).astype(np.float32)
    for step in range(STEPS):
        now = {k: v.astype(np.float32) for k, v in p.items()}
        g = {k: np.zeros_like(v) for k, v in p.items()}
        near, shift = now["context"] * now["position"][0], now["bias"] - np.log(noise)
        for i in some:  # what is two before, with all that is one before
            seen = np.flatnonzero(total[i])
            q = near[seen] + now["context"][i] * now["position"][1]
            n = (counts[i, seen] / every).astype(np.float32)
            d = 1 / (1 + np.exp(-np.clip(q @ now["output"].T + shift, -30, 30)))
            d *= n + n.sum(1, keepdims=True) * noise
            d -= n
            dq = d @ now["output"]
            g["output"] += d.T @ q
            g["bias"] += d.sum(0)
            g["context"][seen] += dq * now["position"][0]
            g["context"][i] += dq.sum(0) * now["position"][1]
            g["position"][0] += (dq * now["context"][seen]).sum(0)
            g["position"][1] += dq.sum(0) * now["context"][i]
        rate = RATE * (1 - step / STEPS)
        for k, v in p.items():
            m, s = state[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            v -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-9)
    return p


def log_table(p: dict[str, np.ndarray]) -> np.ndarray:
    """Normalised log10 probability of each class in each context."""
    one, two = p["context"] * p["position"][0], p["context"] * p["position"][1]
    out = np.empty(((CLASSES + 1) ** 2, CLASSES), np.float32)
    for i in range(CLASSES + 1):  # a batch of contexts
        s = (one + two[i]) @ p["output"].T + p["bias"]
        s -= s.max(1, keepdims=True)
        out[i * (CLASSES + 1) : (i + 1) * (CLASSES + 1)] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / math.log(10)
    return out


def _descend(v: np.ndarray, squares: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """A step of the rows of v against their summed gradients, by the squares so far."""
    order = np.argsort(rows.astype(np.min_scalar_type(len(v))), kind="stable")  # 16 bits, if they do, are sorted by radix
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    some, step = rows[first], np.add.reduceat(grad.take(order, 0), first)
    squares[some] += step**2
    v[some] -= OWN_RATE * step / np.sqrt(squares[some] + 1e-8)


def own_vectors(p: dict[str, np.ndarray], known: Lexicon, batches: Iterable[np.ndarray]) -> dict[str, np.ndarray]:
    """The start of the vectors of words, by noise-contrastive estimation on draws; noise is drawn from the words of the class."""
    rng = np.random.default_rng(SEED)
    kind = np.repeat(np.arange(ENDINGS), np.diff(known.starts))
    upto = np.cumsum(known.weights)
    below = np.r_[0.0, upto][known.starts]
    share = np.log(known.weights / np.diff(below)[kind]).astype(np.float32)
    v = {
        "input": np.concatenate([p["context"], p["context"][WORDS + 1 + kind]]).astype(np.float32),
        "output": np.zeros((len(kind), DIM), np.float32),
        "bias": share.copy(),
        "position": p["position"].astype(np.float32),
    }
    squares = {k: np.zeros_like(x) for k, x in v.items()}
    offset = share + np.float32(math.log(OWN_NOISE))
    for drawn in batches:
        two, one, slot = drawn.T
        k = kind[slot]
        q = v["input"][one] * v["position"][0] + v["input"][two] * v["position"][1]
        noise = below[k, None] + rng.random((len(slot), OWN_NOISE)) * (below[k + 1] - below[k])[:, None]
        noise = np.clip(np.searchsorted(upto, noise, side="right"), known.starts[k, None], known.starts[k + 1, None] - 1)
        each = np.concatenate([slot[:, None], noise], 1)
        out = v["output"][each]
        d = 1 / (1 + np.exp(-np.clip((out @ q[:, :, None])[:, :, 0] + v["bias"][each] - offset[each], -30, 30)))
        d[:, 0] -= 1
        dq = (d[:, None, :] @ out)[:, 0]
        _descend(v["output"], squares["output"], each.ravel(), (d[:, :, None] * q[:, None, :]).reshape(-1, DIM))
        _descend(v["bias"], squares["bias"], each.ravel(), d.ravel())
        _descend(v["input"], squares["input"], np.r_[one, two], np.concatenate([dq * v["position"][0], dq * v["position"][1]]))
    return v


def _lesson(v: dict[str, np.ndarray], squares: dict[str, np.ndarray], known: Lexicon, two: np.ndarray, one: np.ndarray, slot: np.ndarray) -> None:
    """Steps of the vectors over all these tokens, class by class; noise is its expectation over the words of the class."""
    kind = np.searchsorted(known.starts, slot, side="right") - 1
    order = np.argsort(kind, kind="stable")
    two, one, slot = two[order], one[order], slot[order]
    bounds = np.searchsorted(kind[order], np.arange(len(known.starts)))
    for k in np.flatnonzero(np.diff(bounds)):
        low, high = known.starts[k], known.starts[k + 1]
        noise = (OWN_NOISE * known.weights[low:high] / known.weights[low:high].sum()).astype(np.float32)
        offset, out, bias = np.log(noise), v["output"][low:high], v["bias"][low:high]
        for part in range(bounds[k], bounds[k + 1], LESSON):
            at = slice(part, min(part + LESSON, bounds[k + 1]))
            q = v["input"].take(one[at], 0) * v["position"][0] + v["input"].take(two[at], 0) * v["position"][1]
            row, col = np.arange(len(q)), slot[at] - low
            d = 1 / (1 + np.exp(-np.clip(q @ out.T + (bias - offset), -30, 30)))
            true = d[row, col] - 1
            d *= noise
            d[row, col] += true
            dq = d @ out
            for name, x, step in (("output", out, d.T @ q), ("bias", bias, d.sum(0))):
                squares[name][low:high] += step**2
                x -= OWN_RATE * step / np.sqrt(squares[name][low:high] + 1e-8)
            _descend(v["input"], squares["input"], np.concatenate([one[at], two[at]]), np.concatenate([dq * v["position"][0], dq * v["position"][1]]))


def _flat(v: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v[k].ravel() for k in LEARNT])


def lessons(rows: DataFrame, known: Lexicon, v: dict[str, np.ndarray]) -> DataFrame:
    """block, change: how the vectors change by all tokens of the training texts, in blocks of their numbers.

    Each task goes over all its texts from the same vectors; changes of tasks are averaged, each number by the squares of its steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, wide = Classes(known), known.wide()
        mine, squares = {k: x.copy() for k, x in v.items()}, {k: np.zeros_like(v[k]) for k in LEARNT}
        for batch in batches:
            for part in range(0, batch.num_rows, PIECE):
                ids = [numbers.of(tokens(t)) for t in batch.column(0).slice(part, PIECE).to_pylist()]
                flat, ends = np.concatenate(ids), np.cumsum([len(x) for x in ids])
                classes, slots = numbers.classes()[flat], numbers.slots()[flat]
                numbers.trim()
                one, two = before(inputs(classes, slots), ends)
                at = np.flatnonzero(wide[classes])
                _lesson(mine, squares, known, two[at], one[at], slots[at])
        weight, change = _flat(squares), _flat(mine) - _flat(v)
        starts = [i for i in range(0, len(weight), BLOCK) if weight[i : i + BLOCK].any()]
        sums = [np.concatenate([weight[i : i + BLOCK] * change[i : i + BLOCK], weight[i : i + BLOCK]]).tobytes() for i in starts]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK for i in starts], pa.int64()), pa.array([task] * len(starts), pa.int64()), pa.array(sums, pa.binary())], names=["block", "task", "sums"])

    def merge(found: pa.Table) -> pa.Table:
        found = found.sort_by("task")
        weighted, weight = 0.0, 0.0
        for x in found["sums"]:
            a, b = np.frombuffer(x.as_buffer(), np.float32).reshape(2, -1).astype(float)
            weighted, weight = weighted + a, weight + b
        change = np.divide(weighted, weight, out=np.zeros(len(weight)), where=weight > 0).astype(np.float32)
        return pa.table({"block": found["block"].slice(0, 1), "change": pa.array([change.tobytes()], pa.binary())})

    found = rows.where("not held_out").select("text").mapInArrow(worker(run), "block long, task long, sums binary")
    return found.groupBy("block").applyInArrow(merge, "block long, change binary")


def learn(rows: DataFrame, known: Lexicon, v: dict[str, np.ndarray]) -> None:
    """Changes v by all tokens of the training texts; the driver gets no more than the vectors' numbers."""
    if not known.wide().any():
        return
    flat = _flat(v)
    found = lessons(rows, known, v).toArrow()
    for block, change in zip(found["block"].to_pylist(), found["change"].to_pylist(), strict=True):
        flat[block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(change, np.float32)
    ends = np.cumsum([v[k].size for k in LEARNT])
    for k, part in zip(LEARNT, np.split(flat, ends[:-1]), strict=True):
        v[k][:] = part.reshape(v[k].shape)


def log_in_class(v: np.ndarray, starts: np.ndarray, one: np.ndarray, two: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each slot in its class after what is one and two before."""
    kind = np.searchsorted(starts, slot, side="right") - 1
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(len(starts)))
    out = np.zeros(len(slot))
    for k in np.flatnonzero(np.diff(bounds)):
        low, high = starts[k], starts[k + 1]
        step = max(1, (1 << 22) // (high - low))
        for part in range(bounds[k], bounds[k + 1], step):
            rows = order[part : min(part + step, bounds[k + 1])]
            q = v["input"].take(one[rows], 0) * v["position"][0] + v["input"].take(two[rows], 0) * v["position"][1]
            s = q @ v["output"][low:high].T + v["bias"][low:high]
            s -= s.max(1, keepdims=True)
            out[rows] = (s[np.arange(len(rows)), slot[rows] - low] - np.log(np.exp(s).sum(1))) / math.log(10)
    return out


SCORED = "doc_id long, key long, held_out boolean, n_tokens long, n_known long, base double, model double, word binary, docs binary"
_PAIR = np.dtype([("key", "<i8"), ("n", "<i8")])


def _scored(rows: DataFrame, known: Lexicon, params: dict[str, np.ndarray], vectors: dict[str, np.ndarray]) -> DataFrame:
    """A row for each document with its sums over head words; and a row for each other word of a batch with its documents.

    The lexicon and the vectors are in the function that workers get, which Spark broadcasts when it is large.
    """
    head, seen = known.head, known.counts > 0
    log_count = np.log10(known.counts + 1.0)
    share = np.r_[np.zeros(WORDS + 1), np.log10(known.weights[known.starts[1:] - 1])]
    has_own = known.slots >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, wide, table, none = Classes(known), known.wide(), log_table(params), [None]
        for batch in batches:
            for part in range(0, batch.num_rows, PIECE):
                piece = batch.slice(part, PIECE)
                ids = [words.of(tokens(t)) for t in piece.column(3).to_pylist()]
                sizes = np.array([len(x) for x in ids])
                ends, flat = np.cumsum(sizes), np.concatenate(ids)
                starts = ends - sizes
                classes = words.classes()[flat]
                is_head = flat < len(head)
                at = np.minimum(flat, len(head) - 1)
                log_c = np.where(is_head, log_count[at], 0.0)
                slots = words.slots()[flat]
                one, two = before(inputs(classes, slots), ends)
                each = table[contexts(classes, ends), classes] + np.where((classes <= WORDS) | (is_head & has_own[at]), 0.0, log_c - share[classes])
                some = np.flatnonzero(wide[classes])
                each[some] += log_in_class(vectors, known.starts, one[some], two[some], slots[some])
                model = np.add.reduceat(each, starts)
                n = len(ids)
                cols = [piece.column(0), piece.column(1), piece.column(2), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((is_head & seen[at]).astype(np.int64), starts)), pa.array(np.add.reduceat(log_c, starts)), pa.array(model), pa.array(none * n, pa.binary()), pa.array(none * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ")])
                doc = np.repeat(np.arange(n), sizes)
                rest = np.flatnonzero(~is_head)
                pair, count = np.unique(((flat[rest] - len(head)) << 32) | doc[rest], return_counts=True)
                word, doc = pair >> 32, pair & 0xFFFFFFFF
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
                docs = np.empty(len(pair), _PAIR)
                docs["key"], docs["n"] = piece.column(1).to_numpy()[doc], count
                bounds = np.r_[first, len(pair)] * _PAIR.itemsize
                m = len(first)
                packed = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(docs.tobytes())])
                texts = pa.array([words.rest[w] for w in word[first].tolist()], pa.binary())
                empty = [pa.nulls(m, k) for k in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*empty, texts, packed], names=[x.split()[0] for x in SCORED.split(", ")])
                words.trim()

    return rows.mapInArrow(worker(run), SCORED)


def _rest(rows: DataFrame) -> DataFrame:
    """key, log_c, n_known: sums over the words of rows (c, docs) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = np.frombuffer(b"".join(batch.column(1).to_pylist()), _PAIR)
            c = np.repeat(batch.column(0).to_numpy(), np.array([len(x) for x in batch.column(1).to_pylist()], np.int64) // _PAIR.itemsize)
            key, at = np.unique(docs["key"], return_inverse=True)
            log_c, seen = np.bincount(at, docs["n"] * np.log10(c + 1.0), len(key)), np.bincount(at, docs["n"] * (c > 0), len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(log_c), pa.array(seen.astype(np.int64))], names=["key", "log_c", "n_known"])

    found = rows.mapInArrow(worker(run), "key long, log_c double, n_known long")
    return found.groupBy(F.col("key").alias("r_key")).agg(F.sum("log_c").alias("r_log_c"), F.sum("n_known").alias("r_known"))


def op5_lm(docs: DataFrame) -> DataFrame:
    rows = _rows(docs)
    counts = written(word_counts(rows), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(1, -(-n >> HEAD_BITS) if n else 1)
    often = counts.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).toArrow().sort_by([("c", "descending"), ("word", "ascending")])  # at most 2^HEAD_BITS rows and the end
    head, head_counts = often["word"].to_pylist() or [END], often["c"].to_numpy() if len(often) else np.zeros(1, np.int64)
    own = {w: i + 1 for i, w in enumerate([w for w in head[: WORDS + 1] if w != END][:WORDS])} | {END: 0}
    if END not in set(head):
        head, head_counts = [*head, END], np.r_[head_counts, 0]
    last = F.expr(f"substring(word, greatest(length(word) - {LAST - 1}, 1), {LAST})")
    by = counts.where(~F.col("word").isin([bytearray(w) for w in own])).groupBy((F.crc32(last) % ENDINGS).alias("class")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    sums = np.zeros((ENDINGS, 2))
    for r in by.collect():
        sums[r["class"]] = r["c"], r["v"]
    known = Lexicon.of(head, head_counts, own, sums, max(1, math.ceil(math.sqrt(n) / PARTS)))
    seen = written(triples(rows, known, DRAWS / math.sqrt(max(n, 1))), "triples")
    params = train(triple_counts(seen))
    vectors = own_vectors(params, known, draws(seen))
    learn(rows, known, vectors)
    scored = written(_scored(rows, known, params, vectors), "scored")
    words = scored.where("word is not null").select("word", "docs")
    c = words.join(counts.where(F.col("c") < least), "word", "left").select(F.coalesce("c", F.lit(0)).alias("c"), "docs")
    found = scored.where("word is null").join(_rest(c), F.col("key") == F.col("r_key"), "left")
    rest = F.coalesce("r_log_c", F.lit(0.0))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("model") + rest).alias("score"),
    )
