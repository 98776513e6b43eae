"""Toxicity by compression distance between two trained zstandard dictionaries.

A window is one word in lower case, between blanks. One dictionary is trained on windows of toxic texts, one on windows of
ordinary texts; the gain of a window is the length that the ordinary dictionary compresses it to less that of the toxic one.
The ordinary dictionary is trained on the windows that recur in ordinary texts, the toxic one on windows of toxic texts that
the ordinary one leaves most of. Of a few pairs of sizes the one with the least loss on rows that neither its dictionaries
nor its weights saw is taken. A text is judged by its largest gains and by how many windows pass fixed gains; a logistic function with weights
calibrated on labelled rows that no dictionary saw turns that into the score.

Fitted on a bounded sample: at most SAMPLE labelled rows of each class, in the order of a hash of the id. Rows whose
crc32(doc_id) mod 5 is 0 are never learnt from. Texts are scored whole.

Cases: a null text is empty; an empty text gets the score of a text without windows; labels with a null id or class count for nothing, of
repeated labels the larger counts; without labels of both classes every score is the share of toxic labels (0 without any);
no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import text_key, text_of, worker, written

#: Labelled rows of a class that are learnt from at most; of them, one in CALIBRATE is for the weights alone.
SAMPLE, CALIBRATE = 4000, 3
#: A window must recur in this share of a class's texts (in two at least); at most so many windows of a class are used.
RECURS, WINDOWS = {1: 0.012, 0: 0.004}, 50_000
#: Pairs that are tried: bytes of the toxic and of the ordinary dictionary, and the least worth of a toxic window as a share of the best.
PAIRS = ((8192, 65536, 0.05), (8192, 65536, 0.1), (8192, 98304, 0.07), (8192, 131072, 0.1))
#: How often a window is a sample at most.
REPEATS = 50
#: Lower levels don't index all of a dictionary and miss short windows in it.
LEVEL = 12
#: Gains that windows are counted by.
GAINS = (1, 2, 3, 4, 5, 6, 7, 9, 11)
N_FEATURES = len(GAINS) + 3
FOLDS = 5
_EDGES = string.punctuation


class _Spelling(dict):
    def __missing__(self, char: str) -> bytes:
        self[char] = found = xxhash.xxh32_digest(char.encode("utf-8", "surrogatepass"))
        return found


_SPELLED = _Spelling()


def _window(word: str) -> bytes:
    """The word between blanks, each character spelled as four bytes of a fixed code.

    A match costs a compressor several bytes whatever its length, so that a short word in plain letters gains nothing from
    being in a dictionary; spelled out, its length is what counts.
    """
    return b"".join(map(_SPELLED.__getitem__, f" {word.strip(_EDGES)} "))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0


class Distance:
    """The gain of a word: how much better the toxic dictionary compresses it."""

    OFFSET = 1 << 20

    def __init__(self, toxic: bytes, ordinary: bytes):
        self._toxic, self._ordinary = _compressor(toxic), _compressor(ordinary)
        self.gains = words.Codes(lambda w: self.of(_window(w)) + self.OFFSET)

    def of(self, window: bytes) -> int:
        return len(self._ordinary.compress(window)) - len(self._toxic.compress(window))

    def features(self, text: str) -> list[float]:
        own = words.split(text.lower())
        if not own:
            return [0.0] * N_FEATURES
        gain = self.gains.of(own).astype(np.int64) - self.OFFSET
        top = np.sort(gain)[-3:]
        return [float(top[-1]), float(top.sum()) / 3, *(math.log1p(int((gain >= g).sum())) for g in GAINS), math.log1p(len(own))]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(windows: dict[bytes, int], size: int) -> bytes:
    each = [w for w, n in sorted(windows.items()) for _ in range(min(n, REPEATS))]
    np.random.default_rng(0).shuffle(each)
    samples = [b"".join(each[i : i + 8]) for i in range(0, len(each), 8)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary themselves
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: dict[bytes, int], ordinary: dict[bytes, int], texts: dict[int, int], pair: tuple[int, int, float] = PAIRS[0]) -> tuple[bytes, bytes]:
    """The two dictionaries, from windows and the number of texts that each recurs in; texts: how many there are of a class.

    The ordinary one is trained on all recurrent windows of ordinary texts. What it leaves of a window, times how much more
    often toxic texts have it, is what the toxic one could save; that is trained on the windows worth enough of the best of them.
    """
    size, plain_size, share = pair
    plain = _dictionary(ordinary, plain_size)
    left = _compressor(plain).compress
    worth = {w: len(left(w)) * (n / texts[1] - ordinary.get(w, 0) / texts[0]) for w, n in toxic.items()}
    best = max(worth.values())
    return _dictionary({w: n for w, n in toxic.items() if worth[w] >= share * best} if best > 0 else toxic, size), plain


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: two dictionaries, feature scales and weights; or only the share of toxic labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    total = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = total[1] / max(1, total[0] + total[1])
    if not (total[0] and total[1]):
        return {"share": share}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(SAMPLE).unionByName(known.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    sample = sample.select(F.col("doc_id").alias("l_id"), "toxic", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(CALIBRATE)) == 0).alias("calibrate"))
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = written(rows.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("toxic", "calibrate", "text").repartition(16), "labelled")

    def recur(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(c, w, n) for c in (0, 1) for w, n in _recurrences(batch.loc[batch["toxic"] == c, "text"]).items()]
            yield pd.DataFrame(out, columns=["toxic", "window", "n"])

    counts = rows.where("not calibrate").select("toxic", "text").mapInPandas(worker(recur), "toxic int, window binary, n long").groupBy("toxic", "window").agg(F.sum("n").alias("n"))
    texts = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in rows.where("not calibrate").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {}
    for c in (0, 1):
        often = counts.where((F.col("toxic") == c) & (F.col("n") >= max(2, math.ceil(RECURS[c] * texts[c])))).orderBy(F.desc("n"), "window").limit(WINDOWS)
        found[c] = {bytes(r["window"]): r["n"] for r in often.collect()}
    if not (found[0] and found[1]):
        return {"share": share}
    pairs = [train_dictionaries(found[1], found[0], texts, p) for p in PAIRS]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distances = [Distance(*p) for p in pairs]
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "features": [[f for d in distances for f in d.features(x)] for x in batch["text"]]})
            for d in distances:
                d.gains.clear()

    measured = rows.where("calibrate").select("toxic", "text").mapInPandas(worker(measure), "toxic int, features array<double>").toPandas()
    order = measured["features"].map(str).argsort(kind="stable")  # the same folds whatever the order of rows
    y = measured["toxic"].to_numpy(float)[order]
    if len(set(y)) < 2:
        return {"share": share}
    every = np.array(measured["features"].tolist())[order].reshape(len(y), len(PAIRS), N_FEATURES)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # the sample has other shares than the labels
    losses = [_loss(every[:, i], y, weight) for i in range(len(PAIRS))]
    best = int(np.argmin(losses))
    return {"share": share, "toxic": pairs[best][0], "ordinary": pairs[best][1], **_calibrated(every[:, best], y, weight)}


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return {"mean": mean, "scale": scale, "weights": logistic((x - mean) / scale, y, weight)}


def _score(x: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(((x - model["mean"]) / model["scale"]) @ model["weights"][:-1] + model["weights"][-1], -30, 30)))


def _loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int = 3) -> float:
    """Log loss on folds that the weights did not see."""
    out = 0.0
    for k in range(folds):
        off = np.arange(len(y)) % folds == k
        if len(set(y[~off])) < 2:
            return math.inf
        p = np.clip(_score(x[off], _calibrated(x[~off], y[~off], weight[~off])), 1e-6, 1 - 1e-6)
        out -= float((weight[off] * np.where(y[off] == 1, np.log(p), np.log(1 - p))).sum())
    return out


def _recurrences(texts) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for text in texts:
        for w in {_window(x) for x in words.split(text.lower())}:
            out[w] = out.get(w, 0) + 1
    return out


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text_key and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text_of()).alias("text_key"), text_of().alias("text"))
    if "weights" not in model:
        return rows.select("doc_id", "text_key", F.lit(float(model["share"])).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model["toxic"], model["ordinary"])
        for batch in batches:
            x = np.array([distance.features(t) for t in batch.column(2).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_score(x, model))], names=["doc_id", "text_key", "score"])

    return rows.mapInArrow(worker(run), "doc_id long, text_key binary, score double")


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows that score least or more; columns unchanged."""
    gone = scores(docs, fit(docs, labels)).where(F.col("score") >= least).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    return words.without(docs, written(gone, "gone"))
