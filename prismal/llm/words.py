"""Words as 64-bit codes, for operators that compare word sequences in workers."""

from __future__ import annotations

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_key, text_of

#: What a cache of codes holds at most; it starts anew beyond.
CACHE = 200_000
#: Blanks of str.split that separate no words here.
_ODD = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_ASCII = "\x1c\x1d\x1e\x1f"
_BLANKS = regex.compile(r"[\x20\x09-\x0D]+")


def split(text: str) -> list[str]:
    r"""The words [^\x20\x09-\x0D]+ of a text."""
    odd = any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text)
    return [w for w in _BLANKS.split(text) if w] if odd else text.split()


class Codes(dict):
    """Code of each word, made when first asked for."""

    def __init__(self, code=None):
        super().__init__()
        self.code = code or (lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = self.code(word)
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Bits of the filters below: a fixed size, whatever the data; a full one lets all pass, which is slower and as right.
FILTER_BITS = 24


def bitmap(values: DataFrame, column: str) -> DataFrame:
    """A one-hash Bloom filter of a long column, as at most 2^18 rows of (word, bits)."""
    at = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    return values.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def bitmap_array(values: DataFrame, column: str) -> np.ndarray:
    """The same filter as bytes of 0 and 1 for workers, 2^FILTER_BITS of them packed into bits."""
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for word, bits in bitmap(values, column).collect():  # at most 2^18 rows
        out[word] = bits
    return out


def passes(filter_words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of some 64-bit values the filter lets pass."""
    low = values & np.uint64((1 << FILTER_BITS) - 1)
    return (filter_words.view(np.uint64)[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def probably_in(df: DataFrame, column: Column, values: DataFrame, name: str, flag: str) -> DataFrame:
    """df with a flag column: whether the filter of values[name] lets column pass. The filter is broadcast, its size is fixed."""
    word, bit, at = (fresh(df, x) for x in ("filter_word", "filter_bits", "filter_at"))
    bits = bitmap(values, name).withColumnsRenamed({"word": word, "bits": bit})
    low = column.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    joined = df.withColumn(at, low).join(F.broadcast(bits), F.shiftright(at, 6) == F.col(word), "left")
    hit = F.expr(f"(shiftrightunsigned(coalesce({bit}, 0L), cast({at} & 63 as int)) & 1) = 1")
    return joined.withColumn(flag, hit).drop(at, word, bit)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text key (null as empty) are a gone_id and gone_key; columns unchanged.

    Rows that the filter of the keys rules out stay where they are; only the others are shuffled and joined.
    """
    key, hit, short, g_id, g_key = (fresh(docs, x) for x in ("text_key", "text_hit", "short_key", "gone_id", "gone_key"))
    gone = gone.select(F.col("gone_id").alias(g_id), F.col("gone_key").alias(g_key))
    marked = docs.withColumn(key, text_key(text_of()))
    marked = probably_in(marked, F.xxhash64(key), gone.select(F.xxhash64(g_key).alias(short)), short, hit)
    sure = marked.where(~F.col(hit))
    rest = marked.where(F.col(hit))
    rest = rest.join(gone, rest["doc_id"].eqNullSafe(gone[g_id]) & (F.col(key) == F.col(g_key)), "left_anti")
    return sure.unionByName(rest).drop(key, hit)
