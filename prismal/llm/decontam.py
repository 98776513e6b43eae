"""Benchmark decontamination by template windows.

Words lose case and edge punctuation; numbers, names (words in capitals or with a capital first) and units after a number
become typed placeholders whose words are kept aside as slots; an amount like 120km counts as two words. A window with names is also taken with the names as plain
words, so that a passage in other case is found. A window of placeholders alone stands in any list or heading: with names it is not
taken, and of numbers and units alone it is taken word by word. Windows of five template tokens of the documents meet those
of the benchmark items in a hash join on the window's hash; before it, a filter of fixed size drops in the workers nearly
all windows that are in no item. Hits are counted by item and diagonal, and neighbouring diagonals are merged. In a list of
names or numbers windows also hit their neighbours, so each window of the item keeps one place only: a literally equal one,
or else that on the diagonal with most hits. An item counts as found if at least 0.8 of its windows stand there, and as many
literally or the slots are consistent (where half of its windows hold a plain word, 0.8 of those are enough): one value of the document for each value of the item, so that a question with other
numbers or names is caught and a mere likeness of form is not.

Cases: a null or empty text has no windows and is clean; an item of fewer than five words is found where all of it
stands word by word, without regard to case, as the mere form of so few words stands anywhere;
a null id or repeated rows are judged each by their text; items with one id or none are an item for each text, and a text that
holds items without an id is contaminated though item_ids can't name them; an empty benchmark leaves all documents clean; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import text_key, text_of, worker, written

K, LEAST, NEIGHBOUR, STRETCH, AGREE = 5, 0.8, 3, 1.5, 0.8
#: An item table with at most so many windows is broadcast; a larger one is joined by shuffling.
BROADCAST_WINDOWS = 200_000
EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
ASCII_EDGE = "".join(c for c in map(chr, range(128)) if not c.isalnum())
NUMBER = regex.compile(r"^\p{N}+(?:[.,:/]\p{N}+)*(?:st|nd|rd|th)?$")
AMOUNT = regex.compile(r"^(\p{N}+(?:[.,]\p{N}+)*)(\p{L}+(?:/\p{L}+)?)$")
# Units of measure and money that follow a number.
UNITS = frozenset(
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes lb lbs pound pounds oz ounce ounces "
    "ml l litre litres liter liters gallon gallons cup cups s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees km/h mph w kw kwh v volt volts hz".split()
)
NUM, NAME, UNIT = 1, 2, 3
#: In the low bits of a word's code: what it may be besides a plain word. A unit is one only if a number stands before it.
#: An amount is a number glued to a unit or another word.
KIND, NAMED_UNIT, GLUED = 7, 4, 5
WINDOWS = "doc_id long, text_key binary, at int, hash long, slots array<string>, length int, bare boolean"


def folded(bare: str) -> str:
    """A word without case: the same of its upper, lower and title form."""
    return bare.lower() if bare.isascii() else bare.upper().casefold()


def bare_of(word: str) -> str:
    """A word without what is neither letter nor number at its ends."""
    return word.strip(ASCII_EDGE) if word.isascii() else EDGE.sub("", word)


def _kind(word: str) -> int:
    """The word's code: 0 for no word at all, or the hash of the bare folded word with its kind in the low bits."""
    if word.isascii():
        bare = word.strip(ASCII_EDGE)
        low = bare.lower()
        digest, cased = xxhash.xxh3_64_intdigest(low), bare != low
    else:
        bare = bare_of(word)
        low = folded(bare)
        digest, cased = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")), True
    if not bare:
        return 0
    found = max(digest & ~KIND, KIND + 1)
    if not bare.isalpha():  # letters alone are neither
        if NUMBER.match(low):
            return found | NUM
        if AMOUNT.match(bare):
            return found | GLUED
    if cased and (bare[0].isupper() or bare[0].istitle()):
        return found | (NAMED_UNIT if low in UNITS else NAME)
    return found | UNIT if low in UNITS else found


def template(text: str, codes: words.Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Codes with names as placeholders, with names as folded words, with all as folded words; words. Placeholders are at most UNIT."""
    own = words.split(text)
    found = codes.of(own)
    glued = (found & np.uint64(KIND)) == GLUED
    if glued.any():
        own = [x for w, g in zip(own, glued.tolist(), strict=True) for x in (AMOUNT.match(bare_of(w)).groups() if g else (w,))]
        found = codes.of(own)
    if (found == 0).any():
        keep = np.flatnonzero(found)
        found, own = found[keep], [own[i] for i in keep]
    kind = found & np.uint64(KIND)
    unit = (kind == UNIT) | (kind == NAMED_UNIT)
    unit[1:] &= kind[:-1] == NUM
    unit[:1] = False
    literal = found - kind
    plain = literal.copy()
    plain[kind == NUM] = NUM
    plain[unit] = UNIT
    return np.where((kind == NAME) | (kind == NAMED_UNIT), np.uint64(NAME), plain), plain, literal, own


def _bare(tokens: np.ndarray) -> np.ndarray:
    """Which windows hold placeholders only."""
    slot = tokens <= UNIT
    if np.count_nonzero(slot) < K:
        return np.zeros(max(0, len(tokens) - K + 1), bool)
    return np.lib.stride_tricks.sliding_window_view(slot, K).all(1)


def _windows(df: DataFrame, seen: np.ndarray | None, short: tuple[int, ...] = ()) -> DataFrame:
    """WINDOWS of each text; with a filter, only those that it lets pass.

    A text shorter than K has one window, all of it, of folded words; with a filter, each text has such windows of the lengths
    in short, of equal ones the first.
    """
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = words.Codes(_kind)
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for i, h, text in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                named, plain, literal, own = template(text, codes)
                hashes, formed, bare = words.grams(plain, K), words.grams(named, K), _bare(plain)
                new = formed != hashes
                if bare.any():
                    hashes[bare] = words.grams(literal, K)[bare]
                for tokens, own_hashes, here in ((plain, hashes, None), (named, formed, new)):
                    if seen is not None:
                        here = words.passes(seen, own_hashes) if here is None else here & words.passes(seen, own_hashes)
                    for at in range(len(own_hashes)) if here is None else np.flatnonzero(here).tolist():
                        alone = bool(bare[at])
                        slots = [j for j in range(at, at + K) if tokens[j] <= UNIT]
                        if len(slots) == K and not alone:
                            continue
                        values = [] if alone else [f"{int(tokens[j])}:{folded(bare_of(own[j]))}" for j in slots]
                        for c, x in zip(cols, (i, h, at, int(own_hashes[at].view(np.int64)), values, K, alone), strict=True):
                            c.append(x)
                for k in short if seen is not None else (len(own),) if 0 < len(own) < K else ():
                    wholes, first = np.unique(words.grams(literal, k), return_index=True)
                    for j in range(len(wholes)) if seen is None else np.flatnonzero(words.passes(seen, wholes)):
                        for c, x in zip(cols, (i, h, int(first[j]), int(wholes[j].view(np.int64)), [], k, False), strict=True):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return df.mapInArrow(worker(run), WINDOWS)


def _rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), text_of().alias("text")).select("doc_id", text_key(F.col("text")).alias("text_key"), "text")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, coverage, first, last (template tokens) of each item found in a text."""
    items = written(_windows(_rows(benchmark, "item_id"), None).dropDuplicates(["doc_id", "text_key", "at", "hash"]), "items").select(F.col("doc_id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("at").alias("place"), "hash", F.col("slots").alias("item_slots"), "length", F.col("bare").alias("item_bare"))
    n_windows = items.count()
    sizes = items.groupBy(F.col("item_id").alias("s_id"), F.col("item_key").alias("s_key")).agg(F.count_distinct("place").alias("windows"), F.count_distinct(F.when(~F.col("item_bare"), F.col("place"))).alias("formed"))
    items = items.join(sizes, F.col("item_id").eqNullSafe(F.col("s_id")) & (F.col("item_key") == F.col("s_key"))).drop("s_id", "s_key")
    seen = words.bitmap_array(items, "hash")
    short = tuple(r[0] for r in items.where(F.col("length") < K).select("length").distinct().collect())  # K - 1 of them at most
    hits = _windows(_rows(docs, "doc_id"), seen, short).drop("length", "bare")
    joined = hits.join(F.broadcast(items) if n_windows <= BROADCAST_WINDOWS else items, "hash")
    pairs = F.transform(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    text = ["doc_id", "text_key", "item_id", "item_key", "windows", "formed", "length"]
    hit = F.struct("place", "item_bare", F.col("item_slots").eqNullSafe(F.col("slots")).alias("literal"), pairs.alias("pairs"))
    votes = joined.groupBy(*text, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set(hit).alias("hits"), F.count_distinct("place").alias("votes"))
    own = Window.partitionBy("doc_id", "text_key", "item_id", "item_key").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > NEIGHBOUR).cast("int"), F.lit(0))
    runs = votes.withColumn("opens", opens).withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # A place of the item stands once in a run: where the window is literally equal, or else on the diagonal with most votes.
    ways = runs.select(*text, "run", "votes", "diagonal", F.explode("hits").alias("hit"))
    chosen = ways.groupBy(*text, "run", F.col("hit.place").alias("place")).agg(F.max(F.struct("hit.literal", "votes", "diagonal", "hit.pairs", "hit.item_bare")).alias("way"))
    at = F.col("way.diagonal") + F.col("place")
    spans = chosen.groupBy(*text, "run").agg(
        F.least(F.count(F.lit(1)), F.count_distinct(at)).alias("hit"),
        F.least(F.count_if(~F.col("way.item_bare")), F.count_distinct(F.when(~F.col("way.item_bare"), at))).alias("hit_formed"),
        F.least(F.count_if("way.literal"), F.count_distinct(F.when(F.col("way.literal"), at))).alias("literal"),
        F.array_distinct(F.flatten(F.collect_set("way.pairs"))).alias("pairs"),
        F.min(at).alias("first"),
        (F.max(at) + F.col("length") - 1).alias("last"),
    )
    values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    consistent = (values >= AGREE * F.size("pairs")) | (F.col("literal") / F.col("windows") >= LEAST)
    near = (F.col("last") - F.col("first") + 1) <= STRETCH * (F.col("windows") + F.col("length") - 1)
    share = F.greatest(F.col("hit") / F.col("windows"), F.when(2 * F.col("formed") >= F.col("windows"), F.col("hit_formed") / F.col("formed")))
    return spans.where((share >= LEAST) & consistent & near).select("doc_id", "text_key", "item_id", share.alias("coverage"), "first", "last")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per contaminated text: c_id, c_key, item_ids, coverage."""
    found = matches(docs, benchmark)
    return found.groupBy(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted, empty if clean), coverage (0 if clean) of every document."""
    found = contaminated(docs, benchmark)
    rows = docs.select("doc_id", text_key(text_of()).alias("text_key"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["c_id"]) & (F.col("text_key") == F.col("c_key")), "left")
    return out.select("doc_id", F.col("c_key").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.expr("cast(array() as array<bigint>)")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; columns unchanged."""
    gone = contaminated(docs, benchmark).select(F.col("c_id").alias("gone_id"), F.col("c_key").alias("gone_key"))
    return words.without(docs, written(gone, "gone"))
