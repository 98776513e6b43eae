"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary of the digests (Spark's mergeable frequent-items sketch, a fixed number of counters per task)
proposes the digests that may be frequent. They are counted exactly, and the confirmed ones, at most HEAVY_MOST rows, are
broadcast: rows of frequent texts are resolved where they are read and never shuffled. All other digests go through an
ordinary shuffle: they are counted with partial sums, and those of several rows are joined back to the rows that a filter of fixed size
lets pass, so that no task holds all rows of a digest that the summary may have missed.

Cases: a null text counts as empty; runs of blanks count as one space, nothing is trimmed; of rows with equal texts the
smallest doc_id stays, null ids come last, and of repeated rows with that id one row stays; no rows give no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, one_of_each, text_key, text_of, written
from .words import probably_in, without

#: Counters of each summary, and the most digests that it may propose.
TRACKED, HEAVY_MOST = 8192, 1024


def normalised(text):
    return F.regexp_replace(text, BLANKS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells repeated rows apart), text_key, digest; written once as the text is read only here."""
    return written(docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), text_key(text_of()).alias("text_key"), F.unhex(F.sha2(normalised(text_of()), 256)).alias("digest")), "digests")


def heavy_hitters(rows: DataFrame, least: int) -> DataFrame:
    """digest, first (struct), group_size of digests with at least so many rows; about HEAVY_MOST of them at most.

    The summary holds 64-bit hashes of digests; the count that confirms them is by digest.
    """
    short = F.xxhash64("digest")
    proposed = rows.select(short.alias("short")).agg(F.expr(f"approx_top_k(short, {HEAVY_MOST}, {TRACKED})").alias("top")).select(F.explode("top.item").alias("short"))
    return rows.withColumn("short", short).join(F.broadcast(proposed), "short").groupBy("digest").agg(*_summary()).where(F.col("group_size") >= least)


def _order():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_key")


def _summary():
    return F.min(_order()).alias("first"), F.count(F.lit(1)).alias("group_size")


def resolved(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, row, text_key, digest of each document, first (the row that stays) and group_size."""
    rows = digests(docs)
    heavy = written(heavy_hitters(rows, least), "heavy")
    there = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    several = written(rest.groupBy("digest").agg(*_summary()).where("group_size > 1"), "several")  # a table, so that a hot digest's join can be split
    rest = probably_in(rest, F.xxhash64("digest"), several.select(F.xxhash64("digest").alias("short")), "short", "hit")
    alone = rest.where("not hit").select("digest", "doc_id", "row", "text_key", _order().alias("first"), F.lit(1).cast("long").alias("group_size"))  # these stay where they are
    rest = rest.where("hit").join(several, "digest", "left").select("digest", "doc_id", "row", "text_key", F.coalesce("first", _order()).alias("first"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    return there.select(*rest.columns).unionByName(rest).unionByName(alone)


def exact_dedup(docs: DataFrame, least: int = 32) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256. least: rows that make a digest a heavy one."""
    return resolved(docs, least).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, least: int = 32) -> DataFrame:
    """docs without the rows that exact_dedup drops; columns unchanged."""
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    gone = written(resolved(docs, least).where(~same).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")), "gone")
    return one_of_each(without(docs, gone))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
