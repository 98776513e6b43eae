"""The queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, licenses, lm, minhash, packing, pii, sharding, substring, toxicity
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op3_sharding(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op5_lm(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op6_substring_dedup(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op7_pii(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op8_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10_licenses(table(spark, sf_dir, "documents"))


def base7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7_pii, which plain SQL can give too."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_licenses that plain SQL can give too."""
    return op10_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_sharding, op4_packing, op5_language_model, op6_substring_dedup, op7_pii, op8_decontamination, op9_minhash, op10_licenses)}

QUERIES |= {f.__name__: f for f in (base7_pii, base10_licenses)}

_OP6_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, doc_id, w, unnest(range(len(w) - 49)) AS pos FROM d WHERE len(w) >= 50),
windows AS MATERIALIZED (SELECT r, doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 50], ' ')) AS h FROM places),
early AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
gone AS (SELECT DISTINCT r, pos + i AS pos FROM (SELECT r, pos, unnest(range(50)) AS i FROM windows JOIN early USING (h) WHERE low < doc_id)),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
_BASE7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
         list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
         list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, len(email) AS n_email,
       len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: coalesce(try_cast(p AS BIGINT), 256))) <= 255)) AS n_ip,
       len(list_filter(card, lambda x: len(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(len(x)), lambda i: 
         CASE WHEN i % 2 = 0 THEN CAST(x[len(x) - i] AS INT) ELSE CAST(x[len(x) - i] AS INT) * 2 // 10 + CAST(x[len(x) - i] AS INT) * 2 % 10 END)) % 10 = 0)) AS n_card,
       len(list_filter(phone, lambda x: len(x) BETWEEN 10 AND 15)) AS n_phone
FROM d
"""
_BASE10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (
  SELECT doc_id, w, list_filter(range(len(w)), lambda i: w[i + 1 : i + 4] = ['under', 'the', 'mit', 'license']) AS mit,
         list_filter(range(len(w)), lambda i: w[i + 1 : i + 4] = ['apache', 'license', 'version', '2']) AS apache, list_filter(range(len(w)), lambda i: w[i + 1 : i + 3] = ['cc', 'by', 'nc']) AS cc
  FROM d)
SELECT doc_id, len(w) AS n_words, len(mit) + len(apache) + len(cc) AS n_base, list_min(mit || apache || cc) AS first_word, list_max(mit || apache || cc) AS last_word,
       concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache-2' END, CASE WHEN len(cc) > 0 THEN 'cc-by-nc' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM f
"""

ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op6_substring_dedup": _OP6_SQL, "base7_pii": _BASE7_SQL, "base10_licenses": _BASE10_SQL}
