"""Query logs as tables: which entries count, how many there are, and their statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _good(year: int | None, month: int | None, day: int | None) -> Column:
    """Entries without an error that took time and gave rows, of a period."""
    out = (F.col("error") == 0) & (F.col("elapsed") > 0) & (F.col("rows") > 0)
    for part, value in ((F.year, year), (F.month, month), (F.dayofmonth, day)):
        if value is not None:
            out = out & (part("the_time") == value)
    return out


def count(log: DataFrame, year: int | None = None, month: int | None = None, day: int | None = None) -> DataFrame:
    """One row, total_logs."""
    return log.where(_good(year, month, day)).agg(F.count(F.lit(1)).alias("total_logs"))


def statements(log: DataFrame, year: int | None = None, month: int | None = None, day: int | None = None, limit: int | None = None) -> DataFrame:
    """One column, statement, with runs of blanks as one; limit: a top-n of them."""
    out = log.where(_good(year, month, day)).select(F.trim(F.regexp_replace("statement", r"\s+", " ")).alias("statement"))
    return out if limit is None else out.limit(limit)


def read_text(spark: SparkSession, path: str, marker: str = "__EOL__") -> DataFrame:
    """Statements of a text export: a header line, then one by line, with a marker at the end of each."""
    lines = spark.read.text(path)
    clean = F.trim(F.regexp_replace(F.regexp_replace("value", rf"^\s*\"|[\s,\"]*{marker}[\s\"]*$", ""), r"\s+", " "))
    return lines.select(clean.alias("statement")).where(F.length("statement") > 6).where(~F.lower("statement").isin("statement", "statement,__eol__"))
