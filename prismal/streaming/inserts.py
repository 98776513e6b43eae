"""Streams of rows into stored tables, and running counts of a statement stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.workload import reason_of
from ..model import ModelError
from ..operators.catalog import Catalog
from ..plans.paths import table_map


def insert_stream(catalog: Catalog, table: str, rows: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream's rows to a stored table; each batch is its own idempotent folder, so a repeated one replaces itself."""
    if catalog.location is None:
        raise ModelError("the catalog has to be stored")
    schema = table_map(catalog.design, table).schema
    missing = [f.name for f in schema if f.name not in rows.columns]
    if missing:
        raise ModelError(f"the stream lacks {', '.join(missing)}")
    shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{catalog.location}/{table}/batch-{number}")

    return shaped.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def statement_counts(statements: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statements by time window and reason for leaving them out (null: they count), for a stream of (the_time, statement)."""
    reason = F.coalesce(reason_of(F.col("statement")), F.lit("counts"))
    return statements.withWatermark("the_time", late).groupBy(F.window("the_time", window), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
