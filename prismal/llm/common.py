"""What the text operators share: table access, the shared folder, null rules."""

from __future__ import annotations

import atexit
import ctypes
import functools
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_LEAVING: set[str] = set()

#: Rows of texts that a worker gets at a time.
BATCH, _BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: A word separator in the contracts: space and \t \n \v \f \r.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits of a text that isn't null: two texts of 10^12 share a key with a chance of 10^-15."""
    return F.unhex(F.md5(text))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only in local mode without the setting."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="prismal-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = f"file://{own}"
    return _OWN[app]


def _folder(spark: SparkSession) -> str:
    """The folder of this application's tables, which goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/prismal-{spark.sparkContext.applicationId}"
    if folder not in _LEAVING:
        system, path = _path(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _LEAVING.add(folder)
    return folder


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def clean(spark: SparkSession) -> None:
    """Deletes the tables that this application's operators wrote; their results can't be read any more."""
    system, path = _path(spark, _folder(spark))
    system.delete(path, True)
    _LEAVING.clear()


def written(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so lost executors cost no recomputation.

    instead: a written table that this one takes the place of; nothing may read it any more, and it is deleted.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if instead is not None:
        system, old = _path(spark, instead.written_to)
        system.delete(old, True)
    return out


def buckets(rows: int, per_bucket: int) -> int:
    """How many buckets hold about per_bucket rows each."""
    return max(1, -(-rows // per_bucket))


def rank_buckets(rows: int) -> int:
    """Buckets for ranks in two levels: as many as a bucket has rows, so that neither level outgrows the root of the rows."""
    return max(1, math.isqrt(rows))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of those with the same id and text, which no id tells apart; nothing is shuffled but ids if there are none."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return docs
    key = fresh(docs, "text_key")
    return docs.withColumn(key, text_key(text_of())).dropDuplicates(["doc_id", key]).drop(key)


def worker(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for workers that keeps to an executor's memory.

    Texts come in batches of at most BATCH rows, which is set for the session if it has more, and freed memory goes back to
    the system at a task's end, as workers live on.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH:
        spark.conf.set(_BATCH_SETTING, BATCH)

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)

    return inner
