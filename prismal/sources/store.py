"""Catalogs on disk: a JSON description and a Parquet table for each set.

The tables of a save are in a folder of its own, which the description names. The description is put in place by one
rename, after all tables are written: a save that fails leaves the catalog that was there as it was, and one that supersedes
it drops the old tables at last.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..model import ModelError
from ..operators.catalog import Catalog
from ..plans import checks
from ..plans.paths import table_map
from . import specs

DESCRIPTION = "catalog.json"


def save(catalog: Catalog, location: str, supersede: bool = False) -> Catalog:
    """Writes a consistent catalog and returns it reading from there; an existing one goes only if it is superseded."""
    bad = [v for v in checks.check(catalog.design) if v.severity == checks.ERROR]
    if bad:
        raise ModelError(f"the design is not consistent: {'; '.join(map(str, bad))}")
    spark = catalog.spark
    if exists(spark, location) and not supersede:
        raise ModelError(f"there is a catalog at {location}")
    data = f"data-{uuid.uuid4().hex}"
    for name in catalog.design.tables():
        catalog.table(name).write.parquet(f"{location}/{data}/{name}")
    about = {"domain": specs.domain_json(catalog.design.domain), "design": specs.design_json(catalog.design), "has_data": catalog.has_data, "tables_created": True, "data": data}
    _put(spark, f"{location}/{DESCRIPTION}", json.dumps(about))
    system, root = _path(spark, location)
    for old in system.listStatus(root):
        if old.getPath().getName().startswith("data-") and old.getPath().getName() != data:
            system.delete(old.getPath(), True)
    return load(spark, location)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def _put(spark: SparkSession, name: str, text: str) -> None:
    """Writes a file beside, and renames it to its place, over what is there."""
    system, path = _path(spark, name)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{name}.{uuid.uuid4().hex}")
    out = system.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    over[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(system.getUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(system.makeQualified(beside), system.makeQualified(path), over)


def exists(spark: SparkSession, location: str) -> bool:
    system, path = _path(spark, f"{location}/{DESCRIPTION}")
    return system.exists(path)


def load(spark: SparkSession, location: str, paradigm: str | None = None) -> Catalog:
    if not exists(spark, location):
        raise ModelError(f"there is no catalog at {location}")
    about = json.loads("\n".join(r[0] for r in spark.read.text(f"{location}/{DESCRIPTION}").collect()))
    design = specs.design(about["design"], specs.domain(about["domain"]))
    if paradigm and design.paradigm != paradigm:
        raise ModelError(f"the catalog is {design.paradigm}, not {paradigm}")

    data = f"{location}/{about['data']}"

    def reader(name: str):
        return lambda: spark.read.schema(table_map(design, name).schema).option("recursiveFileLookup", True).parquet(f"{data}/{name}")

    return Catalog(spark, design, {name: reader(name) for name in design.tables()} if about["has_data"] else {}, data)


def register(catalog: Catalog, database: str, buckets: int | None = None) -> None:
    """The tables in Spark's own catalog with statistics for the optimizer; buckets: on the anchor, for joins without a shuffle."""
    from ..operators.validate import primary_key

    spark = catalog.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name in catalog.design.tables():
        writer = catalog.table(name).write.mode("overwrite").format("parquet")
        keys = [k for k in primary_key(catalog, name) if k in catalog.table(name).columns]
        if buckets and keys:
            writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
        writer.saveAsTable(f"`{database}`.`{name}`")
        flat = [f.name for f in catalog.table(name).schema if not f.dataType.simpleString().startswith(("array", "struct"))]
        spark.sql(f"ANALYZE TABLE `{database}`.`{name}` COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(f'`{c}`' for c in flat)}" if flat else ""))
