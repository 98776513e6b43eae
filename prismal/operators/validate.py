"""Keys of the tables' data: rows that break them, as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import Path, TableMap, sets_of, table_map
from .catalog import Catalog


def _col(path: Path) -> Column:
    out = F.col(path[0].name)
    for h in path[1:]:
        out = out.getField(h.name)
    return out


def primary_key(catalog: Catalog, table: str) -> list[str]:
    """Columns of a table's anchor: identities of its classes and ends of its associations."""
    return [p[-1].name for p in key_paths(catalog, table)]


def key_paths(catalog: Catalog, table: str) -> list[Path]:
    d, m = catalog.design.domain, table_map(catalog.design, table)
    out: dict[Path, None] = {}
    for s in m.structs():
        for a in s.anchor:
            found = [m.end_path(e.name) for e in d.associations[a].ends] if a in d.associations else [m.class_path(a)]
            out |= {p: None for p in found if p and not sets_of(p)}
    return list(out)


def key_violations(catalog: Catalog, table: str, key: list[str] | None = None) -> DataFrame:
    """Key values that are null or stand in several rows, with how many; key: columns to test instead of the declared ones."""
    df = catalog.table(table)
    cols = [F.col(k) for k in key] if key else [_col(p).alias(p[-1].name) for p in key_paths(catalog, table)]
    names = key or primary_key(catalog, table)
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in names])
    return df.select(*cols).groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | missing)


def foreign_keys(catalog: Catalog) -> list[tuple[str, str, str, str]]:
    """table, column (a path with dots, into sets as well), referenced table, referenced column of each identity that another table is anchored on."""
    d, design = catalog.design.domain, catalog.design
    maps = [table_map(design, t) for t in design.tables()]
    home: dict[str, tuple[str, str]] = {}
    for m in maps:
        for s in m.structs():
            if len(s.anchor) == 1 and s.anchor[0] in d.classes and len(m.class_path(s.anchor[0]) or ()) == 1:
                home.setdefault(s.anchor[0], (m.name, d.identifier(s.anchor[0])))
    out: dict[tuple[str, str, str, str], None] = {}
    for m in maps:
        held = [(d.end(e).cls, p) for e, p in m.loose.items()]
        held += list(m.classes.items())
        for cls, path in held:
            column = ".".join(h.name for h in path)
            for c in d.line(cls):
                if c in home and home[c][0] != m.name:
                    out[m.name, column, *home[c]] = None
                    break
    return list(out)


def _values(df: DataFrame, column: str) -> DataFrame:
    """The values at a path, a row for each element of the sets on the way."""
    df = df.select(F.struct("*").alias("value"))
    for name in column.split("."):
        df = df.select(F.col("value").getField(name).alias("value"))
        if isinstance(df.schema["value"].dataType, T.ArrayType):
            df = df.select(F.explode("value").alias("value"))
    return df


def reference_violations(catalog: Catalog, table: str, column: str, parent: str, parent_column: str) -> DataFrame:
    """Distinct values of a column that are not in the referenced one."""
    values = _values(catalog.table(table), column).where("value is not null").distinct()
    keys = catalog.table(parent).select(F.col(parent_column).alias("key"))
    return values.join(keys, F.col("value") == F.col("key"), "left_anti").select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.col("value").cast("string").alias("value"))


def all_reference_violations(catalog: Catalog) -> DataFrame:
    found = [reference_violations(catalog, *k) for k in foreign_keys(catalog)]
    empty = catalog.spark.createDataFrame([], "table string, column string, value string")
    return reduce(DataFrame.unionByName, found, empty)


__all__ = ["TableMap", "all_reference_violations", "foreign_keys", "key_violations", "primary_key", "reference_violations"]
