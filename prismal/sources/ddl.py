"""Domains from CREATE TABLE statements or DataFrame schemas, and renamed copies of their tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Attribute, Domain

_CREATE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?(?:[\w\"]+\.)*\"?(\w+)\"?\s*\(", re.I)
_COLUMN = re.compile(r"^\"?(\w+)\"?\s+([A-Za-z]\w*(?:\s+(?:precision|varying))?)\s*(?:\((\d+)[^)]*\))?", re.I)
# What is not a column at the start of a definition.
_CLAUSES = frozenset("constraint primary foreign unique check exclude like".split())


def tables(text: str) -> dict[str, list[tuple[str, str, int | None]]]:
    """Name, type and size of the columns of each CREATE TABLE."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    out = {}
    for m in _CREATE.finditer(text):
        depth, at, start, parts = 1, m.end(), m.end(), []
        while at < len(text) and depth:
            c = text[at]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or not depth:
                parts.append(text[start:at].strip())
                start = at + 1
            at += 1
        found = [_COLUMN.match(p) for p in parts if p.split(None, 1)[:1] and p.split(None, 1)[0].lower() not in _CLAUSES]
        out[m[1]] = [(x[1], x[2], int(x[3]) if x[3] else None) for x in found if x]
    return out


def scaffold(given: str | dict[str, T.StructType], identifiers: dict[str, str] | None = None, name: str = "domain") -> Domain:
    """A class for each table, its attributes named table_column. identifiers: the identifying column by table, else the first."""
    kinds = {"string": "String", "int": "Integer", "bigint": "BIGINT", "double": "FLOAT", "timestamp_ntz": "Timestamp", "timestamp": "Timestamp"}
    known = tables(given) if isinstance(given, str) else {t: [(f.name, kinds.get(f.dataType.simpleString(), f.dataType.simpleString()), None) for f in s] for t, s in given.items()}
    out = Domain(name)
    for t, columns in known.items():
        key = (identifiers or {}).get(t, columns[0][0] if columns else None)
        out.add_class(t, *[Attribute(f"{t}_{c}", kind, size, None, c == key) for c, kind, size in columns])
    return out


def renamed(df: DataFrame, table: str, rename: dict[str, str] | None = None) -> DataFrame:
    """The table's rows under the names of the scaffold; rename: other names for some of these."""
    rename = rename or {}
    return df.select(*[F.col(f"`{c}`").alias(rename.get(f"{table}_{c}", f"{table}_{c}")) for c in df.columns])
