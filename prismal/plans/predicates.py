"""Attributes and parameters of predicates, by Spark's own parser."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import SparkSession

from ..model import ModelError

_PART = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|\$(\d+)", re.S)


def parameters(text: str) -> list[int]:
    """Numbers of the $n in a predicate, outside of strings."""
    return sorted({int(m[1]) for m in _PART.finditer(text) if m[1]})


def bind(text: str, values: dict[int, Any] | list | tuple | None) -> str:
    """The predicate with each $n replaced by a literal."""
    if values is not None and not isinstance(values, dict):
        values = dict(enumerate(values, 1))

    def literal(m: re.Match) -> str:
        if not m[1]:
            return m[0]
        if values is None or int(m[1]) not in values:
            raise ModelError(f"${m[1]} has no value")
        v = values[int(m[1])]
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, int | float):
            return repr(v)
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    return _PART.sub(literal, text)


def unbound(text: str) -> str:
    """The predicate with each $n as NULL, for parsing and for cost estimates."""
    return _PART.sub(lambda m: "NULL" if m[1] else m[0], text)


def mentions(text: str, name: str) -> bool:
    """Whether a predicate names an attribute as a whole word, outside of strings."""
    return name in re.findall(r"[A-Za-z_]\w*", _PART.sub(" ", text))


def attributes(spark: SparkSession, text: str) -> list[str]:
    """Names that a predicate refers to, in order of appearance."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(unbound(text))
    except Exception as e:
        raise ModelError(f"not a predicate: {text}: {str(e).splitlines()[0]}") from e
    out: dict[str, None] = {}

    def walk(x: Any) -> None:
        if x.getClass().getSimpleName() == "UnresolvedAttribute":
            out[x.name().strip("`")] = None
        children = x.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(tree)
    return list(out)
