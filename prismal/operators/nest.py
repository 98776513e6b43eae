"""Rows of a table from flat answers: nested structs, and sets grouped under their anchors."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Design, ModelError, QuerySpec, Struct
from ..plans.paths import loose_ends, table_map
from .catalog import Catalog
from .query import query


def _scalars(design: Design, struct: Struct) -> list[str]:
    """Names of the columns of a struct that are in no set, those of nested structs included."""
    d, out = design.domain, []
    for e in struct.parts:
        if d.is_attribute(e):
            out.append(e)
        elif e in d.classes:
            out.append(d.identifier(e))
        elif e in design.structs:
            out += _scalars(design, design.structs[e])
    return list(dict.fromkeys([*out, *loose_ends(design, struct)]))


def _pattern(design: Design, struct: Struct, sets: bool) -> list[str]:
    """Classes and associations of a struct and its nested structs; with its sets if asked for."""
    d, out = design.domain, []
    for e in struct.parts:
        if e in d.classes or e in d.associations:
            out.append(e)
        elif e in design.structs:
            out += _pattern(design, design.structs[e], sets)
        elif sets and e in design.sets:
            out += _set_pattern(design, e)
    return list(dict.fromkeys(out))


def _set_pattern(design: Design, name: str) -> list[str]:
    out: list[str] = []
    for e in design.sets[name].elements:
        out += _pattern(design, design.structs[e], True) if e in design.structs else [e]
    return out


def _keys(design: Design, struct: Struct) -> list[str]:
    d, out = design.domain, []
    for a in struct.anchor:
        if a in d.classes:
            out.append(d.identifier(a))
        else:
            loose = loose_ends(design, struct)
            out += [e.name if e.name in loose else d.identifier(e.cls) for e in d.associations[a].ends]
    return list(dict.fromkeys(out))


def _core_pattern(design: Design, struct: Struct) -> list[str]:
    """The pattern without associations that only lead to sets, as rows without elements stay."""
    d = design.domain
    whole = _pattern(design, struct, False)
    inner = {c for e in struct.parts if e in design.sets for c in _set_pattern(design, e)}
    roots = {d.root(c) for c in whole if c in d.classes} | {d.root(e.cls) for a in struct.anchor if a in d.associations for e in d.associations[a].ends}
    out = []
    for e in whole:
        if e in d.associations and e not in struct.anchor:
            outside = [x for x in d.associations[e].ends if d.root(x.cls) not in roots]
            if outside and all(d.root(x.cls) in {d.root(c) for c in inner if c in d.classes} for x in outside):
                continue
        out.append(e)
    return out


def _struct(design: Design, struct: Struct, taken: set[str]) -> list[Column]:
    d, cols = design.domain, []
    for e in struct.parts:
        name = e if d.is_attribute(e) else d.identifier(e) if e in d.classes else None
        if name and name not in taken:
            taken.add(name)
            cols.append(F.col(name))
        elif e in design.structs:
            cols.append(F.struct(*_struct(design, design.structs[e], set())).alias(e))
    for end in loose_ends(design, struct):
        if end not in taken:
            taken.add(end)
            cols.append(F.col(end))
    return cols


def struct_rows(source: Catalog, design: Design, struct: Struct) -> DataFrame:
    """A row for each instance of a struct's anchor, its sets as sorted arrays, empty if there are no elements."""
    d = design.domain
    scalars, core = _scalars(design, struct), _core_pattern(design, struct)
    base = _ask(source, scalars, core)
    keys = _keys(design, struct)
    cols = _struct(design, struct, set())
    for name in [e for e in struct.parts if e in design.sets]:
        elements, pattern = design.sets[name].elements, list(dict.fromkeys([*struct.anchor, *_set_pattern(design, name), *_links(design, struct, name)]))
        parts = []
        for e in elements:
            inner = design.structs.get(e)
            if inner is None:
                value, wanted = F.struct(F.col(d.identifier(e))), [d.identifier(e)]
                deep = None
            else:
                value, wanted = F.struct(*_struct(design, inner, set())), _scalars(design, inner)
                deep = [x for x in inner.parts if x in design.sets]
            if deep:
                raise ModelError(f"{name}: a set within a nested set")
            flat = _ask(source, list(dict.fromkeys([*keys, *wanted])), pattern)
            parts.append(flat.select(*keys, value.alias("element")))
        grouped = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.array_sort(F.collect_set("element")).alias(name))
        renamed = grouped.withColumnsRenamed({k: f"{name}__{k}" for k in keys})
        on = reduce(Column.__and__, [F.col(k) == F.col(f"{name}__{k}") for k in keys])
        base = base.join(renamed, on, "left").drop(*[f"{name}__{k}" for k in keys])
        kind = next(f.dataType for f in base.schema if f.name == name)
        base = base.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
        cols.append(F.col(name))
    return base.select(*cols)


def _links(design: Design, struct: Struct, name: str) -> list[str]:
    """Associations of the struct, or in the set, that lead from the anchor to the set's classes."""
    d = design.domain
    inside = {d.root(c) for c in _set_pattern(design, name) if c in d.classes}
    return [a for a in struct.parts if a in d.associations and {d.root(e.cls) for e in d.associations[a].ends} & inside]


def _ask(source: Catalog, project: list[str], pattern: list[str]) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return query(source, QuerySpec(tuple(project), tuple(pattern)))


def table_rows(source: Catalog, design: Design, name: str) -> DataFrame:
    """All rows of a table. Structs of subclasses add their own columns to the rows of their superclass by an outer join."""
    d = design.domain
    schema = table_map(design, name).schema
    structs = [design.structs[e] for e in design.sets[name].elements if e in design.structs]
    if not structs:
        cls = design.sets[name].elements[0]
        return _conform(_ask(source, [d.identifier(cls)], [cls]), schema)
    general = [s for s in structs if not _specialises(design, s, structs)]
    rows = [struct_rows(source, design, s) for s in general]
    for s in structs:
        if s in general:
            continue
        keys = _keys(design, s)
        mine = struct_rows(source, design, s)
        for i, g in enumerate(general):
            if _keys(design, g) != keys:
                continue
            extra = [c for c in mine.columns if c not in rows[i].columns]
            right = mine.select(*[F.col(k).alias(f"sub__{k}") for k in keys], *extra)
            on = reduce(Column.__and__, [F.col(k) == F.col(f"sub__{k}") for k in keys])
            rows[i] = rows[i].join(right, on, "left").drop(*[f"sub__{k}" for k in keys])
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_conform(r, schema) for r in rows])
    return out


def _specialises(design: Design, s: Struct, others: list[Struct]) -> bool:
    mine = [a for a in s.anchor if a in design.domain.classes]
    return any(c in o.anchor for a in mine for c in design.domain.supers(a) for o in others if o is not s)


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
