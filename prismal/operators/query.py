"""Rewritings as lazy DataFrames."""

from __future__ import annotations

import warnings
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ModelError, QuerySpec
from ..plans import predicates
from ..plans.paths import Path
from ..plans.rewrite import Rewriting, Union, alternatives, parse
from . import cost
from .catalog import Catalog


def _name(table: str, path: Path) -> str:
    return "__".join([table, *(h.name for h in path)])


def _column(df: DataFrame, path: Path, unnested: dict[Path, str]) -> Column:
    """The column at a path; an unnested set is a column of its own."""
    start = max((p for p in unnested if path[: len(p)] == p), key=len, default=())
    col = df[unnested[start]] if start else None
    for hop in path[len(start) :]:
        col = df[hop.name] if col is None else col.getField(hop.name)
    return col


def _read(catalog: Catalog, r: Rewriting, table: str, wanted: dict[Path, str]) -> DataFrame:
    """A table with its needed leaves as flat columns; each needed set is unnested once, so that independent sets multiply."""
    df, unnested = catalog.table(table), {}
    sets = r.unnest(table)
    # leaves of structs beside a set are flat before it is unnested: the optimizer loses them under a filter on both
    flat = {p: n for p, n in wanted.items() if len(p) > 1 and not any(p[: len(s)] == s for s in sets)} if sets else {}
    df = df.withColumns({n: _column(df, p, {}) for p, n in flat.items()})
    for s in sets:
        name = _name("unnested", s)
        df = df.select("*", F.explode(_column(df, s, unnested)).alias(name))
        unnested[s] = name
    owner = next(x for x in r.tables if x.name == table)
    for t, text in r.discriminants:
        if t == table:
            used = [a for a in predicates.attributes(catalog.spark, text) if a in owner.attributes]
            df = df.withColumns({a: _column(df, owner.attributes[a], unnested) for a in used}).where(F.expr(text))
    return df.select(*[df[n] if p in flat else _column(df, p, unnested).alias(n) for p, n in wanted.items()])


def build(catalog: Catalog, r: Rewriting | Union, dedupe: bool = True, values: Any = None) -> DataFrame:
    if isinstance(r, Union):
        out = reduce(DataFrame.unionByName, [build(catalog, p, dedupe, values) for p in r.parts])
        return out.distinct() if r.distinct else out
    if r.lossy:
        warnings.warn(f"{r.names} may lack instances: a link to their anchor is optional", stacklevel=2)
    wanted: dict[str, dict[Path, str]] = {t: {} for t in r.names}
    for t, p in [*r.reads.values(), *r.present, *r.distinct_on, *[(x, p) for j in r.joins for pair in j.on for x, p in zip((j.left, j.right), pair, strict=True)]]:
        wanted[t][p] = _name(t, p)
    frames = {}
    for t in r.names:
        df = _read(catalog, r, t, wanted[t])
        for x, p in r.present:
            if x == t:
                df = df.where(F.col(f"`{_name(t, p)}`").isNotNull())
        frames[t] = df
    out = frames[r.names[0]]
    for t in r.names[1:]:
        on = [F.col(f"`{_name(j.left, a)}`") == F.col(f"`{_name(j.right, b)}`") for j in r.joins if j.right == t for a, b in j.on]
        out = out.join(frames[t], reduce(Column.__and__, on), "inner")
    keys = [_name(t, p) for t, p in r.distinct_on] if dedupe else []
    out = out.select(*[F.col(f"`{_name(t, p)}`").alias(n) for n, (t, p) in r.reads.items()], *[F.col(f"`{k}`").alias(f"key__{k}") for k in keys])
    if r.query.filter:
        out = out.where(F.expr(predicates.bind(r.query.filter, values)))
    if keys:
        out = out.dropDuplicates([f"key__{k}" for k in keys])
    return out.select(*r.query.project)


def rewritings(catalog: Catalog, spec: QuerySpec | dict, inherited: bool = True) -> list[Rewriting | Union]:
    return alternatives(catalog.design, parse(catalog.spark, catalog.design.domain, spec, inherited))


def query(catalog: Catalog, spec: QuerySpec | dict, choose: str = "fewest", dedupe: bool = True, values: Any = None, inherited: bool = True) -> DataFrame:
    """The answer of a query as a lazy DataFrame.

    choose: "fewest" takes the first rewriting (no instances lost, then fewest tables), "cost" the one with the least estimate.
    dedupe: answers are the bag that the fully normalised design gives; False leaves the repetitions of wider tables.
    values: what $1, $2 ... in the filter stand for.
    inherited: whether * and Class_* include attributes of superclasses.
    """
    spec = QuerySpec.of(spec)
    if spec.filter and predicates.parameters(spec.filter) and values is None:
        raise ModelError("the filter has parameters: values are needed to run it")
    found = rewritings(catalog, spec, inherited)
    if choose not in ("fewest", "cost"):
        raise ModelError(f"choose by fewest or cost, not {choose}")
    if choose == "cost" and len(found) > 1:
        return min((build(catalog, r, dedupe, values) for r in found if r.lossy == found[0].lossy), key=cost.estimate)
    if len(found) > 1:
        warnings.warn(f"{len(found)} rewritings; the first is taken: {found[0].names}", stacklevel=2)
    return build(catalog, found[0], dedupe, values)


def costs(catalog: Catalog, spec: QuerySpec | dict) -> list[tuple[list[str], float]]:
    """Tables and estimated cost of each rewriting; a filter with parameters reads its attributes and keeps all rows."""
    spec = QuerySpec.of(spec)
    q = parse(catalog.spark, catalog.design.domain, spec)
    if spec.filter and predicates.parameters(spec.filter):
        q = replace(q, filter=None)
    return [(r.names, cost.estimate(build(catalog, r))) for r in alternatives(catalog.design, q)]
