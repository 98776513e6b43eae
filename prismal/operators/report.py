"""Workloads run query by query: rows or counts, estimated costs, measured times, and their weighted means."""

from __future__ import annotations

import csv
import statistics
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Row

from ..model import ModelError, QuerySpec
from ..plans import predicates
from . import cost
from .catalog import Catalog
from .query import build, costs, query, rewritings


@dataclass
class Line:
    order: int
    group_id: int | None
    weight: float
    tables: list[str]
    cost: float | None = None
    seconds: float | None = None
    count: int | None = None
    rows: list[Row] | None = None


def run(catalog: Catalog, specs: Iterable[QuerySpec | dict], with_costs: bool = False, with_times: bool = False, with_counts: bool = False, with_rows: int = 0, repeat: int = 1, values: Any = None) -> list[Line]:
    """A line for each query. With costs the cheapest rewriting is taken, else the first; times are medians over repeat runs."""
    out = []
    for i, given in enumerate(specs, 1):
        spec = QuerySpec.of(given)
        line = Line(i, spec.group_id, spec.frequency, [])
        if with_costs:
            line.tables, line.cost = min(costs(catalog, spec), key=lambda x: x[1])
        if with_times or with_counts or with_rows:
            if spec.filter and predicates.parameters(spec.filter) and values is None:
                raise ModelError("a query with parameters has a cost, but no rows or time without values")
            df = query(catalog, spec, "cost" if with_costs else "fewest", values=values)
            line.tables = line.tables or rewritings(catalog, spec)[0].names
            line.seconds = statistics.median(cost.seconds(df) for _ in range(repeat)) if with_times else None
            line.count = df.count() if with_counts else None
            line.rows = df.take(with_rows) if with_rows else None
        out.append(line)
    return out


def mean_cost(lines: list[Line]) -> float:
    return cost.weighted_mean((x.cost, x.weight) for x in lines if x.cost is not None)


def mean_seconds(lines: list[Line]) -> float:
    return cost.weighted_mean((x.seconds, x.weight) for x in lines if x.seconds is not None)


def write_csv(lines: list[Line], path: str | Path) -> None:
    timed = any(x.seconds is not None for x in lines)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=";")
        w.writerow(["Order", "Group ID", "Weight", "Cost", *(["Time"] if timed else [])])
        for x in lines:
            w.writerow([x.order, x.group_id, x.weight, x.cost, *([x.seconds] if timed else [])])


__all__ = ["Line", "build", "mean_cost", "mean_seconds", "run", "write_csv"]
