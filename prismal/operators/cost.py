"""Estimated costs and measured times of DataFrames, and of weighted workloads."""

from __future__ import annotations

import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame


def estimate(df: DataFrame) -> float:
    """A unitless cost: Catalyst's estimate of the bytes that scans, joins, aggregations and unnesting put out."""
    total = 0.0

    def walk(plan: Any) -> None:
        nonlocal total
        children = plan.children()
        if children.size() == 0 or any(k in plan.nodeName() for k in ("Join", "Aggregate", "Generate", "Union")):
            total += float(str(plan.stats().sizeInBytes()))
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().optimizedPlan())
    return total


def seconds(df: DataFrame) -> float:
    """Time of running a DataFrame whole, without a sink."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def weighted_mean(pairs: Iterable[tuple[float, float]]) -> float:
    """Mean of (value, weight) pairs; 0 without weight."""
    pairs = list(pairs)
    weight = sum(w for _, w in pairs)
    return sum(v * w for v, w in pairs) / weight if weight else 0.0
