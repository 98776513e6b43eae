"""A design together with where its tables' rows are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..model import Design, ModelError
from ..plans.paths import table_map


@dataclass
class Catalog:
    spark: SparkSession
    design: Design
    tables: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    location: str | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            if name not in self.design.sets:
                raise ModelError(f"no table {name}")
            return self.spark.createDataFrame([], table_map(self.design, name).schema)
        found = self.tables[name]
        if callable(found) and not isinstance(found, DataFrame):
            self.tables[name] = found = found()
        return found

    @property
    def has_data(self) -> bool:
        return bool(self.tables)
