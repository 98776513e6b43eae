"""Data of one design as data of another of the same domain."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from ..model import Design, ModelError
from .catalog import Catalog
from .nest import table_rows


def migrate(source: Catalog, target: Design) -> Catalog:
    """A catalog of the target design whose tables are lazy queries over the source; store.save() writes them."""
    if source.design.domain != target.domain:
        raise ModelError("both designs have to be of one domain")
    if not source.tables:
        warnings.warn("the source has no data", stacklevel=2)
    if source.design == target:
        warnings.warn("source and target have the same design", stacklevel=2)

    def lazily(name: str):
        return lambda: table_rows(source, target, name)

    tables: dict[str, DataFrame] = {name: lazily(name) for name in target.tables()}
    return Catalog(source.spark, target, tables)
