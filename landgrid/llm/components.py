"""Connected components of a link table, as the rest of the library has them, with this subpackage's column names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from landgrid.operators import components as shared


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) links, any direction and repeats -> (node, component_id): smallest reachable id.

    Self links and null ends are ignored; an empty table gives an empty result.
    """
    return shared.components(links).withColumnRenamed("component", "component_id")
