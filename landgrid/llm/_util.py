"""What the operators of this subpackage share: table access, the shared folder, Arrow mapping."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from landgrid.shared import materialise, remove, scratch  # noqa: F401 (the operators take them from here)

# Fixed character class of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict = {}


def held(key, make):
    """A model kept by a worker process between tasks; loading another one drops it, so a worker holds one at a time."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow where ``make()`` runs once a task and gives a function from a batch to a dict of columns (or several)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back at once
        f = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = f(batch)
            for cols in [out] if isinstance(out, dict) else out:
                arrays = [pa.array(v, type=x.type) if not isinstance(v := cols[x.name], pa.Array) else v if v.type == x.type else v.cast(x.type) for x in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)
