"""Identifiers, labels and report strings (section 2.O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id prefixes of the layers.
PREFIXES = {"buildings": "BLD_", "roads": "RD_", "land_use": "LU_", "parcels": "PRCL_", "pegs": "PEG_"}


def identifier(prefix: str, n: Column, digits: int = 4) -> Column:
    """Zero-padded to ``digits``; longer numbers are written in full."""
    return F.format_string(f"{prefix}%0{digits}d", n.cast("long"))


def numbered(df: DataFrame, prefix: str, order: list[str], digits: int = 4, column: str = "id") -> DataFrame:
    """Ids by position in a total order. Rows are ranged and counted by partition, so no single task numbers them all."""
    from pyspark.sql import Window

    from landgrid.shared import materialise

    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = materialise(df.repartitionByRange(int(parts), *order).withColumn("__part", F.spark_partition_id()), "numbered")
    n = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a partition
    before = n.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    k = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return ranged.join(F.broadcast(before), "__part").withColumn(column, identifier(prefix, k, digits)).drop("__part", "__before")
