"""Tiles that arrive as a file stream: blended partial sums are merged batch by batch (2.Q).

Overlap-add partials are sums, so batches add up in any order; winner-take-all keeps the maximum of (confidence, -tile).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partials(parts: DataFrame) -> DataFrame:
    """(r, c, tile_no, p, w, cls, conf) -> mergeable r, c, pw, w, best."""
    return parts.groupBy("r", "c").agg(F.sum(F.col("p") * F.col("w")).alias("pw"), F.sum("w").alias("w"), F.max(F.struct("conf", (-F.col("tile_no")).alias("t"), "cls")).alias("best"))


def finished(states: DataFrame) -> DataFrame:
    g = states.groupBy("r", "c").agg(F.sum("pw").alias("pw"), F.sum("w").alias("w"), F.max("best").alias("best"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pw") / F.when(F.col("w") == 0, 1.0).otherwise(F.col("w"))))
    return g.select("r", "c", p.alias("p"), F.when(F.col("best.conf") > 0, F.col("best.cls")).otherwise(0).alias("cls"))


def start(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str):
    """Reads scored tiles as they land in ``source``; each micro-batch writes its partials under its own number, so a batch
    that is run again after a failure replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        partials(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def result(spark: SparkSession, store: str) -> DataFrame:
    return finished(spark.read.parquet(store).drop("batch"))
