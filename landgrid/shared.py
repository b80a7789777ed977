"""Shared-folder materialisation: cuts a plan's lineage without tying it to one executor's disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where the master is local may it be unset: a local folder is set then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="landgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder; ``clean`` removes what was written there."""
    _MADE.append(f"{shared_dir(spark)}/landgrid/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again, so a lost executor loses nothing."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> int:
    """Removes what this process has written to the shared folder so far; results that were not saved elsewhere go with it."""
    n = len(_MADE)
    while _MADE:
        remove(spark, _MADE.pop())
    return n
