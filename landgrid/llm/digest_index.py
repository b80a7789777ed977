"""Exact dedup over a persistent digest index: bucketed and sorted by hash, probed by a sort-merge anti-join.

The index is a table ``(digest binary, keep_id, n_chars, group_size)`` bucketed by ``digest``. A new batch is grouped by
the digest of its normalised texts (counts and the best row combine map-side, so a digest holding a third of all rows
shuffles one row a task), anti-joined with the index and the rest is appended.

Defined results: null text counts as empty, and empty texts are equal to each other; ties go to the smallest doc_id, to null last;
a row repeated with its doc_id and text is kept once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.llm._util import WHITE, materialise, remove
from landgrid.shared import shared_dir

BUCKETS = 64


def normalised(text: Column) -> Column:
    """The text without every white-space character of the contract; null counts as empty."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars): all that the index needs of a text; texts themselves are never shuffled."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


class DigestIndex:
    """A table in the session's catalog, its files in the shared folder (or ``path``); ``name`` persists between batches.

    Where no name is given the index is for one call; ``drop`` removes table and files.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS, path: str | None = None):
        self.spark, self.name, self.buckets = spark, name or f"digest_index_{uuid.uuid4().hex}", buckets
        self.path = path or f"{shared_dir(spark)}/landgrid/{self.name}"
        if not spark.catalog.tableExists(self.name):
            self._write(spark.createDataFrame([], "digest binary, keep_id long, n_chars long, group_size long"), "error")

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> None:
        """Takes ``digests()`` rows; those whose digest the index already has change nothing: the earlier batch's row stays."""
        best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("k"))).alias("best")
        groups = batch.groupBy("digest").agg(best, F.count("*").alias("group_size"))
        fresh = groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", (-F.col("best.k")).alias("keep_id"), F.col("best.n_chars").alias("n_chars"), "group_size")
        if self.rows().isEmpty():
            self._write(fresh, "append")
        else:  # what is read from the table can't be appended to it in one plan on every file system
            self._write(materialise(fresh, "index-batch"), "append")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; ``index``: what earlier batches left (else a new one)."""
    batch = materialise(digests(docs), "digests")
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    index.append(batch)
    # rows repeated with their doc_id: counted first, so that one of them is kept
    rows = batch.groupBy("digest", "doc_id", "n_chars").agg(F.count("*").alias("c"))
    rows = rows.join(index.rows().withColumnRenamed("n_chars", "keep_chars"), "digest")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("k"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("k") == 1)
    rows = rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if own:
        rows = materialise(rows, "decisions")
        index.drop()
    return rows


def kept_documents(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; of rows repeated with their doc_id and normalised text the longest one, once."""
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    keys = lambda digest: {"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__digest": digest}
    ids = decisions.where("kept").withColumns(keys(F.unhex("text_sha256"))).select(*keys(sha))
    # the window is dealt out as the join is, so texts are shuffled once
    order = Window.partitionBy(*keys(sha)).orderBy(F.length(F.coalesce("text", F.lit(""))).desc())
    rows = docs.withColumns(keys(sha)).join(ids, list(keys(sha)), "left_semi")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*docs.columns)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n FROM documents),
h AS (SELECT doc_id, length(t)::BIGINT AS c, sha256(n) AS text_sha256 FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) AS k,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM w
"""
