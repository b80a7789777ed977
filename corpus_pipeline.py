"""Corpus cleaning: language, toxicity, exact copies, near copies, then packing. Each stage reads all its predecessor kept.

Stages take (spark, docs, sf_dir); their results are written as Parquet and read again as the next one's docs. All but the
last give the columns of documents. Language ID rejects what has no letters to tell a language by (``und``), toxicity what
scores 0.7 or more, exact dedup all but one of equal texts, near-dedup all but the smallest doc_id of a component of texts
whose 5-word shingles have a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm import bin_completion, cross_parsing, digest_index, golay_simhash, toxicity_gbt
from landgrid.llm._util import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cross_parsing.tagged(docs).where("__lang_pred <> 'und'").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = toxicity_gbt.scored(docs, toxicity_gbt.fit(docs, labels))
    return rows.where(F.col("__toxicity") < toxicity_gbt.THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_index.kept_documents(docs, digest_index.exact_dedup(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return golay_simhash.kept_texts(docs, words=5, similarity=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_completion.pack_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("packing", packing)]
ORACLE_SQL = None  # trained models and lattices are beyond SQL; tests hold language ID, exact and near dedup and packing against plain Python, and toxicity against its trees in plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
