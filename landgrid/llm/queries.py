"""The queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landgrid.llm import bin_completion, chat_events, cross_parsing, digest_index, golay_simhash, lattice_neardup, lattice_sampling, resync_tokens, toxicity_gbt, warc_store
from landgrid.llm._util import table


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {
        "op1_lattice_neardup": lattice_neardup.op1,
        "op2_golay_simhash": golay_simhash.op2,
        "op3_warc_content_store": warc_store.op3,
        "op4_chat_event_fold": chat_events.op4,
        "op5_digest_index": op5,
        "op6_resync_tokens": resync_tokens.op6,
        "op7_gumbel_segmentations": lattice_sampling.op7,
        "op8_cross_parsing_language": cross_parsing.op8,
        "op9_toxicity_gbt": toxicity_gbt.op9,
        "op10_bin_completion": bin_completion.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lattice_neardup": lattice_neardup.ORACLE_SQL,
        "op3_warc_content_store": warc_store.ORACLE_SQL,
        "op4_chat_event_fold": chat_events.ORACLE_SQL,
        "op5_digest_index": digest_index.ORACLE_SQL,
    }
