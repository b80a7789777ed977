"""Token counts; huge documents by overlap resynchronisation.

A document of more than ``CHUNK`` characters is encoded in chunks that overlap. Both encodings of an overlap have byte
offsets for their tokens; they are spliced at a common token boundary that is proven stable: a space after a visible
ASCII character, where the vocabulary's pattern must end a word whatever stands before or after. If an overlap has no
such place it is widened, in the end to the whole rest, so the count is always that of the whole text.

Defined results: null and empty texts have no tokens; repeated rows each have a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from landgrid.llm._util import arrow_map, table
from landgrid.llm.bpe_words import ByteBpe, loaded

CHUNK, OVERLAP, LIMIT = 65_536, 256, 1024


def _offsets(bpe, text: str) -> np.ndarray:
    """Byte offset of each token's start, and the end."""
    return np.concatenate([[0], np.cumsum(np.asarray(bpe.lengths)[bpe.encode(text)])])


def _stable(overlap: bytes) -> np.ndarray:
    b = np.frombuffer(overlap, np.uint8)
    return np.flatnonzero((b[1:] == 32) & (b[:-1] > 32) & (b[:-1] < 127)) + 1


def spliced_count(bpe, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, chunks, widenings) of a text of any length."""
    n, end, chunks, widened, total = len(text), min(chunk, len(text)), 1, 0, 0
    begin = 0
    held = _offsets(bpe, text[:end])  # token starts of text[begin:end], from the last splice on
    while end < n:
        width = min(overlap, end - begin)
        while True:
            b = end - width
            shared = text[b:end].encode()
            stop = min(n, b + width + chunk)
            following = _offsets(bpe, text[b:stop])
            ours = held - (held[-1] - len(shared))
            both = np.intersect1d(np.intersect1d(ours[:-1], following[:-1]), _stable(shared))
            if len(both):
                p = both[-1]
                total += int(np.searchsorted(ours, p))
                held = following[np.searchsorted(following, p) :]
                begin = b + len(shared[:p].decode())
                break
            widened += 1
            if b == begin:  # nothing stable in all that is held: it is encoded anew together with what follows
                held = _offsets(bpe, text[begin:stop])
                break
            width = min(width * 4, end - begin)
        end, chunks = stop, chunks + 1
        chunk = chunk if held is following or begin != b else chunk * 2
    return total + len(held) - 1, chunks, widened


def count_tokens(docs: DataFrame, folder: str | None = None, chunk: int = CHUNK, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks."""

    def make():
        bpe = loaded(ByteBpe, folder)

        def batch(rows: pa.RecordBatch) -> dict:
            n_bytes, n_tokens, n_chunks = [], [], []
            for x in rows.column("text"):
                text = x.as_py() or ""
                tokens, chunks = (bpe.count(text), 1) if len(text) <= chunk else spliced_count(bpe, text, chunk)[:2]
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(tokens)
                n_chunks.append(chunks)
            return {"doc_id": rows.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [t > limit for t in n_tokens], "n_chunks": n_chunks}

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
