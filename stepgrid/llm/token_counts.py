"""Token counts without token ids in the documents.

Pieces of text between pre-token borders are counted once each; a document's
count is the sum of its piece frequencies times the pieces' counts.

The join of frequencies with counts is done inside each task, over batches of
bounded bytes: joined through a shuffle, the (document, piece) frequencies
would be larger than the texts themselves. A worker remembers the counts of a
bounded number of pieces between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgrid.llm.pieces import distinct_pieces, library_counter, remembered
from stepgrid.llm.textbytes import own_worker, slices


def frequencies(codes: np.ndarray, docs: np.ndarray, n_pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece and frequency of every distinct (document, piece) pair."""
    doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    pairs, counts = np.unique(doc * max(n_pieces, 1) + codes, return_counts=True)
    return pairs // max(n_pieces, 1), pairs % max(n_pieces, 1), counts


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns ``doc_id, n_bytes, n_tokens, over_limit``, one row per input row.

    ``tokenizer`` is the path of a ``.json`` file on every worker. Null and
    empty texts have no tokens. Repeated rows are counted each, rows with a
    null id keep it, an empty table gives an empty result. Special strings
    inside texts are one token, as the library has it by default. Other columns
    of ``docs``, whatever their names, are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("tokens")
        for batch in slices(batches):
            pieces, codes, at = distinct_pieces(batch.column("text"))
            per_piece = np.array(remembered(f"counts {tokenizer}", library_counter(tokenizer), pieces), np.int64)
            doc, piece, often = frequencies(codes, at, len(pieces))
            sums = np.bincount(doc, weights=per_piece[piece] * often, minlength=batch.num_rows) if len(doc) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums.astype(np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
