"""Operator 7: token counts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Encoder, text_chunks, vocabulary
from .shared import lean_workers
from .tables import output_schema, table, tokenizer_path
from .textvec import text_buffers


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and BPE tokens of each whole text, and whether the tokens exceed ``limit``.

    The pre-tokens of a batch are held as ragged numpy arrays; in each round every sequence applies
    its lowest-rank pair, and the symbols that survive are counted.  One narrow pass over the table:
    no shuffle, memory bounded by a chunk of text and a cache of pre-tokens.

    A null or empty text has 0 bytes and 0 tokens.  A special string of the vocabulary inside a text
    counts as one token.  Repeated rows and null ids stay rows of their own; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(vocab_path))
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            n = [encoder.encode(texts).per_doc() for _, texts in text_chunks(batch.column(1))]
            tokens = np.concatenate(n) if n else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    lean_workers(docs.sparkSession)
    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(run, output_schema(picked, id_col, more="n_bytes long, n_tokens long, over_limit boolean"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
