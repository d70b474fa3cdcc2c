"""Token counts: batch encoding in Arrow functions that return lengths only.

Arrow batches are cut into slices of equal bytes, so neither a run of long documents nor one
very long one changes the memory of a task much; long texts are split at boundaries where the
tokenizer splits anyway (see `tokens`), and only numbers leave the task.

Defined cases: a null or empty text has no tokens; null ids and repeated rows are kept as
they are; columns beside the id and the text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskscope.llm.tokens import part_lengths
from riskscope.llm.words import slices

LIMIT_TOKENS = 2048


def token_counts(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT_TOKENS
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; `tokenizer` is the path of its file."""
    sent = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = sent.select(
        id_column, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")
    ).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = part_lengths(tokenizer)
        for part in slices(batches, "__text"):
            texts = [t or "" for t in part.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([sum(lengths.of(t)) for t in texts], pa.int64()),
                ],
                [id_column, "n_bytes", "n_tokens"],
            )

    return sent.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
