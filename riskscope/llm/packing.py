"""Best-fit packing of tokenised documents into sequences, under several capacities at once.

Every document becomes its ids and a separator; longer ones than a sequence are cut into
pieces. A piece needs a vector of resources: its tokens, one document, and its attention cost
(length squared). All three follow from its length, and there are at most `max_tokens`
lengths, so the corpus is reduced to a histogram of lengths. Vector best-fit runs on that
bounded histogram: bins with the same residual vector are one group with a count, the longest
pieces go first, and a piece goes to the group that fits every capacity and scores best by
the weighted dot-product of need and residual, or by the smallest residual norm. The result
is a short list of runs (the pieces of one length with ranks r to r+n go to the bins b to b+n
at one offset), which Spark joins back to the ranked pieces. Bins of one group may take
several pieces of a length, so a run says how many.

Defined cases: a null or empty text is the separator alone, one piece of one token; repeated
rows are packed each; null ids are kept; columns beside the id and the text are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskscope.llm.tokens import part_ids
from riskscope.llm.words import slices
from riskscope.session import materialise

SEPARATOR = 0
MAX_TOKENS = 2048
PIECES_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. The defaults for documents and attention bind nothing more than the tokens do."""

    tokens: int = MAX_TOKENS
    documents: int = MAX_TOKENS
    attention: int = MAX_TOKENS * MAX_TOKENS

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


def need(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


@dataclass
class Run:
    """Pieces of `length` with ranks first_rank.. (bins * each of them) go to bins first_bin.. at offset."""

    length: int
    first_rank: int
    bins: int
    each: int
    first_bin: int
    offset: int


def plan_runs(
    histogram: dict[int, int], capacity: Capacity, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm"
) -> list[Run]:
    """Vector best-fit of a histogram of lengths: the runs, longest pieces first.

    `score` is "dot" (largest weighted dot-product of need and residual) or "norm" (smallest
    weighted norm of what would remain). Resources are in shares of their capacity. The open
    groups are rows of arrays: residual vector, first bin, bins, offset of the next piece.
    """
    total = capacity.vector()
    share = np.array(weights, float)
    residual = np.zeros((0, 3), np.int64)
    first, bins, offset = (np.zeros(0, np.int64) for _ in range(3))
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank, want = histogram[length], 0, need(length)
        if (want > total).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = (residual >= want).all(1)
            if fits.any():
                rest = np.flatnonzero(fits)
                if score == "dot":
                    value = -((residual[rest] / total) * (want / total)) @ share
                else:
                    value = (((residual[rest] - want) / total) ** 2) @ share
                g = int(rest[np.argmin(value)])
                fit = int((residual[g] // want).min())
            else:
                fit = int((total // want).min())
                count = max(1, left // fit)
                residual = np.vstack([residual, total])
                first, bins, offset = np.append(first, opened), np.append(bins, count), np.append(offset, 0)
                opened += count
                g = len(bins) - 1
            # Either every bin of the group takes as many pieces as fit, or some bins do, or one takes the rest.
            each = min(fit, left)
            used = min(int(bins[g]), left // each)
            runs.append(Run(length, rank, used, each, int(first[g]), int(offset[g])))
            rank, left = rank + used * each, left - used * each
            taken = (residual[g] - each * want, int(first[g]), used, int(offset[g]) + each * length)
            if used == bins[g]:
                residual[g], first[g], bins[g], offset[g] = taken
            else:
                first[g], bins[g] = first[g] + used, bins[g] - used
                residual = np.vstack([residual, taken[0]])
                first, bins, offset = np.append(first, taken[1]), np.append(bins, taken[2]), np.append(offset, taken[3])
        open_still = (residual > 0).all(1)
        residual, first, bins, offset = residual[open_still], first[open_still], bins[open_still], offset[open_still]
    return runs


def token_pieces(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""
    sent = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("__text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = part_ids(tokenizer)
        separator = SEPARATOR.to_bytes(4, "little")
        for part in slices(batches, "__text"):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = b"".join(known.of(text or "")) + separator
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    own = ids[at : at + 4 * max_tokens]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return sent.mapInArrow(cut, PIECES_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: Capacity = Capacity(), **scoring) -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` is read twice and should be a stored table.

    Ranks inside a length are counted in slots (a hash of the document), so a common length is
    spread over many tasks; the slot totals give each slot its first rank.
    """
    spark = pieces.sparkSession
    slots = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slotted = pieces.withColumn("__slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)))
    counted = slotted.groupBy("length", "__slot").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each length: at most capacity.tokens rows reach the driver.
    histogram = {int(r[0]): int(r[1]) for r in counted.groupBy("length").agg(F.sum("__n")).collect()}
    runs = plan_runs(histogram, capacity, **scoring)
    plan = spark.createDataFrame(
        [(r.length, r.first_rank, r.bins * r.each, r.each, r.first_bin, r.offset) for r in runs],
        "length bigint, __rank0 bigint, __take bigint, __each bigint, __bin bigint, __offset bigint",
    )
    earlier = Window.partitionBy("length").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "__slot", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__slot").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        slotted.withColumn("__inside", F.row_number().over(inside) - 1)
        .join(before, ["length", "__slot"])
        .withColumn("__rank", F.col("__inside") + F.col("__before"))
    )
    at = F.col("__rank") - F.col("__rank0")
    joined = ranked.join(
        F.broadcast(plan.withColumnRenamed("length", "__length")),
        (F.col("length") == F.col("__length")) & (at >= 0) & (at < F.col("__take")),
    )
    return joined.select(
        *pieces.columns,
        (F.col("__bin") + F.floor(at / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + at % F.col("__each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), **scoring) -> DataFrame:
    """One row per piece of every document: its place in the packed sequences."""
    return pack_pieces(materialise(token_pieces(docs, tokenizer, max_tokens=capacity.tokens)), capacity, **scoring)
