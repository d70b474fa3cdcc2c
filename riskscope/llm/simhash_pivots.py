"""SimHash near-duplicates with pivot distance tables.

The fingerprints are reduced to distinct ones first, so exact copies cost nothing. Each gets
a table of its Hamming distances to reference fingerprints (pivots). By the triangle
inequality two fingerprints within k bits differ by at most k in every coordinate, so a pair
whose largest coordinate difference exceeds k is discarded, and survivors are verified bit by
bit.

Pairs are not taken from all against all. The 64 bits are four blocks; two fingerprints
within two bits agree in at least two of them, which makes six keys of 32 bits. Keys shared by
2 to `PAIR_GROUP` fingerprints are joined pair by pair through the pivot table. Larger groups
take an exact way without pairs: two fingerprints within two bits share a point within one
bit of both, so each joins the smallest fingerprint at each of its 65 such points; at most 65
fingerprints can meet at a point, however large the group.

Defined cases: a text without words (null, empty, blank) has fingerprint zero, linked like
any other; repeated rows share a class; a null id is kept and never names a class, which is
null if no member has an id; further columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskscope.llm.components import component_labels
from riskscope.llm.words import slices
from riskscope.session import materialise

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BLOCKS = 4
PAIR_GROUP = 64
N_PIVOTS = 16


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `width` words, ASCII letters lower-cased, joined by single spaces."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(start[: 1 - width].tolist(), end[width - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bits set in over half of the hashes of each text; its hashes are first[i]:first[i+1]."""
    out = np.zeros(len(first) - 1, np.uint64)
    n = np.diff(first)
    step = 1 << 16
    counts = np.zeros((len(out), 64), np.int64)
    for at in range(0, len(hashes), step):
        to = min(at + step, len(hashes))
        bits = np.unpackbits(hashes[at:to].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        texts = np.flatnonzero((first[:-1] < to) & (first[1:] > at))
        begin = np.maximum(first[texts], at) - at
        counts[texts] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    some = n > 0
    out[some] = np.where(2 * counts[some] > n[some, None], bit, np.uint64(0)).sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed 64-bit number."""
    sent = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = sent.select(id_column, F.lit(0).cast("long").alias("fp")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            found = [shingle_hashes((t or "").encode()) for t in part.column("__text").to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(h) for h in found])])
            flat = np.fromiter((h for hashes in found for h in hashes), np.uint64, int(first[-1]))
            fp = majority_bits(flat, first).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], [id_column, "fp"])

    return sent.mapInArrow(fold, schema)


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: fixed pseudo-random 64-bit numbers, as signed ones."""
    found = [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)]
    return [p - (1 << 64) if p >> 63 else p for p in found]


def distance_table(fp: Column, n: int = N_PIVOTS) -> list[Column]:
    """Distances to the pivots, eight to a bigint."""
    distance = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in pivots(n)]
    packs = [distance[i : i + 8] for i in range(0, n, 8)]
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(d, 8 * j) for j, d in enumerate(p)]) for p in packs]


def coordinates_within(a: Column, b: Column, most: int, n: int = 8) -> Column:
    """True if no coordinate of two packed tables differs by more than `most`."""
    at = lambda c, j: F.shiftrightunsigned(c, 8 * j).bitwiseAND(F.lit(255))
    return reduce(lambda x, y: x & y, [F.abs(at(a, j) - at(b, j)) <= most for j in range(n)])


def _keys(fp: Column) -> Column:
    """The values of each pair of the four blocks, with the number of the pair."""
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    pairs = combinations(range(BLOCKS), BLOCKS - MAX_BITS)
    return F.array(
        *[F.struct(F.lit(k).alias("k"), F.shiftleft(block[i], width).bitwiseOR(block[j]).alias("key")) for k, (i, j) in enumerate(pairs)]
    )


def fingerprint_links(distinct: DataFrame, pair_group: int = PAIR_GROUP) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) within two bits."""
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("__k")).select("fp", "__k.*")
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(keyed.join(sizes, ["k", "key"]))
    table = distance_table(F.col("fp"))
    small = shared.where(F.col("n") <= pair_group).select("k", "key", "fp", *[t.alias(f"t{i}") for i, t in enumerate(table)])
    a, b = small.alias("a"), small.alias("b")
    near = reduce(
        lambda x, y: x & y,
        [coordinates_within(F.col(f"a.t{i}"), F.col(f"b.t{i}"), MAX_BITS) for i in range(len(table))],
    )
    pairs = (
        a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
        .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    crowded = shared.where(F.col("n") > pair_group).select("fp").distinct()
    points = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    stars = points.select("fp", F.min("fp").over(Window.partitionBy("z")).alias("m")).where("fp <> m")
    return pairs.union(stars.select(F.col("fp").alias("u"), F.col("m").alias("v"))).distinct()


def near_duplicate_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; a class is named by its smallest id."""
    found = materialise(fingerprints(docs, id_column, text))
    distinct = found.groupBy("fp").agg(F.min(id_column).alias("__first"))
    labels = component_labels(fingerprint_links(distinct)).withColumnRenamed("node", "fp")
    named = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    # Copies are folded already, so a class has one row per different fingerprint here.
    least = named.groupBy("label").agg(F.min("__first").alias("component_id"))
    classes = named.join(least, "label").select("fp", "component_id")
    return found.join(classes, "fp").select(
        id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that name their class, with their own columns; of repeated rows of an id, one.

    Rows without an id cannot be named: they stay, but only one of those with equal texts.
    """
    return keep_named(docs, near_duplicate_classes(docs, id_column, text), id_column, text)


def keep_named(docs: DataFrame, classes: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id names its class in `classes` (id, component_id), as `drop_near_duplicates` keeps them."""
    winners = materialise(
        classes.where(F.col(id_column) == F.col("component_id"))
        .groupBy(F.col(id_column).alias("__id"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    own = [F.col(f"`{c}`") for c in docs.columns]
    key = F.col(f"`{id_column}`") == F.col("__id")
    # The same join at every size, without sorting the texts.
    single = docs.join(winners.where("__n = 1").hint("shuffle_hash"), key, "left_semi")
    repeated = docs.join(winners.where("__n > 1"), key, "left_semi").dropDuplicates([id_column])
    nameless = docs.where(F.col(f"`{id_column}`").isNull()).dropDuplicates([text])
    return single.union(repeated).union(nameless).select(*own)
