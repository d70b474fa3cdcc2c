"""Exact nearest neighbours with cells that a bound rules out, and the approximate form of the same cells.

Every chunk goes to the nearest of its project's centroids, which are some of its own vectors,
chosen by hash. A cell keeps its radius, the largest distance of a member to the centroid. On unit
vectors the triangle inequality bounds the similarity that a query can find in a cell: none if the
distance to the centroid less the radius is too large. A query first looks in its nearest cell,
then, with the k-th similarity found there, in those other cells that can still hold a better one.
That is exact. `probe` looks in the nearest `probes` cells only.

Centroids and radii are shipped to every task; there are `MOST_CELLS` cells at most, whatever the
corpus, as cells grow with it. Members of a crowded cell are dealt over parts by id, so equal
vectors do not meet in one task. Queries are dealt to the cells they visit, never to all, a few
of them in a row; a cell with many visitors is searched in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskscope.session import materialise

CELL_ROWS = 4096
# 4,096 centroids of 1,024 elements are 32 MB.
MOST_CELLS = 4096
# Visitors of a cell that one task answers, bytes of vectors in a row of them, and vectors that are dealt at a time.
VISIT_ROWS = 1 << 16
VISIT_BYTES = 4096
DEALT_ROWS = 8192
# Scores of a task, and how many of them a visit costs besides.
TASK_SCORES = 1 << 25
VISIT_SCORES = 2048
# Scores are compared after rounding to 12 digits; the bound leaves room for that and for sums of doubles.
SLACK = 1e-9


def unit_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of length one, and which of them have a length; all have one size."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return unit_matrix(lists.flatten().to_numpy(zero_copy_only=False), len(lists))


def unit_matrix(flat: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """As `unit_rows`, from the elements of so many vectors one after the other."""
    flat = flat.astype(np.float64)
    matrix = flat.reshape(rows, -1) if rows else flat.reshape(0, 0)
    length = np.linalg.norm(matrix, axis=1)
    return np.divide(matrix, length[:, None], where=length[:, None] > 0, out=np.zeros_like(matrix)), length > 0


def reach(similarity: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The highest similarity that a query can find in a cell, from its similarity to the centroid."""
    gap = np.maximum(np.sqrt(np.maximum(2 - 2 * similarity, 0)) - radius, 0)
    return 1 - gap * gap / 2


@dataclass
class Cells:
    """members: project, cell, part, cid, vector; by project its centroids, with cell numbers and radii."""

    members: DataFrame
    centroids: dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def count(self) -> int:
        return sum(len(numbers) for numbers, _, _ in self.centroids.values())


def build_cells(corpus: DataFrame, cell_rows: int = CELL_ROWS) -> Cells:
    """`corpus` has project, cid and vector (array of float or double); null and zero vectors are left out."""
    zero = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) == 0
    stored = materialise(corpus.where(F.col("vector").isNotNull() & ~zero))
    # Projects are counted by row; a corpus of more of them than cells has one cell for each.
    sizes = stored.groupBy("project").agg(F.count(F.lit(1)).alias("rows"))
    total, projects = sizes.agg(F.sum("rows"), F.count(F.lit(1))).head()
    if projects > MOST_CELLS:
        raise ValueError(f"{projects} projects; cells are for {MOST_CELLS} at most")
    cell_rows = max(cell_rows, -(-(total or 0) // MOST_CELLS))
    # About rows / cell_rows members of each project by hash, and one more, so that every project has a centroid.
    drawn = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 30)) * F.lit(cell_rows) < F.lit(1 << 30)
    least = stored.groupBy("project").agg(F.min_by("vector", F.struct(F.xxhash64("cid"), "cid")).alias("vector"))
    chosen = stored.where(drawn).select("project", "vector").unionByName(least)
    found = chosen.select("project", "vector").toArrow()
    by: dict[object, list[int]] = {}
    for i, project in enumerate(found.column("project").to_pylist()):
        by.setdefault(project, []).append(i)
    centres = {p: unit_rows(found.column("vector").take(pa.array(rows)))[0] for p, rows in by.items()}
    starts = dict(zip(centres, np.cumsum([0, *[len(c) for c in centres.values()]])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, _ = unit_rows(batch.column("vector"))
            projects = np.array(batch.column("project").to_pylist(), object)
            cell, apart = np.zeros(len(unit), np.int64), np.zeros(len(unit))
            for p in set(projects.tolist()):
                own = np.flatnonzero([x == p or x is p for x in projects])
                similar = unit[own] @ centres[p].T
                best = similar.argmax(1)
                cell[own] = starts[p] + best
                apart[own] = np.sqrt(np.maximum(2 - 2 * similar[np.arange(len(own)), best], 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart)], [*batch.schema.names, "cell", "apart"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema.fields) + ", cell bigint, apart double"
    placed = materialise(stored.mapInArrow(place, schema))
    grown = placed.groupBy("cell").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")).toArrow()
    radius = dict(zip(grown.column("cell").to_pylist(), grown.column("radius").to_pylist()))
    crowded = {c: -(-n // (2 * cell_rows)) for c, n in zip(grown.column("cell").to_pylist(), grown.column("n").to_pylist()) if n > 2 * cell_rows}
    ways = F.coalesce(F.try_element_at(F.create_map(*[F.lit(int(x)) for pair in crowded.items() for x in pair]), "cell"), F.lit(1)) if crowded else F.lit(1)
    members = placed.withColumn("part", F.pmod(F.xxhash64("cid"), ways).cast("long")).withColumn("ways", ways).drop("apart")
    kept = {}
    for p, c in centres.items():
        numbers = starts[p] + np.arange(len(c))
        live = np.array([n in radius for n in numbers])
        kept[p] = (numbers[live], c[live], np.array([radius[n] + SLACK for n in numbers[live]]))
    return Cells(members, kept)


def _visits(queries: DataFrame, cells: Cells, mode: str, probes: int | None = None) -> DataFrame:
    """(qid, packed, least, cell), a few visitors of a cell in a row, the bytes of their vectors one after the other.

    They go to the `nearest` cell of each query, or to the `others`, of its `probes` nearest if given, that its `least` does not rule out.
    """
    centroids = cells.centroids

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                unit, live = unit_rows(batch.column("vector"))
                projects = batch.column("project").to_pylist()
                least = batch.column("least").to_numpy(zero_copy_only=False)
                rows, numbers = [], []
                for p in set(projects):
                    if p not in centroids:
                        continue
                    own = np.flatnonzero([live[i] and (x == p) for i, x in enumerate(projects)])
                    names, centres, radius = centroids[p]
                    similar = unit[own] @ centres.T
                    order = np.argsort(-similar, axis=1, kind="stable")
                    near = np.zeros(similar.shape, bool)
                    np.put_along_axis(near, order[:, :1], True, axis=1)
                    go = near
                    if mode == "others":
                        # Without k rows in the nearest cell there is no bound, and every cell may help.
                        go = ~near & ~(reach(similar, radius) < least[own][:, None] - SLACK)
                        if probes is not None:
                            np.put_along_axis(go, order[:, probes:], False, axis=1)
                    c, r = np.nonzero(go.T)
                    rows.append(own[r])
                    numbers.append(names[c])
                rows, numbers = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, numbers))
                for start in range(0, len(rows), DEALT_ROWS):
                    yield packed(batch, rows[start : start + DEALT_ROWS], numbers[start : start + DEALT_ROWS], unit.shape[1])

    def packed(batch: pa.RecordBatch, rows: np.ndarray, numbers: np.ndarray, size: int) -> pa.RecordBatch:
        taken = batch.take(pa.array(rows))
        flat = taken.column("vector").flatten().to_numpy(zero_copy_only=False)
        step = max(1, VISIT_BYTES // (size * flat.itemsize))
        first = np.r_[True, numbers[1:] != numbers[:-1]]
        inside = np.arange(len(numbers)) - np.maximum.accumulate(np.where(first, np.arange(len(numbers)), 0))
        starts = np.flatnonzero(inside % step == 0)
        ends = np.r_[starts, len(numbers)]
        columns = {
            "qid": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.column("qid")),
            "packed": pa.array([flat[i * size : j * size].tobytes() for i, j in pairwise(ends.tolist())], pa.binary()),
            "least": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.column("least")),
            "cell": pa.array(numbers[starts]),
        }
        return pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return queries.mapInArrow(fold, f"qid array<{queries.schema['qid'].dataType.simpleString()}>, packed binary, least array<double>, cell bigint")


def _found(visits: DataFrame, cells: Cells, k: int, search) -> DataFrame:
    """(qid, cid, similarity): k best of each query in each part of the cells that it visits; those under its `least` may miss."""
    members = cells.members
    crowds = visits.groupBy("cell").agg(F.sum(F.size("qid")).alias("visits"))
    sizes = members.groupBy("cell").agg(F.max("ways").cast("long").alias("ways"), F.count(F.lit(1)).alias("rows"))
    # One short row for each visited cell.
    deal = crowds.join(sizes, "cell").select("*", F.ceil(F.col("visits") / VISIT_ROWS).cast("long").alias("slots")).collect()
    dealt = F.broadcast(visits.sparkSession.createDataFrame([(r.cell, r.slots, r.ways) for r in deal], "cell long, slots long, ways long"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    nothing = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    place = F.struct("cell", "part", "slot").alias("place")
    hosts = members.drop("ways").join(dealt, "cell").withColumn("slot", upto("slots"))
    guests = (
        visits.join(dealt, "cell")
        .withColumn("slot", F.pmod(F.xxhash64(F.get("qid", F.lit(0))), F.col("slots")))
        .withColumn("part", upto("ways"))
    )
    both = hosts.select(
        place, F.lit(0).alias("side"), "cid", "vector", *[nothing(visits, c) for c in ("qid", "packed", "least")]
    ).unionByName(guests.select(place, F.lit(1).alias("side"), *[nothing(members, c) for c in ("cid", "vector")], "qid", "packed", "least"))
    # The number of tasks is given, as rows do not tell the work; more of them than places, so that few share one.
    places, work = sum(r.slots * r.ways for r in deal), sum(r.visits * (r.rows + VISIT_SCORES) for r in deal)
    tasks = max(1, min(2 * places, places + 1024, -(-work // TASK_SCORES)))
    met = both.repartition(tasks, "place").sortWithinPartitions("place", "side", "cid")
    kinds = f"qid {visits.schema['qid'].dataType.elementType.simpleString()}, cid {members.schema['cid'].dataType.simpleString()}, similarity double"
    return met.select("place.*", "side", "cid", "vector", "qid", "packed", "least").mapInArrow(search(k, "qid", "cid"), kinds)


def _in_two_steps(
    queries: DataFrame, cells: Cells, k: int, search, probes: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Best rows, visits of the nearest cells and of others: with the k-th similarity of the first, less is found in the second."""
    asked = materialise(queries.where(F.col("vector").isNotNull()).withColumn("least", F.lit(None).cast("double")))
    first = materialise(_visits(asked, cells, "nearest"))
    near = materialise(_found(first, cells, k, search))
    best = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), "cid")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kth = ranked(near).where(F.col("rank") == k).select(F.col("qid").alias("__qid"), F.col("similarity").alias("least"))
    bounded = asked.drop("least").join(kth, F.col("qid") == F.col("__qid"), "left").select("project", "qid", "vector", "least")
    others = materialise(_visits(bounded, cells, "others", probes))
    return ranked(near.unionByName(_found(others, cells, k, search))), first, others


def pruned_neighbours(queries: DataFrame, cells: Cells, k: int, search) -> tuple[DataFrame, DataFrame]:
    """Best (qid, cid, similarity, rank) rows, and (qid, visited) cells; `queries` has project, qid, vector.

    `search(k, qid, cid)` folds sorted rows of one place, the members and then their visitors.
    """
    found, first, others = _in_two_steps(queries, cells, k, search)
    went = first.select(F.explode("qid").alias("qid")).unionByName(others.select(F.explode("qid").alias("qid")))
    return found, went.groupBy("qid").agg(F.count(F.lit(1)).alias("visited"))


def probe(queries: DataFrame, cells: Cells, k: int, search, probes: int) -> DataFrame:
    """Approximate (qid, cid, similarity, rank): the best rows of the `probes` nearest cells only."""
    return _in_two_steps(queries, cells, k, search, probes)[0]
