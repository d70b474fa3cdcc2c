"""Hard negatives by an R-tree over the vectors, packed by sort-tile-recursive (STR).

Components become integers, floor(scale * x); a score is the integer inner product. For an anchor
its positives are the best rows of its label, and for each of them the negatives are the best
rows of other labels whose score lies in a window below the positive's.

Index. A bounded sample (`SAMPLE_ROWS`) gives the cut points of the upper levels: slabs along
the widest coordinates, each slab cut along the next one. Every row is placed in its tile, tiles
with too many rows (many equal vectors) are dealt over cells by id, and each cell is packed into
leaves of `LEAF_ROWS` rows with their minimum bounding boxes. The number of cells is bounded, see
`tile_rows`, so their boxes are shipped to every task; the leaves are a written table.

Search. Over a box every coordinate's product with the anchor's lies in an interval; the sums of
the ends bound the score of all rows inside. An anchor looks in its own cell first. The k-th score
found there goes with it to the other cells, whose boxes must reach it and the window. In a
cell a best-first queue opens boxes by upper bound; those outside the window or strictly below the
k-th score are dropped, equal ones are opened because a smaller id may be inside. Anchors are
dealt in blocks, so a task holds one cell and one block of anchors.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no
part; a shorter vector counts as filled up with zeros; a row is no partner of rows with its own
id; repeated rows are found and asked for each by itself; equal scores go by id; an anchor without
positives, or a positive without rows in its window, gives no rows; an empty table gives no rows.
Components beyond 2**62 after scaling, or scores beyond 2**63, raise an error. Other columns are
ignored whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskscope.session import materialise

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Rows that give the cut points and the order of the coordinates.
SAMPLE_ROWS = 20_000
#: Rows of a cell, while there are at most MOST_TILES tiles; the boxes of all cells are shipped.
TILE_ROWS = 4096
MOST_TILES = 1 << 14
LEAF_ROWS = 128
FANOUT = 16
ANCHOR_BLOCK = 1 << 14
#: Coordinates along which tiles and leaves are cut in turn.
CUT_DIMS = 3
_LOW, _HIGH = -(1 << 62), 1 << 62


def quantised(vectors: DataFrame, id_column: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, label, vec) of the rows that take part, components as integers."""
    sent = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vec"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            at = lists.offsets.to_numpy()
            flat = lists.values.slice(at[0], at[-1] - at[0])
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            at = at - at[0]
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            whole = wrong[at[1:]] == wrong[at[:-1]]
            values = np.floor(np.where(np.isfinite(values), values, 0.0) * scale)
            if (np.abs(values) >= 2.0**62).any():
                raise OverflowError("a component does not fit in 62 bits")
            ints = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ints], ["id", "label", "vec"])
            yield out.filter(pa.array(whole))

    return sent.mapInArrow(fold, "id bigint, label bigint, vec array<bigint>")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The lists as rows, filled up with zeros."""
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    n = np.diff(at)
    if len(n) and (n == width).all():
        return values[at[0] : at[-1]].reshape(-1, width)
    out = np.zeros((len(n), width), np.int64)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        out[i, : b - a] = values[a:b]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers; floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("scores do not fit in 64 bits")
    return a @ b.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each anchor over each box, from the interval of each coordinate."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


@dataclass
class Cuts:
    """Nested cut points: those of level k are chosen by the slabs of the levels above."""

    dims: list[int]
    levels: list[np.ndarray]

    def tiles(self, vectors: np.ndarray) -> np.ndarray:
        code = np.zeros(len(vectors), np.int64)
        for dim, cuts in zip(self.dims, self.levels):
            x = vectors[:, dim] if dim < vectors.shape[1] else np.zeros(len(vectors), np.int64)
            code = code * (cuts.shape[1] + 1) + (x[:, None] >= cuts[code]).sum(1)
        return code


def sample_cuts(sample: np.ndarray, tiles: int) -> Cuts:
    """Slabs of even size in the sample along its widest coordinates, about `tiles` tiles in all."""
    order = np.argsort(-sample.astype(np.float64).var(0), kind="stable") if len(sample) else np.arange(sample.shape[1])
    dims = [int(d) for d in order[: CUT_DIMS if tiles >= 8 else 1]]
    slabs = max(1, round(tiles ** (1 / max(1, len(dims)))))
    parts, levels = [sample], []
    for dim in dims:
        rows, below = [], []
        for part in parts:
            x = np.sort(part[:, dim]) if len(part) else np.zeros(1, np.int64)
            cut = x[[len(x) * (i + 1) // slabs for i in range(slabs - 1)]] if slabs > 1 else x[:0]
            rows.append(cut)
            slot = (part[:, dim][:, None] >= cut).sum(1)
            below += [part[slot == i] for i in range(slabs)]
        levels.append(np.array(rows, np.int64).reshape(len(parts), slabs - 1))
        parts = below
    return Cuts(dims, levels)


def str_order(vectors: np.ndarray, ids: np.ndarray, dims: Sequence[int], leaf: int) -> np.ndarray:
    """The rows in leaf order: sorted along one coordinate, cut in slabs, each sorted along the next."""

    def pack(rows: np.ndarray, left: Sequence[int]) -> list[np.ndarray]:
        if not left or len(rows) <= leaf:
            return [rows]
        rows = rows[np.lexsort((ids[rows], vectors[rows, left[0]]))]
        leaves = -(-len(rows) // leaf)
        slabs = max(1, round(leaves ** (1 / len(left))))
        size = -(-leaves // slabs) * leaf
        return [p for i in range(0, len(rows), size) for p in pack(rows[i : i + size], left[1:])]

    return np.concatenate(pack(np.arange(len(ids)), dims)) if len(ids) else np.zeros(0, np.int64)


@dataclass
class Index:
    """Leaves: cell, leaf, ids, labels, vecs (laid end to end); boxes of the cells; where rows belong."""

    rows: DataFrame
    leaves: DataFrame
    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray
    width: int


def build_index(rows: DataFrame, tile_rows: int = TILE_ROWS) -> Index:
    """`rows` (id, label, vec) is a written table; every row is indexed."""
    total, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).head()
    width = max(1, width or 0)
    tile_rows = max(tile_rows, -(-total // MOST_TILES))
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(1, total))
    taken = rows.select("vec") if share >= 1 else rows.sample(fraction=share, seed=7).select("vec")
    taken = taken.limit(SAMPLE_ROWS).toArrow().column("vec").combine_chunks()
    cuts = sample_cuts(matrix(taken, width), -(-total // tile_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = pa.array(cuts.tiles(matrix(batch.column(2), width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, tile], ["id", "label", "vec", "tile"])

    tiled = materialise(rows.mapInArrow(place, "id bigint, label bigint, vec array<bigint>, tile bigint"))
    # One row a tile: at most MOST_TILES by the choice of tile_rows.
    sizes = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).withColumn("ways", F.ceil(F.col("n") / tile_rows))
    salt = F.pmod(F.xxhash64("id"), F.col("ways")).cast("long")
    placed = tiled.join(F.broadcast(sizes.select("tile", "ways")), "tile")
    placed = placed.select("id", "label", "vec", (F.col("tile") * F.lit(1 << 32) + salt).alias("cell"))
    dims = cuts.dims if len(cuts.dims) > 1 else list(range(min(CUT_DIMS, width)))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        vectors = matrix(table.column("vec").combine_chunks(), width)
        order = str_order(vectors, ids, dims, LEAF_ROWS)
        starts = range(0, len(order), LEAF_ROWS)
        groups = [order[i : i + LEAF_ROWS] for i in starts]
        return pa.table(
            {
                "cell": pa.array([key[0].as_py()] * len(groups), pa.int64()),
                "leaf": pa.array(range(len(groups)), pa.int64()),
                "ids": pa.array([ids[g] for g in groups], pa.list_(pa.int64())),
                "labels": pa.array([labels[g] for g in groups], pa.list_(pa.int64())),
                "vecs": pa.array([vectors[g].ravel() for g in groups], pa.list_(pa.int64())),
                "low": pa.array([vectors[g].min(0) for g in groups], pa.list_(pa.int64())),
                "high": pa.array([vectors[g].max(0) for g in groups], pa.list_(pa.int64())),
            }
        )

    lists = ", ".join(f"{c} array<bigint>" for c in ("ids", "labels", "vecs", "low", "high"))
    leaves = materialise(placed.groupBy("cell").applyInArrow(pack, f"cell bigint, leaf bigint, {lists}"))
    sides = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(width)]
    # One row a cell: not more than twice the tiles.
    boxes = leaves.groupBy("cell").agg(*sides).toArrow()
    side = lambda c: np.array([boxes.column(f"{c}{i}").to_numpy() for i in range(width)], np.int64).T.reshape(-1, width)
    return Index(placed, leaves, boxes.column("cell").to_numpy(), side("low"), side("high"), width)


class Cell:
    """The packed tree of one cell: levels of boxes over its leaves."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by("leaf")
        self.ids, self.labels = ([np.array(x, np.int64) for x in table.column(c).to_pylist()] for c in ("ids", "labels"))
        vecs = [np.array(x, np.int64).reshape(-1, width) for x in table.column("vecs").to_pylist()]
        self.vecs = vecs
        low, high = (matrix(table.column(c).combine_chunks(), width) for c in ("low", "high"))
        children: list[range | None] = [None] * len(low)
        lows, highs, first = [low], [high], 0
        while len(low) > 1:
            cut = np.arange(0, len(low), FANOUT)
            children += [range(first + i, first + min(i + FANOUT, len(low))) for i in cut]
            first += len(low)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            lows.append(low)
            highs.append(high)
        self.low, self.high, self.children = np.concatenate(lows), np.concatenate(highs), children

    def best(self, anchor: np.ndarray, own: int, allowed, least, most, low: int, high: int, floor: int, k: int, seen: dict) -> list[tuple[int, int]]:
        """The k best (score, -id) in [low, high], those below `floor` left out; `seen` keeps scores of leaves."""
        found: list[tuple[int, int]] = []
        bar = max(low, floor)
        root = len(most) - 1
        queue = [(-min(int(most[root]), high), root)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < bar:
                break
            if most[node] < bar or least[node] > high:
                continue
            inside = self.children[node]
            if inside is not None:
                for c in inside:
                    if most[c] >= bar and least[c] <= high:
                        heapq.heappush(queue, (-min(int(most[c]), high), c))
                continue
            if node not in seen:
                mine = allowed(self.labels[node]) & (self.ids[node] != own)
                seen[node] = (products(self.vecs[node][mine], anchor[None])[:, 0], self.ids[node][mine])
            scores, ids = seen[node]
            fit = np.flatnonzero((scores >= bar) & (scores <= high))
            if len(fit) > k:
                fit = fit[np.lexsort((ids[fit], -scores[fit]))[:k]]
            for i in fit:
                entry = (int(scores[i]), -int(ids[i]))
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
            if len(found) == k:
                bar = max(bar, found[0][0])
        return found


_REQUEST = "key bigint, id bigint, label bigint, vec array<bigint>, home bigint, lows array<bigint>, highs array<bigint>, floors array<bigint>"
_FOUND = "key bigint, w int, score bigint, partner bigint"


def _routed(requests: DataFrame, index: Index, home: bool) -> DataFrame:
    """The requests with the cells to look in: the own one, or all others whose box may hold an answer."""
    cells, low, high, width = index.cells, index.low, index.high, index.width

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                own = batch.column("home").to_numpy()[:, None] == cells
                if home:
                    go = own
                else:
                    least, most = bounds(matrix(batch.column("vec"), width), low, high)
                    windows = [batch.column(c).to_pylist() for c in ("lows", "highs", "floors")]
                    go = np.zeros(own.shape, bool)
                    for i, (lows, highs, floors) in enumerate(zip(*windows)):
                        for a, b, c in zip(lows, highs, floors):
                            if a <= b:
                                go[i] |= (most[i] >= max(a, c)) & (least[i] <= b)
                    go &= ~own
                row, cell = np.nonzero(go)
                for part in range(0, len(row), 4096):
                    some = slice(part, part + 4096)
                    columns = batch.take(pa.array(row[some])).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cells[cell[some]])], [*batch.schema.names, "cell"])

    return requests.mapInArrow(fold, f"{_REQUEST}, cell bigint")


def _searched(requests: DataFrame, index: Index, blocks: int, k: int, same: bool) -> DataFrame:
    """(key, w, score, partner): for each window of a routed request its k best rows in that cell."""
    width = index.width
    dealt = materialise(requests.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))))
    asked = dealt.select(F.col("cell").alias("at"), F.col("block").alias("for")).distinct()
    leaves = index.leaves.join(asked, F.col("cell") == F.col("at")).drop("cell")

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            cell = Cell(right, width)
            anchors = matrix(left.column("vec").combine_chunks(), width)
            names = left.column("key").to_pylist()
            own, label = left.column("id").to_pylist(), left.column("label").to_pylist()
            windows = [left.column(c).to_pylist() for c in ("lows", "highs", "floors")]
            for at in range(0, len(names), 256):
                least, most = bounds(anchors[at : at + 256], cell.low, cell.high)
                for i in range(at, min(at + 256, len(names))):
                    allowed = (lambda x, i=i: x == label[i]) if same else (lambda x, i=i: x != label[i])
                    seen: dict = {}
                    for w, (low, high, floor) in enumerate(zip(*(c[i] for c in windows))):
                        if low <= high:
                            hits = cell.best(anchors[i], own[i], allowed, least[i - at], most[i - at], low, high, floor, k, seen)
                            out += [(names[i], w, s, -p) for s, p in hits]
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("key", "w", "score", "partner"), columns, kinds)})

    return dealt.groupBy("cell", "block").cogroup(leaves.groupBy("at", "for")).applyInArrow(search, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each request and window, with their rank."""
    order = Window.partitionBy("key", "w").orderBy(F.col("score").desc(), F.col("partner").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_partners(requests: DataFrame, index: Index, blocks: int, k: int, same: bool) -> DataFrame:
    """(key, w, rank, score, partner): own cell first, the other cells with the k-th score found there."""
    near = materialise(_searched(_routed(requests, index, True), index, blocks, k, same))
    floor = _first(near, k).where(F.col("rank") == k).select("key", F.struct("w", "score").alias("f"))
    floor = floor.groupBy("key").agg(F.map_from_entries(F.collect_list("f")).alias("at"))
    raised = requests.join(floor, "key", "left").withColumn(
        "floors", F.transform("floors", lambda x, i: F.coalesce(F.try_element_at("at", i), x))
    )
    raised = raised.select(*requests.columns)
    far = _searched(_routed(raised, index, False), index, blocks, k, same)
    return materialise(_first(near.unionByName(far), k))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_column: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = 50,
    most_percent: int = 95,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` is a condition on the column `id`. A negative's score lies between `least_percent`
    and `most_percent` of the positive's.
    """
    rows = materialise(quantised(vectors, id_column, label, vector))
    index = build_index(rows, tile_rows)
    one = lambda v: F.array(F.lit(v).cast("long"))
    asked = index.rows.where(anchor).select(
        F.monotonically_increasing_id().alias("key"),
        "id",
        "label",
        "vec",
        F.col("cell").alias("home"),
        one(_LOW).alias("lows"),
        one(_HIGH).alias("highs"),
        one(_LOW).alias("floors"),
    )
    asked = materialise(asked)
    blocks = max(1, -(-asked.count() // ANCHOR_BLOCK))
    best = best_partners(asked, index, blocks, positives, True)
    pairs = best.select("key", (F.col("rank") - 1).alias("w"), F.col("partner").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = materialise(pairs)
    windows = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("w", "positive_score"))).alias("p"))
    # 100 * score >= least * positive, 100 * score <= most * positive.
    share = lambda s, percent: f"{s} * {percent}L"
    down = lambda x: f"(({x}) - pmod({x}, 100L)) div 100L"
    up = lambda x: f"(({x}) + pmod(-({x}), 100L)) div 100L"
    lows, highs = (f"transform(p, s -> {f(share('s.positive_score', c))})" for f, c in ((up, least_percent), (down, most_percent)))
    wanted = asked.drop("lows", "highs", "floors").join(windows, "key")
    wanted = wanted.select(
        "key",
        "id",
        "label",
        "vec",
        "home",
        F.expr(lows).alias("lows"),
        F.expr(highs).alias("highs"),
        F.transform("p", lambda s: F.lit(_LOW).cast("long")).alias("floors"),
    )
    found = best_partners(materialise(wanted), index, blocks, negatives, False)
    named = found.join(pairs, ["key", "w"]).join(asked.select("key", F.col("id").alias("anchor_id")), "key")
    return named.select(
        "anchor_id", "positive_id", "rank", F.col("partner").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
