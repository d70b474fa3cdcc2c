"""Hard negatives against the scores of all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscope.llm import queries, rtree_negatives


def valid(row):
    i, label, vec = row
    return i is not None and label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)


def negatives(rows, every=50):
    """rows: (vec_id, label, vector); rows of the operator, in order."""
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in filter(valid, rows)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, vec in rows:
        if i % every:
            continue
        ranked = sorted((-score(vec, v), j, other) for j, other, v in rows if j != i)
        for s, j, _ in [r for r in ranked if r[2] == label][:5]:
            fit = [r for r in ranked if r[2] != label and -50 * s <= -100 * r[0] <= -95 * s]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit[:3])]
    return sorted(out)


SCHEMA = "vec_id bigint, label int, embedding array<float>"


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ["id", "vec", "key", "cell", "tile", "n"]})
    found = rtree_negatives.hard_negatives(df, F.col("id") % 50 == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def test_given_embeddings(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    moved = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in given]
    got = queries.QUERIES["op13_rtree_negatives"](spark, sf_dir)
    assert sorted(tuple(r) for r in got.collect()) == negatives(moved)


@pytest.mark.parametrize("clustered", [False, True])
def test_many_cells_and_equal_vectors(spark, clustered):
    """A third of the rows are one vector; small tiles make many cells."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * (3 if clustered else 0)
    vectors = (centres[rng.integers(0, 6, 1500)] + rng.normal(size=(1500, 8))).round(2)
    vectors[::3] = 0.5
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in v]) for i, v in enumerate(vectors)]
    assert run(spark, rows, tile_rows=100) == negatives([(i, c, np.array(v, np.float32).astype(float)) for i, c, v in rows])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, None, [1.0, 1.0]), (2, 1, None), (3, 1, [nan, 1.0]), (4, 1, [inf, 1.0]), (5, 1, [None, 1.0])]
    rows += [(None, 1, [1.0, 1.0]), (6, 1, [1.0, 1.0]), (7, 1, []), (8, 1, [2.0]), (9, 1, [-5.0, -5.0]), (-50, 2, [0.0, 0.0])]
    rows += [(10, 2, [1.0, 0.5]), (10, 2, [1.0, 0.5]), (11, 2, [1.0, 0.5]), (12, 3, [0.25, 0.25]), (50, 9, [1.0, 1.0]), (100, 3, [4.0, 4.0])]
    assert run(spark, rows) == negatives(rows)
    assert run(spark, rows[:0]) == [] and run(spark, rows[:3]) == []


def test_best_first_queue_drops_boxes():
    """On clustered rows most leaves are never scored."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 900
    vectors = np.repeat(centres, 100, 0).astype(np.int64) + rng.integers(-20, 20, (4000, 16))
    order = rtree_negatives.str_order(vectors, np.arange(4000), [0, 1, 2], 32)
    assert sorted(order) == list(range(4000))
    parts = [order[i : i + 32] for i in range(0, 4000, 32)]
    lists = lambda rows: pa.array([np.asarray(r).ravel() for r in rows], pa.list_(pa.int64()))
    cell = rtree_negatives.Cell(
        pa.table(
            {
                "leaf": list(range(len(parts))), "ids": lists(parts), "labels": lists([p * 0 for p in parts]),
                "vecs": lists([vectors[p] for p in parts]), "low": lists([vectors[p].min(0) for p in parts]),
                "high": lists([vectors[p].max(0) for p in parts]),
            }
        ),
        16,
    )
    anchor, seen = vectors[0], {}
    least, most = rtree_negatives.bounds(anchor[None], cell.low, cell.high)
    low, high = -(1 << 62), 1 << 62
    got = cell.best(anchor, 0, lambda x: x == 0, least[0], most[0], low, high, low, 5, seen)
    scores = vectors @ anchor
    want = sorted(((int(s), -i) for i, s in enumerate(scores) if i), reverse=True)[:5]
    assert sorted(got, reverse=True) == want and len(seen) < len(parts) / 2
