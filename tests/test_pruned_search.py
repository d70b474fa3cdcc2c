"""Nearest neighbours in cells: exact with few cells visited, and the recall of the approximate form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscope.operators import pruned_search, retrieval


def frame(spark, rows, id_, vector):
    return spark.createDataFrame(rows, f"{id_} long, project_id string, {vector} array<float>")


def nearest(corpus, queries, k):
    unit = lambda v: np.array(v, "float32").astype(float) / np.linalg.norm(np.array(v, "float32").astype(float))
    out = []
    for q, project, v in queries:
        if v is None or not any(v):
            continue
        scored = [(round(float(unit(v) @ unit(c)), 12), -i) for i, p, c in corpus if p == project and c is not None and any(c)]
        out += [(q, -i, r + 1) for r, (_, i) in enumerate(sorted(scored, reverse=True)[:k])]
    return sorted(out)


def clustered(rng, n, start=0, project="p"):
    centres = rng.normal(size=(12, 8))
    return [(start + i, project, (centres[i % 12] + rng.normal(size=8) * 0.05).tolist()) for i in range(n)]


def test_exact_with_few_cells(spark):
    rng = np.random.default_rng(2)
    corpus = clustered(rng, 900) + [(5000, "p", None), (5001, "p", [0.0] * 8), (5002, None, [1.0] * 8), (5003, "small", [2.0] * 8)]
    corpus += [(6000 + i, "p", [0.3] * 8) for i in range(300)]
    queries = corpus[:40] + [(7000, "p", [0.3] * 8), (7001, "none", [1.0] * 8), (7002, None, [1.0] * 8), (7003, "p", None), (7004, "small", [1.0] + [0.0] * 7)]
    c, q = frame(spark, corpus, "chunk_id", "embedding"), frame(spark, queries, "query_id", "query_vector")
    found = retrieval.knn_join(q, c, 4, cell_rows=20)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in found.collect()) == nearest(corpus, queries, 4)
    asked, chunks = retrieval._parts(q, c, "query_id", "query_vector", "project_id", "chunk_id", "embedding")
    cells = pruned_search.build_cells(chunks, 20)
    assert cells.members.where("cid >= 6000 AND cid < 6300").select("cell", "part").distinct().count() > 3
    _, visited = pruned_search.pruned_neighbours(asked, cells, 4, retrieval._cell_nearest)
    mean = visited.where("qid < 40").agg(F.avg("visited")).head()[0]
    assert cells.count > 30 and mean < cells.count / 3


def test_probes_trade_cells_for_recall(spark):
    rng = np.random.default_rng(3)
    corpus = clustered(rng, 1200)
    queries = [(i, p, v) for i, p, v in corpus[::20]]
    c, q = frame(spark, corpus, "chunk_id", "embedding"), frame(spark, queries, "query_id", "query_vector")
    want = {(q_, i) for q_, i, _ in nearest(corpus, queries, 5)}
    recall = lambda n: len(want & {(r.query_id, r.chunk_id) for r in retrieval.knn_probe(q, c, 5, n, cell_rows=30).collect()}) / len(want)
    few, all_ = recall(6), recall(10_000)
    assert 0.9 <= few <= all_ == 1.0


def test_no_rows(spark):
    c, q = frame(spark, [], "chunk_id", "embedding"), frame(spark, [(1, "p", [1.0])], "query_id", "query_vector")
    assert retrieval.knn_join(q, c, 2).count() == 0
    assert retrieval.knn_join(q.limit(0), frame(spark, [(1, "p", [1.0])], "chunk_id", "embedding"), 2).count() == 0


def test_the_bound_holds():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centre, members, queries = x[0], x[1:400], x[400:]
    radius = np.sqrt(2 - 2 * members @ centre).max()
    assert ((queries @ members.T).max(1) <= pruned_search.reach(queries @ centre, np.full(len(queries), radius)) + 1e-12).all()


def test_visitors_travel_in_rows_of_many_and_a_crowded_cell_has_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    corpus = [(i, "p", rng.normal(size=8).tolist()) for i in range(700)] + [(1000 + i, "p", [0.3] * 8) for i in range(60)]
    corpus += [(7, "p", corpus[7][2]), (None, "p", corpus[9][2])]
    queries = [r for r in corpus[::5] if r[0] is not None]
    c, q = frame(spark, corpus, "chunk_id", "embedding"), frame(spark, queries, "query_id", "query_vector")
    asked, chunks = retrieval._parts(q, c, "query_id", "query_vector", "project_id", "chunk_id", "embedding")
    cells = pruned_search.build_cells(chunks, 400)
    visits = pruned_search._visits(asked.withColumn("least", F.lit(None).cast("double")), cells, "nearest")
    assert visits.count() <= cells.count + len(queries) // 8
    assert visits.agg(F.sum(F.size("qid"))).head()[0] == len(queries)
    monkeypatch.setattr(pruned_search, "VISIT_ROWS", 16)
    found = retrieval.knn_join(q, c, 3, cell_rows=400).collect()
    want = nearest([(-1 if i is None else i, p, v) for i, p, v in corpus], queries, 3)
    assert sorted((r.query_id, -1 if r.chunk_id is None else r.chunk_id, r["rank"]) for r in found) == want


def test_scores_in_single_precision_lose_no_neighbour():
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    near = unit(np.full((300, 24), 0.2) + rng.normal(size=(300, 24)) * 1e-9)
    c = unit(np.concatenate([rng.normal(size=(1500, 24)), near, np.repeat(rng.normal(size=(3, 24)), 200, axis=0)]))[rng.permutation(2400)]
    q = np.concatenate([c[:90], unit(rng.normal(size=(60, 24))), near[:20]])
    want = [x.tolist() for x in retrieval._best_of(q, c, 4)]
    few = retrieval._few_copies(c, 4)
    assert len(few) == 1500 + 300 + 3 * 4
    row, col, score = retrieval._best_above(q, c[few], c[few].astype("float32"), 4, np.full(len(q), np.nan))
    assert [row.tolist(), few[col].tolist()] == want[:2] and np.allclose(score, want[2], atol=2e-12, rtol=0)
    least = np.where(np.arange(len(q)) % 3 == 0, np.nan, 0.6)
    row, col, score = retrieval._best_above(q, c[few], c[few].astype("float32"), 4, least)
    kept = [i for i, (r, s) in enumerate(zip(want[0], want[2])) if not s < least[r]]
    assert [row.tolist(), few[col].tolist()] == [[x[i] for i in kept] for x in want[:2]]
