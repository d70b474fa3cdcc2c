"""Boosting against the same algorithm row by row, and what it is for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscope.operators import boosting, models


def plain_fit(x, y, w, cuts, rounds, depth, step, l2=1.0, least=1.0):
    """[(splits, leaves)] per round, by loops over cuts and rows."""
    margin = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        node, splits = np.ones(len(y), int), {}
        for level in range(depth):
            for n in range(2**level, 2 ** (level + 1)):
                at = node == n
                if not at.any():
                    continue
                best = None
                for f in range(x.shape[1]):
                    for c, cut in enumerate(cuts[f]):
                        for missing_left in (False, True):
                            left = at & np.where(np.isnan(x[:, f]), missing_left, x[:, f] < cut)
                            right = at & ~left
                            hl, hr = h[left].sum(), h[right].sum()
                            if hl < least or hr < least:
                                continue
                            gain = (g[left].sum() ** 2 / (hl + l2) + g[right].sum() ** 2 / (hr + l2) - g[at].sum() ** 2 / (h[at].sum() + l2)) / 2
                            key = (float(f"{gain:.10g}"), -f, -c, -missing_left)
                            if gain > 1e-9 and (best is None or key > best[0]):
                                best = (key, f, cut, missing_left, left)
                if best:
                    _, f, cut, missing_left, left = best
                    splits[n] = (f, float(cut), bool(missing_left))
                    node[at] = np.where(left[at], 2 * n, 2 * n + 1)
        leaves = {int(n): -step * g[node == n].sum() / (h[node == n].sum() + l2) for n in np.unique(node)}
        margin = margin + np.array([leaves[n] for n in node])
        trees.append((splits, leaves))
    return trees, margin


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3)).round(1)
    x[rng.random(600) < 0.2, 1] = np.nan
    y = ((x[:, 0] > 0) ^ (np.nan_to_num(x[:, 1], nan=3.0) > 0.3)).astype(int)
    y[rng.random(600) < 0.1] ^= 1
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int").repartition(5), x, y


def test_trees_are_those_of_the_plain_algorithm(spark, given):
    df, x, y = given
    weighted = models.positive_weights(df, "label")
    est = models.boosted_trees(["a", "b", "c"], "label", 3, 3, 0.3, row_share=1.0, feature_share=1.0, bins=16)
    model = est.fit(weighted)
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    trees, margin = plain_fit(x, y, w, boosting.bin_cuts(df, ["a", "b", "c"], 16), 3, 3, 0.3)
    for tree, (splits, leaves) in zip(model.trees, trees):
        assert {n: (s.feature, s.cut, s.missing_left) for n, s in tree.splits.items()} == splits
        assert tree.leaves == pytest.approx(leaves)
    got = {r.id: r.s for r in models.with_score(model, weighted, "s").select("id", "s").collect()}
    assert [got[i] for i in range(600)] == pytest.approx((1 / (1 + np.exp(-margin))).tolist())


def test_a_fit_can_be_repeated_and_learns(spark, given, tmp_path):
    df, x, y = given
    weighted = models.positive_weights(df, "label")
    make = lambda rounds: models.boosted_trees(["a", "b", "c"], "label", rounds, 3, 0.3, row_keys=["id"])
    train, held = weighted.where("id % 3 <> 0"), weighted.where("id % 3 = 0")
    model = make(10).fit(train)
    again = make(10).fit(train.repartition(2))
    assert [sorted(t.splits) for t in model.trees] == [sorted(t.splits) for t in again.trees]
    scores = models.with_score(model, held).agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int")))
    assert scores.head()[0] > 0.8
    assert {i for t in model.trees for i in {s.feature for s in t.splits.values()}} == {0, 1, 2} and any(
        len({s.feature for s in t.splits.values()}) < 3 for t in model.trees
    )
    model.save(spark, f"{tmp_path}/m")
    loaded = boosting.BoostedModel.load(spark, f"{tmp_path}/m")
    values = np.where(x == 0.1, np.nan, x)
    assert (loaded.margins(values) == model.margins(values)).all()
    table = models.importances(loaded, ["a", "b", "c"], spark).collect()
    assert sum(r.importance for r in table) == pytest.approx(1.0) and min(r.importance for r in table[:2]) > table[2].importance


def test_margins_are_written_now_and_then(spark, given, monkeypatch):
    df, _, _ = given
    weighted = models.positive_weights(df, "label")
    est = models.boosted_trees(["a", "b"], "label", 5, 2, 0.3, row_share=1.0, feature_share=1.0, bins=8)
    one = est.fit(weighted)
    monkeypatch.setattr(boosting, "TREES_IN_PLAN", 2)
    two = est.fit(weighted)
    assert [t.leaves for t in two.trees] == [pytest.approx(t.leaves) for t in one.trees]


def test_odd_training_sets(spark):
    df = spark.createDataFrame([(1.0, None, 0), (1.0, None, 1), (None, None, 1)], "a double, b double, label int").withColumn("weight", F.lit(1.0))
    model = models.boosted_trees(["a", "b"], "label", 2, 2, 0.3).fit(df)
    assert all(not t.splits for t in model.trees) and models.with_score(model, df).count() == 3
    with pytest.raises(ValueError, match="both classes"):
        models.boosted_trees(["a"], "label", 2, 2, 0.3).fit(df.where("label = 1"))
