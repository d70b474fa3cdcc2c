"""Stacked logistic fits against one fit at a time."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscope.operators import evaluation, newton


def plain(x, y, c):
    """Balanced, standardised, L2-penalised fit of one model by Newton steps with halving."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    free = np.r_[0, np.ones(x.shape[1])]
    beta = np.zeros(z.shape[1])
    loss = lambda b: c * (w * (np.logaddexp(0, z @ b) - y * (z @ b))).sum() + (free * b * b).sum() / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ beta))
        move = np.linalg.lstsq(c * (z.T * (w * p * (1 - p))) @ z + np.diag(free), c * z.T @ (w * (p - y)) + free * beta, rcond=None)[0]
        t = 1.0
        while loss(beta - t * move) > loss(beta) and t > 1e-9:
            t /= 2
        beta = beta - t * move
    return beta, mean, scale


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3)) * [1, 50, 1e-3] + [0, 1e6, 0]
    y = (rng.random(900) < 1 / (1 + np.exp(-2 * x[:, 0] + (x[:, 1] - 1e6) / 40))).astype(int)
    fold = rng.integers(0, 4, 900)
    rows = [(*map(float, r), int(c), int(f), 7.0) for r, c, f in zip(x, y, fold)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int, fold int, same double").repartition(5)
    return df, np.column_stack([x, np.full(900, 7.0)]), y, fold


FEATURES = ["a", "b", "c", "same"]


def test_all_cells_are_the_single_fits(spark, given):
    df, x, y, fold = given
    rows = newton.design_rows(df, FEATURES, "label", "fold")
    fit = newton.fit_stacked(rows, FEATURES, [0, 1, 2, 3, newton.ALL_FOLDS], [0.01, 1.0, 10.0])
    assert fit.settled
    for cell in fit.cells:
        own = fold != cell.held
        beta, mean, scale = plain(x[own], y[own], cell.c)
        assert cell.mean == pytest.approx(mean) and cell.scale == pytest.approx(scale, rel=1e-6)
        assert cell.beta == pytest.approx(beta, abs=1e-5)
        raw = cell.raw_coefficients()
        assert 1 / (1 + np.exp(-(raw[0] + x[:5] @ raw[1:]))) == pytest.approx(cell.scores(x[:5]), rel=1e-6)


def test_scans_do_not_grow_with_folds_or_penalties(spark, given, monkeypatch):
    df, *_ = given
    plain_sum, scans = newton._summed, []
    monkeypatch.setattr(newton, "_summed", lambda *a: scans.append(a) or plain_sum(*a))
    used = []
    for k, values in ((2, [1.0]), (4, [0.01, 0.1, 1.0, 10.0])):
        scans.clear()
        newton.logistic_grid_search(df.withColumn("fold", F.col("fold") % k), FEATURES, "label", "fold", k, values, steps=4)
        used.append(len(scans))
    assert used[0] == used[1] <= 8


def test_grid_search_scores_held_out_rows(spark, given):
    df, x, y, fold = given
    table, fit = newton.logistic_grid_search(df, FEATURES, "label", "fold", 4, [0.001, 1.0])
    got = {json.loads(r.params)["C"]: r.mean_mcc for r in table.collect()}
    for c in (0.001, 1.0):
        scores = np.concatenate([fit.cell(f, c).scores(x[fold == f]) for f in range(4)])
        order = np.concatenate([np.flatnonzero(fold == f) for f in range(4)])
        rows = [(int(y[i]), int(s >= 0.5), int(fold[i])) for i, s in zip(order, scores)]
        counts = evaluation.confusion_counts(spark.createDataFrame(rows, "y int, p int, f int"), "y", "p", ["f"])
        assert got[c] == pytest.approx(counts.agg(F.avg(evaluation.mcc())).head()[0])
    best = newton.best_cell(table, fit)
    assert best.held == newton.ALL_FOLDS and got[best.c] == max(got.values())


def test_separable_rows_missing_values_and_one_class(spark):
    rows = [(float(i), None if i % 3 else float("nan"), int(i > 20), i % 2) for i in range(40)] + [(1.0, 1.0, None, 0)]
    df = spark.createDataFrame(rows, "a double, b double, label int, fold int")
    design = newton.design_rows(df, ["a", "b"], "label", "fold")
    assert design.count() == 40
    fit = newton.fit_stacked(design, ["a", "b"], [0, 1, newton.ALL_FOLDS], [1e6])
    assert all(np.isfinite(c.beta).all() for c in fit.cells)
    counts = newton.held_out_counts(design, fit).collect()
    assert sum(r.fp + r.fn for r in counts) <= 2 and sum(r.tp + r.fp + r.fn + r.tn for r in counts) == 40
    one = newton.design_rows(df.where("label = 1"), ["a", "b"], "label", "fold")
    assert newton.fit_stacked(one, ["a", "b"], [newton.ALL_FOLDS], [1.0], steps=5).cells[0].scores(np.ones((1, 2)))[0] >= 0.5
