"""Logistic regressions of all folds and penalties at once, by stacked Newton steps.

A cell is one model: the rows of all folds but one (or of all folds), standardised and class
weighted by those rows alone, with one C. Every scan gives loss, gradient and Gram matrix of
all cells together, summed by task and then by cell; the driver solves one small system for each. So
the number of scans does not depend on the number of folds or penalties: one for the moments of
the folds, one for each step and one for the held-out counts.

The objective of a cell is C times the weighted log-loss plus half the squared coefficients; the intercept is free. A step that does not
lower the objective is halved. Missing values become `fill`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskscope.scaling import number
from riskscope.session import materialise

ALL_FOLDS = -1
_SUMS = "cell int, place int, value double"


@dataclass
class Cell:
    """One model: without the rows of fold `held`, with penalty 1 / `c`."""

    held: int
    c: float
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[float, float]
    beta: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def raw_coefficients(self) -> np.ndarray:
        """Intercept and coefficients for features as they are given."""
        slopes = self.beta[1:] / self.scale
        return np.concatenate([[self.beta[0] - slopes @ self.mean], slopes])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.design(x) @ self.beta))


@dataclass
class StackedFit:
    features: list[str]
    cells: list[Cell]
    scans: int
    settled: bool

    def cell(self, held: int, c: float) -> Cell:
        return next(x for x in self.cells if x.held == held and x.c == c)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(held, c, feature, coefficient) on the standardised features; the intercept's name is empty."""
        names = ["", *self.features]
        rows = [(x.held, x.c, n, float(b)) for x in self.cells for n, b in zip(names, x.beta)]
        return spark.createDataFrame(rows, "held int, c double, feature string, coefficient double")


def design_rows(df: DataFrame, features: Sequence[str], label: str, fold: str, fill: float = -1.0) -> DataFrame:
    """(x, y, fold) of labelled rows, written once for all scans."""
    values = F.array(*[F.coalesce(number(f), F.lit(fill)) for f in features])
    return materialise(df.where(F.col(label).isin(0, 1)).select(values.alias("x"), F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("fold")))


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, k: int, cells: int, size: int, each) -> np.ndarray:
    """The sum over all rows of `each(x, y, fold)`, a cells x size array; one scan."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, size))
        for batch in batches:
            if batch.num_rows:
                total += each(*_arrays(batch, k))
        at = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["cell", "place", "value"])

    found = rows.mapInArrow(fold, _SUMS).groupBy("cell", "place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((cells, size))
    out[found.column("cell").to_numpy(), found.column("place").to_numpy()] = found.column("value").to_numpy()
    return out


def _start(rows: DataFrame, k: int, held: Sequence[int], values: Sequence[float]) -> list[Cell]:
    """The cells at zero, with the moments and class counts of their rows."""
    folds = [r[0] for r in rows.select("fold").distinct().collect()]
    place = {f: i for i, f in enumerate(sorted(folds))}

    def moments(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((len(place), 2 + 2 * k))
        for f, i in place.items():
            own = x[fold == f]
            ones = float(y[fold == f].sum())
            out[i] = np.concatenate([[len(own) - ones, ones], own.sum(0), (own**2).sum(0)])
        return out

    # Squares around the overall means, so that large means cost no digits.
    first = _summed(rows, k, len(place), 2 + 2 * k, moments)
    n = first[:, :2].sum()
    centre = first[:, 2 : 2 + k].sum(0) / max(n, 1)
    centred = _summed(rows, k, len(place), 2 + 2 * k, lambda x, y, fold: moments(x - centre, y, fold))
    cells = []
    for h in held:
        kept = np.array([f != h for f in place])
        s = centred[kept].sum(0)
        size = s[0] + s[1]
        mean = s[2 : 2 + k] / max(size, 1)
        var = s[2 + k :] / max(size, 1) - mean**2
        # A column that is constant but for rounding is not scaled.
        scale = np.where(var > 1e-24 * np.maximum(centre**2, 1e-300), np.sqrt(np.maximum(var, 0)), 1.0)
        weights = (size / (2 * s[0]) if s[0] else 0.0, size / (2 * s[1]) if s[1] else 0.0)
        cells += [Cell(h, c, centre + mean, scale, weights, np.zeros(k + 1)) for c in values]
    return cells


def stacked_sums(cells: Sequence[Cell], k: int):
    """For `_summed`: loss, gradient and upper Gram triangle of each cell."""
    upper = np.triu_indices(k + 1)

    def each(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cells), 1 + k + 1 + len(upper[0])))
        for i, cell in enumerate(cells):
            own = fold != cell.held
            z, t = cell.design(x[own]), y[own]
            margin = z @ cell.beta
            w = np.where(t == 1, cell.weights[1], cell.weights[0])
            p = 1.0 / (1.0 + np.exp(-margin))
            loss = (w * (np.logaddexp(0.0, margin) - t * margin)).sum()
            gram = (z * (w * p * (1 - p))[:, None]).T @ z
            out[i] = np.concatenate([[loss], z.T @ (w * (p - t)), gram[upper]])
        return out

    return each


def fit_stacked(
    rows: DataFrame, features: Sequence[str], held: Sequence[int], values: Sequence[float], steps: int = 50, tolerance: float = 1e-8
) -> StackedFit:
    """All (held fold, C) models on `design_rows`. It ends when no gradient is above `tolerance` a row, or after `steps`."""
    k = len(features)
    cells = _start(rows, k, held, values)
    n = max(1, rows.count())
    upper, free = np.triu_indices(k + 1), np.concatenate([[0.0], np.ones(k)])
    best, move, share = [np.inf] * len(cells), [np.zeros(k + 1)] * len(cells), [1.0] * len(cells)
    last = [c.beta.copy() for c in cells]
    scans, settled = 0, False
    while scans < steps + 1 and not settled:
        sums = _summed(rows, k, len(cells), 1 + k + 1 + len(upper[0]), stacked_sums(cells, k))
        scans += 1
        settled = True
        for i, cell in enumerate(cells):
            loss = cell.c * sums[i, 0] + 0.5 * (free * cell.beta**2).sum()
            gradient = cell.c * sums[i, 1 : k + 2] + free * cell.beta
            if loss > best[i] + 1e-12 * abs(best[i]) and share[i] > 1e-6:
                share[i] /= 2
                cell.beta = last[i] - share[i] * move[i]
                settled = False
                continue
            best[i], share[i], last[i] = loss, 1.0, cell.beta.copy()
            if np.abs(gradient).max() <= tolerance * n * cell.c:
                continue
            gram = np.zeros((k + 1, k + 1))
            gram[upper] = sums[i, k + 2 :]
            gram = cell.c * (gram + np.triu(gram, 1).T) + np.diag(free)
            move[i] = np.linalg.lstsq(gram, gradient, rcond=None)[0]
            if scans <= steps:
                cell.beta = last[i] - move[i]
            settled = False
    return StackedFit(list(features), cells, scans, settled)


def held_out_counts(rows: DataFrame, fit: StackedFit) -> DataFrame:
    """(held, c, tp, fp, fn, tn) of each model on the fold it did not see; one scan."""
    k, cells = len(fit.features), fit.cells

    def each(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cells), 4))
        for i, cell in enumerate(cells):
            own = fold == cell.held
            positive, true = cell.scores(x[own]) >= 0.5, y[own] == 1
            out[i] = [(positive & true).sum(), (positive & ~true).sum(), (~positive & true).sum(), (~positive & ~true).sum()]
        return out

    counts = _summed(rows, k, len(cells), 4, each).astype(np.int64)
    found = [(c.held, c.c, *map(int, n)) for c, n in zip(cells, counts) if c.held != ALL_FOLDS]
    return rows.sparkSession.createDataFrame(found, "held int, c double, tp long, fp long, fn long, tn long")


def logistic_grid_search(
    df: DataFrame, features: Sequence[str], label: str, fold: str, k: int, values: Sequence[float], steps: int = 50
) -> tuple[DataFrame, StackedFit]:
    """(trial, params, mean_mcc) of each C over k folds, and the fits, those on all rows included."""
    from riskscope.operators.evaluation import mcc

    rows = design_rows(df, features, label, fold)
    fit = fit_stacked(rows, features, [*range(k), ALL_FOLDS], values, steps)
    scored = held_out_counts(rows, fit).select("c", mcc().alias("mcc"))
    means = scored.groupBy("c").agg(F.avg("mcc").alias("mean_mcc"))
    trials = [(i, json.dumps({"C": c}), c) for i, c in enumerate(values)]
    named = df.sparkSession.createDataFrame(trials, "trial int, params string, c double")
    return named.join(means, "c").select("trial", "params", "mean_mcc"), fit


def best_cell(table: DataFrame, fit: StackedFit) -> Cell:
    """The model on all rows with the C of the highest mean, the first on ties."""
    row = table.orderBy(F.col("mean_mcc").desc_nulls_last(), "trial").head()
    return fit.cell(ALL_FOLDS, json.loads(row["params"])["C"])
