"""Gradient boosting with second-order gains on histograms.

Features are cut into bins at exact quantiles once. A tree grows level by level, and a level is
one aggregation: sums of gradient and Hessian by (node, feature, bin) of all rows, combined before
the shuffle. The driver sees that table only, at most 2**(depth - 1) nodes x features x bins,
and picks the splits with

    gain = (GL² / (HL + l2) + GR² / (HR + l2) - G² / (H + l2)) / 2

Rows with a missing value go to the side that gains more. A leaf adds -step * G / (H + l2) to the
log-odds. Rows taken and features tried by a tree follow from hashes, so a fit on rows with keys
can be repeated on any cluster; equal gains go to the first feature and cut.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskscope.operators.selection import select_quantiles
from riskscope.scaling import number
from riskscope.session import materialise

# Trees that an expression of margins may hold before the margins are written.
TREES_IN_PLAN = 8


@dataclass
class Split:
    """Left are values below `cut`, and missing ones if `missing_left`; `code` is the cut's place among the bins."""

    feature: int
    code: int
    cut: float
    missing_left: bool
    gain: float


@dataclass
class Tree:
    """Nodes are numbered from 1; those below node i are 2i and 2i + 1."""

    splits: dict[int, Split] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def walk(self, left, leaf, node: int = 1) -> Column:
        """A nested condition: `left` of each split, `leaf` of each end."""
        split = self.splits.get(node)
        if split is None:
            return leaf(node)
        return F.when(left(split), self.walk(left, leaf, 2 * node)).otherwise(self.walk(left, leaf, 2 * node + 1))


def _left(split: Split) -> Column:
    """Of binned rows; bin 0 holds the missing values."""
    bin_ = F.col(f"b{split.feature}")
    return ((bin_ > 0) | F.lit(split.missing_left)) & (bin_ <= split.code)


@dataclass
class BoostedModel:
    features: list[str]
    base: float
    trees: list[Tree]

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Log-odds of rows of feature values, NaN for missing."""
        out = np.full(len(values), self.base)
        for tree in self.trees:
            node = np.ones(len(values), np.int64)
            for i in sorted(tree.splits):
                s, at = tree.splits[i], np.flatnonzero(node == i)
                x = values[at, s.feature]
                node[at] = 2 * i + 1 - np.where(np.isnan(x), s.missing_left, x < s.cut)
            ends = np.array(sorted(tree.leaves))
            out += np.array([tree.leaves[i] for i in ends])[np.searchsorted(ends, node)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `probability` (a vector of both classes) and `prediction`."""
        model, inputs = self, [number(f) for f in self.features]

        @F.pandas_udf("double")
        def positive(*columns):
            import pandas as pd

            values = np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
            return pd.Series(1.0 / (1.0 + np.exp(-model.margins(values))))

        scored = df.withColumn("__p", positive(*inputs))
        both = array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p")))
        return scored.withColumn("probability", both).withColumn("prediction", (F.col("__p") >= 0.5).cast("double")).drop("__p")

    def importances(self) -> list[tuple[str, float]]:
        """Mean gain of the splits on each feature, as shares."""
        gains: dict[int, list[float]] = {}
        for tree in self.trees:
            for s in tree.splits.values():
                gains.setdefault(s.feature, []).append(s.gain)
        means = [float(np.mean(gains[i])) if i in gains else 0.0 for i in range(len(self.features))]
        return [(f, m / (sum(means) or 1.0)) for f, m in zip(self.features, means)]

    def save(self, spark: SparkSession, path: str) -> None:
        trees = [{"splits": {i: asdict(s) for i, s in t.splits.items()}, "leaves": t.leaves} for t in self.trees]
        text = json.dumps({"features": self.features, "base": self.base, "trees": trees})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        kept = json.loads(spark.read.text(path).head()[0])
        trees = [
            Tree({int(i): Split(**s) for i, s in t["splits"].items()}, {int(i): v for i, v in t["leaves"].items()})
            for t in kept["trees"]
        ]
        return BoostedModel(kept["features"], kept["base"], trees)


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """The different quantiles i / bins of each feature; a value equal to a cut lies right of it."""
    rows = select_quantiles(df, features, [i / bins for i in range(1, bins)]).collect()
    by = {f: sorted({r["quantile"] for r in rows if r["feature"] == f}) for f in features}
    return [np.array(by[f], np.float64) for f in features]


def _binned(df: DataFrame, features: Sequence[str], cuts: list[np.ndarray], label: str, weight: str, row_keys: Sequence[str]) -> DataFrame:
    """(y, w, r, b0, b1, …): label, weight, a number of the row, and the bins, 0 where a value is missing."""
    row = F.xxhash64(*row_keys) if row_keys else F.monotonically_increasing_id()
    sent = df.select(
        F.col(label).cast("double").alias("y"),
        F.col(weight).cast("double").alias("w"),
        row.alias("r"),
        *[number(f).alias(f"b{i}") for i, f in enumerate(features)],
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:3])
            for cut, column in zip(cuts, batch.columns[3:]):
                x = column.to_numpy(zero_copy_only=False).astype(np.float64)
                bins = np.where(np.isnan(x), 0, 1 + np.searchsorted(cut, x, "right"))
                columns.append(pa.array(bins.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = "y double, w double, r bigint, " + ", ".join(f"b{i} int" for i in range(len(features)))
    return materialise(sent.where(F.col(label).isNotNull()).mapInArrow(fold, schema))


def level_sums(rows: DataFrame, tried: Sequence[int]) -> DataFrame:
    """(node, feature, bin, g, h) of rows with node, g, h and their bins."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"b{i}").alias("bin")) for i in tried])
    spread = rows.select("node", "g", "h", F.explode(pairs).alias("e"))
    return spread.groupBy("node", "e.feature", "e.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def cut_gains(sums: Sequence, cuts: int, l2: float, least: float) -> list[tuple[float, int, bool, tuple[float, float], tuple[float, float]]]:
    """(gain, code, missing left, left sums, right sums) of the cuts of one feature in one node.

    `sums` are its (bin, g, h) rows; both sides need a Hessian of `least`.
    """
    g, h = np.zeros(cuts + 2), np.zeros(cuts + 2)
    for b, x, y in sums:
        g[b], h[b] = x, y
    G, H = g.sum(), h.sum()
    found = []
    for missing_left in (False, True):
        gl = np.cumsum(g[1:-1]) + (g[0] if missing_left else 0.0)
        hl = np.cumsum(h[1:-1]) + (h[0] if missing_left else 0.0)
        gr, hr = G - gl, H - hl
        gain = (gl**2 / (hl + l2) + gr**2 / (hr + l2) - G**2 / (H + l2)) / 2
        for code in np.flatnonzero((hl >= least) & (hr >= least)):
            ends = (float(gl[code]), float(hl[code])), (float(gr[code]), float(hr[code]))
            found.append((float(gain[code]), int(code) + 1, missing_left, *ends))
    return found


def logistic_sums(rows: DataFrame, margin: Column) -> DataFrame:
    """Rows with g and h of the weighted logistic loss at `margin`."""
    p = 1.0 / (1.0 + F.exp(-margin))
    return rows.withColumn("__p", p).withColumns({"g": F.col("w") * (F.col("__p") - F.col("y")), "h": F.col("w") * F.col("__p") * (1 - F.col("__p"))}).drop("__p")


@dataclass
class BoostedTrees:
    """An estimator: `fit` takes rows with features, label and weight."""

    features: Sequence[str]
    label: str
    rounds: int
    depth: int
    step: float
    row_share: float = 0.8
    feature_share: float = 0.8
    l2: float = 1.0
    least_hessian: float = 1.0
    bins: int = 64
    seed: int = 42
    weight: str = "weight"
    row_keys: Sequence[str] = ()

    def _tried(self, tree: int) -> list[int]:
        ranked = sorted(range(len(self.features)), key=lambda i: hashlib.md5(f"{self.seed}:{tree}:{self.features[i]}".encode()).digest())
        return sorted(ranked[: max(1, int(self.feature_share * len(ranked)))])

    def _grown(self, rows: DataFrame, tried: list[int], cuts: list[np.ndarray]) -> Tree:
        """A tree on rows with g and h."""
        tree, open_nodes, ends = Tree(), [1], {}
        for _ in range(self.depth):
            placed = rows.withColumn("node", tree.walk(_left, F.lit))
            placed = placed.where(F.col("node").isin(open_nodes)) if open_nodes != [1] else placed
            by: dict[int, dict[int, list]] = {}
            for r in level_sums(placed, tried).collect():
                by.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"]))
            following = []
            for node in open_nodes:
                sums = by.get(node, {})
                for s in list(sums.values())[:1]:
                    ends[node] = (sum(x[1] for x in s), sum(x[2] for x in s))
                found = [(c, i) for i in tried if len(cuts[i]) for c in cut_gains(sums.get(i, []), len(cuts[i]), self.l2, self.least_hessian)]
                found = [x for x in found if x[0][0] > 1e-9]
                if not found:
                    continue
                # Sums of doubles differ in their last digits between runs; those do not decide.
                (gain, code, missing_left, left, right), i = max(found, key=lambda x: (float(f"{x[0][0]:.10g}"), -x[1], -x[0][1], -x[0][2]))
                tree.splits[node] = Split(i, code, float(cuts[i][code - 1]), bool(missing_left), gain)
                ends[2 * node], ends[2 * node + 1] = left, right
                following += [2 * node, 2 * node + 1]
            open_nodes = following
            if not open_nodes:
                break
        tree.leaves = {n: -self.step * g / (h + self.l2) for n, (g, h) in ends.items() if n not in tree.splits}
        tree.leaves.setdefault(1, 0.0) if not tree.splits else None
        return tree

    def fit(self, df: DataFrame) -> BoostedModel:
        cuts = bin_cuts(df, self.features, self.bins)
        rows = _binned(df, self.features, cuts, self.label, self.weight, self.row_keys)
        share = rows.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).head()[0]
        if share is None or not 0 < share < 1:
            raise ValueError("boosting needs rows of both classes")
        base = float(np.log(share / (1 - share)))
        model = BoostedModel(list(self.features), base, [])
        rows, since = rows.withColumn("m", F.lit(base)), []
        for t in range(self.rounds):
            margin = F.col("m")
            for tree in since:
                margin = margin + tree.walk(_left, lambda n, tree=tree: F.lit(tree.leaves[n]))
            if len(since) == TREES_IN_PLAN:
                rows, since, margin = materialise(rows.withColumn("m", margin)), [], F.col("m")
            taken = rows
            if self.row_share < 1:
                taken = rows.where(F.pmod(F.xxhash64("r", F.lit(self.seed * 100_003 + t)), F.lit(1_000_000)) < int(self.row_share * 1_000_000))
            tree = self._grown(logistic_sums(taken, margin), self._tried(t), cuts)
            model.trees.append(tree)
            since.append(tree)
        return model


def first_gains(df: DataFrame, estimator: BoostedTrees) -> DataFrame:
    """(feature, cut, gain, missing_left, base) of every cut of the root, from all rows and features."""
    cuts = bin_cuts(df, estimator.features, estimator.bins)
    rows = _binned(df, estimator.features, cuts, estimator.label, estimator.weight, estimator.row_keys)
    share = rows.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).head()[0]
    base = float(np.log(share / (1 - share)))
    sums = level_sums(logistic_sums(rows, F.lit(base)).withColumn("node", F.lit(1)), range(len(cuts))).collect()
    out = []
    for i, feature in enumerate(estimator.features):
        own = [(r["bin"], r["g"], r["h"]) for r in sums if r["feature"] == i]
        best: dict[int, tuple[float, bool]] = {}
        for gain, code, missing_left, _, _ in cut_gains(own, len(cuts[i]), estimator.l2, estimator.least_hessian):
            if code not in best or gain > best[code][0] * (1 + 1e-10):
                best[code] = (gain, missing_left)
        out += [(feature, float(cuts[i][c - 1]), g, m, base) for c, (g, m) in sorted(best.items())]
    return df.sparkSession.createDataFrame(out, "feature string, cut double, gain double, missing_left boolean, base double")
