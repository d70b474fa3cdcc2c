"""Quantiles by selection against numpy, and NaN as a missing value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskscope.operators import profiling, selection

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def samples():
    rng = np.random.default_rng(11)
    near = [1.0]
    for _ in range(40):
        near.append(math.nextafter(near[-1], 2.0))
    return {
        "continuous": rng.normal(size=4000),
        "heavy": np.exp(rng.normal(size=3000) * 60),
        "adjacent": rng.permutation(near * 5),
        "ties": rng.integers(0, 4, 1000).astype(float),
        "tiny": np.concatenate([rng.random(200) * 5e-324 * 1000, -rng.random(200) * 1e-310, [0.0, -0.0]]),
        "huge": rng.choice([-1.7e308, 1.7e308, 1.0], 301),
        "one": np.array([3.5]),
    }


@pytest.mark.parametrize("name", sorted(samples()))
def test_quantiles_are_exact(spark, name):
    x = samples()[name]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    found = {r.probability: r.quantile for r in selection.select_quantiles(df, ["x"], PROBABILITIES).collect()}
    ordered = np.sort(x)
    for p in PROBABILITIES:
        at = p * (len(x) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert found[p] == (low if low == high else low + (high - low) * (at - math.floor(at)))


def test_no_more_than_three_scans(spark, monkeypatch):
    scans = []
    plain = selection.tall_values
    monkeypatch.setattr(selection, "tall_values", lambda *a: scans.append(a) or plain(*a))
    rng = np.random.default_rng(2)
    wide = {"a": rng.normal(size=3000), "b": np.exp(rng.normal(size=3000) * 50), "c": 1 + rng.integers(0, 9, 3000) * 2.0**-52}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in wide.values()])), "a double, b double, c double")
    rows = profiling.describe(df, ["a", "b", "c"]).collect()
    assert len(scans) <= 3
    for r in rows:
        assert [r.q25, r.q50, r.q75] == pytest.approx(np.quantile(wide[r.feature], [0.25, 0.5, 0.75]).tolist(), rel=1e-15)
        assert r.mean == pytest.approx(wide[r.feature].mean()) and r["std"] == pytest.approx(wide[r.feature].std(ddof=1))


def test_groups_with_null_and_missing_values(spark):
    nan = float("nan")
    rows = [("a", 1.0, None), ("a", 2.0, None), ("a", nan, None), (None, 5.0, 1.0), (None, None, nan), (None, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r.feature, r.g): r.quantile for r in selection.select_quantiles(df, ["x", "y"], [0.5], ["g"]).collect()}
    assert got == {("x", "a"): 1.5, ("x", None): 6.0, ("y", None): 1.5}
    nothing = profiling.describe(df.where("false"), ["x"]).collect()
    assert [(r.feature, r.n, r.q50) for r in nothing] == [("x", 0, None)]
    assert profiling.extreme_outliers(df.where("false"), ["x"]).count() == 0


def test_beyond_the_shipped_cells_the_value_counts_serve(spark, monkeypatch):
    monkeypatch.setattr(selection, "SHIPPED_CELLS", 1)
    x = np.random.default_rng(3).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    row = selection.select_quartiles(df, ["x"]).head()
    assert [row.q25, row.q50, row.q75] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist())


def test_outliers_and_boxes(spark):
    x = [1.0, 2.0, 3.0, 4.0, 100.0, float("nan"), None]
    df = spark.createDataFrame([(v, "g") for v in x], "x double, g string")
    out = profiling.extreme_outliers(df, ["x"], reach=3.0).head()
    assert (out.low, out.high, out.n_outliers, out.pct_outliers) == (-4.0, 10.0, 1, 14.3)
    box = profiling.box_stats(df, ["x"], ["g"]).head()
    assert (box.q25, box.q50, box.q75, box.whisker_low, box.whisker_high, box.n_fliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_nan_is_missing_in_every_report(spark):
    nan = float("nan")
    rows = [(1.0, 2.0, 0), (2.0, 1.0, 1), (nan, 3.0, 1), (4.0, None, 0), (7.0, 9.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    plain = df.withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    for report in (
        lambda d: profiling.pearson_pairs(d, ["a", "b", "label"]),
        lambda d: profiling.label_correlation(d, ["a", "b"], "label"),
        lambda d: profiling.low_variance(d, ["a", "b"]),
        lambda d: profiling.vif(d, ["a", "b"]),
        lambda d: profiling.missing_profile(d, ["a", "b"]),
    ):
        got = sorted(map(tuple, report(df).collect()))
        assert got == sorted(map(tuple, report(plain).collect())) and "nan" not in repr(got)
