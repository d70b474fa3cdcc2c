"""Statistics, metrics and splits against hand-computed values and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from riskscope import scaling
from riskscope.operators import evaluation, folds, profiling, scoring


def frame(spark, **columns):
    names = list(columns)
    kinds = {int: "int", float: "double", str: "string"}
    first = lambda c: next(v for v in c if v is not None)
    schema = ", ".join(f"{n} {kinds[type(first(columns[n]))]}" for n in names)
    return spark.createDataFrame(list(zip(*columns.values())), schema)


A = [1.0, 2, 3, 4, 5, 6, 7, 7, 8]
B = [5.0, 6, 7, 8, 9, 10, 11, 12, 13, 13]


def test_mann_whitney(spark):
    df = frame(spark, x=[float(v) for v in A + B], label=[0] * len(A) + [1] * len(B))
    row = profiling.with_mann_whitney_p(profiling.mann_whitney(df, ["x"], "label")).head()
    assert row.u == 10.5 and row.has_ties
    assert row.z == pytest.approx(2.785881, abs=1e-6) and row.p == pytest.approx(0.005338, abs=1e-6)
    assert row.mark == "***"


def test_exact_mann_whitney_p():
    m, n = 6, 7
    pooled = range(m + n)
    us = [sum(ranks) - m * (m - 1) // 2 for ranks in itertools.combinations(pooled, m)]
    for u in (3, 10, 21, 30):
        top = max(u, m * n - u)
        expected = min(1.0, 2 * sum(v >= top for v in us) / len(us))
        assert profiling.exact_mann_whitney_p(u, m, n) == pytest.approx(expected)


def test_chi2(spark):
    data = [(0, 0)] * 20 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 15
    df = spark.createDataFrame(data, "flag int, label int")
    row = profiling.with_chi2_p(profiling.chi2_yates(profiling.contingency(df, ["flag"], "label"))).head()
    assert row.chi2 == pytest.approx(6.75) and row.p == pytest.approx(0.009375, abs=1e-6) and row.separates


Y = [1, 0, 1, 1, 0, 0, 1, 0]
S = [0.9, 0.9, 0.8, 0.6, 0.6, 0.5, 0.4, 0.1]


def test_metrics(spark):
    df = frame(spark, y=Y, s=S).withColumn("p", evaluation.predicted(F.col("s")))
    assert evaluation.roc_auc(df, "y", "s").head()[0] == pytest.approx(0.625)
    assert evaluation.average_precision(df, "y", "s").head()[0] == pytest.approx(0.584524, abs=1e-6)
    m = evaluation.binary_metrics(df, "y", "p").head()
    assert (m.tp, m.fp, m.fn, m.tn) == (3, 3, 1, 1)
    assert (m.mcc, m.balanced_accuracy) == (0.0, 0.5) and m.f1 == pytest.approx(0.6)
    one = df.withColumn("p", F.lit(1))
    assert evaluation.binary_metrics(one, "y", "p").head().mcc == 0


def test_one_class(spark):
    df = frame(spark, y=[0, 0], s=[0.2, 0.7]).withColumn("p", evaluation.predicted(F.col("s")))
    assert evaluation.roc_auc(df, "y", "s").head()[0] is None
    assert evaluation.average_precision(df, "y", "s").head()[0] is None
    m = evaluation.binary_metrics(df, "y", "p").head()
    assert m.balanced_accuracy == 0.5 and m.f1 == 0


def test_large_counts_stay_in_range(spark):
    huge = spark.createDataFrame([(10**15, 10**14, 10**14, 10**15)], "tp long, fp long, fn long, tn long")
    expected = (1e30 - 1e28) / (1.1e15 * 1.1e15)
    assert huge.select(evaluation.mcc()).head()[0] == pytest.approx(expected)


@pytest.mark.parametrize("slices", [2, 7])
def test_quantiles_against_numpy(spark, slices):
    random.seed(slices)
    x = [random.choice([0.0, 0.0, random.random() * 10]) for _ in range(500)]
    counts = scaling.value_counts(frame(spark, x=x), ["x"])
    spark.conf.set("spark.sql.shuffle.partitions", str(max(4, slices)))
    found = scaling.exact_quantiles(counts, [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for r in found:
        assert r["quantile"] == pytest.approx(float(np.quantile(x, r.probability)))


def test_small_quartiles(spark):
    row = profiling.describe(frame(spark, x=[1.0, 2.0, 3.0, 10.0]), ["x"]).head()
    assert (row.q25, row.q50, row.q75) == (1.75, 2.5, 4.75)


def test_constant_columns(spark):
    df = frame(spark, a=[1.0, 1.0, 1.0], b=[2.0, 3.0, 5.0], label=[0, 1, 1])
    assert profiling.pearson_pairs(df, ["a", "b"]).head().r is None
    assert profiling.correlated_pairs(df, ["a", "b"]).count() == 0
    vif = dict(rows(profiling.vif(df, ["a", "b"]), "feature", "vif"))
    assert math.isinf(vif["a"]) and vif["b"] == 1.0


def test_vif_collinear(spark):
    random.seed(1)
    a = [random.random() for _ in range(60)]
    b = [random.random() for _ in range(60)]
    df = frame(spark, a=a, b=b, c=[x + y for x, y in zip(a, b)], d=[random.random() for _ in a])
    vif = dict(rows(profiling.vif(df, ["a", "b", "c", "d"]), "feature", "vif"))
    assert all(math.isinf(vif[f]) for f in "abc") and vif["d"] < 2


def test_pearson_incomplete_pairs(spark):
    a, b = [1.0, 2.0, None, 4.0, 7.0], [2.0, None, 1.0, 3.0, 9.0]
    r = profiling.pearson_pairs(frame(spark, a=a, b=b), ["a", "b"]).head().r
    assert r == pytest.approx(np.corrcoef([1, 4, 7], [2, 3, 9])[0, 1])


def test_histogram(spark):
    df = frame(spark, x=[float(i) / 3 for i in range(31)], label=[i % 2 for i in range(31)])
    found = profiling.histogram(df, ["x"], 30).orderBy("bin").collect()
    counts, edges = np.histogram([float(i) / 3 for i in range(31)], bins=30)
    assert [r.n for r in found] == counts.tolist()
    assert [r.bin_low for r in found] == pytest.approx(edges[:-1].tolist())
    same = profiling.histogram(frame(spark, x=[4.0, 4.0]), ["x"], 30).where("n > 0").collect()
    assert [(r.bin, r.n) for r in same] == [(15, 2)]


def test_low_variance_ties(spark):
    row = profiling.low_variance(frame(spark, x=[3.0, 3.0, 1.0, 1.0, 2.0]), ["x"]).head()
    assert (row.dominant_value, row.dominant_pct, row.n_unique) == (1.0, 40.0, 3)


def test_class_balance_one_label(spark):
    row = profiling.class_balance(frame(spark, label=[0, 0]), "label").head()
    assert row.ratio is None and row.is_imbalanced
    assert profiling.constant_label(frame(spark, label=[0, 0]), "label")


def test_votes_and_bands(spark):
    df = frame(spark, file=["a", "a", "b"], y=[1, 1, 0], p=[1, 0, 0])
    assert rows(evaluation.group_vote(df, "file", "y", "p"), "file", "label", "vote") == [("a", 1, 1), ("b", 0, 0)]
    bands = frame(spark, s=[0.39, 0.40, 0.69, 0.70]).select(scoring.risk_band(F.col("s")))
    assert [r[0] for r in bands.collect()] == ["Faible", "Moyen", "Moyen", "Élevé"]
    assert scoring.top_rows(df, "p", ["file", "y"], n=1).count() == 1


def test_stratified_folds(spark):
    df = spark.range(2000).select((F.col("id") % 100).alias("g"), (F.col("id") % 100 < 30).cast("int").alias("y"))
    assigned = folds.stratified_group_folds(df, "g", "y")
    mix = assigned.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()
    assert sorted((r.n, r.pos) for r in mix) == [(20, 6)] * 5
    attached = folds.attach_folds(df, assigned, "g")
    assert attached.count() == 2000 and attached.groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0


def test_group_split(spark):
    df = spark.range(1000).select((F.col("id") % 25).alias("g"))
    parts = dict(rows(folds.group_split(df, "g").groupBy("part").count()))
    assert parts == {"test": 8, "train": 17}


def _hot(spark):
    """One key holds most rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(-1).alias("k"), (F.col("id") * 37 % 3001).alias("pos")
    )


@pytest.mark.parametrize("width", [1, 64, 1 << 20])
def test_bucketed_position(spark, width):
    bucket = scaling.position_bucket(F.col("pos"), width)
    found = scaling.bucketed_position(_hot(spark), ["k"], bucket, [F.col("pos")], "n", "total")
    plain = _hot(spark).selectExpr(
        "k", "pos", "row_number() OVER (PARTITION BY k ORDER BY pos) AS n", "count(*) OVER (PARTITION BY k) AS total"
    )
    assert rows(found, "k", "pos", "n", "total") == rows(plain, "k", "pos", "n", "total")


def test_checked_position_large_group(spark):
    plain = _hot(spark).selectExpr("k", "pos", "row_number() OVER (PARTITION BY k ORDER BY pos) AS n")
    assert rows(scaling.checked_position(_hot(spark), ["k"], ["pos"], "n"), "k", "pos", "n") == rows(plain, "k", "pos", "n")


def test_running_counts(spark):
    df = frame(spark, x=[float(i % 13) for i in range(200)], g=[i % 2 for i in range(200)])
    counts = scaling.value_counts(df, ["x"], ["g"])
    counts.createOrReplaceTempView("vc")
    plain = spark.sql("SELECT g, value, sum(n) OVER (PARTITION BY g ORDER BY value) AS up FROM vc")
    found = scaling.running_counts(counts, ["g"], ["n"])
    assert rows(found, "g", "value", "n_upto") == rows(plain, "g", "value", "up")


def test_null_groups_and_nan(spark):
    data = [(None, 1.0, 0), (None, 3.0, 1), ("a", 2.0, 1), ("a", float("nan"), 0), ("a", 1.0, 0)]
    df = spark.createDataFrame(data, "g string, x double, y int")
    assert {r.g for r in profiling.histogram(df, ["x"], 2, ["g"]).collect()} == {None, "a"}
    assert {r.g: r.roc_auc for r in evaluation.roc_auc(df.where(~F.isnan("x")), "y", "x", ["g"]).collect()} == {None: 1.0, "a": 1.0}
    row = profiling.describe(df, ["x"]).head()
    assert (row.n, row.max, row["mean"]) == (4, 3.0, 1.75)


def test_exact_rank_p_for_one_small_side():
    from itertools import combinations

    for m, n in ((3, 5), (2, 9), (4, 4)):
        us = [sum(c) - m * (m + 1) // 2 for c in combinations(range(1, m + n + 1), m)]
        for u in set(us):
            top = max(u, m * n - u)
            want = min(1.0, 2 * sum(x >= top for x in us) / len(us))
            assert abs(profiling.exact_mann_whitney_p(u, m, n) - want) < 1e-9
    assert 0.0 < profiling.exact_mann_whitney_p(400_000, 2, 300_000) <= 1.0
