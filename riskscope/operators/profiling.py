"""Profiling of feature tables.

Every scan feeds one aggregation for all features: one wide row of aggregates, counts of
ordered cells for quantiles and bins, or, for ranks and dominant values, the distinct values of
each feature with their counts. Reports are a few rows per feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from riskscope.operators.selection import SHIPPED_CELLS, cell_counts, moments, select_quartiles, tall_values
from riskscope.scaling import join_on, number, running_counts, value_counts
from riskscope.session import materialise

SENTINEL = -1.0


def _tall(row: DataFrame, features: Sequence[str], measures: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One wide row of `<measure>__<feature>` columns to one row per feature."""
    entries = [
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{m}__{f}").alias(m) for m in measures])
        for f in features
    ]
    return row.select(*keep, F.explode(F.array(*entries)).alias("e")).select(*keep, "e.*")


def missing_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null count and percentage per feature."""
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(number(f).isNull()).alias(f"n_missing__{f}") for f in features],
    )
    return _tall(row, features, {"n_missing": "long"}, ["n_rows"]).select(
        "feature",
        "n_missing",
        F.round(100.0 * F.col("n_missing") / F.nullif("n_rows", F.lit(0)), 1).alias("pct_missing"),
    )


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per feature, in three scans at most."""
    cells = cell_counts(df, features)
    base = moments(cells).join(select_quartiles(df, features, cells=cells), "feature")
    named = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return named.join(base, "feature", "left").select(
        "feature", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def sentinel_profile(
    df: DataFrame, features: Sequence[str], sentinel: float = SENTINEL, warn_pct: float = 20.0
) -> DataFrame:
    """Rows holding the sentinel, their percentage, a warning flag, and rows above zero."""
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(f) == sentinel).alias(f"n_sentinel__{f}") for f in features],
        *[F.count_if(F.col(f) > 0).alias(f"n_positive__{f}") for f in features],
    )
    pct = 100.0 * F.col("n_sentinel") / F.nullif("n_rows", F.lit(0))
    return _tall(row, features, dict.fromkeys(["n_sentinel", "n_positive"]), ["n_rows"]).select(
        "feature",
        "n_sentinel",
        F.round(pct, 1).alias("pct_sentinel"),
        (pct > warn_pct).alias("is_warning"),
        "n_positive",
    )


def extreme_outliers(df: DataFrame, features: Sequence[str], reach: float = 3.0, warn_pct: float = 5.0) -> DataFrame:
    """Rows strictly beyond `reach` interquartile ranges, with a warning above `warn_pct`."""
    wide = F.col("q75") - F.col("q25")
    fences = select_quartiles(df, features).select(
        "feature", (F.col("q25") - reach * wide).alias("low"), (F.col("q75") + reach * wide).alias("high")
    )
    # One row per feature; null where a feature has no value.
    limits = {r["feature"]: (r["low"], r["high"]) for r in fences.collect()}
    outside = lambda f: F.count_if((number(f) < limits[f][0]) | (number(f) > limits[f][1]))
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[outside(f).alias(f"n_outliers__{f}") for f in limits])
    if not limits:
        return _no_rows(df, "feature string, low double, high double, n_outliers long, pct_outliers double, is_warning boolean")
    pct = 100.0 * F.col("n_outliers") / F.col("n_rows")
    bounds = df.sparkSession.createDataFrame([(f, *b) for f, b in limits.items()], "feature string, low double, high double")
    return _tall(row, list(limits), {"n_outliers": "long"}, ["n_rows"]).join(bounds, "feature").select(
        "feature",
        "low",
        "high",
        "n_outliers",
        F.round(pct, 1).alias("pct_outliers"),
        (pct > warn_pct).alias("is_warning"),
    )


def _no_rows(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def _shipped(table: DataFrame) -> DataFrame:
    """A table of one row per feature and group, broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= SHIPPED_CELLS else table


def histogram(df: DataFrame, features: Sequence[str], bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the range of each (feature, by…), the maximum in the last bin.

    Empty bins are kept. A range of zero width is widened by one half on each side. Two scans:
    one for the ranges, one that counts rows by bin.
    """
    values = tall_values(df, features, by)
    width = F.when(F.max("value") == F.min("value"), 0.5).otherwise(0.0)
    ranges = materialise(
        values.groupBy("feature", *by).agg(
            (F.min("value") - width).alias("low"), (F.max("value") + width).alias("high")
        )
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = lambda i: F.col("low") + i * ((F.col("high") - F.col("low")) / bins)
    raw = F.least(
        F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)
    )
    placed = join_on(values, _shipped(ranges), ["feature", *by]).withColumn("__raw", raw).select(
        "feature",
        *by,
        (
            F.col("__raw")
            - F.when(F.col("value") < edge(F.col("__raw")), 1).otherwise(0)
            + F.when(
                (F.col("__raw") < bins - 1) & (F.col("value") >= edge(F.col("__raw") + 1)), 1
            ).otherwise(0)
        ).cast("int").alias("bin"),
    )
    filled = placed.groupBy("feature", *by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return (
        join_on(grid, filled, ["feature", *by, "bin"], "left")
        .na.fill({"n": 0})
        .select(
            "feature",
            *by,
            "bin",
            edge(F.col("bin")).alias("bin_low"),
            edge(F.col("bin") + 1).alias("bin_high"),
            "n",
        )
    )


def box_stats(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and fliers per (feature, by…)."""
    q = materialise(select_quartiles(df, features, by))
    iqr = F.col("q75") - F.col("q25")
    inside = F.col("value").between(F.col("q25") - 1.5 * iqr, F.col("q75") + 1.5 * iqr)
    return (
        join_on(tall_values(df, features, by), _shipped(q), ["feature", *by])
        .groupBy("feature", *by)
        .agg(
            F.max("q25").alias("q25"),
            F.max("q50").alias("q50"),
            F.max("q75").alias("q75"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_fliers"),
        )
    )


def mann_whitney(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Two-sided rank test of each feature between labels 0 and 1.

    Ranks are averaged over ties, on value counts instead of rows. Features need more than
    five values on each side. `u` belongs to label 0; `z` carries tie and continuity corrections.
    """
    one = value_counts(df.where(F.col(label).isin(0, 1)), features, [label])
    counts = one.groupBy("feature", "value").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("n0"),
    )
    ranked = running_counts(counts, [], ["n"])
    rank = F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2.0
    n = F.col("n").cast("double")
    sums = ranked.groupBy("feature").agg(
        F.sum("n0").alias("n_safe"),
        (F.sum("n") - F.sum("n0")).alias("n_risk"),
        F.sum(rank * F.col("n0")).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
    ).where((F.col("n_safe") > 5) & (F.col("n_risk") > 5))
    a, b = F.col("n_safe").cast("double"), F.col("n_risk").cast("double")
    total = a + b
    u = F.col("rank_sum") - a * (a + 1) / 2
    sigma = F.sqrt(a * b / 12 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    return sums.withColumn("u", u).select(
        "feature",
        "n_safe",
        "n_risk",
        "u",
        (F.col("ties") > 0).alias("has_ties"),
        F.try_divide(F.greatest("u", a * b - F.col("u")) - a * b / 2 - 0.5, sigma).alias("z"),
    )


def exact_mann_whitney_p(u: float, n_safe: int, n_risk: int) -> float:
    """Exact two-sided p of a rank test without ties, by counting arrangements.

    The arrangements with a given U are the coefficients of a Gaussian binomial, and only the
    tail is needed: dividing by 1 - q^i is a running sum in steps of i, multiplying by
    1 - q^(n+i) a shifted difference.
    """
    m, n = sorted((n_safe, n_risk))
    tail = m * n - math.ceil(max(u, m * n - u)) + 1
    if tail <= 0:
        return 0.0
    ways = np.zeros(tail)
    ways[0] = 1.0
    for i in range(1, m + 1):
        for start in range(min(i, tail)):
            ways[start::i] = np.cumsum(ways[start::i])
        if n + i < tail:
            ways[n + i :] -= ways[: tail - n - i].copy()
    return min(1.0, 2.0 * float(ways.sum()) / float(math.comb(m + n, m)))


def with_mann_whitney_p(tests: DataFrame, exact_rows: int = 8) -> DataFrame:
    """Add p and a significance mark to `mann_whitney` rows (one row per feature).

    Without ties and with a side of at most `exact_rows` rows the distribution is exact,
    however large the other side; otherwise it is the normal approximation.
    """

    def finish(batches):
        for pdf in batches:
            p = []
            for row in pdf.itertuples():
                small = min(row.n_safe, row.n_risk) <= exact_rows and not row.has_ties
                if small:
                    p.append(exact_mann_whitney_p(row.u, row.n_safe, row.n_risk))
                else:
                    p.append(min(1.0, math.erfc(row.z / math.sqrt(2.0))))
            pdf["p"] = pd.Series(p, index=pdf.index, dtype="float64")
            yield pdf

    rows = tests.mapInPandas(finish, _with_p(tests))
    return rows.withColumn("mark", significance(F.col("p")))


def _with_p(tests: DataFrame) -> T.StructType:
    return T.StructType([*tests.schema.fields, T.StructField("p", T.DoubleType())])


def significance(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "*").otherwise("ns")


def _complete_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns without nulls, from one row of counts."""
    row = df.agg(F.count(F.lit(1)), *[F.count(c) for c in columns]).head()
    return {c for c, n in zip(columns, row[1:]) if n == row[0]}


def _pearson(a: str, b: str, complete: set[str]) -> Column:
    """Correlation over complete pairs; null where a side is constant.

    A deviation that no null of the other side can change is shared by all pairs of its column.
    """
    kept = lambda x, y: F.col(x) if y in complete else F.when(F.col(y).isNotNull(), F.col(x))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(kept(a, b)) * F.stddev_pop(kept(b, a)), F.lit(0.0))


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, r) for i < j, over complete pairs; null where a side is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.select(*[number(c).alias(c) for c in columns])
    complete = _complete_columns(wide, columns)
    row = wide.agg(*[_pearson(a, b, complete).alias(f"r__{a}__{b}") for a, b in pairs])
    entries = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r__{a}__{b}").alias("r"))
        for a, b in pairs
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def correlated_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.7) -> DataFrame:
    return pearson_pairs(df, features).where(F.abs("r") > threshold)


def label_correlation(df: DataFrame, features: Sequence[str], label: str, weak: float = 0.05) -> DataFrame:
    """r of each feature with the label; weak below `weak` in absolute value."""
    wide = df.select(*[number(c).alias(c) for c in [*features, label]])
    complete = _complete_columns(wide, [*features, label])
    row = wide.agg(*[_pearson(f, label, complete).alias(f"r__{f}") for f in features])
    return _tall(row, features, {"r": "double"}).withColumn(
        "is_weak", F.coalesce(F.abs("r") < weak, F.lit(False))
    )


def leak_check(df: DataFrame, total: str, source: str, threshold: float = 0.5) -> DataFrame:
    """Correlation of the total count with the column that defines the label."""
    return pearson_pairs(df, [total, source]).withColumn(
        "is_leak", F.coalesce(F.abs("r") > threshold, F.lit(False))
    )


def low_variance(df: DataFrame, features: Sequence[str], flag_pct: float = 95.0) -> DataFrame:
    """Distinct values, dominant value (smallest on ties) and share, sample variance."""
    counts = value_counts(df, features)
    by_value = counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("dominant_value"),
        F.max("n").alias("top"),
        F.sum("n").alias("total"),
    )
    row = df.agg(*[F.var_samp(number(f)).alias(f"variance__{f}") for f in features])
    pct = F.round(100.0 * F.col("top") / F.col("total"), 1)
    return by_value.join(_tall(row, features, {"variance": "double"}), "feature").select(
        "feature",
        "n_unique",
        "dominant_value",
        pct.alias("dominant_pct"),
        F.round(F.coalesce("variance", F.lit(0.0)), 4).alias("variance"),
        (pct >= flag_pct).alias("is_quasi_constant"),
    )


def class_balance(df: DataFrame, label: str, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Rows per label, percentages, ratio 1/0 and an alert outside [low, high]."""
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("n_safe"),
        F.count_if(F.col(label) == 1).alias("n_risk"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    pct = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col("n_rows")), 1)
    ratio = F.when((F.col("n_risk") > 0), F.try_divide(F.col("n_risk"), F.col("n_safe")))
    return row.select(
        "n_safe",
        "n_risk",
        pct("n_safe").alias("pct_safe"),
        pct("n_risk").alias("pct_risk"),
        ratio.alias("ratio"),
        F.coalesce((ratio < low) | (ratio > high), F.lit(True)).alias("is_imbalanced"),
    )


def constant_label(df: DataFrame, label: str) -> bool:
    """True when the label has one class only, so nothing can be trained or evaluated on it."""
    low, high = df.agg(F.min(label), F.max(label)).head()
    return low == high


def constant_labels(df: DataFrame, label: str, by: str) -> DataFrame:
    """(by, is_constant): the same for every value of a column, in one aggregation."""
    return df.groupBy(by).agg((F.min(label) == F.max(label)).alias("is_constant"))


def rate_by_group(df: DataFrame, group: str, label: str, min_rows: int = 3) -> DataFrame:
    """Label rate and rows per group; groups of one label only are marked."""
    return (
        df.groupBy(group)
        .agg(F.avg(F.col(label).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn(
            "note",
            F.when((F.col("n_rows") >= min_rows) & (F.col("rate") == 1), "all risk")
            .when((F.col("n_rows") >= min_rows) & (F.col("rate") == 0), "all safe")
            .otherwise(""),
        )
    )


def contingency(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """2×2 cells of each binary feature with the label; both levels must occur."""
    cell = lambda f, x, y: F.count_if((F.col(f) == x) & (F.col(label) == y))
    row = df.agg(
        *[
            cell(f, x, y).alias(f"n{x}{y}__{f}")
            for f in features
            for x in (0, 1)
            for y in (0, 1)
        ]
    )
    return _tall(row, features, dict.fromkeys(["n00", "n01", "n10", "n11"])).where(
        (F.col("n00") + F.col("n01") > 0) & (F.col("n10") + F.col("n11") > 0)
    )


def binary_rates(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Label rate and rows where a flag is 0 and where it is 1."""
    cells = contingency(df, features, label)
    return cells.select(
        "feature",
        (F.col("n00") + F.col("n01")).alias("n_0"),
        F.try_divide(F.col("n01"), F.col("n00") + F.col("n01")).alias("rate_0"),
        (F.col("n10") + F.col("n11")).alias("n_1"),
        F.try_divide(F.col("n11"), F.col("n10") + F.col("n11")).alias("rate_1"),
    )


def chi2_yates(cells: DataFrame) -> DataFrame:
    """χ² with Yates correction of `contingency` rows whose cells are all at least five."""
    d = lambda c: F.col(c).cast("double")
    row0, row1 = d("n00") + d("n01"), d("n10") + d("n11")
    col0, col1 = d("n00") + d("n10"), d("n01") + d("n11")
    total = row0 + row1

    def part(cell: str, row: Column, col: Column) -> Column:
        expected = row * col / total
        gap = F.abs(d(cell) - expected)
        corrected = gap - F.least(F.lit(0.5), gap)
        return corrected * corrected / expected

    return cells.where(F.least("n00", "n01", "n10", "n11") >= 5).select(
        "feature",
        (
            part("n00", row0, col0) + part("n01", row0, col1) + part("n10", row1, col0) + part("n11", row1, col1)
        ).alias("chi2"),
        (d("n01") / row0).alias("rate_0"),
        (d("n11") / row1).alias("rate_1"),
    )


def with_chi2_p(tests: DataFrame) -> DataFrame:
    """Add p for one degree of freedom, a mark, and whether the feature separates the labels."""

    def finish(batches):
        for pdf in batches:
            pdf["p"] = [math.erfc(math.sqrt(x / 2.0)) for x in pdf["chi2"]]
            yield pdf

    rows = tests.mapInPandas(finish, _with_p(tests))
    separates = (F.col("p") < 0.05) & (F.abs(F.col("rate_1") - F.col("rate_0")) > 0.1)
    return rows.withColumn("mark", significance(F.col("p"))).withColumn("separates", separates)


def vif(df: DataFrame, features: Sequence[str], fill: float = SENTINEL) -> DataFrame:
    """Variance inflation factor per feature; infinite for constant or collinear ones.

    One pass builds the k×k covariance matrix; only that matrix reaches the driver.
    """
    wide = df.select(*[F.coalesce(number(f), F.lit(fill)).alias(f) for f in features])
    k = len(features)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = wide.agg(*[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in cells]).head()
    cov = np.zeros((k, k))
    for i, j in cells:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    result = [(f, float(v)) for f, v in zip(features, vif_from_covariance(cov))]
    return df.sparkSession.createDataFrame(result, "feature string, vif double").withColumn(
        "band", F.when(F.col("vif") > 10, "high").when(F.col("vif") > 5, "moderate").otherwise("low")
    )


def vif_from_covariance(cov: np.ndarray) -> np.ndarray:
    """1/(1−R²) of each variable on the others by least squares on the correlation matrix."""
    std = np.sqrt(np.diag(cov))
    live = std > 0
    corr = np.divide(cov, np.outer(std, std), out=np.zeros_like(cov), where=np.outer(live, live))
    out = np.full(len(std), np.inf)
    for i in np.flatnonzero(live):
        others = [j for j in np.flatnonzero(live) if j != i]
        r = corr[others, i]
        solution = np.linalg.lstsq(corr[np.ix_(others, others)], r, rcond=1e-10)[0] if others else r
        r2 = float(r @ solution)
        if r2 < 1 - 1e-9:
            out[i] = round(1.0 / (1.0 - r2), 2)
    return out


def recommendations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Recommendations that follow from label share and row count."""
    row = df.agg(F.avg(F.col(label).cast("double")).alias("share"), F.count(F.lit(1)).alias("n_rows"))
    k = len(features)
    rules = [
        F.when((F.col("share") < 0.1) | (F.col("share") > 0.9), "resample the minority class"),
        F.when(F.col("n_rows") < 10 * k, "few rows for the number of features"),
        F.lit("compare metrics with and without the flagged features"),
        F.lit("rerun the pipeline after adjusting the features"),
    ]
    kept = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return row.select(F.lit("recommendations").alias("category"), F.explode(kept).alias("message"))


def findings_report(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(category, message) rows gathered from the separate reports."""
    row = lambda category, message: [F.lit(category).alias("category"), message.alias("message")]
    shown = lambda c, digits: F.format_number(c, digits)
    missing = missing_profile(df, features)
    balance = class_balance(df, label)
    pairs = correlated_pairs(df, features)
    flat = low_variance(df, features).where("is_quasi_constant")
    weak = label_correlation(df, features, label).where("is_weak")
    outliers = extreme_outliers(df, features).where("is_warning")
    parts = [
        missing.where("n_missing > 0").select(
            *row("warnings", F.concat("feature", F.lit(": missing "), shown("pct_missing", 1), F.lit("%")))
        ),
        balance.select(
            F.when(F.col("is_imbalanced"), "warnings").otherwise("findings").alias("category"),
            F.concat(F.lit("label ratio "), F.coalesce(shown("ratio", 2), F.lit("undefined"))).alias("message"),
        ),
        outliers.select(*row("warnings", F.concat("feature", F.lit(": extreme outliers "), F.col("n_outliers")))),
        pairs.select(
            *row("warnings", F.concat("feature_a", F.lit(" and "), "feature_b", F.lit(": r = "), shown("r", 3)))
        ),
        flat.select(*row("warnings", F.concat("feature", F.lit(": quasi-constant")))),
        weak.select(*row("findings", F.concat("feature", F.lit(": hardly correlated with the label")))),
        recommendations(df, features, label),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
