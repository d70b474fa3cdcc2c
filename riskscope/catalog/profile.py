"""Profiling reports on the feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscope.catalog.registry import register
from riskscope.catalog.tables import FEATURES, FEATURES_SQL, FLAGS, features, rounded, tall_sql
from riskscope.operators import profiling

_TALL = f"{FEATURES_SQL}, {tall_sql(FEATURES)}"


@register(
    "missing_profile",
    f"""WITH {_TALL} SELECT feature, count(*) FILTER (value IS NULL) AS n_missing,
        round(100.0 * count(*) FILTER (value IS NULL) / count(*), 1) AS pct_missing FROM tall GROUP BY feature""",
)
def missing_profile(spark, sf_dir):
    return profiling.missing_profile(features(spark, sf_dir), FEATURES)


_QUARTILES = """
quart AS (SELECT feature, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
                 quantile_cont(value, 0.75) AS q75 FROM tall WHERE value IS NOT NULL GROUP BY feature)"""


@register(
    "describe",
    f"""WITH {_TALL}, {_QUARTILES}
    SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
           round(min(value), 6) AS min, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50,
           round(any_value(q75), 6) AS q75, round(max(value), 6) AS max
    FROM tall JOIN quart USING (feature) GROUP BY feature""",
)
def describe(spark, sf_dir):
    return rounded(profiling.describe(features(spark, sf_dir), FEATURES))


@register(
    "sentinel_profile",
    f"""WITH {_TALL}
    SELECT feature, count(*) FILTER (value = -1) AS n_sentinel,
           round(100.0 * count(*) FILTER (value = -1) / count(*), 1) AS pct_sentinel,
           100.0 * count(*) FILTER (value = -1) / count(*) > 5 AS is_warning,
           count(*) FILTER (value > 0) AS n_positive
    FROM tall GROUP BY feature""",
)
def sentinel_profile(spark, sf_dir):
    return profiling.sentinel_profile(features(spark, sf_dir), FEATURES, warn_pct=5.0)


@register(
    "extreme_outliers",
    f"""WITH {FEATURES_SQL.replace("l_extendedprice AS price", "l_extendedprice * l_extendedprice AS price")},
    {tall_sql(FEATURES)}, {_QUARTILES},
    fences AS (SELECT feature, q25 - 1.0 * (q75 - q25) AS low, q75 + 1.0 * (q75 - q25) AS high FROM quart)
    SELECT feature, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high,
           count(*) FILTER (value < low OR value > high) AS n_outliers,
           round(100.0 * count(*) FILTER (value < low OR value > high) / count(*), 1) AS pct_outliers,
           100.0 * count(*) FILTER (value < low OR value > high) / count(*) > 5 AS is_warning
    FROM tall JOIN fences USING (feature) GROUP BY feature""",
)
def extreme_outliers(spark, sf_dir):
    """On squared prices and a reach of one range, so that the fences cut something."""
    df = features(spark, sf_dir).withColumn("price", F.col("price") * F.col("price"))
    return rounded(profiling.extreme_outliers(df, FEATURES, reach=1.0), 4)


@register(
    "histogram_by_label",
    f"""WITH {_TALL},
    ranges AS (SELECT feature, label, min(value) AS low, max(value) AS high FROM tall
               WHERE value IS NOT NULL GROUP BY feature, label),
    grid AS (SELECT *, unnest(range(30)) AS bin FROM ranges),
    raw AS (SELECT feature, label, value, low, high,
                   least(floor((value - low) / (high - low) * 30), 29) AS b
            FROM tall JOIN ranges USING (feature, label) WHERE value IS NOT NULL),
    placed AS (SELECT feature, label, b
                 - CASE WHEN value < low + b * ((high - low) / 30) THEN 1 ELSE 0 END
                 + CASE WHEN b < 29 AND value >= low + (b + 1) * ((high - low) / 30) THEN 1 ELSE 0 END AS bin
               FROM raw),
    filled AS (SELECT feature, label, bin::BIGINT AS bin, count(*) AS n FROM placed GROUP BY ALL)
    SELECT feature, label, bin::INT AS bin, round(low + bin * ((high - low) / 30), 6) AS bin_low,
           round(low + (bin + 1) * ((high - low) / 30), 6) AS bin_high, coalesce(n, 0) AS n
    FROM grid LEFT JOIN filled USING (feature, label, bin)""",
)
def histogram_by_label(spark, sf_dir):
    return rounded(profiling.histogram(features(spark, sf_dir), FEATURES, 30, ["label"]))


@register(
    "histogram_null_group",
    f"""WITH {FEATURES_SQL}, t AS (SELECT nullif(method % 3, 0) AS grp, quantity::DOUBLE AS value FROM features),
    r AS (SELECT grp, min(value) AS low, max(value) AS high FROM t GROUP BY grp),
    b AS (SELECT t.grp, least(floor((value - low) / (high - low) * 10), 9) AS bin FROM t JOIN r ON t.grp IS NOT DISTINCT FROM r.grp),
    g AS (SELECT grp, unnest(range(10)) AS bin FROM r), n AS (SELECT grp, bin, count(*) AS n FROM b GROUP BY ALL)
    SELECT g.grp, g.bin::INT AS bin, coalesce(n, 0) AS n FROM g LEFT JOIN n ON g.grp IS NOT DISTINCT FROM n.grp AND g.bin = n.bin""",
)
def histogram_null_group(spark, sf_dir):
    """Rows whose group is null have bins like any other group."""
    df = features(spark, sf_dir).withColumn("grp", F.nullif(F.col("method") % 3, F.lit(0)))
    return profiling.histogram(df, ["quantity"], 10, ["grp"]).select("grp", "bin", "n")


@register(
    "box_stats",
    f"""WITH {_TALL},
    quart AS (SELECT feature, label, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
                     quantile_cont(value, 0.75) AS q75 FROM tall WHERE value IS NOT NULL GROUP BY ALL),
    marked AS (SELECT *, value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside
               FROM tall JOIN quart USING (feature, label) WHERE value IS NOT NULL)
    SELECT feature, label, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50,
           round(any_value(q75), 6) AS q75, round(min(value) FILTER (inside), 6) AS whisker_low,
           round(max(value) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS n_fliers
    FROM marked GROUP BY feature, label""",
)
def box_stats(spark, sf_dir):
    return rounded(profiling.box_stats(features(spark, sf_dir), FEATURES, ["label"]))


@register(
    "mann_whitney",
    f"""WITH {_TALL},
    vc AS (SELECT feature, value, count(*) AS n, count(*) FILTER (label = 0) AS n0 FROM tall
           WHERE value IS NOT NULL GROUP BY ALL),
    ranked AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value) - n + (n + 1) / 2.0 AS rnk FROM vc),
    sums AS (SELECT feature, sum(n0)::DOUBLE AS a, (sum(n) - sum(n0))::DOUBLE AS b,
                    sum(rnk * n0)::DOUBLE AS rs, sum(n::DOUBLE * n * n - n) AS ties FROM ranked GROUP BY feature),
    tests AS (SELECT *, rs - a * (a + 1) / 2 AS u FROM sums WHERE a > 5 AND b > 5)
    SELECT feature, a::BIGINT AS n_safe, b::BIGINT AS n_risk, round(u, 3) AS u, ties > 0 AS has_ties,
           round((greatest(u, a * b - u) - a * b / 2 - 0.5)
                 / sqrt(a * b / 12 * ((a + b + 1) - ties / ((a + b) * (a + b - 1)))), 6) AS z
    FROM tests""",
)
def mann_whitney(spark, sf_dir):
    tests = profiling.mann_whitney(features(spark, sf_dir), FEATURES, "label")
    return tests.withColumn("u", F.round("u", 3)).withColumn("z", F.round("z", 6))


def _pairs_sql(columns: list[str]) -> str:
    rows = [
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM features"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return " UNION ALL ".join(rows)


@register("pearson_pairs", f"WITH {FEATURES_SQL} {_pairs_sql([*FEATURES, 'label'])}")
def pearson_pairs(spark, sf_dir):
    return rounded(profiling.pearson_pairs(features(spark, sf_dir), [*FEATURES, "label"]))


_WITH_SUM = FEATURES_SQL.replace("AS score", "AS score, l_quantity + 4 * l_linenumber AS mixed")


@register(
    "correlated_pairs",
    f"WITH {_WITH_SUM} SELECT * FROM ({_pairs_sql([*FEATURES, 'mixed'])}) WHERE abs(r) > 0.7",
)
def correlated_pairs(spark, sf_dir):
    df = features(spark, sf_dir).withColumn("mixed", F.col("quantity") + 4 * F.col("line_no"))
    return rounded(profiling.correlated_pairs(df, [*FEATURES, "mixed"]))


@register(
    "label_correlation",
    f"WITH {FEATURES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(corr({f}, label), 6) AS r, abs(corr({f}, label)) < 0.05 AS is_weak FROM features"
        for f in FEATURES
    ),
)
def label_correlation(spark, sf_dir):
    return rounded(profiling.label_correlation(features(spark, sf_dir), FEATURES, "label"))


@register(
    "leak_check",
    """WITH per_part AS (SELECT l_partkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS returned
                        FROM lineitem GROUP BY l_partkey)
    SELECT 'total' AS feature_a, 'returned' AS feature_b, round(corr(total, returned), 6) AS r,
           abs(corr(total, returned)) > 0.5 AS is_leak FROM per_part""",
)
def leak_check(spark, sf_dir):
    per_part = features(spark, sf_dir).groupBy("part").agg(
        F.count(F.lit(1)).alias("total"), F.sum("label").alias("returned")
    )
    return rounded(profiling.leak_check(per_part, "total", "returned"))


_LOW = [*FEATURES, *FLAGS]


@register(
    "low_variance",
    f"""WITH {FEATURES_SQL}, {tall_sql(_LOW)},
    vc AS (SELECT feature, value, count(*) AS n FROM tall WHERE value IS NOT NULL GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS k,
                      sum(n) OVER (PARTITION BY feature) AS total, count(*) OVER (PARTITION BY feature) AS n_unique
               FROM vc),
    var AS (SELECT feature, var_samp(value) AS variance FROM tall GROUP BY feature)
    SELECT feature, n_unique, value AS dominant_value, round(100.0 * n / total, 1) AS dominant_pct,
           round(variance, 4) AS variance, round(100.0 * n / total, 1) >= 95 AS is_quasi_constant
    FROM ranked JOIN var USING (feature) WHERE k = 1""",
)
def low_variance(spark, sf_dir):
    return profiling.low_variance(features(spark, sf_dir), _LOW)


@register(
    "class_balance",
    f"""WITH {FEATURES_SQL}
    SELECT count(*) FILTER (label = 0) AS n_safe, count(*) FILTER (label = 1) AS n_risk,
           round(100.0 * count(*) FILTER (label = 0) / count(*), 1) AS pct_safe,
           round(100.0 * count(*) FILTER (label = 1) / count(*), 1) AS pct_risk,
           round(count(*) FILTER (label = 1) / count(*) FILTER (label = 0), 6) AS ratio,
           count(*) FILTER (label = 1) / count(*) FILTER (label = 0) NOT BETWEEN 0.2 AND 5 AS is_imbalanced
    FROM features""",
)
def class_balance(spark, sf_dir):
    return rounded(profiling.class_balance(features(spark, sf_dir), "label"))


@register(
    "rate_by_group",
    f"""WITH {FEATURES_SQL}
    SELECT profile, round(avg(label), 6) AS rate, count(*) AS n_rows,
           CASE WHEN count(*) >= 3 AND avg(label) = 1 THEN 'all risk'
                WHEN count(*) >= 3 AND avg(label) = 0 THEN 'all safe' ELSE '' END AS note
    FROM features GROUP BY profile""",
)
def rate_by_group(spark, sf_dir):
    return rounded(profiling.rate_by_group(features(spark, sf_dir), "profile", "label"))


_CELLS = f"""{FEATURES_SQL}, {tall_sql(FLAGS)},
cells AS (SELECT feature, count(*) FILTER (value = 0 AND label = 0) AS n00, count(*) FILTER (value = 0 AND label = 1) AS n01,
                 count(*) FILTER (value = 1 AND label = 0) AS n10, count(*) FILTER (value = 1 AND label = 1) AS n11
          FROM tall GROUP BY feature)"""


@register("contingency", f"WITH {_CELLS} SELECT * FROM cells WHERE n00 + n01 > 0 AND n10 + n11 > 0")
def contingency(spark, sf_dir):
    return profiling.contingency(features(spark, sf_dir), FLAGS, "label")


@register(
    "binary_rates",
    f"""WITH {_CELLS} SELECT feature, n00 + n01 AS n_0, round(n01 / (n00 + n01), 6) AS rate_0,
        n10 + n11 AS n_1, round(n11 / (n10 + n11), 6) AS rate_1 FROM cells""",
)
def binary_rates(spark, sf_dir):
    return rounded(profiling.binary_rates(features(spark, sf_dir), FLAGS, "label"))


@register(
    "rank_test_marks",
    f"""WITH {_TALL},
    vc AS (SELECT feature, value, count(*) AS n, count(*) FILTER (label = 0) AS n0 FROM tall WHERE value IS NOT NULL GROUP BY ALL),
    ranked AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value) - n + (n + 1) / 2.0 AS rnk FROM vc),
    sums AS (SELECT feature, sum(n0)::DOUBLE AS a, (sum(n) - sum(n0))::DOUBLE AS b, sum(rnk * n0)::DOUBLE AS rs, sum(n::DOUBLE * n * n - n) AS ties FROM ranked GROUP BY feature),
    z AS (SELECT feature, (greatest(rs - a * (a + 1) / 2, a * b - (rs - a * (a + 1) / 2)) - a * b / 2 - 0.5)
        / sqrt(a * b / 12 * ((a + b + 1) - ties / ((a + b) * (a + b - 1)))) AS z FROM sums WHERE a > 5 AND b > 5)
    SELECT feature, CASE WHEN z > 2.5758293035489004 THEN '***' WHEN z > 1.959963984540054 THEN '*' ELSE 'ns' END AS mark FROM z""",
)
def rank_test_marks(spark, sf_dir):
    """Marks from p against the critical values of z."""
    tests = profiling.mann_whitney(features(spark, sf_dir), FEATURES, "label")
    return profiling.with_mann_whitney_p(tests).select("feature", "mark")


@register(
    "chi2_yates",
    f"""WITH {_CELLS},
    m AS (SELECT feature, n00::DOUBLE AS a, n01::DOUBLE AS b, n10::DOUBLE AS c, n11::DOUBLE AS d,
                 (n00 + n01 + n10 + n11)::DOUBLE AS n FROM cells WHERE least(n00, n01, n10, n11) >= 5)
    SELECT feature,
           round(n * pow(greatest(abs(a * d - b * c) - n / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 4) AS chi2,
           round(b / (a + b), 6) AS rate_0, round(d / (c + d), 6) AS rate_1 FROM m""",
)
def chi2_yates(spark, sf_dir):
    df = profiling.chi2_yates(profiling.contingency(features(spark, sf_dir), FLAGS, "label"))
    return rounded(df.withColumn("chi2", F.round("chi2", 4)))


@register(
    "vif",
    """WITH f AS (SELECT l_quantity AS a, l_extendedprice AS b, l_quantity * 0.5 + l_linenumber AS c FROM lineitem),
    r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM f),
    d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r),
    v AS (SELECT unnest(['quantity', 'price', 'mixed']) AS feature,
                 unnest([(1 - bc * bc) / det, (1 - ac * ac) / det, (1 - ab * ab) / det]) AS vif FROM d)
    SELECT feature, round(vif, 2) AS vif,
           CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'moderate' ELSE 'low' END AS band FROM v""",
)
def vif(spark, sf_dir):
    df = features(spark, sf_dir).withColumn("mixed", F.col("quantity") * 0.5 + F.col("line_no"))
    return profiling.vif(df, ["quantity", "price", "mixed"])


@register(
    "recommendations",
    f"""WITH {FEATURES_SQL}, s AS (SELECT avg(label) AS share, count(*) AS n FROM features)
    SELECT 'recommendations' AS category, unnest(list_filter([
        CASE WHEN share < 0.1 OR share > 0.9 THEN 'resample the minority class' END,
        CASE WHEN n < 50 THEN 'few rows for the number of features' END,
        'compare metrics with and without the flagged features',
        'rerun the pipeline after adjusting the features'], lambda x: x IS NOT NULL)) AS message FROM s""",
)
def recommendations(spark, sf_dir):
    return profiling.recommendations(features(spark, sf_dir), FEATURES, "label")


@register("findings_report")
def findings_report(spark, sf_dir):
    return profiling.findings_report(features(spark, sf_dir), FEATURES, "label")
