"""Models on documents joined with labels: label = toxic, group = text source and length class.

Results depend on the tree and solver implementation, so these have no SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscope.catalog.evaluate import fold_sql
from riskscope.catalog.registry import register
from riskscope.catalog.tables import FEATURES, FEATURES_SQL, features, rounded, table
from riskscope.functions import code
from riskscope.operators import boosting, feature_sets, folds, models, newton, scoring
from riskscope.session import materialise

TEXT_FEATURES = ["n_chars", "n_lines", "n_words", "complexity", "n_digits", "quality"]


def labelled(spark, sf_dir):
    """Whole documents with their features; the group keeps a language and a length class together.

    Training reads the rows many times, so they are written to the checkpoint folder first.
    """
    text = F.col("text")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = documents.select(
        "doc_id",
        "source",
        F.concat_ws("-", "lang", (F.col("n_chars") % 20).cast("string")).alias("file"),
        F.col("n_chars").cast("double").alias("n_chars"),
        code.file_loc(text).cast("double").alias("n_lines"),
        count(r"\S+").alias("n_words"),
        code.cyclomatic(text).cast("double").alias("complexity"),
        count(r"\d").alias("n_digits"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("int").alias("label"),
    )
    written = materialise(models.impute_constant(rows, TEXT_FEATURES))
    return models.balanced_weights(written, "label")


def _forest(features, trees=20):
    return models.random_forest(features, "label", trees, 8, 5)


@register("logistic_cv")
def logistic_cv(spark, sf_dir):
    df = folds.group_folds(labelled(spark, sf_dir), "file", 3)
    total = df.agg(F.sum("weight")).head()[0]
    scored = models.cross_validated(df, models.logistic(TEXT_FEATURES, "label", 10.0, total, 50), "label", k=3)
    return rounded(models.cv_report(scored, "label", name="LogisticRegression"))


@register("forest_importances")
def forest_importances(spark, sf_dir):
    model = _forest(TEXT_FEATURES).fit(labelled(spark, sf_dir))
    return rounded(models.top_importances(models.importances(model, TEXT_FEATURES, spark)))


@register("boosted_scores")
def boosted_scores(spark, sf_dir):
    """Scores, decisions and bands of a boosted model for all labelled documents."""
    df = models.positive_weights(labelled(spark, sf_dir), "label")
    model = models.boosted_trees(TEXT_FEATURES, "label", 10, 4, 0.1, row_keys=["doc_id"]).fit(df)
    return rounded(scoring.score(df, model).select("doc_id", "risk_score", "risk_pred", "risk_label"))


_CUTS = 32


@register(
    "boosted_first_gains",
    f"""WITH {FEATURES_SQL},
    c AS (SELECT count(*) FILTER (label = 0)::DOUBLE AS n0, count(*) FILTER (label = 1)::DOUBLE AS n1 FROM features),
    w AS (SELECT *, CASE WHEN label = 1 THEN n0 / n1 ELSE 1.0::DOUBLE END AS w FROM features, c),
    b AS (SELECT sum(w * label) / sum(w) AS share FROM w),
    gh AS (SELECT w.*, w * (share - label) AS g, w * share * (1 - share) AS h FROM w, b),
    tall AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS value, g, h FROM gh" for f in FEATURES)}),
    cuts AS (SELECT DISTINCT feature, unnest(q) AS cut FROM (SELECT feature, quantile_cont(value, [{", ".join(str(i / _CUTS) for i in range(1, _CUTS))}]) AS q
             FROM tall WHERE value IS NOT NULL GROUP BY feature)),
    s AS (SELECT feature, cut, coalesce(sum(g) FILTER (value < cut), 0) AS gl, coalesce(sum(h) FILTER (value < cut), 0) AS hl,
          coalesce(sum(g) FILTER (value IS NULL), 0) AS gm, coalesce(sum(h) FILTER (value IS NULL), 0) AS hm, sum(g) AS ga, sum(h) AS ha
          FROM cuts JOIN tall USING (feature) GROUP BY feature, cut),
    sides AS (SELECT feature, cut, ga, ha, false AS missing_left, gl, hl FROM s UNION ALL SELECT feature, cut, ga, ha, true, gl + gm, hl + hm FROM s),
    gains AS (SELECT feature, cut, missing_left, (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)) / 2 AS gain
              FROM sides WHERE hl >= 1 AND ha - hl >= 1),
    best AS (SELECT feature, cut, max(gain) AS gain, coalesce(max(gain) FILTER (missing_left) > max(gain) FILTER (NOT missing_left) * (1 + 1e-10),
             bool_and(missing_left)) AS missing_left FROM gains GROUP BY feature, cut)
    SELECT feature, round(cut, 8) AS cut, round(gain, 4) AS gain, missing_left, round(ln(share / (1 - share)), 6) + 0.0 AS base FROM best, b""",
)
def boosted_first_gains(spark, sf_dir):
    """Base score and second-order gain of every cut of the first tree's root, all feature rows, positives weighted."""
    df = models.positive_weights(features(spark, sf_dir), "label")
    found = boosting.first_gains(df, models.boosted_trees(FEATURES, "label", 1, 1, 0.1, bins=_CUTS))
    return found.select(
        "feature", F.round("cut", 8).alias("cut"), F.round("gain", 4).alias("gain"), "missing_left", (F.round("base", 6) + 0.0).alias("base")
    )


@register("grid_search_mcc")
def grid_search_mcc(spark, sf_dir):
    df = labelled(spark, sf_dir)
    grid = {"maxDepth": [4, 8], "minInstancesPerNode": [3, 10]}
    search = models.grid_search(df, _forest(TEXT_FEATURES, 10), grid, "label", "file", k=3)
    return rounded(models.grid_table(search, spark))


@register("grid_search_c")
def grid_search_c(spark, sf_dir):
    """The logistic model over all values of C on five group folds, every model from the same scans."""
    df = folds.group_folds(labelled(spark, sf_dir), "file", 5)
    found, _ = newton.logistic_grid_search(df, TEXT_FEATURES, "label", "fold", 5, models.LOGISTIC_C)
    return rounded(found)


def _newton_sql(step: int) -> str:
    """One step of all cells: sums at x, then x less the solution of the 3 x 3 system, by Cramer's rule."""
    p = "(1 / (1 + exp(-(x0 + x1 * z1 + x2 * z2))))"
    z = ["1", "z1", "z2"]
    sums = [f"sum(w * ({p} - y) * {z[i]}) AS g{i}" for i in range(3)]
    sums += [f"sum(w * {p} * (1 - {p}) * {z[i]} * {z[j]}) AS h{i}{j}" for i in range(3) for j in range(i, 3)]
    det = lambda m: " + ".join(
        f"({m[0][i]}) * (({m[1][(i + 1) % 3]}) * ({m[2][(i + 2) % 3]}) - ({m[1][(i + 2) % 3]}) * ({m[2][(i + 1) % 3]}))" for i in range(3)
    )
    gram = [[f"c * h{min(i, j)}{max(i, j)}" + (" + 1" if i == j and i else "") for j in range(3)] for i in range(3)]
    gradient = [f"c * g{i}" + (f" + x{i}" if i else "") for i in range(3)]
    swapped = [[[gradient[r] if j == i else gram[r][j] for j in range(3)] for r in range(3)] for i in range(3)]
    moved = ", ".join(f"x{i} - ({det(swapped[i])}) / ({det(gram)}) AS x{i}" for i in range(3))
    return f"""s{step} AS (SELECT held, c, x0, x1, x2, {", ".join(sums)} FROM b{step} JOIN z USING (held) GROUP BY held, c, x0, x1, x2),
    b{step + 1} AS (SELECT held, c, {moved} FROM s{step})"""


@register(
    "stacked_newton_steps",
    f"""WITH {FEATURES_SQL}, d AS (SELECT quantity::DOUBLE AS a, price::DOUBLE AS b, label AS y, {fold_sql("file", 3)} AS fold FROM features),
    m AS (SELECT held, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb,
          count(*) / (2.0::DOUBLE * sum(y)) AS w1, count(*) / (2.0::DOUBLE * sum(1 - y)) AS w0
          FROM d JOIN (SELECT unnest([-1, 0, 1, 2]) AS held) ON fold <> held GROUP BY held),
    z AS (SELECT held, y, (a - ma) / sa AS z1, (b - mb) / sb AS z2, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w FROM d JOIN m ON fold <> held),
    b0 AS (SELECT held, c, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2 FROM (SELECT unnest([-1, 0, 1, 2]) AS held), (SELECT unnest([0.01::DOUBLE, 10]) AS c)),
    {_newton_sql(0)}, {_newton_sql(1)}
    SELECT held, c, unnest(['', 'quantity', 'price']) AS feature, round(unnest([x0, x1, x2]), 6) AS coefficient FROM b2""",
)
def stacked_newton_steps(spark, sf_dir):
    """Coefficients of eight models (three folds and all rows, two penalties) after two common steps over all feature rows."""
    names = ["quantity", "price"]
    rows = newton.design_rows(folds.group_folds(features(spark, sf_dir), "file", 3), names, "label", "fold")
    fit = newton.fit_stacked(rows, names, [newton.ALL_FOLDS, 0, 1, 2], [0.01, 10.0], steps=2)
    return rounded(fit.coefficients(spark))


@register("file_level_report")
def file_level_report(spark, sf_dir):
    df = folds.group_folds(labelled(spark, sf_dir), "file", 3)
    scored = models.cross_validated(df, _forest(TEXT_FEATURES), "label", k=3)
    return rounded(models.group_level_report(scored, "label", "file"))


@register("compare_feature_sets")
def compare_feature_sets(spark, sf_dir):
    sets = {"v1": TEXT_FEATURES, "v2": ["n_chars", "n_words", "quality"]}
    comparison = models.compare_feature_sets(labelled(spark, sf_dir), sets, lambda f: _forest(f, 10), "label", "file", k=3)
    return rounded(models.set_deltas(comparison, "v1", "v2"))


@register("cross_dataset_eval")
def cross_dataset_eval(spark, sf_dir):
    """Train on the lineitem rows of some line numbers and test on others."""
    df = features(spark, sf_dir)
    datasets = {
        "first": df.where("method IN (1, 2)"),
        "second": df.where("method IN (3, 4)").drop("price"),
        "third": df.where("method IN (5, 6)"),
        "unlabelled": df.where("method > 6").withColumn("label", F.lit(0)),
    }
    runs = {
        "first→third": (["first"], "third"),
        "first+second→third": (["first", "second"], "third"),
        "first→unlabelled": (["first"], "unlabelled"),
    }
    make = lambda names: models.boosted_trees(names, "label", 5, 3, 0.1)
    return models.cross_dataset_eval(datasets, runs, FEATURES, "label", make, ["discount"])


@register("leak_vs_honest")
def leak_vs_honest(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("leak", F.col("label") * 2.0 + F.pmod(F.hash("doc_id"), F.lit(100)) / 100)
    leaky = [*TEXT_FEATURES, "leak"]
    return models.leak_vs_honest(df, TEXT_FEATURES, leaky, "label", "file", ["doc_id"], lambda f: _forest(f, 10), k=3)


@register(
    "union_datasets",
    """SELECT count(*) AS n_rows, sum((l_returnflag = 'R')::INT)::BIGINT AS n_positive, round(sum(l_quantity), 2) AS quantity,
              'quantity,discount,tax,line_no' AS common FROM lineitem""",
)
def union_datasets(spark, sf_dir):
    """The rows of two datasets stacked on the features both have."""
    df = features(spark, sf_dir)
    stacked, common = feature_sets.union_datasets(
        [df.where("method < 4"), df.where("method >= 4").drop("price")], FEATURES, "label"
    )
    return stacked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("label").alias("n_positive"),
        F.round(F.sum("quantity"), 2).alias("quantity"),
    ).withColumn("common", F.lit(",".join(common)))


@register(
    "impute_median",
    """WITH m AS (SELECT quantile_cont(nullif(l_tax, 0.0), 0.5) AS tax, quantile_cont(nullif(l_discount, 0.0), 0.5) AS discount
                  FROM lineitem WHERE l_linenumber <> 1)
    SELECT l_orderkey AS file, l_linenumber AS method, round(coalesce(nullif(l_tax, 0.0), m.tax), 6) AS tax,
           round(coalesce(nullif(l_discount, 0.0), m.discount), 6) AS discount FROM lineitem, m WHERE l_linenumber = 1""",
)
def impute_median(spark, sf_dir):
    """Test rows filled with the medians of the train rows."""
    df = features(spark, sf_dir).select("file", "method", "tax", "discount")
    _, test = models.impute_median(df.where("method <> 1"), df.where("method = 1"), ["tax", "discount"], ["discount"])
    return rounded(test)
