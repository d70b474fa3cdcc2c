"""Metrics, splits and rankings of the scored feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscope.catalog.registry import register
from riskscope.catalog.tables import FEATURES_SQL, features, rounded, table
from riskscope.operators import evaluation, folds, scoring

_PRED = "(score >= 0.5)::INT AS pred"
_SCORED = f"{FEATURES_SQL}, scored AS (SELECT *, {_PRED} FROM features)"
_COUNTS = """count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
             count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn"""
# Metrics from a relation `c` holding tp, fp, fn and tn.
_MCC = """coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE)
          * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE), 0), 0)"""
_BALANCED = "list_avg(list_filter([tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)], lambda r: r IS NOT NULL))"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_ACCURACY = "(tp + tn) / (tp + fp + fn + tn)"
_METRICS = f"""round({_MCC}, 6) AS mcc, round({_BALANCED}, 6) AS balanced_accuracy, round({_F1}, 6) AS f1,
               round({_ACCURACY}, 6) AS accuracy,
               round(greatest(tp + fn, fp + tn) / (tp + fp + fn + tn), 6) AS majority_baseline"""


def scored(spark, sf_dir):
    return features(spark, sf_dir).withColumn("pred", evaluation.predicted(F.col("score")))


@register(
    "confusion_matrix",
    f"WITH {_SCORED} SELECT label AS actual, pred AS predicted, count(*) AS n_rows FROM scored GROUP BY ALL",
)
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(scored(spark, sf_dir), "label", "pred")


@register(
    "binary_metrics",
    f"WITH {_SCORED}, c AS (SELECT profile, {_COUNTS} FROM scored GROUP BY profile) SELECT *, {_METRICS} FROM c",
)
def binary_metrics(spark, sf_dir):
    """MCC, balanced accuracy, F1, accuracy and baseline, per profile."""
    return rounded(evaluation.binary_metrics(scored(spark, sf_dir), "label", "pred", ["profile"]))


@register(
    "classification_report",
    f"""WITH {_SCORED}, c AS (SELECT {_COUNTS} FROM scored),
    k AS (SELECT '0' AS class_name, coalesce(tn / nullif(tn + fn, 0), 0) AS precision,
                 coalesce(tn / nullif(tn + fp, 0), 0) AS recall, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1,
                 tn + fp AS support FROM c
          UNION ALL
          SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
                 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM c)
    SELECT class_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM k
    UNION ALL
    SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM k
    UNION ALL
    SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
           round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM k""",
)
def classification_report(spark, sf_dir):
    return rounded(evaluation.classification_report(scored(spark, sf_dir), "label", "pred"))


def _auc_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keep = f"{by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    vc AS (SELECT {keep} score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
           FROM scored GROUP BY ALL),
    up AS (SELECT *, sum(neg) OVER ({part} ORDER BY score) AS below,
                  sum(pos) OVER ({part} ORDER BY score DESC) AS tp_down,
                  sum(neg) OVER ({part} ORDER BY score DESC) AS fp_down FROM vc),
    auc AS (SELECT {keep} sum(pos * (below - neg / 2.0))::DOUBLE / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS roc_auc,
                   sum(pos * (tp_down::DOUBLE / (tp_down + fp_down))) / nullif(sum(pos), 0) AS average_precision
            FROM up {group})"""


@register("roc_auc", f"WITH {_SCORED}, {_auc_sql('')} SELECT round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(spark, sf_dir):
    return rounded(evaluation.roc_auc(scored(spark, sf_dir), "label", "score"))


@register(
    "roc_auc_by_profile",
    f"WITH {_SCORED}, {_auc_sql('profile')} SELECT profile, round(roc_auc, 6) AS roc_auc FROM auc",
)
def roc_auc_by_profile(spark, sf_dir):
    return rounded(evaluation.roc_auc(scored(spark, sf_dir), "label", "score", ["profile"]))


@register(
    "average_precision",
    f"WITH {_SCORED}, {_auc_sql('')} SELECT round(average_precision, 6) AS average_precision FROM auc",
)
def average_precision(spark, sf_dir):
    return rounded(evaluation.average_precision(scored(spark, sf_dir), "label", "score"))


_VOTES = f"""{_SCORED},
votes AS (SELECT file, max(label) AS label, (avg(pred) >= 0.5)::INT AS pred, max(label) = min(label) AS is_consistent,
                 count(*) AS n_rows FROM scored GROUP BY file)"""


@register(
    "group_vote",
    f"WITH {_VOTES} SELECT file, label, pred AS vote, is_consistent, n_rows FROM votes",
)
def group_vote(spark, sf_dir):
    return evaluation.group_vote(scored(spark, sf_dir), "file", "label", "pred")


@register(
    "group_report",
    f"""WITH {_VOTES}, c AS (SELECT {_COUNTS} FROM votes)
    SELECT round({_MCC}, 6) AS file_mcc, round({_BALANCED}, 6) AS file_balanced_accuracy, round({_F1}, 6) AS file_f1,
           round(2 * (tp + fn) / (2 * (tp + fn) + fp + tn), 6) AS file_f1_baseline, tp + fp + fn + tn AS n_files,
           round((tp + fn) / (tp + fp + fn + tn), 6) AS file_positive_rate FROM c""",
)
def group_report(spark, sf_dir):
    return rounded(evaluation.group_report(scored(spark, sf_dir), "file", "label", "pred"))


def fold_sql(column: str, k: int = 5) -> str:
    return f"(('0x' || substr(md5({column} || ':42'), 1, 8))::BIGINT % {k})::INT"


@register(
    "group_folds",
    f"""WITH {FEATURES_SQL}, f AS (SELECT *, {fold_sql("file")} AS fold FROM features)
    SELECT fold, count(*) AS n_rows, count(DISTINCT file) AS n_groups, sum(label)::BIGINT AS n_positive FROM f GROUP BY fold""",
)
def group_folds(spark, sf_dir):
    df = folds.group_folds(features(spark, sf_dir), "file")
    return folds.fold_label_mix(df, "fold", "label", "file")


@register(
    "row_folds",
    f"""SELECT doc_id, {fold_sql("doc_id")} AS fold FROM documents""",
)
def row_folds(spark, sf_dir):
    return folds.row_folds(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


_GROUPS = f"""{FEATURES_SQL},
groups AS (SELECT file, max(label) AS label, count(*) AS n_rows, md5(file || ':42') AS h FROM features GROUP BY file)"""


@register(
    "stratified_group_folds",
    f"""WITH {_GROUPS}
    SELECT file, label, n_rows, ((row_number() OVER (PARTITION BY label ORDER BY h, file) - 1) % 5)::INT AS fold FROM groups""",
)
def stratified_group_folds(spark, sf_dir):
    return folds.stratified_group_folds(features(spark, sf_dir), "file", "label")


@register(
    "balanced_group_folds",
    f"""WITH {FEATURES_SQL} SELECT count(DISTINCT file) AS n_groups, count(*) AS n_rows, sum(label)::BIGINT AS n_positive,
    5 AS n_folds, true AS rows_even, true AS positives_even FROM features""",
)
def balanced_group_folds(spark, sf_dir):
    """All groups in five folds whose rows and positives differ by less than the deal by label alone leaves."""
    df = features(spark, sf_dir)
    dealt = folds.balanced_group_folds(df, "file", "label")
    counts = dealt.select("file", "n_rows", "n_positive")
    before = folds.stratified_group_folds(df, "file", "label").select("file", "fold").join(counts, "file")
    ours = folds.fold_spread(dealt).select(F.col("rows").alias("r"), F.col("positives").alias("p"))
    both = folds.fold_spread(before).crossJoin(ours)
    totals = dealt.agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"), F.sum("n_positive").alias("n_positive"),
        F.count_distinct("fold").cast("int").alias("n_folds"),
    )
    return totals.crossJoin(both.select((F.col("r") <= F.col("rows")).alias("rows_even"), (F.col("p") <= F.col("positives")).alias("positives_even")))


@register(
    "group_split",
    f"""WITH {_GROUPS}
    SELECT file, CASE WHEN row_number() OVER (ORDER BY h, file) <= ceil(count(*) OVER () * 0.3::DOUBLE)
                 THEN 'test' ELSE 'train' END AS part FROM groups""",
)
def group_split(spark, sf_dir):
    return folds.group_split(features(spark, sf_dir), "file")


_FOLDED = f"""{FEATURES_SQL}, scored AS (SELECT *, {_PRED}, {fold_sql("file")} AS fold FROM features),
c AS (SELECT fold, {_COUNTS} FROM scored GROUP BY fold), {_auc_sql('fold')},
per_fold AS (SELECT fold, {_MCC} AS mcc, {_BALANCED} AS ba, {_F1} AS f1, {_ACCURACY} AS acc, roc_auc
             FROM c JOIN auc USING (fold))"""


@register(
    "cv_summary",
    f"""WITH {_FOLDED}
    SELECT round(avg(f1), 6) AS cv_f1_mean, round(stddev_pop(f1), 6) AS cv_f1_std, round(avg(acc), 6) AS cv_accuracy_mean,
           round(avg(roc_auc), 6) AS cv_auc_mean, round(stddev_pop(roc_auc), 6) AS cv_auc_std,
           round(avg(ba), 6) AS cv_balanced_accuracy_mean, round(avg(mcc), 6) AS cv_mcc_mean,
           count(*) FILTER (roc_auc IS NULL) AS n_folds_without_auc FROM per_fold""",
)
def cv_summary(spark, sf_dir):
    df = folds.group_folds(features(spark, sf_dir), "file")
    return rounded(evaluation.cv_summary(evaluation.fold_metrics(df, "label", "score", "fold")))


@register(
    "cv_report_with_train",
    f"""WITH {FEATURES_SQL}, parts AS (SELECT *, {_PRED}, {fold_sql("file")} AS own FROM features),
    runs AS (SELECT parts.*, m.i AS fold, CASE WHEN own = m.i THEN 'test' ELSE 'train' END AS cv_part FROM parts, (SELECT unnest(range(5)) AS i) m),
    c AS (SELECT fold, cv_part, {_COUNTS} FROM runs GROUP BY fold, cv_part),
    f AS (SELECT fold, cv_part, {_F1} AS f1, {_ACCURACY} AS acc FROM c)
    SELECT round(avg(f1) FILTER (cv_part = 'test'), 6) AS cv_f1_mean, round(avg(f1) FILTER (cv_part = 'train'), 6) AS cv_train_f1_mean,
        round(stddev_pop(f1) FILTER (cv_part = 'train'), 6) AS cv_train_f1_std, round(stddev_pop(acc) FILTER (cv_part = 'train'), 6) AS cv_train_accuracy_std,
        round(avg(f1) FILTER (cv_part = 'train') - avg(f1) FILTER (cv_part = 'test'), 6) AS cv_gap FROM f""",
)
def cv_report_with_train(spark, sf_dir):
    """Five runs over all rows, each with its own held-out fold, scored by a fixed rule."""
    runs = folds.group_folds(features(spark, sf_dir), "file").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    scored_ = runs.withColumn("cv_part", F.when(F.col("fold") == F.col("i"), "test").otherwise("train")).withColumn("fold", F.col("i"))
    report = evaluation.cv_report(scored_, "label", "score", "fold")
    return rounded(report.select("cv_f1_mean", "cv_train_f1_mean", "cv_train_f1_std", "cv_train_accuracy_std", "cv_gap"))


@register(
    "roc_auc_null_group",
    f"""WITH {FEATURES_SQL}, r AS (SELECT nullif(method % 3, 0) AS grp, label,
        rank() OVER (PARTITION BY method % 3 ORDER BY score) + (count(*) OVER (PARTITION BY method % 3, score) - 1) / 2.0::DOUBLE AS rk
        FROM features WHERE score IS NOT NULL),
    s AS (SELECT grp, sum(rk) FILTER (label = 1) AS rs, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM r GROUP BY grp)
    SELECT grp, round((rs - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM s""",
)
def roc_auc_null_group(spark, sf_dir):
    """Rows whose group is null are a group of their own."""
    df = features(spark, sf_dir).withColumn("grp", F.nullif(F.col("method") % 3, F.lit(0)))
    return rounded(evaluation.roc_auc(df, "label", "score", ["grp"]))


@register(
    "stratified_folds_null_label",
    f"""WITH {FEATURES_SQL}, groups AS (SELECT file, max(CASE WHEN file % 3 = 0 THEN NULL ELSE label END) AS label, count(*) AS n_rows,
        md5(file || ':42') AS h FROM features GROUP BY file)
    SELECT file, label, n_rows, ((row_number() OVER (PARTITION BY label ORDER BY h, file) - 1) % 5)::INT AS fold FROM groups""",
)
def stratified_folds_null_label(spark, sf_dir):
    """Groups without a label are dealt over the folds like a label of their own."""
    label = F.when(F.col("file") % 3 != 0, F.col("label"))
    return folds.stratified_group_folds(features(spark, sf_dir).withColumn("label", label), "file", "label")


@register(
    "holdout_report",
    f"""WITH {FEATURES_SQL}, scored AS (SELECT *, {_PRED},
        CASE WHEN {fold_sql("file", 10)} < 3 THEN 'test' ELSE 'train' END AS half FROM features),
    c AS (SELECT half, {_COUNTS} FROM scored GROUP BY half), {_auc_sql('half')},
    m AS (SELECT max({_F1}) FILTER (half = 'train') AS train_f1, max({_F1}) FILTER (half = 'test') AS test_f1,
                 max({_ACCURACY}) FILTER (half = 'test') AS test_accuracy,
                 max(roc_auc) FILTER (half = 'test') AS test_auc FROM c JOIN auc USING (half))
    SELECT round(train_f1, 6) AS train_f1, round(test_f1, 6) AS test_f1, round(test_accuracy, 6) AS test_accuracy,
           round(test_auc, 6) AS test_auc, round(train_f1 - test_f1, 6) AS overfit_gap,
           CASE WHEN train_f1 - test_f1 >= 0.15 THEN 'severe' WHEN train_f1 - test_f1 > 0.05 THEN 'light' ELSE 'none' END AS overfit
    FROM m""",
)
def holdout_report(spark, sf_dir):
    half = F.when(folds.hash_fold(["file"], 10) < 3, "test").otherwise("train")
    return rounded(
        evaluation.holdout_report(features(spark, sf_dir).withColumn("half", half), "label", "score", "half")
    )


_RULES = {"quantity rule": "quantity / 50", "discount rule": "greatest(discount, 0) * 10", "tax rule": "coalesce(tax, 0) * 12"}


@register(
    "select_best_model",
    f"""WITH {FEATURES_SQL},
    scored AS ({" UNION ALL ".join(
        f"SELECT {i} AS model_no, '{name}' AS model, {fold_sql('file')} AS fold, label, (({rule}) >= 0.5)::INT AS pred FROM features"
        for i, (name, rule) in enumerate(_RULES.items()))}),
    c AS (SELECT model_no, model, fold, {_COUNTS} FROM scored GROUP BY ALL),
    m AS (SELECT model_no, model, round(avg({_MCC}), 6) AS cv_mcc_mean, round(avg({_F1}), 6) AS cv_f1_mean FROM c GROUP BY ALL)
    SELECT * FROM m ORDER BY cv_mcc_mean DESC, model_no LIMIT 1""",
)
def select_best_model(spark, sf_dir):
    """Three scoring rules compared on group folds, one pass per metric."""
    df = folds.group_folds(features(spark, sf_dir), "file")
    rules = F.array(
        *[
            F.struct(F.lit(i).alias("model_no"), F.lit(name).alias("model"), F.expr(rule).alias("s"))
            for i, (name, rule) in enumerate(_RULES.items())
        ]
    )
    tall = df.select("fold", "label", F.explode(rules).alias("r")).select(
        "fold", "label", "r.model_no", "r.model", evaluation.predicted(F.col("r.s")).alias("pred")
    )
    per_fold = evaluation.binary_metrics(tall, "label", "pred", ["model_no", "model", "fold"])
    summary = rounded(
        per_fold.groupBy("model_no", "model").agg(
            F.avg("mcc").alias("cv_mcc_mean"), F.avg("f1").alias("cv_f1_mean")
        )
    )
    return evaluation.select_best_model(summary)


@register(
    "score_bands",
    f"""WITH {FEATURES_SQL}
    SELECT file, method, score, (score >= 0.5)::INT AS risk_pred,
           CASE WHEN score >= 0.7 THEN 'Élevé' WHEN score >= 0.4 THEN 'Moyen' ELSE 'Faible' END AS risk_label FROM features""",
)
def score_bands(spark, sf_dir):
    return scoring.add_bands(features(spark, sf_dir).select("file", "method", "score"), "score")


@register(
    "band_counts",
    f"""WITH {FEATURES_SQL}
    SELECT count(*) AS n_rows, count(*) FILTER (score >= 0.7) AS n_high,
           count(*) FILTER (score >= 0.4 AND score < 0.7) AS n_medium, count(*) FILTER (score < 0.4) AS n_low,
           count(*) FILTER (score >= 0.5) AS n_priority, count(DISTINCT class) AS n_classes FROM features""",
)
def band_counts(spark, sf_dir):
    return scoring.band_counts(features(spark, sf_dir), "score", "class")


@register(
    "class_score_top",
    f"""WITH {FEATURES_SQL}, m AS (SELECT class, round(avg(score), 6) AS mean_score FROM features GROUP BY class)
    SELECT * FROM m ORDER BY mean_score DESC, class LIMIT 15""",
)
def class_score_top(spark, sf_dir):
    return rounded(scoring.class_score_top(features(spark, sf_dir), "class", "score"))


@register(
    "top_rows",
    f"""WITH {FEATURES_SQL} SELECT file, class, method, score FROM features
    ORDER BY score DESC, file, class, method LIMIT 30""",
)
def top_rows(spark, sf_dir):
    return scoring.top_rows(
        features(spark, sf_dir), "score", ["file", "class", "method"], columns=["file", "class", "method", "score"]
    )


@register(
    "priority_classes",
    f"""WITH {FEATURES_SQL} SELECT class, min(file) AS first_file, count(*) AS n_positive FROM features
    WHERE score >= 0.5 GROUP BY class""",
)
def priority_classes(spark, sf_dir):
    found = scoring.priority_classes(scored(spark, sf_dir), "class", "pred", ["file", "method"])
    return found.select("class", F.col("first_seen.file").alias("first_file"), "n_positive")


@register(
    "threshold_table",
    f"""WITH {FEATURES_SQL}
    {" UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (score >= {t} AND label = 1) AS tp, "
        f"count(*) FILTER (score >= {t} AND label = 0) AS fp, count(*) FILTER (score < {t} AND label = 1) AS fn, "
        f"count(*) FILTER (score < {t} AND label = 0) AS tn FROM features" for t in (0.5, 0.7))}""",
)
def threshold_table(spark, sf_dir):
    return scoring.threshold_table(features(spark, sf_dir), "label", "score", [0.5, 0.7])
