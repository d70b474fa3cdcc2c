"""Metrics of binary predictions, exact and in one or two aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskscope.scaling import running_counts
from riskscope.session import materialise

# Fixed value: score from which a row counts as predicted positive.
DECISION_THRESHOLD = 0.5
# Gap between train and test F1 that is reported, and that is severe.
OVERFIT_LIGHT = 0.05
OVERFIT_SEVERE = 0.15


def predicted(score: Column, threshold: float = DECISION_THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def confusion_matrix(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def confusion_counts(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn and tn as one row per group."""
    cell = lambda a, p: F.count_if((F.col(y) == a) & (F.col(pred) == p))
    return df.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")
    )


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def mcc() -> Column:
    """Matthews correlation from tp, fp, fn, tn; zero when undefined. Square roots are taken
    factor by factor so that the product stays in range."""
    tp, fp, fn, tn = map(_d, ("tp", "fp", "fn", "tn"))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0))


def balanced_accuracy() -> Column:
    """Mean recall over the classes that occur."""
    recalls = F.array(
        F.try_divide(_d("tp"), _d("tp") + _d("fn")), F.try_divide(_d("tn"), _d("tn") + _d("fp"))
    )
    seen = F.filter(recalls, lambda r: r.isNotNull())
    return F.try_divide(F.aggregate(seen, F.lit(0.0), lambda a, r: a + r), F.size(seen))


def f1() -> Column:
    both = 2 * _d("tp")
    return F.coalesce(F.try_divide(both, both + _d("fp") + _d("fn")), F.lit(0.0))


def accuracy() -> Column:
    return F.try_divide(_d("tp") + _d("tn"), _d("tp") + _d("fp") + _d("fn") + _d("tn"))


def majority_baseline() -> Column:
    """Accuracy of always predicting the larger class."""
    return F.try_divide(
        F.greatest(_d("tp") + _d("fn"), _d("fp") + _d("tn")), _d("tp") + _d("fp") + _d("fn") + _d("tn")
    )


def all_positive_f1() -> Column:
    """F1 of predicting every row positive."""
    positives = _d("tp") + _d("fn")
    return F.coalesce(
        F.try_divide(2 * positives, 2 * positives + _d("fp") + _d("tn")), F.lit(0.0)
    )


def binary_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with MCC, balanced accuracy, F1, accuracy and the majority baseline."""
    return (
        confusion_counts(df, y, pred, by)
        .withColumn("mcc", mcc())
        .withColumn("balanced_accuracy", balanced_accuracy())
        .withColumn("f1", f1())
        .withColumn("accuracy", accuracy())
        .withColumn("majority_baseline", majority_baseline())
    )


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    row = confusion_counts(df, y, pred)
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def entry(name: str, hit: str, wrong: str, missed: str) -> Column:
        precision = zero(F.try_divide(_d(hit), _d(hit) + _d(wrong)))
        recall = zero(F.try_divide(_d(hit), _d(hit) + _d(missed)))
        score = zero(F.try_divide(2 * _d(hit), 2 * _d(hit) + _d(wrong) + _d(missed)))
        return F.struct(
            F.lit(name).alias("class_name"),
            precision.alias("precision"),
            recall.alias("recall"),
            score.alias("f1"),
            (F.col(hit) + F.col(missed)).alias("support"),
        )

    classes = row.select(
        entry("0", "tn", "fn", "fp").alias("c0"), entry("1", "tp", "fp", "fn").alias("c1")
    )
    total = F.col("c0.support") + F.col("c1.support")
    mean = lambda m: (F.col(f"c0.{m}") + F.col(f"c1.{m}")) / 2
    weighted = lambda m: zero(
        F.try_divide(
            F.col(f"c0.{m}") * F.col("c0.support") + F.col(f"c1.{m}") * F.col("c1.support"), total
        )
    )

    def average(name: str, how) -> Column:
        return F.struct(
            F.lit(name).alias("class_name"),
            *[how(m).alias(m) for m in ("precision", "recall", "f1")],
            total.alias("support"),
        )

    rows = F.array(F.col("c0"), F.col("c1"), average("macro avg", mean), average("weighted avg", weighted))
    return classes.select(F.explode(rows).alias("r")).select("r.*")


def score_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, written once: the only input the curves need."""
    return materialise(
        df.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("value"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
        .withColumn("feature", F.lit("score"))
    )


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half; null when a class is missing."""
    ranked = running_counts(score_counts(df, y, score, by), by, ["pos", "neg"])
    below = F.col("neg_upto") - F.col("neg") / 2.0
    return ranked.groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("pos") * below), F.max(_d("pos_total")) * F.max(_d("neg_total"))
        ).alias("roc_auc")
    )


def average_precision(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Σ (Rₙ − Rₙ₋₁) Pₙ over distinct scores from the highest down; null without positives."""
    ranked = running_counts(score_counts(df, y, score, by), by, ["pos", "neg"], descending=True)
    precision = _d("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    return ranked.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.max(_d("pos_total"))).alias("average_precision")
    )


def group_vote(df: DataFrame, group: str, y: str, pred: str, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """One row per group: its label and the vote of its predictions.

    `is_consistent` is false where rows of a group disagree on the label.
    """
    return df.groupBy(group).agg(
        F.max(y).alias("label"),
        (F.avg(_d(pred)) >= threshold).cast("int").alias("vote"),
        (F.max(y) == F.min(y)).alias("is_consistent"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def group_report(df: DataFrame, group: str, y: str, pred: str) -> DataFrame:
    """Metrics of the group votes, each group counting once, with the all-positive baseline."""
    votes = group_vote(df, group, y, pred)
    return binary_metrics(votes, "label", "vote").select(
        F.col("mcc").alias("file_mcc"),
        F.col("balanced_accuracy").alias("file_balanced_accuracy"),
        F.col("f1").alias("file_f1"),
        all_positive_f1().alias("file_f1_baseline"),
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_files"),
        F.try_divide(_d("tp") + _d("fn"), _d("tp") + _d("fp") + _d("fn") + _d("tn")).alias(
            "file_positive_rate"
        ),
    )


def fold_metrics(df: DataFrame, y: str, score: str, fold: str, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Metrics and AUC per fold of scored rows."""
    rows = df.withColumn("__pred", predicted(F.col(score), threshold))
    return binary_metrics(rows, y, "__pred", [fold]).join(roc_auc(df, y, score, [fold]), fold)


def cv_summary(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds; folds without an AUC are counted apart."""
    return per_fold.groupBy(*by).agg(
        F.avg("f1").alias("cv_f1_mean"),
        F.stddev_pop("f1").alias("cv_f1_std"),
        F.avg("accuracy").alias("cv_accuracy_mean"),
        F.avg("roc_auc").alias("cv_auc_mean"),
        F.stddev_pop("roc_auc").alias("cv_auc_std"),
        F.avg("balanced_accuracy").alias("cv_balanced_accuracy_mean"),
        F.avg("mcc").alias("cv_mcc_mean"),
        F.count_if(F.col("roc_auc").isNull()).alias("n_folds_without_auc"),
    )


def cv_report(scored: DataFrame, y: str, score: str, fold: str) -> DataFrame:
    """`cv_summary` of scored rows; with a `cv_part` column also of the train rows, and the gap of F1."""
    if "cv_part" not in scored.columns:
        return cv_summary(fold_metrics(scored, y, score, fold))
    test = cv_summary(fold_metrics(scored.where("cv_part = 'test'"), y, score, fold))
    rows = scored.where("cv_part = 'train'").withColumn("__pred", predicted(F.col(score)))
    train = binary_metrics(rows, y, "__pred", [fold]).agg(
        F.avg("f1").alias("cv_train_f1_mean"),
        F.stddev_pop("f1").alias("cv_train_f1_std"),
        F.stddev_pop("accuracy").alias("cv_train_accuracy_std"),
    )
    gap = F.col("cv_train_f1_mean") - F.col("cv_f1_mean")
    # Both sides are one row.
    both = test.withColumn("__one", F.lit(1)).join(train.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return both.withColumn("cv_gap", gap).withColumn("cv_overfit", overfit_severity(gap))


def overfit_severity(gap: Column) -> Column:
    return (
        F.when(gap >= OVERFIT_SEVERE, "severe").when(gap > OVERFIT_LIGHT, "light").otherwise("none")
    )


def holdout_report(df: DataFrame, y: str, score: str, part: str) -> DataFrame:
    """Train and test F1, test accuracy and AUC, and the gap between them.

    `part` holds "train" or "test".
    """
    rows = df.withColumn("__pred", predicted(F.col(score)))
    metrics = binary_metrics(rows, y, "__pred", [part])
    pick = lambda name, column: F.max(F.when(F.col(part) == name, F.col(column)))
    row = metrics.agg(
        pick("train", "f1").alias("train_f1"),
        pick("test", "f1").alias("test_f1"),
        pick("test", "accuracy").alias("test_accuracy"),
    )
    auc = roc_auc(df.where(F.col(part) == "test"), y, score).select(
        F.lit(1).alias("__one"), F.col("roc_auc").alias("test_auc")
    )
    gap = F.col("train_f1") - F.col("test_f1")
    return (
        row.withColumn("__one", F.lit(1))
        .join(auc, "__one", "left")
        .drop("__one")
        .withColumn("overfit_gap", gap)
        .withColumn("overfit", overfit_severity(gap))
    )


def select_best_model(metrics: DataFrame, order: str = "model_no") -> DataFrame:
    """The row with the best CV MCC, else CV F1, else F1; the first one on ties."""
    columns = [F.col(c) for c in ("cv_mcc_mean", "cv_f1_mean", "f1") if c in metrics.columns]
    return metrics.orderBy(F.coalesce(*columns).desc(), F.col(order)).limit(1)
