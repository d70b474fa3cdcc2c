"""Scores to bands, counts and ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.ml.functions import vector_to_array

from riskscope.operators.evaluation import DECISION_THRESHOLD, predicted

# Band limits and names, and the usual rows of a displayed table.
BAND_MEDIUM = 0.4
BAND_HIGH = 0.7
BAND_NAMES = ("Faible", "Moyen", "Élevé")
TOP_CLASSES = 15
ROWS_DEFAULT = 30


def risk_band(score: Column) -> Column:
    low, medium, high = BAND_NAMES
    return F.when(score >= BAND_HIGH, high).when(score >= BAND_MEDIUM, medium).otherwise(low)


def add_bands(df: DataFrame, score: str = "risk_score", threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Add the decision and the display band of a score."""
    return df.withColumn("risk_pred", predicted(F.col(score), threshold)).withColumn(
        "risk_label", risk_band(F.col(score))
    )


def score(df: DataFrame, model, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Score rows with a fitted pipeline: positive probability, decision and band."""
    scored = model.transform(df).withColumn(
        "risk_score", vector_to_array("probability").getItem(1)
    )
    return add_bands(scored, "risk_score", threshold).select(
        *df.columns, "risk_score", "risk_pred", "risk_label"
    )


def band_counts(df: DataFrame, score: str, class_column: str) -> DataFrame:
    """Rows per band, rows to test first, and distinct classes, in one pass.

    Rows are first combined per class, so the distinct count needs no second expansion.
    """
    s = F.col(score)
    per_class = df.groupBy(class_column).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(s >= BAND_HIGH).alias("n_high"),
        F.count_if((s >= BAND_MEDIUM) & (s < BAND_HIGH)).alias("n_medium"),
        F.count_if(s < BAND_MEDIUM).alias("n_low"),
        F.count_if(s >= DECISION_THRESHOLD).alias("n_priority"),
    )
    names = ["n_rows", "n_high", "n_medium", "n_low", "n_priority"]
    return per_class.agg(*[F.sum(n).alias(n) for n in names], F.count(class_column).alias("n_classes"))


def class_score_top(df: DataFrame, class_column: str, score: str, n: int = TOP_CLASSES) -> DataFrame:
    """Classes with the highest mean score."""
    means = df.groupBy(class_column).agg(F.avg(score).alias("mean_score"))
    return means.orderBy(F.col("mean_score").desc(), class_column).limit(n)


def top_rows(
    df: DataFrame, score: str, ties: Sequence[str], n: int = ROWS_DEFAULT, columns: Sequence[str] | None = None
) -> DataFrame:
    """The n highest scores, ties in a stated order; a distributed top-k."""
    kept = [c for c in columns if c in df.columns] if columns else df.columns
    return df.orderBy(F.col(score).desc(), *ties).limit(n).select(*kept)


def priority_classes(df: DataFrame, class_column: str, pred: str, order: Sequence[str]) -> DataFrame:
    """Classes with a positive prediction and the place of their first one."""
    return (
        df.where(F.col(pred) == 1)
        .groupBy(class_column)
        .agg(F.min(F.struct(*order)).alias("first_seen"), F.count(F.lit(1)).alias("n_positive"))
    )


def threshold_table(df: DataFrame, y: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows and true positives flagged at each decision threshold, in one pass."""
    s = F.col(score)
    entries = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if((s >= t) & (F.col(y) == 1)).alias("tp"),
            F.count_if((s >= t) & (F.col(y) == 0)).alias("fp"),
            F.count_if((s < t) & (F.col(y) == 1)).alias("fn"),
            F.count_if((s < t) & (F.col(y) == 0)).alias("tn"),
        )
        for t in thresholds
    ]
    return df.agg(F.array(*entries).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
