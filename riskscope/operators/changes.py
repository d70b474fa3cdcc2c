"""Change history per file and the risk label built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskscope.functions.commits import NO_COMMIT, days_between

# Fixed value: bug-fix commits from which a file counts as risky.
BUGFIX_THRESHOLD = 5


def commits_since(commits: DataFrame, cutoff: Column | int, ts: str = "ts") -> DataFrame:
    """Commits at or after a unix second."""
    return commits.where(F.col(ts) >= cutoff)


def change_metrics(
    touches: DataFrame,
    now: Column | int,
    file: str = "file",
    author: str = "author",
    ts: str = "ts",
    bugfix: str = "is_bugfix",
) -> DataFrame:
    """Per file: bug-fix commits, all commits, distinct authors and days since the last one.

    Touches are first combined per (file, author): a file holding a third of the log is
    then spread over its authors, and the distinct count needs no second expansion.
    """
    per_author = touches.groupBy(F.col(file).alias("file"), F.col(author).alias("author")).agg(
        F.count_if(F.col(bugfix)).alias("bugfix"),
        F.count(F.lit(1)).alias("total"),
        F.max(ts).alias("last_ts"),
    )
    now = F.lit(now) if isinstance(now, int) else now
    return (
        per_author.groupBy("file")
        .agg(
            F.sum("bugfix").alias("bugfix_count"),
            F.sum("total").alias("total_commits"),
            F.count("author").alias("nb_authors"),
            F.max("last_ts").alias("last_ts"),
        )
        .withColumn(
            "days_since_change",
            F.coalesce(days_between(now, F.nullif("last_ts", F.lit(0))), F.lit(NO_COMMIT)),
        )
        .drop("last_ts")
    )


def attach_change_metrics(rows: DataFrame, metrics: DataFrame, file: str = "file") -> DataFrame:
    """Left join of per-file metrics; files without history get zeros and -1.0 days."""
    right = metrics.withColumnRenamed("file", "__file")
    return (
        rows.join(right, F.col(file) == F.col("__file"), "left")
        .drop("__file")
        .na.fill({"bugfix_count": 0, "total_commits": 0, "nb_authors": 0, "days_since_change": NO_COMMIT})
    )


def risk_label(bugfix_count: Column, threshold: int = BUGFIX_THRESHOLD) -> Column:
    return (bugfix_count >= threshold).cast("int")
