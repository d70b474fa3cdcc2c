"""Deterministic group-aware splits.

A row's place follows from the md5 of its group and a seed, so it is the same in every
run, on every cluster and in any engine that has md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskscope.scaling import bucketed_position, hash_bucket
from riskscope.session import materialise


def digest(columns: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def hash_fold(columns: Sequence[str], k: int = 5, seed: int = 42) -> Column:
    """Fold from the first eight hexadecimal digits; no shuffle is needed."""
    return (F.conv(F.substring(digest(columns, seed), 1, 8), 16, 10).cast("long") % k).cast("int")


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold`: all rows of a group share one."""
    return df.withColumn("fold", hash_fold([group], k, seed))


def row_folds(df: DataFrame, row_keys: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` row by row: the leaky protocol, for comparison only."""
    return df.withColumn("fold", hash_fold(row_keys, k, seed))


def _ordered_groups(df: DataFrame, group: str, label: str | None, seed: int) -> DataFrame:
    """One row per group with its position in hash order, per label when one is given."""
    labels = [F.max(label).alias("label")] if label else []
    groups = df.groupBy(group).agg(*labels, F.count(F.lit(1)).alias("n_rows"))
    hashed = groups.withColumn("__hash", digest([group], seed))
    return bucketed_position(
        hashed,
        ["label"] if label else [],
        hash_bucket(F.col("__hash")),
        [F.col("__hash"), F.col(group)],
        "position",
        "n_groups",
    ).drop("__hash")


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(group, label, n_rows, fold): groups of each label dealt over the folds in hash order."""
    ordered = _ordered_groups(df, group, label, seed)
    return ordered.withColumn("fold", ((F.col("position") - 1) % k).cast("int")).drop("position", "n_groups")


def deal_classes(classes: Sequence[tuple[int, int, int]], k: int) -> list[list[int]]:
    """How many groups of each (rows, positives, groups) class go to each fold.

    Classes with most rows come first. Equal groups are dealt evenly; each group of the remainder goes to
    the fold that keeps the shares of positives and of negatives of the folds closest together, then
    to the one with fewest rows.
    """
    positives = max(1, sum(p * c for _, p, c in classes))
    negatives = max(1, sum((n - p) * c for n, p, c in classes))
    rows, pos, neg = [0] * k, [0] * k, [0] * k
    quotas: list[list[int]] = [[] for _ in classes]
    for at in sorted(range(len(classes)), key=lambda i: (-classes[i][0], -classes[i][1])):
        n, p, count = classes[at]
        quota = [count // k] * k
        for f in range(k):
            rows[f] += quota[f] * n
            pos[f] += quota[f] * p
            neg[f] += quota[f] * (n - p)
        for _ in range(count % k):
            # Adding a and b to one fold changes the sum of squared shares by this much, whatever the mean.
            cost = lambda f: ((2 * pos[f] + p) * p / positives**2 + (2 * neg[f] + n - p) * (n - p) / negatives**2, rows[f], f)
            best = min((f for f in range(k) if quota[f] == count // k), key=cost)
            quota[best] += 1
            rows[best] += n
            pos[best] += p
            neg[best] += n - p
        quotas[at] = quota
    return quotas


def balanced_group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(group, n_rows, n_positive, fold): whole groups, folds of even rows and even positives.

    Groups with the same counts form a class, and the greedy deal runs on the histogram of classes:
    a row for each pair of counts that occurs, and groups of n rows in all have at most n / r of r rows. Inside a class
    the groups follow in hash order, numbered without gathering a class in one task.
    """
    groups = materialise(
        df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("n_positive"))
    )
    keys = ["n_rows", "n_positive"]
    found = [tuple(r) for r in groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).collect()]
    quotas = deal_classes(found, k)
    plan = [(n, p, [sum(q[: f + 1]) for f in range(k)]) for (n, p, _), q in zip(found, quotas)]
    table = df.sparkSession.createDataFrame(plan, "n_rows long, n_positive long, upto array<long>")
    placed = bucketed_position(
        groups.withColumn("__hash", digest([group], seed)), keys, hash_bucket(F.col("__hash")), [F.col("__hash"), F.col(group)], "position"
    )
    fold = F.size(F.filter("upto", lambda u: u < F.col("position"))).alias("fold")
    return placed.join(table, keys).select(group, *keys, fold)


def fold_spread(folded: DataFrame) -> DataFrame:
    """(rows, positives): the largest fold less the smallest, from (n_rows, n_positive, fold) of groups."""
    totals = folded.groupBy("fold").agg(F.sum("n_rows").alias("r"), F.sum("n_positive").alias("p"))
    return totals.agg((F.max("r") - F.min("r")).alias("rows"), (F.max("p") - F.min("p")).alias("positives"))


def attach_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    return df.join(folds.select(group, "fold"), group)


def group_split(df: DataFrame, group: str, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """(group, part): the first ceil(share × groups) in hash order are the test part."""
    ordered = _ordered_groups(df, group, None, seed)
    in_test = F.col("position") <= F.ceil(F.col("n_groups") * F.lit(test_share))
    return ordered.select(group, F.when(in_test, "test").otherwise("train").alias("part"))


def fold_label_mix(df: DataFrame, fold: str, label: str, group: str) -> DataFrame:
    """Rows, groups and positives per fold."""
    return df.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(group).alias("n_groups"),
        F.sum(label).alias("n_positive"),
    )
