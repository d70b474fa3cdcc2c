"""Commit log text: blocks separated by NUL, each a header line and the paths it touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskscope.functions.commits import is_bugfix


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Raw blocks, one row each, in column `block`."""
    return spark.read.text(path, lineSep="\x00").withColumnRenamed("value", "block")


def parse_commits(blocks: DataFrame) -> DataFrame:
    """(commit_id, subject, author, ts, is_bugfix, paths); malformed blocks are dropped.

    Dropped are blank blocks, headers with fewer than three tab-separated fields and
    headers whose third field is not an integer, so a tab inside a subject loses its commit.
    """
    lines = F.split("block", "\n")
    header = F.split(F.element_at(lines, 1), "\t")
    parsed = blocks.where(F.trim("block") != "").select(
        F.sha2("block", 256).alias("commit_id"),
        header.alias("header"),
        F.filter(
            F.transform(
                F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
                lambda p: F.translate(F.trim(p), "\\", "/"),
            ),
            lambda p: p != "",
        ).alias("paths"),
    )
    timestamp = F.trim(F.get("header", F.lit(2))).try_cast("long")
    return (
        parsed.where((F.size("header") >= 3) & timestamp.isNotNull())
        .select(
            "commit_id",
            F.get("header", F.lit(0)).alias("subject"),
            F.get("header", F.lit(1)).alias("author"),
            timestamp.alias("ts"),
            "paths",
        )
        .withColumn("is_bugfix", is_bugfix(F.col("subject")))
    )


def commit_files(commits: DataFrame) -> DataFrame:
    """One row per (commit, touched path)."""
    touched = commits.select(
        "commit_id", "author", "ts", "is_bugfix", F.explode_outer("paths").alias("file")
    )
    return touched.where(F.col("file").isNotNull())
