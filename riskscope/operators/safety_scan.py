"""Safety scan of generated code, one row per finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskscope.functions import safety


def scan(df: DataFrame, code: str, keep_lines: bool = True, rules=None) -> DataFrame:
    """Add `findings` (array) and `is_safe`: no blocking finding. No shuffle is involved."""
    stripped = df.withColumn("__stripped", safety.scannable(F.col(code), keep_lines))
    found = stripped.withColumn("findings", safety.findings(F.col("__stripped"), rules or safety.RULES))
    return found.withColumn("is_safe", ~F.exists("findings", lambda f: f["is_blocking"])).drop("__stripped")


def finding_rows(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding. The outer form keeps Spark from scanning twice to drop clean rows early."""
    found = scanned.select(*keys, F.explode_outer("findings").alias("f"))
    return found.where(F.col("f").isNotNull()).select(*keys, "f.*")
