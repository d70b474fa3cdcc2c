"""The given tables and the roles they play, each as a DataFrame and as the same SQL.

commit log      orders (one commit each) with the lineitem rows they touch
feature rows    lineitem, label = returned, group = order
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskscope.functions.commits import BUGFIX_PATTERNS, is_bugfix

# Reference time of the recency columns: 2003-01-01.
NOW = 1041379200
FEATURES = ["quantity", "price", "discount", "tax", "line_no"]
FLAGS = ["is_bulk", "is_open", "is_discounted", "is_first"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(column, name: str):
    return F.round(column, 6).alias(name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order cannot show in a comparison."""
    return df.select(
        *[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


# Unix second of the order date; stored without a time zone, so the session's has no say.
SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))"

_SUBJECTS = {
    "1-URGENT": "fix: total of order ",
    "2-HIGH": "refactor #12 fix for order ",
    "3-MEDIUM": "prefix change in order ",
    "4-NOT SPECIFIED": "feat: page of order ",
    "5-LOW": "Bug fix in order ",
}


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in _SUBJECTS.items() for x in pair]), F.col("o_orderpriority")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit_id"),
        F.concat(F.coalesce(prefix, F.lit("chore: order ")), F.col("o_orderkey").cast("string")).alias("subject"),
        F.col("o_custkey").alias("author"),
        F.expr(SECONDS).alias("ts"),
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file")
    )
    flagged = commits(spark, sf_dir).select("*", is_bugfix(F.col("subject")).alias("is_bugfix"))
    return lines.join(flagged, "commit_id")


BUGFIX_SQL = "'(?i)" + "|".join(BUGFIX_PATTERNS) + "'"
_SUBJECT_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SUBJECTS.items())
COMMITS_SQL = f"""
commits AS (
  SELECT o_orderkey AS commit_id,
         (CASE o_orderpriority {_SUBJECT_CASES} ELSE 'chore: order ' END) || o_orderkey AS subject,
         o_custkey AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts
  FROM orders)"""
TOUCHES_SQL = f"""{COMMITS_SQL},
touches AS (
  SELECT l_partkey AS file, c.*, regexp_matches(subject, {BUGFIX_SQL}) AS is_bugfix
  FROM lineitem JOIN commits c ON l_orderkey = commit_id)"""
METRICS_SQL = f"""{TOUCHES_SQL},
metrics AS (
  SELECT file, CAST(count(*) FILTER (is_bugfix) AS BIGINT) AS bugfix_count, count(*) AS total_commits,
         count(DISTINCT author) AS nb_authors, round(({NOW} - max(ts)) / 86400.0, 1) AS days_since_change
  FROM touches GROUP BY file)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows. A zero tax counts as missing and a zero discount as the -1 sentinel."""
    flag = lambda condition: condition.cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"),
        F.col("l_suppkey").alias("class"),
        F.col("l_linenumber").alias("method"),
        F.col("l_partkey").alias("part"),
        F.concat(F.col("l_linestatus"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("profile"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") == 0, -1.0).otherwise(F.col("l_discount")).alias("discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        F.col("l_linenumber").cast("double").alias("line_no"),
        flag(F.col("l_quantity") >= 25).alias("is_bulk"),
        flag(F.col("l_linestatus") == "O").alias("is_open"),
        flag(F.col("l_discount") > 0).alias("is_discounted"),
        flag(F.col("l_linenumber") == 1).alias("is_first"),
        flag(F.col("l_returnflag") == "R").alias("label"),
        F.round(
            F.col("l_quantity") * 0.01 + F.col("l_discount") * 4 + F.col("l_tax"), 3
        ).alias("score"),
    )


FEATURES_SQL = """
features AS (
  SELECT l_orderkey AS file, l_suppkey AS class, l_linenumber AS method, l_partkey AS part,
         l_linestatus || '-' || l_linenumber AS profile,
         l_quantity AS quantity, l_extendedprice AS price,
         CASE WHEN l_discount = 0 THEN -1.0::DOUBLE ELSE l_discount END AS discount,
         nullif(l_tax, 0.0) AS tax, l_linenumber::DOUBLE AS line_no,
         (l_quantity >= 25)::INT AS is_bulk, (l_linestatus = 'O')::INT AS is_open,
         (l_discount > 0)::INT AS is_discounted, (l_linenumber = 1)::INT AS is_first,
         (l_returnflag = 'R')::INT AS label,
         round(l_quantity * 0.01::DOUBLE + l_discount * 4 + l_tax, 3) AS score
  FROM lineitem)"""


def tall_sql(features: list[str], keep: str = "label") -> str:
    """The features as (feature, value) rows."""
    parts = [f"SELECT {keep}, '{f}' AS feature, {f}::DOUBLE AS value FROM features" for f in features]
    return "tall AS (" + " UNION ALL ".join(parts) + ")"
