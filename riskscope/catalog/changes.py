"""Change history and risk label on orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskscope.catalog.registry import register
from riskscope.catalog.tables import (
    BUGFIX_SQL,
    COMMITS_SQL,
    METRICS_SQL,
    NOW,
    SECONDS,
    TOUCHES_SQL,
    commits,
    table,
    touches,
)
from riskscope.functions.commits import is_bugfix, safe_name, safe_path_part
from riskscope.operators import changes, profiling
from riskscope.sources.commit_log import commit_files, parse_commits


@register(
    "change_metrics",
    f"WITH {METRICS_SQL} SELECT * FROM metrics",
)
def change_metrics(spark, sf_dir):
    return changes.change_metrics(touches(spark, sf_dir), NOW)


@register(
    "risk_label",
    f"""WITH {METRICS_SQL}
    SELECT file, bugfix_count, (bugfix_count >= 5)::INT AS label_risk FROM metrics""",
)
def risk_label(spark, sf_dir):
    metrics = changes.change_metrics(touches(spark, sf_dir), NOW)
    return metrics.select(
        "file", "bugfix_count", changes.risk_label(F.col("bugfix_count")).alias("label_risk")
    )


_CUTOFF = 883612800  # 1998-01-01
_RECENT = 1007164800  # 2001-12-01: a window in which some files have no commit


@register(
    "commits_since_window",
    f"""WITH {TOUCHES_SQL}
    SELECT file, CAST(count(*) FILTER (is_bugfix) AS BIGINT) AS bugfix_count, count(*) AS total_commits,
           count(DISTINCT author) AS nb_authors, round(({NOW} - max(ts)) / 86400.0, 1) AS days_since_change
    FROM touches WHERE ts >= {_CUTOFF} GROUP BY file""",
)
def commits_since_window(spark, sf_dir):
    return changes.change_metrics(changes.commits_since(touches(spark, sf_dir), _CUTOFF), NOW)


@register(
    "attach_change_metrics",
    f"""WITH {TOUCHES_SQL},
    recent AS (
      SELECT file, CAST(count(*) FILTER (is_bugfix) AS BIGINT) AS bugfix_count, count(*) AS total_commits,
             count(DISTINCT author) AS nb_authors, round(({NOW} - max(ts)) / 86400.0, 1) AS days_since_change
      FROM touches WHERE ts >= {_RECENT} GROUP BY file)
    SELECT p_partkey, p_brand, coalesce(bugfix_count, 0) AS bugfix_count,
           coalesce(total_commits, 0) AS total_commits, coalesce(nb_authors, 0) AS nb_authors,
           coalesce(days_since_change, -1.0) AS days_since_change
    FROM part LEFT JOIN recent ON p_partkey = file""",
)
def attach_change_metrics(spark, sf_dir):
    recent = changes.commits_since(touches(spark, sf_dir), _RECENT)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return changes.attach_change_metrics(parts, changes.change_metrics(recent, NOW), "p_partkey")


@register(
    "bugfix_subjects",
    f"""WITH {COMMITS_SQL}
    SELECT commit_id, subject, regexp_matches(subject, {BUGFIX_SQL}) AS is_bugfix FROM commits""",
)
def bugfix_subjects(spark, sf_dir):
    return commits(spark, sf_dir).select("commit_id", "subject", is_bugfix(F.col("subject")).alias("is_bugfix"))


def _log_blocks(spark, sf_dir):
    """Log blocks from orders: some with a tab in the subject, some blank, some without paths."""
    kind = F.col("o_custkey") % 7
    header = F.concat(
        F.when(kind == 0, F.lit("fix\twith tab")).otherwise(F.lit("fix: total")),
        F.lit("\tdev"), F.col("o_custkey").cast("string"), F.lit("@x\t"),
        F.expr(SECONDS).cast("string"), F.lit("\n"),
    )
    paths = F.concat(
        F.lit("\nsrc/"), F.col("o_orderstatus"), F.lit("/A.php\nsrc\\"), F.col("o_orderpriority"), F.lit("/B.php\n")
    )
    return table(spark, sf_dir, "orders").select(
        F.when(kind == 1, F.lit(" ")).when(kind == 2, header).otherwise(F.concat(header, paths)).alias("block")
    )


@register(
    "parse_commit_log",
    """SELECT 'dev' || o_custkey || '@x' AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, true AS is_bugfix,
           unnest(['src/' || o_orderstatus || '/A.php', 'src/' || o_orderpriority || '/B.php']) AS file
    FROM orders WHERE o_custkey % 7 > 2""",
)
def parse_commit_log(spark, sf_dir):
    return commit_files(parse_commits(_log_blocks(spark, sf_dir))).drop("commit_id")


@register(
    "commit_headers",
    """SELECT 'dev' || o_custkey || '@x' AS author, count(*) AS n_commits,
           CAST(sum(CASE WHEN o_custkey % 7 = 2 THEN 0 ELSE 2 END) AS BIGINT) AS n_paths
    FROM orders WHERE o_custkey % 7 > 1 GROUP BY 1""",
)
def commit_headers(spark, sf_dir):
    return (
        parse_commits(_log_blocks(spark, sf_dir))
        .groupBy("author")
        .agg(F.count(F.lit(1)).alias("n_commits"), F.sum(F.size("paths")).alias("n_paths"))
    )


@register(
    "risk_rate_by_brand",
    f"""WITH {METRICS_SQL},
    rated AS (SELECT p_brand, (coalesce(bugfix_count, 0) >= 5)::INT AS label_risk
              FROM part LEFT JOIN metrics ON p_partkey = file)
    SELECT p_brand, round(avg(label_risk), 6) AS rate, count(*) AS n_rows,
           CASE WHEN count(*) >= 3 AND avg(label_risk) = 1 THEN 'all risk'
                WHEN count(*) >= 3 AND avg(label_risk) = 0 THEN 'all safe' ELSE '' END AS note
    FROM rated GROUP BY p_brand""",
)
def risk_rate_by_brand(spark, sf_dir):
    """Flagship: change history, label and risk rate per group of files."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    metrics = changes.change_metrics(touches(spark, sf_dir), NOW)
    rated = changes.attach_change_metrics(parts, metrics, "p_partkey").withColumn(
        "label_risk", changes.risk_label(F.col("bugfix_count"))
    )
    rates = profiling.rate_by_group(rated, "p_brand", "label_risk")
    return rates.withColumn("rate", F.round("rate", 6))


@register(
    "safe_names",
    """SELECT p_partkey, regexp_replace(p_name || ' #' || p_brand, '[^a-zA-Z0-9]', '', 'g') AS safe_name,
           coalesce(nullif(regexp_replace(CASE WHEN p_size % 2 = 0 THEN '../' || p_type ELSE '../.' END,
                    '[^a-zA-Z0-9_-]', '', 'g'), ''), 'Unnamed') AS safe_part
    FROM part""",
)
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        safe_name(F.concat_ws(" #", "p_name", "p_brand")).alias("safe_name"),
        safe_path_part(
            F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("../"), "p_type")).otherwise("../.")
        ).alias("safe_part"),
    )
