"""Registered queries against their SQL on the smallest tables.

A sample runs by default; RISKSCOPE_ALL_ORACLES=1 runs every query that has SQL.
"""

import os

import duckdb
import pytest

from riskscope.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAMPLE = [
    "change_metrics",
    "risk_rate_by_brand",
    "parse_commit_log",
    "describe",
    "histogram_by_label",
    "mann_whitney",
    "vif",
    "roc_auc_by_profile",
    "stratified_group_folds",
    "text_size",
    "block_extract",
    "rule_scan",
    "template_facts",
    "scenarios",
    "render_files",
    "uncovered_routes",
    "knn_join",
    "hybrid_context",
    "assemble_responses",
]
NAMES = sorted(ORACLES) if os.environ.get("RISKSCOPE_ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(table):
    columns = sorted(table.column_names)
    return columns, sorted(tuple(map(repr, r)) for r in zip(*[table.column(c).to_pylist() for c in columns]))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, oracle, name):
    found = canonical(QUERIES[name](spark, sf_dir).toArrow())
    assert found == canonical(oracle.execute(ORACLES[name]).to_arrow_table())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
