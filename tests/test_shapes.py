"""Physical plans keep the shape that scale depends on."""

import pytest

from riskscope import session
from riskscope.catalog import QUERIES
from riskscope.operators import retrieval
from riskscope.operators.chunks import method_references
from riskscope.plans import scenarios
from riskscope.sources.chunk_table import ChunkTable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_route_is_limited_before_the_shuffle(spark):
    chunks = spark.createDataFrame([("C", 1, "Méthode 'a' (C) — Route: /x")], "class_name string, pos long, content string")
    first = scenarios.first_routes(method_references(chunks), ["class_name"])
    text = plan(first)
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_top_k_prunes_partitions_and_sorts_no_table(spark):
    table = ChunkTable(spark, "chunks_for_shape")
    try:
        rows = spark.createDataFrame(
            [("1", "t", "f", "C", "text", [1.0, 0.0])],
            "chunk_id string, chunk_type string, file_path string, class_name string, content string, embedding array<float>",
        )
        table.replace_project("a", rows)
        text = plan(retrieval.top_k(table.read(), [1.0, 0.0], 3, "a"))
        assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text
        assert "PartitionFilters: [isnotnull(project_id" in text
    finally:
        spark.sql("DROP TABLE IF EXISTS chunks_for_shape")


def test_change_metrics_reads_only_its_columns(spark, sf_dir):
    text = plan(QUERIES["change_metrics"](spark, sf_dir))
    assert "FileScan parquet [l_orderkey" in text and "l_extendedprice" not in text and "o_totalprice" not in text


def test_group_folds_need_no_shuffle(spark, sf_dir):
    assert "Exchange" not in plan(QUERIES["row_folds"](spark, sf_dir))


def test_scan_needs_no_shuffle(spark, sf_dir):
    text = plan(QUERIES["rule_scan"](spark, sf_dir))
    assert "Exchange" not in text and "Python" not in text


def test_wide_reports_are_one_pass(spark, sf_dir):
    text = plan(QUERIES["pearson_pairs"](spark, sf_dir))
    assert text.count("FileScan") == 1 and "SinglePartition" in text


def test_settings_need_one_shuffle(spark):
    from riskscope.operators.chunks import class_settings

    chunks = spark.createDataFrame([("C", 1, "x")], "class_name string, pos long, content string")
    assert plan(class_settings(chunks, ["class_name"])).count("Exchange") == 1


def test_a_request_reads_the_corpus_twice(spark, monkeypatch):
    stored = []

    def keep(df):
        stored.append(plan(df))
        return df

    monkeypatch.setattr(retrieval, "materialise", keep)
    spark.range(3).selectExpr(
        "id AS chunk_id", "'p' AS project_id", "'t' AS chunk_type", "'C' AS class_name", "'x' AS content", "array(1.0D, id) AS embedding"
    ).write.mode("overwrite").saveAsTable("corpus_for_shape")
    try:
        corpus = spark.table("corpus_for_shape")
        retrieval.request_candidates(corpus, [1.0, 0.0], [0.0, 1.0], "C", 2, 2)
        assert len(stored) == 1 and stored[0].count("FileScan") <= 2
    finally:
        spark.sql("DROP TABLE IF EXISTS corpus_for_shape")


def test_vectors_of_another_size_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "chunk_id long, embedding array<float>")
    assert retrieval.top_k(df, [1.0, 0.0]).count() == 1
    with pytest.raises(Exception, match="3 elements"):
        retrieval.top_k(df, [1.0, 0.0, 0.0]).collect()


def test_a_cluster_needs_a_shared_folder():
    assert session.is_single_process("local") and session.is_single_process("local[4]")
    assert not session.is_single_process("local-cluster[3,2,1024]") and not session.is_single_process("spark://h:7077")


def test_intermediate_tables_are_released(spark):
    import os

    session.materialise(spark.range(3))
    path = session._WRITTEN[-1].removeprefix("file:")
    assert os.path.isdir(path)
    assert session.release_materialised(spark) >= 1 and not os.path.isdir(path)
