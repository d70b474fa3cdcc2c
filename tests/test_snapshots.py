"""Replacement of projects: in a session without settings, and as snapshots."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from riskscope.sources import files
from riskscope.sources.chunk_table import ChunkTable, project_stats
from riskscope.sources.versioned_chunks import VersionedChunks


def chunks(spark, n, project=None, tag="x"):
    data = [(str(i), "t", f"f{i}", f"C{i}", f"{tag} {i}", [float(i)]) for i in range(n)]
    df = spark.createDataFrame(data, "chunk_id string, chunk_type string, file_path string, class_name string, content string, embedding array<float>")
    return df if project is None else df.withColumn("project_id", F.lit(project))


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_replacing_a_project_keeps_the_others(spark, mode):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    table = ChunkTable(spark, f"chunks_{mode}")
    try:
        table.append(chunks(spark, 3, "a").unionByName(chunks(spark, 2, "it's {b}\\")))
        table.replace_project("a", chunks(spark, 5))
        table.replace_project("c", chunks(spark, 1))
        assert rows(table.stats()) == [("a", 5), ("c", 1), ("it's {b}\\", 2)]
        table.replace_project("it's {b}\\", chunks(spark, 4))
        table.replace_project("c", chunks(spark, 0))
        assert rows(table.stats()) == [("a", 5), ("it's {b}\\", 4)]
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        spark.sql(f"DROP TABLE IF EXISTS chunks_{mode}")


def test_a_reader_does_not_see_a_swap(spark, tmp_path):
    store = VersionedChunks(spark, f"{tmp_path}/chunks")
    assert store.read().count() == 0 and store.manifest() == {}
    store.replace_projects(chunks(spark, 3, "a").unionByName(chunks(spark, 2, "b/é=1")))
    reader, one = store.read(), store.read("a")
    store.replace_project("a", chunks(spark, 7, tag="new"))
    store.drop_project("b/é=1")
    assert rows(project_stats(reader)) == [("a", 3), ("b/é=1", 2)] and one.count() == 3
    assert rows(project_stats(store.read())) == [("a", 7)]
    assert store.read("a").where("content LIKE 'new%'").count() == 7 and store.read("none").count() == 0
    text = store.read().where("project_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_id" in text
    store.replace_project("a", chunks(spark, 0))
    assert store.read().count() == 0 and reader.count() == 5
    assert store.vacuum(keep=1) == 3 and store.manifest() == {}


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """The second writer of a number starts again from the first one's manifest."""
    store, other = (VersionedChunks(spark, f"{tmp_path}/chunks") for _ in range(2))
    publish, met = store._publish, []

    def late(number, versions):
        if not met:
            met.append(number)
            other.replace_project("other", chunks(spark, 2))
        return publish(number, versions)

    monkeypatch.setattr(store, "_publish", late)
    store.replace_project("mine", chunks(spark, 1))
    assert met and rows(project_stats(store.read())) == [("mine", 1), ("other", 2)]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    store = VersionedChunks(spark, f"{tmp_path}/chunks")
    store.replace_project("a", chunks(spark, 2))
    broken = chunks(spark, 3, "a").withColumn("content", F.raise_error(F.lit("no text")).cast("string"))
    with pytest.raises(Exception, match="no text"):
        store.replace_projects(broken)
    assert rows(project_stats(store.read())) == [("a", 2)]
    with pytest.raises(ValueError):
        store.replace_projects(chunks(spark, 1, ""))


def test_examples_keep_their_order_over_many_files(spark, tmp_path):
    df = spark.range(0, 500, 1, 7).select(F.col("id").alias("n"), F.concat(F.lit("e"), "id").alias("test_ideal"))
    files.write_examples(df.orderBy(F.col("n").desc()), f"{tmp_path}/e", ["n"])
    found = files.read_examples(spark, f"{tmp_path}/e", lines=True)
    assert rows(found, "example_no", "test_ideal") == [(i + 1, f"e{i}") for i in range(500)]
