"""Work on narrow rows is dealt over tasks by rows, not by the bytes of their file."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import rows
from riskscope.catalog import QUERIES, code_tables as ct
from riskscope.llm.words import SLICE_BYTES
from riskscope.operators import retrieval
from riskscope.plans import route_plan
from riskscope.scaling import spread


@pytest.fixture
def part_dir(tmp_path):
    """20,000 parts in one small row group; one key twice, one size missing."""
    keys = [*range(19_998), 7, 8]
    sizes = [None if k == 3 else 1 + k % 50 for k in keys]
    table = pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_size": pa.array(sizes, pa.int32())})
    pq.write_table(table, tmp_path / "part.parquet")
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_spread_keeps_all_rows(spark):
    df = spark.range(1000).coalesce(1).select((F.col("id") % 300).alias("id"))
    dealt = spread(df, 100)
    assert dealt.rdd.getNumPartitions() == 10
    assert rows(dealt) == rows(df)
    assert spread(df, 1000) is df
    assert spread(df.limit(0), 100).count() == 0


def test_classes_are_dealt_over_tasks(spark, part_dir):
    parts = ct.parts(spark, part_dir)
    assert parts.rdd.getNumPartitions() == 3
    assert parts.count() == 20_000


def test_class_facts_are_not_broadcast(spark, part_dir):
    df = QUERIES["class_facts_round_trip"](spark, part_dir)
    assert "BroadcastHashJoin" not in plan_of(df)
    assert df.where("NOT same_methods OR NOT same_attributes").count() == 0
    assert df.count() == 19_996 + 2 * 4


@pytest.mark.parametrize("limit", [2, 1 << 18])
def test_names_are_settled_from_stored_rows(spark, monkeypatch, limit):
    """The rows are computed once, for both results, and sorted in tasks of few rows."""
    monkeypatch.setattr(route_plan, "NAMED_ROWS", limit)
    names = ["a", "a", "a2", "a", "b", "b", "c", None, None]
    given = [(k, f, n) for f in ("x", "y", None) for k, n in enumerate(names)]
    df = spark.createDataFrame(given, "pos long, file string, name string").withColumn("seen", F.explode(F.array(F.lit(1))))
    named = route_plan.unique_names(df, ["file"], "name", "pos")
    assert "explode" not in plan_of(named)
    assert ("REPARTITION_BY_NUM" in plan_of(named)) == (limit == 2)
    found = {f: [r.name for r in named.where(F.col("file").eqNullSafe(f)).orderBy("pos").collect()] for f in ("x", "y", None)}
    assert found == {f: ["a", "a2", "a22", "a3", "b", "b2", "c", None, None] for f in found}


def test_embed_encodes_bounded_slices(spark):
    def encode(texts):
        if sum(map(len, texts)) > SLICE_BYTES:
            raise ValueError("too many texts at once")
        return retrieval.hashing_encoder(8)(texts)

    df = spark.range(40, numPartitions=1).select("id", F.when(F.col("id") % 9 != 8, F.repeat(F.concat("id", F.lit(" word ")), 10_000)).alias("t"))
    found = retrieval.embed(df, "t", encode).select("id", F.size("embedding").alias("n"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("square"))
    assert rows(found, "id", "n") == [(i, 8) for i in range(40)]
    assert all(r.square == pytest.approx(0 if r.id % 9 == 8 else 1, abs=1e-6) for r in found.collect())
    assert retrieval.embed(df.limit(0), "t", encode).count() == 0
