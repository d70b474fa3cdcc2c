"""How the Merkle paths are joined: digests of siblings repeat, so stored paths are far smaller than in memory."""

from pyspark.sql import functions as F

from riskscope.llm import merkle


def test_no_table_of_paths_is_gathered_in_the_driver(spark, monkeypatch):
    plans, store = [], merkle.materialise

    def planned(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return store(df)

    monkeypatch.setattr(merkle, "materialise", planned)
    group = (F.col("id") % 3).cast("string")
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), group.alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"), F.lit("x").alias("text")
    )
    found = merkle.manifest_proofs(docs)
    planned(found)
    joined = [plan for columns, plan in plans if "path" in columns]
    assert len(joined) >= 5 and all("SortMergeJoin" in plan and "Broadcast" not in plan for plan in joined)
    checked = found.agg(F.count(F.lit(1)), F.bool_and(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root"))).head()
    assert tuple(checked) == (600, True)
