"""A batch over a chunk table that is a union, with every join shuffled and its parts of unequal size."""

import pytest
from pyspark.sql import functions as F

from riskscope.plans.pipeline import batch_requests_of, plan_batch
from riskscope.session import materialise

SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "6k",
}


@pytest.fixture
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in SHUFFLED}
    for k, v in SHUFFLED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_batch_of_a_union(shuffled):
    name = F.concat(F.lit("Deed"), "id", F.lit("Controller"))
    methods = F.array(
        F.concat(F.lit("La classe PHP "), name, F.lit(" (type: controllers) → Profil: web_crud → Rôles classe: ADMIN")),
        F.concat(F.lit("Méthode 'list' ("), name, F.lit(") — Route: /deed/"), "id", F.lit("\n  → Type de réponse: render (200)")),
        F.concat(F.lit("Méthode 'sum' ("), name, F.lit(") — méthode interne sans route")),
    )
    read = shuffled.range(400).select(name.alias("class_name"), "id", F.posexplode(methods).alias("pos", "content"))
    chunks = materialise(read.select("class_name", "id", F.col("pos").cast("long").alias("pos"), "content"))
    again = chunks.where("id % 5 = 0 AND pos = 1").withColumn("pos", F.col("pos") + 50000)
    both = chunks.unionByName(again)
    requests = materialise(batch_requests_of(both.where("id % 4 <> 3").select("class_name").distinct()))
    files = plan_batch(both, requests).files()
    found = files.join(requests.select("class_name", "test_name"), "class_name")
    texts = {r.class_name: r for r in found.collect()}
    assert sorted(texts) == sorted(f"Deed{i}Controller" for i in range(400) if i % 4 != 3)
    for name, row in texts.items():
        assert row.test_name == f"{name}Test"
        assert row.text.startswith("<?php") and row.text.endswith("    }\n}\n") and row.text.count("final class") == 1
        assert row.text.count("testListRedirectsWhenNotAuthenticated()") == 1 and row.text.count(": sum\n") == 1
