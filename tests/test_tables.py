"""Commit logs, files, the chunk table, retrieval and models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from riskscope.functions import vectors
from riskscope.operators import changes, feature_sets, models, retrieval
from riskscope.sources import chunk_table, commit_log, files

LOG = (
    "\x00fix: total\ta@x\t1000000\n\nsrc/A.php\nsrc/B.php\n"
    "\x00feat: page\tb@x\t2000000\n\nsrc/A.php\n"
    "\x00fix\twith tab\tc@x\t3000000\n\nsrc/A.php\n"
    "\x00merge\td@x\t4000000\n"
)


def test_commit_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    commits = commit_log.parse_commits(commit_log.read_commit_log(spark, str(tmp_path / "log.txt")))
    assert commits.count() == 3
    metrics = changes.change_metrics(commit_log.commit_files(commits), 2_864_000)
    assert rows(metrics) == [("src/A.php", 1, 2, 2, 10.0), ("src/B.php", 1, 1, 1, 21.6)]
    every = spark.createDataFrame([("src/A.php",), ("src/C.php",)], "file string")
    attached = changes.attach_change_metrics(every, metrics)
    assert rows(attached)[1] == ("src/C.php", 0, 0, 0, -1.0)
    for threshold, label in ((1, 1), (2, 0)):
        assert attached.select(changes.risk_label(F.col("bugfix_count"), threshold)).head()[0] == label


def test_zero_timestamp_is_missing(spark):
    df = spark.createDataFrame([("f", "a", 0, True)], "file string, author string, ts long, is_bugfix boolean")
    assert changes.change_metrics(df, 86400).head().days_since_change == -1.0


def test_source_files(spark, tmp_path):
    for name in (
        "src/Controller/A.php", "src/Service/BController.php", "src/Service/C.php", "src/Entity/Foo.php",
        "vendor/Controller/D.php", "src/tests/EAction.php", "src/Controller/note.txt",
    ):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes("é".encode("latin-1" if name.endswith("C.php") else "utf-8"))
    found = files.read_source_files(spark, str(tmp_path))
    kept = files.select_controllers(found).select(F.regexp_extract("path", "([^/]+)$", 1))
    assert sorted(r[0] for r in kept.collect()) == ["A.php", "BController.php"]
    texts = found.select(files.decode_text(F.col("content"))).distinct().collect()
    assert [r[0] for r in texts] == ["é"]
    counts = {r.category: r.n_files for r in files.category_counts(found).collect()}
    assert counts["controllers"] >= 1 and counts["services"] == 2 and counts["forms"] == 0


def test_feature_files(spark, tmp_path):
    from riskscope.schemas import FEATURES_SCHEMA

    row = tuple(["f", "C", "m", "api"] + [1] * 22 + [2.5, 1])
    df = spark.createDataFrame([row], FEATURES_SCHEMA)
    files.write_features(df, str(tmp_path / "f.csv"), "csv")
    files.write_features(df, str(tmp_path / "f.parquet"))
    assert files.read_features(spark, str(tmp_path / "f.csv")).head() == df.head()
    assert files.read_features(spark, str(tmp_path / "f.parquet"), ["file", "label_risk"]).columns == ["file", "label_risk"]
    files.write_report(df, str(tmp_path / "report"))
    files.export_scored(df, str(tmp_path / "scored"))
    assert spark.read.csv(str(tmp_path / "scored"), header=True).count() == 1
    assert files.missing_columns(df, ["file", "nope"]) == ["nope"]


def test_examples(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"demande_utilisateur": "a", "contexte_pertinent": ["x"], "test_ideal": "t"}]')
    row = files.read_examples(spark, str(tmp_path / "e.json")).head()
    assert row.demande_utilisateur == "a" and list(row.contexte_pertinent) == ["x"]


def _chunks(spark, n, tag="x"):
    data = [(str(i), "t", f"f{i}", f"Class{i}", f"{tag} {i}", [float(i), 1.0]) for i in range(n)]
    return spark.createDataFrame(
        data, "chunk_id string, chunk_type string, file_path string, class_name string, content string, embedding array<float>"
    )


def test_chunk_table(spark):
    table = chunk_table.ChunkTable(spark, "chunks_under_test")
    try:
        table.replace_project("a", _chunks(spark, 3))
        table.replace_project("b", _chunks(spark, 2))
        table.replace_project("a", _chunks(spark, 5, "new"))
        assert rows(table.stats()) == [("a", 5), ("b", 2)]
        assert table.read().where("project_id = 'a' AND content LIKE 'new%'").count() == 5
        table.replace_project("a", _chunks(spark, 0))
        assert rows(table.projects()) == [("b",)]
        table.drop_project("b")
        assert table.read().count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS chunks_under_test")


def test_vector_sizes(spark):
    for bad in (0, 16001, True, "3", 2.0):
        with pytest.raises(ValueError):
            chunk_table.check_vector_size(bad)
    assert chunk_table.vector_violations(_chunks(spark, 3), 2).count() == 0
    assert chunk_table.vector_violations(_chunks(spark, 3), 3).count() == 3


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in df.select(vectors.normalise(F.col("v"))).collect()] == [None, [0.6, 0.8]]
    assert df.select(vectors.cosine_similarity(F.col("v"), F.col("v"))).collect()[0][0] is None


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_knn_join_brute_force(spark, cell_rows):
    rng = np.random.default_rng(0)
    corpus = [(i, i % 2, rng.normal(size=4).astype("float32").tolist()) for i in range(60)] + [(60, 0, [0.0] * 4)]
    queries = [(100 + i, i % 2, rng.normal(size=4).astype("float32").tolist()) for i in range(8)]
    schema = "{} long, project_id long, {} array<float>"
    found = retrieval.knn_join(
        spark.createDataFrame(queries, schema.format("query_id", "query_vector")),
        spark.createDataFrame(corpus, schema.format("chunk_id", "embedding")),
        3,
        cell_rows=cell_rows,
    )
    unit = lambda v: np.array(v, dtype="float64") / np.linalg.norm(v)
    expected = []
    for q, project, v in queries:
        scored = [(float(unit(v) @ unit(c)), -i) for i, p, c in corpus if p == project and any(c)]
        expected += [(q, -i) for _, i in sorted(scored, reverse=True)[:3]]
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == sorted(expected)


def test_wildcards_in_lookup(spark):
    assert retrieval.ilike_lookup(_chunks(spark, 12).withColumn("project_id", F.lit("p")), "class_1").count() == 1
    assert retrieval.ilike_lookup(_chunks(spark, 12).withColumn("project_id", F.lit("p")), "CLA_S1").count() == 3


def test_direct_hits_come_first_and_reversed(spark):
    chunks = _chunks(spark, 6).withColumn("chunk_id", F.col("chunk_id").cast("long")).withColumn("project_id", F.lit("p"))
    hits = retrieval.top_k(chunks, [5.0, 1.0], 2)
    merged = retrieval.merge_direct_hits(hits, retrieval.ilike_lookup(chunks, "Class"))
    order = [r.chunk_id for r in merged.orderBy("priority", "place").collect()]
    assert order == [3, 2, 1, 0, 5, 4]


def test_related_classes(spark):
    blocks = spark.createDataFrame(
        [(1, "p", "new Foo::class; private readonly Bar $b; Request::class; foo::class")], "id int, project_id string, code string"
    )
    chunks = spark.createDataFrame(
        [(2, "p", "MyFooController", "two"), (1, "p", "FOO", "one"), (3, "p", "Baz", "x"), (0, "q", "Foo", "other")],
        "chunk_id long, project_id string, class_name string, content string",
    )
    found = retrieval.related_classes(blocks, chunks, "id", "code")
    assert rows(found, "reference", "chunk_id", "content") == [("Foo", 1, "one")]


def test_embed(spark):
    df = spark.createDataFrame([("a b a",), (None,)], "t string")
    out = retrieval.embed(df, "t", retrieval.hashing_encoder(16)).select(vectors.norm(F.col("embedding"))).collect()
    assert out[0][0] == pytest.approx(1.0, abs=1e-6) and out[1][0] == 0.0


def test_feature_sets(spark):
    assert [len(feature_sets.feature_set(v)) for v in ("v1", "v2", "v3")] == [21, 15, 13]
    assert feature_sets.feature_set("v3", True)[-1] == "git_total_commits"
    assert len(feature_sets.feature_set("v3", True)) == 16
    assert feature_sets.feature_diff(feature_sets.feature_set("v2"), feature_sets.feature_set("v3")) == [
        "git_days_since_change",
        "git_nb_authors",
    ]
    df = spark.createDataFrame([("f", 1, 2.0, 3)], "file string, nb_params long, git_nb_authors double, label_risk int")
    assert feature_sets.numeric_features(df) == ["nb_params"]
    assert feature_sets.numeric_features(df, drop_leaky=False) == ["nb_params", "git_nb_authors"]
    present, missing = feature_sets.present_and_missing(df, ["nb_params", "x"])
    assert (present, missing) == (["nb_params"], ["x"])
    assert feature_sets.select_features(df, ["nb_params"], ["file"]).columns == ["file", "nb_params"]


def _learnable(spark):
    return models.balanced_weights(
        spark.range(600).select(
            (F.col("id") % 40).alias("file"),
            (F.col("id") % 7).cast("double").alias("a"),
            (F.col("id") % 11).cast("double").alias("b"),
            (F.col("id") % 7 > 3).cast("int").alias("label"),
        ),
        "label",
    )


def test_models(spark, tmp_path):
    df = _learnable(spark)
    model = models.random_forest(["a", "b"], "label", 5, 4, 3).fit(df)
    ranked = models.top_importances(models.importances(model, ["a", "b"], spark)).collect()
    assert ranked[0].feature == "a" and ranked[0].importance > 0.9
    metrics = models.dataset_metrics(models.with_score(model, df), "label")
    assert metrics.head().mcc == 1.0 and metrics.head().roc_auc == 1.0
    models.save_model(model, ["a", "b"], metrics, str(tmp_path / "best"))
    loaded, names, saved = models.load_model(spark, str(tmp_path / "best"))
    assert names == ["a", "b"] and saved.head().mcc == 1.0
    assert models.with_score(loaded, df).where("score >= 0.5").count() == df.where("label = 1").count()


def test_logistic_and_search(spark):
    df = _learnable(spark)
    total = df.agg(F.sum("weight")).head()[0]
    search = models.grid_search(df, models.logistic(["a", "b"], "label", 1.0, total, 20), {"regParam": [0.0001, 10.0]}, "label", "file", k=3)
    table = rows(models.grid_table(search, spark), "trial", "mean_mcc")
    assert table[0][1] > 0.9 and table[0][1] > table[1][1]


def test_imputation(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (-1.0,), (None,)], "x double")
    test = spark.createDataFrame([(-1.0,), (None,), (9.0,)], "x double")
    _, filled = models.impute_median(train, test, ["x"], ["x"])
    assert [r.x for r in filled.collect()] == [2.0, 2.0, 9.0]
    assert [r.x for r in models.impute_constant(test, ["x"]).collect()] == [-1.0, -1.0, 9.0]
