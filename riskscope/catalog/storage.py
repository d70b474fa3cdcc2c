"""Writers and readers: tables written to the shared folder by one operator and read back by another."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskscope.catalog import code_tables as ct
from riskscope.catalog.plans import chunk_rows
from riskscope.catalog.registry import register
from riskscope.catalog.tables import FEATURES_SQL, features, rounded, table
from riskscope.operators import feature_sets, models, profiling
from riskscope.plans.pipeline import batch_requests_of, plan_batch
from riskscope.schemas import FEATURE_COLUMNS, IDENTITY_COLUMNS, LABEL_COLUMN
from riskscope.session import materialise, scratch_path
from riskscope.sources import files
from riskscope.sources.chunk_table import ChunkTable, project_stats
from riskscope.sources.versioned_chunks import VersionedChunks


def _rows(spark, sf_dir):
    """Line items in the layout of stored feature rows; every seventh last feature is missing."""
    lines = table(spark, sf_dir, "lineitem")
    texts = [F.concat(F.lit(f"{c}-"), F.col("l_orderkey").cast("string")).alias(c) for c in IDENTITY_COLUMNS]
    numbers = [(F.col("l_linenumber") * (i + 1) + F.col("l_partkey") % 5).cast("long").alias(c) for i, c in enumerate(FEATURE_COLUMNS[:-1])]
    last = F.when(F.col("l_partkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity") / 2).alias(FEATURE_COLUMNS[-1])
    return lines.select(*texts, *numbers, last, (F.col("l_returnflag") == "R").cast("int").alias(LABEL_COLUMN))


_SUMS_SQL = f"""SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_files, {", ".join(
    f"sum(l_linenumber * {i + 1} + l_partkey % 5)::BIGINT AS {c}" for i, c in enumerate(FEATURE_COLUMNS[:-1])
)}, round(sum(l_quantity / 2) FILTER (l_partkey % 7 <> 0), 2) AS {FEATURE_COLUMNS[-1]},
  count(*) FILTER (l_partkey % 7 = 0) AS n_missing, sum((l_returnflag = 'R')::INT)::BIGINT AS {LABEL_COLUMN} FROM lineitem"""


def _sums(df):
    last = FEATURE_COLUMNS[-1]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(IDENTITY_COLUMNS[0]).alias("n_files"),
        *[F.sum(c).alias(c) for c in FEATURE_COLUMNS[:-1]],
        F.round(F.sum(last), 2).alias(last),
        F.count_if(F.col(last).isNull()).alias("n_missing"),
        F.sum(LABEL_COLUMN).alias(LABEL_COLUMN),
    )


@register("features_parquet_round_trip", _SUMS_SQL)
def features_parquet(spark, sf_dir):
    """Feature rows as Parquet; a stored NaN is read as missing."""
    path = scratch_path(spark) + ".parquet"
    files.write_features(_rows(spark, sf_dir), path)
    return _sums(files.read_features(spark, path))


@register("features_csv_round_trip", _SUMS_SQL)
def features_csv(spark, sf_dir):
    """Feature rows as CSV with a header."""
    path = scratch_path(spark)
    files.write_features(_rows(spark, sf_dir), path, "csv")
    return _sums(files.read_features(spark, path))


@register(
    "select_features",
    f"WITH {FEATURES_SQL} SELECT file, method, round(quantity, 6) AS quantity, round(price, 6) AS price FROM features",
)
def select_features(spark, sf_dir):
    """The wanted columns that exist, behind the kept ones."""
    df = features(spark, sf_dir)
    return rounded(feature_sets.select_features(df, ["quantity", "absent", "price"], ["file", "method"]))


@register(
    "numeric_features",
    f"WITH {FEATURES_SQL} SELECT round(sum(quantity), 2) AS quantity, round(sum(price), 2) AS price FROM features",
)
def numeric_features(spark, sf_dir):
    """Sums of the numeric columns that are left when identity, label and text are dropped."""
    df = features(spark, sf_dir).select("file", "profile", "label", "quantity", "price")
    names = feature_sets.numeric_features(df, drop=("file", "label"))
    return df.agg(*[F.round(F.sum(c), 2).alias(c) for c in names])


@register(
    "constant_labels",
    f"""WITH {FEATURES_SQL} SELECT l_linestatus AS part, min(l_returnflag = 'R') = max(l_returnflag = 'R') AS is_constant FROM lineitem GROUP BY 1
    UNION ALL SELECT 'positive', true""",
)
def constant_labels(spark, sf_dir):
    """Whether the label is constant in each line status, and among the positives."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("part"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    positive = rows.where("label = 1").withColumn("part", F.lit("positive"))
    return profiling.constant_labels(rows.unionByName(positive), "label", "part")


@register(
    "report_round_trip",
    "SELECT l_returnflag AS flag, count(*)::VARCHAR AS n FROM lineitem GROUP BY 1",
)
def report_round_trip(spark, sf_dir):
    path = scratch_path(spark)
    files.write_report(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).csv(path)


@register(
    "export_top",
    f"""WITH {FEATURES_SQL}, s AS (SELECT file, method, coalesce(score, 0) AS risk_score FROM features),
    t AS (SELECT * FROM s ORDER BY risk_score DESC, file, method LIMIT 12)
    SELECT 'all' AS export, count(*) AS n, round(sum(risk_score), 3) AS total FROM s UNION ALL SELECT 'top', count(*), round(sum(risk_score), 3) FROM t""",
)
def export_top(spark, sf_dir):
    """All scored rows and the file of the highest ones, both read back."""
    scored = features(spark, sf_dir).select("file", "method", F.coalesce("score", F.lit(0.0)).alias("risk_score"))
    everything, top = scratch_path(spark), scratch_path(spark)
    files.export_scored(scored, everything, top, 12, ties=["file", "method"])
    read = lambda path, name: spark.read.schema("file long, method long, risk_score double").option("header", True).csv(path).withColumn("export", F.lit(name))
    return read(everything, "all").unionByName(read(top, "top")).groupBy("export").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("risk_score"), 3).alias("total")
    )


@register(
    "class_facts_round_trip",
    f"SELECT {ct.CLASS} AS class_name, true AS same_methods, true AS same_attributes FROM part",
)
def class_facts_round_trip(spark, sf_dir):
    """Class facts as JSON lines, attribute values as variants, read back."""
    path = scratch_path(spark)
    given = ct.raw_facts(spark, sf_dir)
    given.write.json(path)
    facts = files.read_class_facts(spark, path)
    text = lambda df, prefix: df.select(
        "class_name", F.to_json("methods").alias(f"{prefix}_methods"), F.to_json("class_attributes").alias(f"{prefix}_attributes")
    )
    # Spark takes the texts for as small as the keys they follow from, so a hint keeps them out of a broadcast.
    both = text(given, "first").join(text(facts, "second").hint("merge"), "class_name")
    return both.select(
        "class_name",
        (F.col("first_methods") == F.col("second_methods")).alias("same_methods"),
        (F.col("first_attributes") == F.col("second_attributes")).alias("same_attributes"),
    )


@register(
    "examples_round_trip",
    "SELECT item_id + 1 AS example_no, 'Cas ' || item_id AS demande_utilisateur, text AS test_ideal FROM benchmark",
)
def examples_round_trip(spark, sf_dir):
    """Examples as JSON lines, numbered in file order."""
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", F.concat(F.lit("Cas "), F.col("item_id").cast("string")).alias("demande_utilisateur"), F.col("text").alias("test_ideal")
    )
    path = scratch_path(spark)
    files.write_examples(rows, path, ["item_id"])
    return files.read_examples(spark, path, lines=True).select("example_no", "demande_utilisateur", "test_ideal")


def _document_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.lit("t").alias("chunk_type"), F.col("source").alias("file_path"),
        F.col("source").alias("class_name"), F.col("text").alias("content"), F.array(F.lit(1.0).cast("float")).alias("embedding"),
        F.col("lang").alias("project_id"),
    )


_EVEN_FRENCH = "project_id = 'fr' AND cast(chunk_id AS long) % 2 = 0"


@register(
    "replaced_projects",
    "SELECT lang AS project_id, count(*) AS chunks FROM documents WHERE lang <> 'es' AND (lang <> 'fr' OR doc_id % 2 = 0) GROUP BY lang",
)
def replaced_projects(spark, sf_dir):
    """A chunk table after one project was replaced by half of it and one was dropped."""
    documents = _document_chunks(spark, sf_dir)
    store = ChunkTable(spark, f"chunks_{uuid.uuid4().hex}")
    try:
        store.append(documents)
        store.replace_project("fr", documents.where(_EVEN_FRENCH))
        store.drop_project("es")
        return materialise(store.stats())
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {store.name}")


@register(
    "project_snapshots",
    """SELECT 'before' AS snapshot, lang AS project_id, count(*) AS chunks FROM documents GROUP BY lang UNION ALL
    SELECT 'after', lang, count(*) FROM documents WHERE lang <> 'es' AND (lang <> 'fr' OR doc_id % 2 = 0) GROUP BY lang""",
)
def project_snapshots(spark, sf_dir):
    """Versioned folders: a reader from before a replacement and one from after it, both read afterwards."""
    documents = _document_chunks(spark, sf_dir)
    store = VersionedChunks(spark, scratch_path(spark))
    store.replace_projects(documents)
    before = store.read()
    store.replace_project("fr", documents.where(_EVEN_FRENCH))
    store.drop_project("es")
    snapshot = lambda df, name: project_stats(df).select(F.lit(name).alias("snapshot"), "project_id", "chunks")
    return snapshot(before, "before").unionByName(snapshot(store.read(), "after"))


@register(
    "model_round_trip",
    f"WITH {FEATURES_SQL} SELECT file, method, true AS same_score, true AS same_band FROM features",
)
def model_round_trip(spark, sf_dir):
    """Scores of a stored and reloaded model against those of the fitted one."""
    from riskscope.operators import scoring

    names = ["quantity", "price"]
    df = models.balanced_weights(features(spark, sf_dir).select("file", "method", "label", *names), "label")
    model = models.logistic(names, "label", 1.0, 1000.0, 10).fit(df)
    path = scratch_path(spark)
    models.save_model(model, names, spark.range(1), path)
    loaded, kept, _ = models.load_model(spark, path)
    assert kept == names
    both = models.with_score(loaded, models.with_score(model, df, "first"), "second")
    return both.select(
        "file", "method", (F.abs(F.col("first") - F.col("second")) < 1e-12).alias("same_score"),
        (scoring.risk_band(F.col("first")) == scoring.risk_band(F.col("second"))).alias("same_band"),
    )


@register(
    "impute_constant",
    "SELECT l_orderkey AS file, l_linenumber AS method, coalesce(nullif(l_tax, 0.0), -1.0::DOUBLE) AS tax FROM lineitem",
)
def impute_constant(spark, sf_dir):
    return models.impute_constant(features(spark, sf_dir).select("file", "method", "tax"), ["tax"])


@register(
    "batch_plan",
    f"SELECT {ct.CLASS} AS class_name, {ct.CLASS} || 'Test' AS test_name FROM part",
)
def batch_plan(spark, sf_dir):
    """Files of a batch that names every class of the table."""
    chunks = chunk_rows(spark, sf_dir)
    requests = materialise(batch_requests_of(chunks.select("class_name").distinct()))
    made = plan_batch(chunks, requests).files().select("class_name")
    return made.join(requests.select("class_name", "test_name"), "class_name")


@register(
    "file_level_counts",
    """WITH g AS (SELECT lang || '-' || (n_chars % 20) AS file, max(toxic) AS label FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    s AS (SELECT count(*) AS n, avg(label) AS p FROM g)
    SELECT n AS n_files, round(2 * p / (1 + p), 6) AS file_f1_baseline, round(p, 6) AS file_positive_rate FROM s""",
)
def file_level_counts(spark, sf_dir):
    """What a file-level report says whatever the model: files, positives, the all-positive baseline."""
    from riskscope.catalog.modelling import labelled

    scored = labelled(spark, sf_dir).withColumn("score", F.lit(0.9))
    report = models.group_level_report(scored, "label", "file")
    return rounded(report.select("n_files", "file_f1_baseline", "file_positive_rate"))


@register(
    "cross_dataset_counts",
    """WITH r AS (SELECT 'first→third' AS run UNION ALL SELECT 'second→third'),
    t AS (SELECT count(*) AS n_total, sum((l_returnflag = 'R')::INT)::BIGINT AS n_true_1, avg((l_returnflag = 'R')::INT) AS p FROM lineitem WHERE l_linenumber IN (5, 6))
    SELECT run, 'done' AS status, n_total, n_true_1, round(greatest(p, 1 - p), 4) AS baseline FROM r, t
    UNION ALL SELECT 'first→unlabelled', 'skipped', NULL, NULL, NULL""",
)
def cross_dataset_counts(spark, sf_dir):
    """The exact part of training on some datasets and testing on others; one feature is missing in all train rows."""
    df = features(spark, sf_dir)
    datasets = {
        "first": df.where("method IN (1, 2)"),
        "second": df.where("method IN (3, 4)").withColumn("tax", F.lit(None).cast("double")),
        "third": df.where("method IN (5, 6)"),
        "unlabelled": df.where("method > 6").withColumn("label", F.lit(0)),
    }
    runs = {
        "first→third": (["first"], "third"),
        "second→third": (["second"], "third"),
        "first→unlabelled": (["first"], "unlabelled"),
    }
    make = lambda names: models.random_forest(names, "label", 2, 2, 5)
    found = models.cross_dataset_eval(datasets, runs, ["quantity", "tax"], "label", make)
    return found.select("run", "status", "n_total", "n_true_1", "baseline")
