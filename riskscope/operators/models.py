"""Classifiers on feature rows with group-aware validation.

Rows stay distributed: Spark ML trains on the executors, and the driver only sees models,
one row of class counts, and a few rows of metrics per fold.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskscope.operators import evaluation, folds, profiling
from riskscope.operators.boosting import BoostedModel, BoostedTrees
from riskscope.operators.selection import select_quantiles

IMPUTED = -1.0

# Parameters that are tried and parameters of the quick and boosted models.
LOGISTIC_C = [0.01, 0.1, 1.0, 10.0]
FOREST_GRID = {"trees": [100, 200], "depth": [4, 8, 12], "leaf": [3, 5, 10]}
QUICK_FOREST = {"trees": 100, "depth": 8, "leaf": 5}
BOOSTED = {"rounds": 200, "depth": 4, "step": 0.1, "least_hessian": 5.0}
CROSS_PROJECT_BOOSTED = {"rounds": 400, "depth": 4, "step": 0.05}


def impute_constant(df: DataFrame, features: Sequence[str], value: float = IMPUTED) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(value)) for f in features})


def impute_median(
    train: DataFrame, test: DataFrame, features: Sequence[str], sentinel_columns: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Fill nulls of both parts with the exact medians of the train part.

    In `sentinel_columns` the -1 sentinel counts as null. The medians are selected in cells,
    so no task holds a whole column. A feature that is null in all train rows has no median
    and becomes the constant `IMPUTED`, which no model can learn from.
    """
    clear = lambda df: df.withColumns(
        {f: F.nullif(F.col(f).cast("double"), F.lit(IMPUTED)) if f in sentinel_columns else F.col(f).cast("double") for f in features}
    )
    train, test = clear(train), clear(test)
    rows = select_quantiles(train, features, [0.5]).collect()
    medians = {r["feature"]: r["quantile"] for r in rows}
    fill = {f: medians.get(f, IMPUTED) for f in features}
    return train.na.fill(fill), test.na.fill(fill)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add n / (2·n_class) per row."""
    n0, n1 = class_counts(df, label)
    n = n0 + n1
    weight = F.when(F.col(label) == 1, n / (2.0 * max(n1, 1))).otherwise(n / (2.0 * max(n0, 1)))
    return df.withColumn(out, weight)


def positive_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add n0/n1 for positives and 1 for negatives."""
    n0, n1 = class_counts(df, label)
    return df.withColumn(out, F.when(F.col(label) == 1, n0 / max(n1, 1)).otherwise(F.lit(1.0)))


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).head()
    return row[0], row[1]


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def logistic(features: Sequence[str], label: str, c: float = 1.0, weight_sum: float = 1.0, max_iter: int = 1000) -> Pipeline:
    """Standardised, L2-penalised logistic regression; `weight_sum` turns C into a penalty per unit of weight."""
    return Pipeline(
        stages=[
            _assembler(features, "raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(
                labelCol=label, weightCol="weight", regParam=1.0 / (c * weight_sum), elasticNetParam=0.0,
                standardization=False, maxIter=max_iter,
            ),
        ]
    )


def random_forest(features: Sequence[str], label: str, trees: int, depth: int, leaf: int, seed: int = 42) -> Pipeline:
    return Pipeline(
        stages=[
            _assembler(features),
            RandomForestClassifier(
                labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed
            ),
        ]
    )


def boosted_trees(
    features: Sequence[str], label: str, rounds: int, depth: int, step: float, seed: int = 42, **options
) -> BoostedTrees:
    """Second-order boosting on 80 percent of rows and features for each tree; `options` as in `BoostedTrees`."""
    return BoostedTrees(features, label, rounds, depth, step, seed=seed, **options)


def with_score(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Rows with the positive probability of a fitted model, without the vector columns."""
    scored = model.transform(df)
    return scored.withColumn(name, vector_to_array("probability").getItem(1)).select(*df.columns, name)


class MccEvaluator(Evaluator):
    """Matthews correlation of the `prediction` column, for parameter searches."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        row = evaluation.binary_metrics(
            dataset.select(self.label, F.col("prediction").cast("int").alias("prediction")), self.label, "prediction"
        ).head()
        return float(row["mcc"])

    def isLargerBetter(self) -> bool:
        return True


def grid_search(
    df: DataFrame, pipeline: Pipeline, grid: dict[str, Sequence], label: str, group: str, k: int = 5, seed: int = 42, parallelism: int = 4
) -> CrossValidatorModel:
    """Parameter search on group folds, scored by MCC.

    `grid` maps parameter names of the pipeline's last stage to values.
    """
    stage = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(stage.getParam(name), list(values))
    validator = CrossValidator(
        estimator=pipeline, estimatorParamMaps=builder.build(), evaluator=MccEvaluator(label), numFolds=k,
        foldCol="fold", parallelism=parallelism, seed=seed,
    )
    return validator.fit(folds.group_folds(df, group, k, seed))


def logistic_grid(weight_sum: float, values: Sequence[float] = tuple(LOGISTIC_C)) -> dict[str, Sequence]:
    """The grid of C as the penalty per unit of weight that the solver takes."""
    return {"regParam": [1.0 / (c * weight_sum) for c in values]}


def forest_grid(grid: dict[str, Sequence] = FOREST_GRID) -> dict[str, Sequence]:
    return {"numTrees": grid["trees"], "maxDepth": grid["depth"], "minInstancesPerNode": grid["leaf"]}


def quick_forest(features: Sequence[str], label: str) -> Pipeline:
    return random_forest(features, label, **QUICK_FOREST)


def default_boosted(features: Sequence[str], label: str, cross_project: bool = False) -> Pipeline:
    return boosted_trees(features, label, **(CROSS_PROJECT_BOOSTED if cross_project else BOOSTED))


def grid_table(search: CrossValidatorModel, spark: SparkSession) -> DataFrame:
    """Mean MCC of each tried parameter combination."""
    rows = [
        (i, json.dumps({p.name: v for p, v in params.items()}, sort_keys=True), float(m))
        for i, (params, m) in enumerate(zip(search.getEstimatorParamMaps(), search.avgMetrics))
    ]
    return spark.createDataFrame(rows, "trial int, params string, mean_mcc double")


def cross_validated(
    df: DataFrame, pipeline: Pipeline, label: str, fold: str = "fold", k: int = 5, with_train: bool = False
) -> DataFrame:
    """Out-of-fold scores: every row scored by the model that did not see its fold.

    `with_train` adds the scores of the rows each model was trained on; `cv_part` then tells
    train from test, and the fold column names the model.
    """
    parts = []
    for i in range(k):
        model = pipeline.fit(df.where(F.col(fold) != i))
        if with_train:
            part = F.when(F.col(fold) == i, "test").otherwise("train")
            parts.append(with_score(model, df.withColumn("cv_part", part)).withColumn(fold, F.lit(i)))
        else:
            parts.append(with_score(model, df.where(F.col(fold) == i)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cv_report(scored: DataFrame, label: str, fold: str = "fold", name: str = "model") -> DataFrame:
    """Fold means and deviations of out-of-fold scores, one row.

    Scores with a `cv_part` column also give those of the train rows, and the gap between both.
    """
    return evaluation.cv_report(scored, label, "score", fold).select(F.lit(name).alias("model"), "*")


def holdout_scores(df: DataFrame, split: DataFrame, pipeline: Pipeline, group: str) -> DataFrame:
    """All rows with their part and the score of the model trained on the train part."""
    parted = df.join(split.select(group, "part"), group)
    model = pipeline.fit(parted.where(F.col("part") == "train"))
    return with_score(model, parted)


def group_level_report(scored: DataFrame, label: str, group: str) -> DataFrame:
    """Out-of-fold predictions voted per group."""
    rows = scored.withColumn("pred", evaluation.predicted(F.col("score")))
    return evaluation.group_report(rows, group, label, "pred")


def importances(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Importance of each feature in a tree model, or absolute coefficient in a linear one."""
    if isinstance(model, BoostedModel):
        return spark.createDataFrame(model.importances(), "feature string, importance double")
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def top_importances(table: DataFrame, n: int = 10) -> DataFrame:
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def compare_feature_sets(
    df: DataFrame, sets: dict[str, Sequence[str]], make, label: str, group: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Hold-out and CV figures of the same model on several feature sets.

    `make(features)` builds the pipeline. Rows carry a `weight` column.
    """
    out = None
    split = folds.group_split(df, group, seed=seed)
    for name, features in sets.items():
        pipeline = make(features)
        held = evaluation.holdout_report(holdout_scores(df, split, pipeline, group), label, "score", "part")
        cv = cv_report(cross_validated(folds.group_folds(df, group, k, seed), pipeline, label, k=k), label, name=name)
        row = cv.join(held.withColumn("model", F.lit(name)), "model")
        out = row if out is None else out.unionByName(row)
    return out


def set_deltas(comparison: DataFrame, first: str, second: str) -> DataFrame:
    """Change of CV F1, gap and AUC from one feature set to another; one row of two rows."""
    pick = lambda name, c: F.max(F.when(F.col("model") == name, F.col(c)))
    row = comparison.agg(
        *[(pick(second, c) - pick(first, c)).alias(f"delta_{c}") for c in ("cv_f1_mean", "overfit_gap", "test_auc")]
    )
    return row.withColumn(
        "verdict",
        F.when(F.col("delta_cv_f1_mean") > 0, f"{second} better")
        .when(F.col("delta_cv_f1_mean") < 0, f"{first} better")
        .otherwise("no difference"),
    )


def dataset_metrics(scored: DataFrame, label: str) -> DataFrame:
    """MCC, balanced accuracy, ROC-AUC, average precision and baseline of scored rows, one row."""
    rows = scored.withColumn("pred", evaluation.predicted(F.col("score")))
    one = lambda df: df.withColumn("__one", F.lit(1))
    joined = one(evaluation.binary_metrics(rows, label, "pred"))
    for curve in (evaluation.roc_auc(scored, label, "score"), evaluation.average_precision(scored, label, "score")):
        joined = joined.join(F.broadcast(one(curve)), "__one", "left")
    return joined.select(
        F.round("mcc", 4).alias("mcc"),
        F.round("balanced_accuracy", 4).alias("bal_acc"),
        F.round("roc_auc", 4).alias("roc_auc"),
        F.round("average_precision", 4).alias("pr_auc"),
        F.round("majority_baseline", 4).alias("baseline"),
        (F.col("tp") + F.col("fp")).alias("n_pred_1"),
        (F.col("tp") + F.col("fn")).alias("n_true_1"),
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_total"),
    )


def cross_dataset_eval(
    datasets: dict[str, DataFrame],
    runs: dict[str, tuple[Sequence[str], str]],
    features: Sequence[str],
    label: str,
    make,
    sentinel_columns: Sequence[str] = (),
) -> DataFrame:
    """Train on some datasets and test on another, one row per run.

    Runs whose test set has one class only are reported as skipped.
    """
    from riskscope.operators.feature_sets import union_datasets

    out = None
    for name, (train_names, test_name) in runs.items():
        test = datasets[test_name]
        if profiling.constant_label(test, label):
            row = test.sparkSession.createDataFrame([(name, "skipped")], "run string, status string")
        else:
            train, common = union_datasets([datasets[n] for n in train_names], features, label)
            train, held = impute_median(train, test.select(*common, label), common, sentinel_columns)
            model = make(common).fit(positive_weights(train, label))
            scored = with_score(model, held.withColumn("weight", F.lit(1.0)))
            row = dataset_metrics(scored, label).select(F.lit(name).alias("run"), F.lit("done").alias("status"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def leak_vs_honest(
    df: DataFrame, clean: Sequence[str], leaky: Sequence[str], label: str, group: str, row_keys: Sequence[str], make, k: int = 5, seed: int = 0
) -> DataFrame:
    """The same model under the honest protocol (group folds, clean features) and the leaky one."""
    honest = folds.group_folds(df, group, k, seed)
    shuffled = folds.row_folds(df, row_keys, k, seed)
    rows = []
    for name, frame, features in (("honest", honest, clean), ("leaky", shuffled, leaky)):
        scored = cross_validated(frame, make(features), label, k=k)
        rows.append(dataset_metrics(scored, label).select(F.lit(name).alias("protocol"), "*"))
    return rows[0].unionByName(rows[1])


def save_model(model: PipelineModel, features: Sequence[str], metrics: DataFrame, path: str) -> None:
    """Model, feature order and metrics below one folder."""
    model.write().overwrite().save(f"{path}/model")
    spark = metrics.sparkSession
    names = spark.createDataFrame(list(enumerate(features)), "place int, feature string")
    names.coalesce(1).write.mode("overwrite").json(f"{path}/features")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], DataFrame]:
    names = spark.read.schema("place int, feature string").json(f"{path}/features").orderBy("place").collect()
    return PipelineModel.load(f"{path}/model"), [r["feature"] for r in names], spark.read.json(f"{path}/metrics")
