"""Whole planning runs over any number of classes at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskscope.functions.commits import safe_name
from riskscope.operators import chunks as chunk_ops
from riskscope.plans import rendering, scenarios
from riskscope.plans.settings import AppSettings
from riskscope.session import materialise


@dataclass(frozen=True)
class TestPlan:
    """Lazy results of one planning run."""

    __test__ = False

    classes: DataFrame
    internal: DataFrame
    metadata: DataFrame
    scenarios: DataFrame
    unrouted: DataFrame
    segments: DataFrame

    def files(self) -> DataFrame:
        return rendering.join_segments(self.segments)


def plan_tests(chunks: DataFrame, app: AppSettings = AppSettings(), key: str = "class_name") -> TestPlan:
    """Scenarios and files of all classes in a chunk table; internal classes are set apart.

    `chunks` is read a few times: pass a stored table. Classes are joined with their
    settings by name, and nothing is gathered per class.
    """
    keys = [key]
    settings = chunk_ops.class_settings(chunks, keys)
    functional, internal = chunk_ops.split_internal(settings)
    references = chunk_ops.method_references(chunks)
    ranked = scenarios.rank_routes(scenarios.first_routes(references, keys), keys).join(functional, keys)
    metadata = chunk_ops.chunk_metadata(ranked, F.col("class_role"), app.role_map)
    expanded = scenarios.expand(metadata, keys, app, keep=["first_route", "last_pos"])
    unrouted = scenarios.unrouted_methods(references, keys).join(functional, keys)
    segments = rendering.file_segments(functional, expanded, unrouted, key, app)
    return TestPlan(functional, internal, metadata, expanded, unrouted, segments)


def batch_requests(spark: SparkSession, class_names: Sequence[str], prefix: str = "Tests fonctionnels pour") -> DataFrame:
    """(class_name, description, test_name) of a batch of named classes."""
    if not class_names:
        raise ValueError("a batch has one class at least")
    return batch_requests_of(spark.createDataFrame([(c,) for c in class_names], "class_name string"), prefix)


def batch_requests_of(classes: DataFrame, prefix: str = "Tests fonctionnels pour") -> DataFrame:
    """(class_name, description, test_name) of a batch that is a table of class names."""
    return classes.select(
        "class_name",
        F.concat_ws(" ", F.lit(prefix), "class_name").alias("description"),
        F.concat(safe_name(F.col("class_name")), F.lit("Test")).alias("test_name"),
    )


def plan_batch(chunks: DataFrame, requests: DataFrame, app: AppSettings = AppSettings()) -> TestPlan:
    """The plan of the requested classes, whose chunks are stored first.

    Unstored, every branch of the plan would repeat the join, and where `chunks` is a union, adaptive
    execution may cut the parts of the joins below it into unequal numbers, which Spark rejects.
    """
    wanted = chunks.join(requests.select("class_name"), "class_name", "left_semi")
    return plan_tests(materialise(wanted), app)
