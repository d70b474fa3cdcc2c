"""Class facts to method rows and feature rows; every step is a narrow transformation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskscope.functions import code, facts
from riskscope.operators.changes import BUGFIX_THRESHOLD, attach_change_metrics, risk_label


def class_facts(raw: DataFrame) -> DataFrame:
    """Interpreted facts, one row per class; files without a class are dropped."""
    no_params = F.array().cast("array<struct<type: string, name: string>>")
    own = [c for c in raw.columns if c not in ("class_attributes", "class_docblock", "methods")]
    prefixed = raw.where(F.coalesce("class_name", F.lit("")) != "").select(
        *own,
        "methods",
        facts.class_prefix(F.col("class_attributes"), F.col("class_docblock")).alias("class_route_prefix"),
        facts.grants(F.col("class_attributes"), F.col("class_docblock")).alias("class_grants"),
    )
    read = prefixed.select(
        *own,
        "class_route_prefix",
        "class_grants",
        facts.method_facts(F.col("methods"), F.col("class_route_prefix")).alias("method_facts"),
    )
    constructor = F.try_element_at(F.filter("method_facts", lambda m: m["name"] == "__construct"), F.lit(-1))
    return read.select(
        "*",
        F.coalesce(constructor["params"], no_params).alias("constructor_params"),
        code.properties(F.col("content")).alias("properties"),
        facts.class_profile(F.col("method_facts")).alias("controller_profile"),
    )


def method_rows(classes: DataFrame) -> DataFrame:
    """One row per method with its class columns; constructors are left out but still counted.

    The outer form keeps Spark from testing the facts for emptiness, which would compute them twice.
    """
    return (
        classes.select(
            "*",
            F.size("method_facts").cast("long").alias("nb_methods_in_class"),
            F.posexplode_outer("method_facts").alias("method_pos", "m"),
        )
        .drop("method_facts")
        .where(F.col("m.name") != "__construct")
    )


def feature_rows(
    classes: DataFrame, metrics: DataFrame, threshold: int = BUGFIX_THRESHOLD
) -> DataFrame:
    """The feature dataset: one labelled row per (file, class, method)."""
    flag = lambda c: c.cast("long")
    size = lambda c: F.size(c).cast("long")
    types = F.col("m.response_types")
    body = code.method_body(F.col("content"), F.col("m.name"))
    rows = (
        method_rows(classes)
        .withColumn("__body", body)
        .select(
            "file",
            F.col("class_name").alias("class"),
            F.col("m.name").alias("method"),
            F.col("controller_profile").alias("profile"),
            size("m.routes").alias("nb_routes_method"),
            flag(F.size("m.routes") > 0).alias("has_route_attr"),
            size("m.params").alias("nb_params"),
            flag(F.col("m.has_form")).alias("has_form"),
            flag(F.col("m.is_ajax_only")).alias("is_ajax_only"),
            size("m.voter_checks").alias("nb_voter_checks"),
            size("m.response_types").alias("nb_response_types"),
            flag(facts.mentions(types, "render")).alias("has_render"),
            flag(facts.mentions(types, "redirect")).alias("has_redirect"),
            flag(facts.mentions(types, "json")).alias("has_json"),
            flag(facts.mentions(types, "file_download") | facts.mentions(types, "binary")).alias(
                "has_file_download"
            ),
            size("m.method_grants").alias("nb_method_grants"),
            size("class_grants").alias("nb_class_grants"),
            size("constructor_params").alias("nb_constructor_deps"),
            "nb_methods_in_class",
            flag(F.col("m.name") == "__invoke").alias("is_invoke"),
            code.file_loc(F.col("content")).alias("file_loc"),
            code.body_loc(F.col("__body")).alias("method_loc"),
            code.cyclomatic(F.col("__body")).alias("cyclomatic_complexity"),
        )
    )
    labelled = attach_change_metrics(rows, metrics)
    return labelled.select(
        *rows.columns,
        F.col("bugfix_count").alias("git_bugfix_count"),
        F.col("total_commits").alias("git_total_commits"),
        F.col("nb_authors").alias("git_nb_authors"),
        F.col("days_since_change").alias("git_days_since_change"),
        risk_label(F.col("bugfix_count"), threshold).alias("label_risk"),
    )


def profile_by_class(methods: DataFrame, keys: list[str]) -> DataFrame:
    """Class profile as an aggregation over method rows (`is_routed`, `response_types`).

    Counts combine before the shuffle, so a class with very many methods costs one row per task.
    """
    routed = F.col("is_routed")
    counts = methods.groupBy(*keys).agg(
        F.count_if(routed).alias("routed"),
        F.count_if(routed & facts.mentions(F.col("response_types"), "json")).alias("json"),
        F.count_if(routed & facts.mentions(F.col("response_types"), "render")).alias("render"),
    )
    return counts.withColumn(
        "profile", facts.profile_from_counts(F.col("routed"), F.col("json"), F.col("render"))
    )
