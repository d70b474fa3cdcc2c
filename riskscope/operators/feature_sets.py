"""Named feature sets and their choice; driver-side lists, no query."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from riskscope.schemas import (
    FEATURE_COLUMNS,
    IDENTITY_COLUMNS,
    LABEL_COLUMN,
    LABEL_SOURCE,
    LEAKY_COLUMNS,
    REDUNDANT_FEATURES,
    TOTAL_COMMITS,
    WINDOW_FEATURES,
)


def feature_set(version: str = "v3", with_commits: bool = False) -> list[str]:
    """v1: all safe features; v2: without redundant ones; v3: also without the label's window.

    With the total commit count added, v3 falls back to v2.
    """
    v1 = [c for c in FEATURE_COLUMNS if c not in (LABEL_SOURCE, TOTAL_COMMITS)]
    v2 = [c for c in v1 if c not in REDUNDANT_FEATURES]
    sets = {"v1": v1, "v2": v2, "v3": [c for c in v2 if c not in WINDOW_FEATURES]}
    if with_commits:
        return [*sets["v2" if version == "v3" else version], TOTAL_COMMITS]
    return sets[version]


def present_and_missing(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """The wanted columns a frame has, in order, and those it lacks."""
    columns = set(df.columns)
    return [c for c in wanted if c in columns], [c for c in wanted if c not in columns]


def select_features(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    present, _ = present_and_missing(df, wanted)
    return df.select(*[c for c in keep if c not in present], *present)


def numeric_features(
    df: DataFrame, drop_leaky: bool = True, drop: Sequence[str] = (*IDENTITY_COLUMNS, LABEL_COLUMN)
) -> list[str]:
    """Numeric columns other than identity, label and, on request, leaky ones."""
    dropped = {*drop, *(LEAKY_COLUMNS if drop_leaky else [])}
    return [f.name for f in df.schema.fields if f.name not in dropped and isinstance(f.dataType, T.NumericType)]


def feature_diff(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """Features of the first set that the second lacks, sorted."""
    return sorted(set(a) - set(b))


def union_datasets(frames: Sequence[DataFrame], wanted: Sequence[str], label: str = LABEL_COLUMN) -> tuple[DataFrame, list[str]]:
    """The frames stacked on the features all of them have, in the wanted order."""
    common = [c for c in wanted if all(c in df.columns for df in frames)]
    stacked = reduce(
        DataFrame.unionByName,
        [df.select(*[F.col(c).cast("double").alias(c) for c in common], label) for df in frames],
    )
    return stacked, common
