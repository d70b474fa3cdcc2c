"""Exact quantiles of many features by selection: counts of ordered cells, then only the cells that matter.

A pass cuts the values of each feature into cells by a function that never decreases, and
keeps for each cell its rows, least and greatest value. Only the cells in which a wanted
position lies are cut again, between their own ends, by the next pass. The first cut is the
binary logarithm in steps of 1/1024, which leaves 42 of a double's 52 fraction bits; the
second and third cut an opened cell into 2**22 parts, so three passes settle any data, and a
cell of one value is settled at once. No pass writes a row for each value, and positions are
taken from rows, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskscope.scaling import exact_quantiles, join_on, number, value_counts
from riskscope.session import materialise

STEPS = 1 << 10
PARTS = 1 << 22
# Opened cells that may be shipped to every task; a row is about 100 bytes.
SHIPPED_CELLS = 200_000
# Above the logarithm of the smallest double, so that cells of positive values are positive.
_SMALLEST = 1076


def tall_values(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, feature, value): one row per value; null and NaN are missing, a negative zero is zero."""
    wide = df.select(*by, *[(number(f) + F.lit(0.0)).alias(f) for f in features])
    return wide.unpivot(list(by), list(features), "feature", "value").where(F.col("value").isNotNull())


def first_cell(value: Column) -> Column:
    """Cell of a value by sign and logarithm; it never decreases with the value."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1025.0)) * STEPS) + _SMALLEST * STEPS
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def cell_counts(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(feature, by…, cell, n, low, high, mean, var) of the first pass, written once.

    At most 4.3 million cells for a feature and group, in practice some thousands.
    """
    value = F.col("value")
    return materialise(
        tall_values(df, features, by)
        .groupBy("feature", *by, first_cell(value).alias("cell"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            F.avg(value).alias("mean"),
            F.var_pop(value).alias("var"),
        )
    )


def moments(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(feature, by…, n, mean, std, min, max) from the first pass; the deviation is that of a sample."""
    keys = ["feature", *by]
    mean = (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("__mean")
    totals = cells.groupBy(*keys).agg(mean, F.min("low").alias("min"), F.max("high").alias("max"))
    gap = F.col("mean") - F.col("__mean")
    spread = F.sum(F.col("n") * (F.col("var") + gap * gap))
    found = join_on(cells, totals, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.max("__mean").alias("mean"),
        F.sqrt(spread / F.nullif(F.sum("n") - 1, F.lit(0))).alias("std"),
        F.max("min").alias("min"),
        F.max("max").alias("max"),
    )
    return found


def _at_positions(cells: DataFrame, wanted: DataFrame, keys: Sequence[str], slot: Sequence[str], order: str) -> DataFrame:
    """The cell in which each wanted position (`rest`, from 0 inside `slot`) lies, and its place there."""
    earlier = Window.partitionBy(*slot).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = placed.select(*slot, F.col("n").alias("__n"), "__before", F.col("low").alias("__low"), F.col("high").alias("__high"))
    inside = join_on(placed, wanted, slot).where(
        (F.col("rest") >= F.col("__before")) & (F.col("rest") < F.col("__before") + F.col("__n"))
    )
    return inside.select(
        *keys, "position", (F.col("rest") - F.col("__before")).alias("rest"), F.col("__low").alias("low"), F.col("__high").alias("high")
    )


def select_quantiles(
    df: DataFrame, features: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """(feature, by…, probability, quantile): exact, linearly interpolated quantiles.

    `cells` are those of `cell_counts`, if they exist already. Opened cells are shipped after
    their number is checked; beyond it the counts of all distinct values are used instead.
    """
    keys = ["feature", *by]
    cells = cell_counts(df, features, by) if cells is None else cells
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    target = F.col("probability") * (F.col("n") - 1)
    targets = cells.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, "n", asked)
    targets = targets.select(*keys, "probability", F.floor(target).alias("first"), F.ceil(target).alias("last"), (target - F.floor(target)).alias("part"))
    wanted = targets.select(*keys, F.explode(F.array("first", "last")).alias("position")).distinct()
    current = materialise(_at_positions(cells, wanted.withColumn("rest", F.col("position")), keys, keys, "cell"))
    settled = [current.where("low = high")]
    current = current.where("low < high")
    opened = current.select(*keys, "low", "high").distinct()
    n_opened = opened.count()
    if n_opened > SHIPPED_CELLS:
        return exact_quantiles(value_counts(df, features, by), probabilities, by)
    while n_opened:
        inside = join_on(tall_values(df, features, by), F.broadcast(opened), keys).where(F.col("value").between(F.col("low"), F.col("high")))
        part = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * PARTS)
        parts = inside.groupBy(*keys, F.col("low").alias("in_low"), F.col("high").alias("in_high"), part.alias("__part")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        outer = current.select(*keys, "position", "rest", F.col("low").alias("in_low"), F.col("high").alias("in_high"))
        found = materialise(_at_positions(parts, outer, keys, [*keys, "in_low", "in_high"], "__part"))
        settled.append(found.where("low = high"))
        current = found.where("low < high")
        opened = current.select(*keys, "low", "high").distinct()
        n_opened = opened.count()
    values = settled[0]
    for more in settled[1:]:
        values = values.unionByName(more)
    values = values.select(*keys, "position", F.col("low").alias("value"))
    first = join_on(targets, values.withColumnsRenamed({"position": "first", "value": "__first"}), [*keys, "first"])
    both = join_on(first, values.withColumnsRenamed({"position": "last", "value": "__last"}), [*keys, "last"])
    # Equal ends also where both are infinite.
    between = F.when(F.col("__first") == F.col("__last"), F.col("__first")).otherwise(
        F.col("__first") + (F.col("__last") - F.col("__first")) * F.col("part")
    )
    return both.select(*keys, "probability", between.alias("quantile"))


def select_quartiles(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), cells: DataFrame | None = None) -> DataFrame:
    """q25, q50 and q75 per (feature, by…)."""
    found = select_quantiles(df, features, [0.25, 0.5, 0.75], by, cells)
    at = lambda p: F.max(F.when(F.col("probability") == p, F.col("quantile")))
    return found.groupBy("feature", *by).agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
