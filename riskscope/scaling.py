"""Positions, running sums and exact quantiles that no single hot key can pin to one task.

A window partitioned by a key sends every row of that key to one task. The helpers here
split each key into ordered buckets first: rows are numbered inside (key, bucket), and
the bucket totals, a far smaller table, give each bucket its starting offset. Results
are the same as those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskscope.session import materialise

# Rows of one (key, bucket) pair when the bucket is cut from a unique integer position.
POSITION_BUCKET_ROWS = 1 << 20
# Distinct values of a feature that one task ranks.
SLICE_VALUES = 200_000
# Rows of one task where a narrow row is turned into much text or many facts.
SPREAD_ROWS = 8192


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, a null key matching a null key; the keys appear once."""
    renamed = right.select(*[F.col(c).alias(f"__on_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__on_{k}" for k in keys])


def spread(df: DataFrame, rows: int = SPREAD_ROWS, *by: str) -> DataFrame:
    """The same rows in tasks of about `rows` each, dealt evenly or by the columns `by`.

    Files are split by bytes, so a few tasks read millions of narrow rows and do all the work that
    follows. The number of tasks grows with the rows; as it is given, adaptive execution keeps it.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, *by) if tasks > 1 else df


def position_bucket(position: Column, width: int = POSITION_BUCKET_ROWS) -> Column:
    """Bucket of an integer position that is unique inside its key: at most `width` rows each."""
    return F.floor(position / F.lit(width)).cast("long")


def hash_bucket(hex_digest: Column) -> Column:
    """Bucket of a hexadecimal digest: its first three digits, 4096 even slices in digest order."""
    return F.conv(F.substring(hex_digest, 1, 3), 16, 10).cast("long")


def bucketed_position(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str,
    total_name: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its key, and on request the rows of the key.

    `bucket` must not decrease along `order`. A null key is a key like any other.
    """
    tagged = df.withColumn("__bucket", bucket)
    slot = [*keys, "__bucket"]
    offsets = _offsets(tagged.groupBy(*slot).agg(F.count(F.lit(1)).alias("__n")), keys, ["__n"])
    inside = Window.partitionBy(*slot).orderBy(*order)
    placed = (
        join_on(tagged.withColumn("__inside", F.row_number().over(inside)), offsets, slot)
        .withColumn(name, (F.col("__inside") + F.col("__n_before")).cast("long"))
    )
    if total_name:
        placed = placed.withColumn(total_name, F.col("__n_total"))
    return placed.drop("__bucket", "__inside", "__n_before", "__n_total")


def bucketed_running_sums(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], sums: Sequence[str]
) -> DataFrame:
    """Add `<s>_upto` (running sum including the row) and `<s>_total` for each column in `sums`."""
    tagged = df.withColumn("__bucket", bucket)
    slot = [*keys, "__bucket"]
    totals = tagged.groupBy(*slot).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = _offsets(totals, keys, sums)
    inside = Window.partitionBy(*slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged
    for s in sums:
        out = out.withColumn(f"__{s}_inside", F.sum(s).over(inside))
    out = join_on(out, offsets, slot)
    for s in sums:
        out = out.withColumn(f"{s}_upto", F.col(f"__{s}_inside") + F.col(f"{s}_before"))
    return out.drop("__bucket", *[f"__{s}_inside" for s in sums], *[f"{s}_before" for s in sums])


def _offsets(totals: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Bucket totals turned into the sum before each bucket and the sum of the whole key."""
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return totals.select(
        *keys,
        "__bucket",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
    )


def checked_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
) -> DataFrame:
    """Add the 1-based position inside `keys` for an arbitrary `order`, ascending for plain names.

    The rows are cut into ranges of (keys, order) and written to the checkpoint folder, so
    that the cut points cannot move, and each slice of a key gets its offset.
    """
    by = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    ranges = df.repartitionByRange(*[F.col(k).asc() for k in keys], *by)
    sliced = materialise(ranges.withColumn("__slice", F.spark_partition_id().cast("long")))
    ranked = bucketed_position(sliced, keys, F.col("__slice"), by, name)
    return ranked.drop("__slice")


def number(feature: str) -> Column:
    """A feature as a double; NaN stands for a missing value, as in tables written by other tools."""
    value = F.col(feature).cast("double")
    return F.when(~F.isnan(value), value)


def value_counts(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(feature, by…, value, n): each distinct non-null value of each feature with its row count.

    All features share one scan and one aggregation; map-side combining shrinks common values
    before the shuffle. The reports read the counts several times, so they are written once
    and the raw rows are not read again.
    """
    tall = df.select(*by, *[number(f).alias(f) for f in features]).unpivot(
        list(by), list(features), "feature", "value"
    )
    return materialise(
        tall.where(F.col("value").isNotNull())
        .groupBy("feature", *by, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_slices(counts: DataFrame, slices: int | None = None) -> DataFrame:
    """(feature, splits): cut points that spread the distinct values of a feature evenly.

    Cut points only decide which task handles a value, never a result. One row per feature;
    the slices follow the number of values, which are a stored table.
    """
    if slices is None:
        slices = max(4, -(-counts.count() // SLICE_VALUES))
    probabilities = [i / slices for i in range(1, slices)]
    return counts.groupBy("feature").agg(
        F.percentile_approx("value", probabilities, max(1000, 10 * slices)).alias("splits")
    )


def running_counts(
    counts: DataFrame, by: Sequence[str], sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Running and total sums over the distinct values of each (feature, by…) in value order.

    `counts` holds one row per (feature, by…, value) and is read three times; the features are
    a short explicit list, so the cut points are broadcast.
    """
    slot = F.size(F.filter("splits", lambda s: s <= F.col("value"))).cast("long")
    placed = counts.join(F.broadcast(value_slices(counts)), "feature").withColumn(
        "__slot", -slot if descending else slot
    ).drop("splits")
    order = F.col("value").desc() if descending else F.col("value").asc()
    out = bucketed_running_sums(placed, ["feature", *by], F.col("__slot"), [order], sums)
    return out.drop("__slot")


def exact_quantiles(
    counts: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(feature, by…, probability, quantile): exact, linearly interpolated quantiles.

    Works from value counts: the quantile sits on the one or two distinct values whose
    running counts cover its position, so no task holds all the values of a feature.
    """
    placed = running_counts(counts.select("feature", *by, "value", "n"), by, ["n"])
    target = F.col("probability") * (F.col("n_total") - 1)
    low, high = F.floor(target), F.ceil(target)
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    covered = F.filter(
        asked,
        lambda p: (F.floor(p * (F.col("n_total") - 1)) <= F.col("n_upto") - 1)
        & (F.ceil(p * (F.col("n_total") - 1)) >= F.col("n_upto") - F.col("n")),
    )
    hits = placed.withColumn("probability", F.explode(covered))
    at = lambda position: F.max(F.when(position.between(first, last), F.col("value")))
    ends = hits.groupBy("feature", *by, "probability").agg(
        at(low).alias("__low"), at(high).alias("__high"), F.max(target - low).alias("__part")
    )
    return ends.select(
        "feature",
        *by,
        "probability",
        (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")).alias("quantile"),
    )
