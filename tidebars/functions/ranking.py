"""Ranks, medians and step-up corrections that never sort one group in one task.

Values are first put into ordered buckets whose width is a fixed fraction of the
value. Counting per bucket is an ordinary aggregation with map-side combining; a
running sum over these counts gives every bucket its place, and only rows inside
one bucket are ever compared with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.session import stage

STEPS_PER_OCTAVE = 4_096
SMALL_TARGETS = 100_000  # wanted buckets that are broadcast, a few MB
_SMALLEST_EXPONENT = 1_100  # below the exponent of any double


def value_bucket(value: Column, steps: int = STEPS_PER_OCTAVE) -> Column:
    """Integer that does not decrease with ``value``; at most 2 * 2200 * ``steps`` distinct."""
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    # log2 may round up next to a power of two: clipping keeps the order
    inside = F.least(F.greatest(size / F.pow(F.lit(2.0), octave) - 1, F.lit(0.0)), F.lit(1.0))
    ordinal = (octave + _SMALLEST_EXPONENT) * steps + F.floor(inside * (steps - 1)) + 1
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * ordinal).cast("long")


def middle_buckets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_bucket, _low, _high, _before`` per group: the one or two buckets that hold its middle
    rows, the 1-based ranks of these, and how many rows lie in lower buckets. ``counts``
    has the rows ``_n`` of every ``_bucket``."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)}).withColumns(
        {"_low": F.floor((F.col("_total") + 1) / 2), "_high": F.floor((F.col("_total") + 2) / 2)}
    )
    return placed.filter("_upto >= _low and _upto - _n < _high").select(
        *keys, "_bucket", "_low", "_high", (F.col("_upto") - F.col("_n")).alias("_before")
    )


def counted_values(rows: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, small: int = SMALL_TARGETS) -> DataFrame:
    """``_n`` rows of each ``value`` of the buckets that ``wanted`` (read from a small written table) names per group.

    Single rows are never shuffled. Up to ``small`` wanted buckets are broadcast and
    cut the rows down where they are read; beyond it equal values are counted first.
    Either way one aggregation with map-side combining carries the rest.
    """
    on, by = wanted.columns, [*keys, "_bucket", value]
    if wanted.count() <= small:
        return rows.join(F.broadcast(wanted), on).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).join(wanted, on)


def median_of(counted: DataFrame, middle: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median per group from the counted values of its middle buckets."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.join(middle, [*keys, "_bucket"])
        .withColumn("_last", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )
    at = lambda rank: F.max(F.when(F.col(rank).between(F.col("_first"), F.col("_last")), F.col(value)))
    return ranked.groupBy(*keys).agg((at("_low") + at("_high")).alias("_sum")).select(*keys, (F.col("_sum") / 2).alias(name))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str, small: int = SMALL_TARGETS) -> DataFrame:
    """Median of ``value`` per group, exact for groups of any size.

    Buckets are counted first; then only values of the buckets that hold a group's
    middle are counted. Missing values are ignored.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value).withColumn("_bucket", value_bucket(F.col(value)))
    middle = stage(middle_buckets(rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")), keys))
    return median_of(counted_values(rows, keys, value, middle.select(*keys, "_bucket"), small), middle, keys, value, name)


def benjamini_hochberg(df: DataFrame, p_value: str, name: str, family: Sequence[str] = ()) -> DataFrame:
    """Step-up adjusted p-values, per family; rows with a missing p-value get none.

    q = min over p' >= p of p' * m / rank(p'), at most 1. Distinct p-values are
    ranked bucket by bucket. Rows without a p-value and the certain cases p = 0 and
    p = 1, which may be any share of the rows, leave before the join and come back by
    union.
    """
    family = list(family)
    counted = (
        df.filter(F.col(p_value).isNotNull())
        .groupBy(*family, F.col(p_value).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", value_bucket(F.col("_p")))
    )
    spread = Window.partitionBy(*family)
    ordered = spread.orderBy("_bucket")
    buckets = (
        counted.groupBy(*family, "_bucket")
        .agg(F.sum("_n").alias("_in_bucket"))
        .withColumns(
            {
                "_before": F.coalesce(
                    F.sum("_in_bucket").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
                "_family": F.sum("_in_bucket").over(spread),
            }
        )
        .drop("_in_bucket")
    )
    keys = [*family, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy("_p")
    raw = counted.join(buckets, keys).withColumn(
        "_rank", F.col("_before") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_raw", F.col("_p") * F.col("_family") / F.col("_rank"))
    after = (
        raw.groupBy(*keys)
        .agg(F.min("_raw").alias("_best"))
        .select(*keys, F.min("_best").over(ordered.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    )
    adjusted = raw.join(after, keys).select(
        *family,
        "_p",
        F.least(
            F.lit(1.0),
            F.min("_raw").over(inside.rowsBetween(0, Window.unboundedFollowing)),
            F.col("_later"),
        ).alias("_q"),
    )
    settled = F.col(p_value).isNull() | F.col(p_value).isin(0.0, 1.0)
    looked_up = (
        df.filter(~settled)
        .withColumn("_p", F.col(p_value))
        .join(adjusted.filter("_p > 0 and _p < 1"), [*family, "_p"], "left")
        .select(*df.columns, F.col("_q").alias(name))
    )
    return looked_up.unionAll(df.filter(settled).select(*df.columns, F.col(p_value).alias(name)))


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Add each row's place, from 1, in the given order, which is to be total.

    Rows are cut into ranges of that order, sorted in their range and written once; a
    row's place is its own in the range plus the rows of the ranges before, of which
    there is one small row each. No task sees all rows, however many there are. Lists that are
    only written in order do not need this; it gives places that can be joined and compared.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    own = F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row a partition
        .withColumn(name, F.col("_offset") + own)
        .drop("_id", "_part", "_offset")
    )
