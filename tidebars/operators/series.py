"""Splitting ordered series into bounded blocks.

A window over ``partitionBy(pair).orderBy(date)`` puts a whole series into one
task. Here a series is cut into blocks of a fixed number of rows instead, so that
a series holding a third of all bars is spread over the cluster like any other
data. A block also carries copies of the rows just before and after it (its
halo); rolling windows and leads that reach no further than the halo give the
same values as on the uncut series. Only ``core`` rows are results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("pair", "timeframe")
BLOCK_ROWS = 65_536
LAYOUT_COLUMNS = ("pos", "series_rows", "block", "core")


def bar_seconds(timeframe: Column | str = "timeframe") -> Column:
    """Length of one bar in seconds, from labels such as 1m, 4h, 1d, 2w."""
    label = F.col(timeframe) if isinstance(timeframe, str) else timeframe
    count = F.regexp_extract(label, r"^([1-9][0-9]*)[mhdw]$", 1)
    unit = F.substring(label, -1, 1)
    seconds = (
        F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400).when(unit == "w", 604_800)
    )
    return F.when((count != "") & seconds.isNotNull(), count.cast("long") * seconds).otherwise(
        F.raise_error(F.concat(F.lit("Unsupported timeframe: "), label)).cast("long")
    )


def date_chunk(seconds: Column | int, date: str = "date") -> Column:
    """Ordinal of the fixed-length time span a row falls into."""
    width = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.floor(F.unix_seconds(F.col(date)) / width).cast("long")


def bar_chunk(rows: int = BLOCK_ROWS) -> Column:
    """Time span holding at most ``rows`` bars of a series on its own grid."""
    return date_chunk(bar_seconds() * F.lit(rows))


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column
) -> DataFrame:
    """Add ``pos``, the 0-based row number inside each series, and its length ``series_rows``.

    Rows are numbered inside (series, chunk) tasks and shifted by the number of
    rows in earlier chunks, a running sum over one small row per chunk. ``chunk``
    must not decrease along ``order``.
    """
    keys = list(keys)
    tagged = df.withColumn("_chunk", chunk)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_chunk",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("series_rows"),
        )
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = tagged.withColumn("_row", F.row_number().over(inside))
    return (
        numbered.join(starts, [*keys, "_chunk"])
        .withColumn("pos", F.col("_start") + F.col("_row") - 1)
        .drop("_chunk", "_row", "_start")
    )


def into_blocks(df: DataFrame, *, rows: int = BLOCK_ROWS, back: int = 0, ahead: int = 0) -> DataFrame:
    """Assign positioned rows to blocks, copying halo rows into their neighbours.

    Adds ``block`` and ``core``. Block b holds positions [b*rows - back,
    (b+1)*rows + ahead); a row is core in exactly one block.
    """
    if rows <= 0:
        raise ValueError("rows must be positive")
    if back < 0 or ahead < 0:
        raise ValueError("halo sizes cannot be negative")
    own = F.floor(F.col("pos") / rows).cast("long")
    if not back and not ahead:
        return df.withColumn("block", own).withColumn("core", F.lit(True))
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - ahead) / rows)).cast("long")
    last = F.floor((F.col("pos") + back) / rows).cast("long")
    return df.withColumn("block", F.explode(F.sequence(first, last))).withColumn(
        "core", F.col("block") == own
    )


def bar_blocks(
    bars: DataFrame, *, rows: int = BLOCK_ROWS, back: int = 0, ahead: int = 0, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Position bars by date and cut every series into blocks.

    Bars stored with the columns of ``with_position`` keep them; drop the two columns
    after filtering such bars.
    """
    if back > rows // 4:
        rows = 4 * back  # keep the copied share of a block small
    stored = {"pos", "series_rows"} <= set(bars.columns)
    positioned = bars if stored else with_position(bars, keys, ["date"], bar_chunk(rows))
    return into_blocks(positioned, rows=rows, back=back, ahead=ahead)


def core_rows(blocks: DataFrame) -> DataFrame:
    """Drop halo copies and layout columns."""
    return blocks.filter("core").drop(*LAYOUT_COLUMNS)


@dataclass(frozen=True)
class Panel:
    """Window expressions over the blocks of a panel."""

    keys: tuple[str, ...] = SERIES

    @property
    def block_keys(self) -> list[str]:
        return [*self.keys, "block"]

    @property
    def window(self):
        return Window.partitionBy(*self.block_keys).orderBy("pos")

    def lag(self, col, n: int = 1) -> Column:
        return F.lag(col, n).over(self.window)

    def lead(self, col, n: int = 1) -> Column:
        return F.lead(col, n).over(self.window)

    def trailing(self, aggregate, col, n: int, *, shift: int = 0, missing: int = 0) -> Column:
        """Aggregate of the ``n`` rows ending ``shift`` rows before the current one.

        Missing until the series has a full window; ``missing`` is the number of
        leading rows at which ``col`` itself has no value. The position gate does
        the work of a windowed count.
        """
        frame = self.window.rowsBetween(-(n - 1) - shift, -shift)
        return F.when(F.col("pos") >= n - 1 + shift + missing, aggregate(col).over(frame))

    def values(self, col, n: int, *, shift: int = 0, missing: int = 0) -> Column:
        """The values of a full window as an array, for ``median_of``."""
        return self.trailing(F.collect_list, col, n, shift=shift, missing=missing)


def median_of(values: Column, n: int) -> Column:
    """Median of a window of ``n`` values; missing if any of them is.

    Collecting a window is cheap and sorting it is not, so evaluate this under a
    ``when`` that rules most rows out.
    """
    ordered = F.array_sort(values)
    middle = (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    return F.when(F.size(values) == n, middle)


def carry_last(
    blocks: DataFrame,
    panel: Panel,
    derive: Callable[[DataFrame], DataFrame],
    value: str,
    name: str,
    *,
    rows: int,
) -> DataFrame:
    """Add the latest non-missing ``value`` strictly before each core row.

    ``derive`` adds ``value`` to the blocks. Inside a block the latest value is a
    streaming window; what a block of a longer series inherits comes from the last
    value of each earlier block.
    """
    several = derive(blocks.filter(F.col("series_rows") > rows)).filter("core")
    present = F.when(F.col(value).isNotNull(), F.col("pos"))
    last_of_block = several.groupBy(*panel.block_keys).agg(F.max_by(value, present).alias("_last"))
    before = (
        Window.partitionBy(*panel.keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    inherited = last_of_block.select(
        *panel.block_keys, F.last("_last", ignorenulls=True).over(before).alias("_inherited")
    )
    inside = panel.window.rowsBetween(Window.unboundedPreceding, -1)
    own = derive(blocks).withColumn("_core_value", F.when(F.col("core"), F.col(value)))
    return (
        own.withColumn("_inside", F.last("_core_value", ignorenulls=True).over(inside))
        .join(inherited, panel.block_keys, "left")
        .withColumn(name, F.coalesce("_inside", "_inherited"))
        .drop("_core_value", "_inside", "_inherited")
    )
