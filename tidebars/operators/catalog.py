"""Quality audit of market files and the universe it releases for research."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.config import as_utc
from tidebars.functions.ranking import ranked
from tidebars.operators.series import BLOCK_ROWS, Panel, bar_blocks, bar_seconds

FILE = ("pair", "timeframe", "file")
_ISO = "yyyy-MM-dd'T'HH:mm:ss"
# Fixed texts accepted as truth values in a catalog.
TRUE_TEXTS = ("true", "1", "yes")
FALSE_TEXTS = ("false", "0", "no")


def iso_time(moment: Column) -> Column:
    """ISO-8601 with offset; the fraction is written only if there is one."""
    fraction = F.unix_micros(moment) % 1_000_000 != 0
    return F.when(fraction, F.date_format(moment, _ISO + ".SSSSSSxxx")).otherwise(
        F.date_format(moment, _ISO + "xxx")
    )


def invalid_ohlc() -> Column:
    """A bar whose extremes do not enclose its prices, or with impossible values."""
    o, h, low, c = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    return (
        (h < F.greatest(o, c, low))
        | (low > F.least(o, c, h))
        | (F.least(o, h, low, c) <= 0)
        | (F.col("volume") < 0)
    )


def gap_columns(blocks: DataFrame, panel: Panel) -> DataFrame:
    """Add ``gap`` and the number of bars ``missing`` before each bar (fractional off the grid)."""
    step = F.unix_micros("date") - F.unix_micros(panel.lag("date"))
    bar = bar_seconds() * 1_000_000
    gap = F.coalesce(step > bar, F.lit(False))
    return blocks.withColumns({"gap": gap, "missing": F.when(gap, step / bar - 1).otherwise(F.lit(0.0))})


def expected_bars(start, end) -> Column:
    span = as_utc(end) - as_utc(start)
    return F.floor(F.lit(span.total_seconds()) / bar_seconds()).cast("long")


def assess_files(
    files: DataFrame,
    bars: DataFrame,
    start,
    end,
    *,
    minimum_coverage: float = 0.80,
    minimum_candles: int = 1_000,
    keys: Sequence[str] = FILE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One catalog row per file, whether or not any of its bars fall into [start, end).

    ``files`` has the keys, ``extension``, ``size_bytes`` and ``source_sha256``.
    """
    if not 0 < minimum_coverage <= 1:
        raise ValueError("minimum_coverage must be in (0, 1]")
    if minimum_candles <= 0:
        raise ValueError("minimum_candles must be positive")
    if as_utc(end) <= as_utc(start):
        raise ValueError("end must be later than start")
    keys = list(keys)
    inside = bars.filter((F.col("date") >= F.lit(as_utc(start))) & (F.col("date") < F.lit(as_utc(end))))
    blocks = bar_blocks(inside, rows=block_rows, back=1, keys=keys)
    audited = (
        gap_columns(blocks, Panel(tuple(keys)))
        .filter("core")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("candles"),
            F.min("date").alias("_first"),
            F.max("date").alias("_last"),
            F.count(F.when(F.col("gap"), 1)).alias("gap_count"),
            F.sum("missing").alias("_missing"),
            F.count(F.when(invalid_ohlc(), 1)).alias("invalid_ohlc_rows"),
        )
    )
    joined = files.join(audited, keys, "left").withColumn("expected_candles", expected_bars(start, end))
    joined = joined.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("candles", "gap_count", "invalid_ohlc_rows")}
    )
    candles, expected = F.col("candles"), F.col("expected_candles")
    coverage = F.when(expected > 0, F.least(candles / expected, F.lit(1.0))).otherwise(0.0)
    joined = joined.withColumns(
        {
            "coverage_ratio": coverage,
            "missing_candles_inside": F.when(candles > 0, F.col("_missing").cast("long")).otherwise(expected),
            "first_candle": iso_time(F.col("_first")),
            "last_candle": iso_time(F.col("_last")),
        }
    )
    ready = (
        (candles >= minimum_candles)
        & (F.col("coverage_ratio") >= minimum_coverage)
        & (F.col("invalid_ohlc_rows") == 0)
    )
    status = (
        F.when(ready, "ready")
        .when(candles == 0, "empty")
        .when(F.col("invalid_ohlc_rows") > 0, "invalid_ohlc")
        .when(candles < minimum_candles, "too_short")
        .otherwise("partial_coverage")
    )
    return joined.select(
        *keys,
        "extension",
        "size_bytes",
        "source_sha256",
        "candles",
        "expected_candles",
        "coverage_ratio",
        "first_candle",
        "last_candle",
        "gap_count",
        "missing_candles_inside",
        "invalid_ohlc_rows",
        ready.alias("research_ready"),
        status.alias("status"),
    ).orderBy("timeframe", "pair")


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """One row: files, pairs, ready files and the number of files per status."""
    statuses = catalog.groupBy("status").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("research_ready").cast("long")).alias("_ready"))
    totals = statuses.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("_ready"), F.lit(0)).alias("research_ready_files"),
        # at most five statuses
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "_n")))).alias("status_counts"),
    )
    pairs = catalog.select("pair").distinct().agg(F.count(F.lit(1)).alias("unique_pairs"))
    return totals.crossJoin(F.broadcast(pairs)).select(
        "files", "unique_pairs", "research_ready_files", "status_counts"
    )


def truth_value(column: str) -> Column:
    """Boolean of a catalog text; anything but the known texts is an error."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    return (
        F.when(text.isin(*TRUE_TEXTS), True)
        .when(text.isin(*FALSE_TEXTS), False)
        .otherwise(F.raise_error(F.lit("catalog contains invalid research_ready values")).cast("boolean"))
    )


def ready_rows(catalog: DataFrame, timeframe: str) -> DataFrame:
    """Rows released for research at one timeframe; every truth value is checked."""
    missing = sorted({"pair", "timeframe", "research_ready"} - set(catalog.columns))
    if missing:
        raise ValueError("catalog is missing columns: " + ", ".join(missing))
    # the test stands first so that values of other timeframes are checked too
    return catalog.filter(truth_value("research_ready") & (F.col("timeframe") == timeframe))


def gate(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep the market files whose pair is released."""
    return files.join(selection.select("pair").distinct(), "pair", "left_semi")


def stale_pairs(selection: DataFrame, files: DataFrame) -> DataFrame:
    """Released pairs that have no market file."""
    return selection.select("pair").distinct().join(files.select("pair"), "pair", "left_anti")


def check_not_stale(selection: DataFrame, files: DataFrame) -> None:
    lost = stale_pairs(selection, files)
    preview = [row.pair for row in lost.orderBy("pair").limit(5).collect()]
    if preview:
        raise ValueError(
            f"Catalog is stale: {lost.count()} research-ready pairs are missing "
            f"from the data directory ({', '.join(preview)})"
        )


def select_universe(selection: DataFrame, *, max_pairs: int | None = None, pair_offset: int = 0) -> DataFrame:
    """Batch of pairs in name order: skip ``pair_offset``, then take ``max_pairs``.

    A batch without an end skips by places, as an offset alone would pass all pairs through one task.
    """
    if max_pairs is not None and max_pairs <= 0:
        raise ValueError("max_pairs must be positive")
    if pair_offset < 0:
        raise ValueError("pair_offset cannot be negative")
    pairs = selection.select("pair").distinct()
    if max_pairs is not None:
        return pairs.orderBy("pair").offset(pair_offset).limit(max_pairs)
    if pair_offset:
        pairs = ranked(pairs, F.asc("pair"), name="place").filter(F.col("place") > pair_offset).drop("place")
    return pairs.orderBy("pair")


def pair_coverage(bars: DataFrame) -> DataFrame:
    """Bars used per file in a run."""
    return bars.groupBy(*[c for c in FILE if c in bars.columns]).agg(
        F.count(F.lit(1)).alias("candles"),
        iso_time(F.min("date")).alias("first_candle"),
        iso_time(F.max("date")).alias("last_candle"),
    )


def unusable_files(files: DataFrame, coverage: DataFrame, problems: DataFrame) -> DataFrame:
    """Error rows of files that cannot be read or have no bar in the study range; they never stop a run."""
    without = files.join(coverage, list(FILE), "left_anti").join(problems, ["pair", "file"], "left")
    error = F.coalesce("problem", F.lit("No readable candles inside requested timerange"))
    return without.select("pair", "file", error.alias("error"))
