"""Metrics of exported backtest trades.

A trades table has ``strategy``, ``timeframe``, ``pair`` and ``profit_ratio``, and may
have ``is_short``, ``open_date``, ``close_date``, ``trade_duration``, ``exit_reason`` and
``funding_fees``. ``trade_no``, the place in the export, breaks ties between trades
that close together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.ranking import counted_values, median_of, middle_buckets, value_bucket
from tidebars.operators.events import profit_factor
from tidebars.operators.series import BLOCK_ROWS, date_chunk, into_blocks, with_position
from tidebars.session import stage

RUN = ("strategy", "timeframe")
ALL_PAIRS = "__ALL__"
OPTIONAL = {
    "is_short": "boolean",
    "open_date": "timestamp",
    "close_date": "timestamp",
    "trade_duration": "double",
    "exit_reason": "string",
    "funding_fees": "double",
    "trade_no": "bigint",
}
_DAY = 86_400


def adjusted_trades(trades: DataFrame, slippage_bps_round_trip: float = 4.0) -> DataFrame:
    """Check the columns, fill absent optional ones, and charge slippage to every return."""
    if slippage_bps_round_trip < 0:
        raise ValueError("slippage_bps_round_trip cannot be negative")
    missing = sorted({"pair", "profit_ratio"} - set(trades.columns))
    if missing:
        raise ValueError("Backtest trades missing columns: " + ", ".join(missing))
    # reports name no timeframe: an absent run key is one empty value, not a missing one
    run = [F.col(c) if c in trades.columns else F.lit("").alias(c) for c in RUN]
    optional = [
        (F.col(c) if c in trades.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()
    ]
    ratio = F.col("profit_ratio").cast("double")
    return trades.select(
        *run,
        "pair",
        ratio.alias("profit_ratio"),
        (ratio - slippage_bps_round_trip / 10_000.0).alias("adjusted"),
        *optional,
    )


def direction_of(is_short: Column) -> Column:
    return F.when(F.coalesce(is_short, F.lit(False)), "short").otherwise("long")


def signed_drawdown(trades: DataFrame, keys: Sequence[str], *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``max_drawdown`` for groups whose equity may fall below zero.

    Trades are taken in the order pair, close, open. Equity is kept as a logarithm and
    a sign, so that no run is too long for it; logarithms and their extremes are running
    values inside blocks, and a block starts from sums and extremes over one row per
    block. The running maximum starts at the first trade's equity.
    """
    keys = list(keys)
    place = F.coalesce("pair", F.lit("\U0010ffff"))
    day = F.coalesce(date_chunk(_DAY, "close_date"), F.lit(2**62))
    order = [
        place,
        F.asc_nulls_last("close_date"),
        F.asc_nulls_last("open_date"),
        F.asc_nulls_last("trade_no"),
    ]
    rows = trades.filter(F.col("adjusted").isNotNull()).select(
        *keys, *[c for c in ("pair", "close_date", "open_date", "trade_no") if c not in keys], "adjusted"
    )
    blocks = into_blocks(with_position(rows, keys, order, F.struct(place, day)), rows=block_rows)
    block_keys = [*keys, "block"]
    so_far = Window.partitionBy(*block_keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.col("adjusted") + 1
    size = F.when(growth == 0, F.lit(float("-inf"))).otherwise(F.log(F.abs(growth)))
    grown = blocks.withColumns(
        {"_log": F.sum(size).over(so_far), "_odd": F.sum((growth < 0).cast("int")).over(so_far) % 2}
    )
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entry = (
        grown.groupBy(*block_keys)
        .agg(
            F.max_by(F.struct("_log", "_odd"), "pos").alias("_total"),
            *[f(F.when(F.col("_odd") == odd, F.col("_log"))).alias(f"_{name}{odd}") for odd in (0, 1) for name, f in (("most", F.max), ("least", F.min))],
        )
        .withColumns(
            {
                "_from": F.coalesce(F.sum("_total._log").over(earlier), F.lit(0.0)),
                "_flip": F.coalesce(F.sum("_total._odd").over(earlier), F.lit(0)) % 2,
            }
        )
        # equity above zero by its largest logarithm, below zero by its least
        .withColumn("_top", F.col("_from") + F.when(F.col("_flip") == 0, F.col("_most0")).otherwise(F.col("_most1")))
        .withColumn("_under", F.col("_from") + F.when(F.col("_flip") == 0, F.col("_least1")).otherwise(F.col("_least0")))
        .select(*block_keys, "_from", "_flip", F.max("_top").over(earlier).alias("_top"), F.min("_under").over(earlier).alias("_under"))
    )
    level, below = F.col("_from") + F.col("_log"), (F.col("_flip") + F.col("_odd")) % 2 == 1
    signed = (
        grown.join(entry, block_keys)
        .withColumns({"_level": level, "_below": below})
        .withColumns(
            {
                "_top": F.greatest("_top", F.max(F.when(~F.col("_below"), F.col("_level"))).over(so_far)),
                "_under": F.least("_under", F.min(F.when(F.col("_below"), F.col("_level"))).over(so_far)),
            }
        )
    )
    to_top = F.when(F.col("_below"), -1).otherwise(1) * F.exp(F.col("_level") - F.col("_top"))
    share = F.when(F.col("_top") > float("-inf"), to_top).when(F.col("_top").isNull(), F.exp(F.col("_level") - F.col("_under")))
    return (
        signed.groupBy(*keys).agg(F.min(share - 1).alias("max_drawdown_compounded"))
    )


# -- drawdown as a summary that can be joined ---------------------------------------------

_SUMMARY = ("total", "top", "low", "fall")


def _joined(a: tuple, b: tuple) -> tuple:
    """Summary of a run of trades followed by another: total growth, highest and lowest equity
    and deepest fall, all as logarithms relative to the start."""
    across = a[0] + b[2] - a[1]
    return (
        a[0] + b[0], max(a[1], a[0] + b[1]), min(a[2], a[0] + b[2]),
        min(a[3], b[3], across if across == across else math.inf),
    )


def _drawdown_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """One summary for each group met in a sorted range; the first columns are its keys."""
    names, open_, place = None, None, 0

    def row(key: tuple, at: int, summary: tuple, negative: int) -> pa.RecordBatch:
        values = [*key, at, *summary, negative]
        kinds = [pa.string()] * keys + [pa.int64()] + [pa.float64()] * 4 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        names = [*batch.schema.names[:keys], "place", *_SUMMARY, "negative"]
        codes = [batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for code in codes:
            change[1:] |= code[1:] != code[:-1]
        growth = batch.column(keys).to_numpy() + 1
        starts = np.flatnonzero(change)
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(batch.column(i)[int(a)].as_py() for i in range(keys))
            with np.errstate(divide="ignore", invalid="ignore"):
                level = np.cumsum(np.log(np.abs(growth[a:b])))
                fall = level - np.maximum.accumulate(level)
            fall = fall[~np.isnan(fall)]
            summary = float(level[-1]), float(level.max()), float(level.min()), float(fall.min()) if len(fall) else math.inf
            negative = int((growth[a:b] < 0).sum())
            if open_ and open_[0] == key:
                open_ = key, open_[1], _joined(open_[2], summary), open_[3] + negative
            else:
                if open_:
                    yield row(*open_)
                open_ = key, place, summary, negative
            place += 1
    if open_:
        yield row(*open_)


def drawdown_summaries(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of all trades by ``keys`` (texts) and ``place``, their order.

    Trades are dealt by ranges of keys, pair, close and open, so that neither a hot pair nor
    trades without a close date meet in one task; each range gives one row a group.
    """
    keys = list(keys)
    own = [F.col(c).cast("string").alias(c) for c in keys]
    order = [F.asc_nulls_last(c) for c in (*keys, "_pair", "close_date", "open_date", "trade_no")]
    rows = trades.filter(F.col("adjusted").isNotNull()).select(*own, "adjusted", F.col("pair").alias("_pair"), "close_date", "open_date", "trade_no")
    # a last random key spreads trades that agree in everything else
    ranged = rows.withColumn("_tie", F.rand(7)).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    schema = ", ".join([*[f"`{c}` string" for c in keys], "place long", *[f"{c} double" for c in _SUMMARY], "negative long"])
    found = ranged.select(*keys, "adjusted").mapInArrow(lambda it: _drawdown_runs(it, len(keys)), schema)
    return found.withColumn("place", F.spark_partition_id().cast("long") * F.lit(1 << 33) + F.col("place"))


def joined_drawdown(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``max_drawdown_compounded`` and ``negative`` of groups joined from their
    summaries in order; ``keys`` may be fewer than those of the summaries."""
    infinite = F.lit(float("inf"))
    start = F.struct(F.lit(0.0).alias("total"), (-infinite).alias("top"), infinite.alias("low"), infinite.alias("fall"))

    def step(a: Column, b: Column) -> Column:
        across = F.nanvl(a["total"] + b["low"] - a["top"], infinite)
        return F.struct(
            (a["total"] + b["total"]).alias("total"), F.greatest(a["top"], a["total"] + b["top"]).alias("top"),
            F.least(a["low"], a["total"] + b["low"]).alias("low"), F.least(a["fall"], b["fall"], across).alias("fall"),
        )

    ordered = F.array_sort(F.collect_list(F.struct("place", *_SUMMARY)))  # a row a range or pair, not a trade
    folded = summaries.groupBy(*keys).agg(F.aggregate(ordered, start, step).alias("_s"), F.sum("negative").alias("negative"))
    # equity that begins at zero has no share of its maximum
    fall = F.when(F.col("_s.top") > float("-inf"), F.exp("_s.fall") - 1)
    return folded.select(*keys, fall.alias("max_drawdown_compounded"), "negative")


def max_drawdown(trades: DataFrame, keys: Sequence[str], *levels: Sequence[str], block_rows: int = BLOCK_ROWS) -> list[DataFrame]:
    """Deepest fall of compounded equity below its running maximum: per group of ``keys``, and per
    group of each of ``levels``, keys that leave out the last of ``keys``.

    Trades are taken in the order of the keys, pair, close, open. They are sorted once;
    a coarser level joins the summaries of the finer one. Groups with a return below -100 %,
    whose equity changes its sign, are computed from their trades.
    """
    summaries = stage(drawdown_summaries(trades, keys))
    below = summaries.filter("negative > 0")
    found, any_below = [], not below.isEmpty()
    for level in (list(keys), *map(list, levels)):
        own = joined_drawdown(summaries, level)
        if any_below:
            fallen = trades.join(below.select(*level).distinct(), level, "left_semi")
            own = own.filter("negative = 0").drop("negative").unionByName(signed_drawdown(fallen, level, block_rows=block_rows))
        found.append(own.drop("negative"))
    return found


# -- metrics from one table of sums ------------------------------------------------------------

CELL = (*RUN, "pair", "direction")
CELL_STEPS = 64  # buckets an octave: fewer cells, still few values in a middle one
_COUNTS = ("trades", "wins", "draws", "losses", "returns", "durations", "spans", "sided", "long_trades", "short_trades")
_TOTALS = ("sum_returns", "gain", "loss", "sum_duration", "sum_span", "funding_fees_sum")
_SUMS = (*_COUNTS, *[f"{part}_{c}" for c in _TOTALS for part in ("coarse", "rest")])
_UNIT = 2.0**20  # multiples of its inverse add up without rounding far beyond any sum of returns


class TradeLattice:
    """Metrics of several levels from one pass over the trades.

    Sums are taken per (run, pair, direction, bucket of the return) with map-side combining
    and written; every level adds up these few rows, and its median is looked for in
    the buckets that hold its middle, by one more pass that counts the values in them.
    No trade is copied for a second level.
    """

    def __init__(self, trades: DataFrame, slippage_bps_round_trip: float = 4.0) -> None:
        adjusted = adjusted_trades(trades, slippage_bps_round_trip)
        self.trades = adjusted.withColumn("direction", direction_of(F.col("is_short")))
        r, short = F.col("adjusted"), F.coalesce("is_short", F.lit(False))
        number = lambda test: F.count(F.when(test, 1))
        elapsed = (F.unix_micros("close_date") - F.unix_micros("open_date")) / 60_000_000
        counts = [
            F.count(F.lit(1)), number(r > 0), number(r == 0), number(r < 0), F.count(r), F.count("trade_duration"),
            F.count(elapsed), F.count("is_short"), number(~short), number(short),
        ]
        totals = [r, F.when(r > 0, r), F.when(r < 0, -r), F.col("trade_duration"), elapsed, F.col("funding_fees")]
        sums = [*counts, *[part for value in totals for part in self._parts(value)]]
        self.bucketed = self.trades.withColumn("_bucket", value_bucket(r, CELL_STEPS))
        self.cells = stage(self.bucketed.groupBy(*CELL, "_bucket").agg(*[s.alias(c) for s, c in zip(sums, _SUMS, strict=True)]))

    @staticmethod
    def _parts(value: Column) -> tuple[Column, Column]:
        """A sum in two parts, so that it does not depend on how trades are grouped on the way."""
        coarse = F.rint(value * _UNIT) / _UNIT
        return F.coalesce(F.sum(coarse), F.lit(0.0)), F.coalesce(F.sum(F.nanvl(value - coarse, F.lit(0.0))), F.lit(0.0))

    def _medians(self, levels: Sequence[Sequence[str]]) -> list[DataFrame]:
        counts = self.cells.filter("_bucket IS NOT NULL")
        found = []
        for i, level in enumerate(levels):
            middle = middle_buckets(counts.groupBy(*level, "_bucket").agg(F.sum("returns").alias("_n")), level)
            absent = [F.lit(None).cast("string").alias(c) for c in CELL if c not in level]
            found.append(middle.select(F.lit(i).alias("_level"), *level, *absent, "_bucket", "_low", "_high", "_before"))
        middle = stage(reduce(DataFrame.unionByName, found))
        middles = [middle.filter(F.col("_level") == i).select(*level, "_bucket", "_low", "_high", "_before") for i, level in enumerate(levels)]
        wanted = middle.select(*RUN, "_bucket").distinct()
        values = stage(counted_values(self.bucketed.select(*CELL, "_bucket", "adjusted"), CELL, "adjusted", wanted))
        return [
            median_of(values.groupBy(*level, "_bucket", "adjusted").agg(F.sum("_n").alias("_n")), middle, level, "adjusted", "median_return")
            for level, middle in zip(levels, middles, strict=True)
        ]

    def metrics(self, levels: Sequence[Sequence[str]], *, drawdowns: Sequence[DataFrame] = (), sides: bool = True) -> list[DataFrame]:
        """Statistics of each level; groups with a missing key are left out."""
        out = []
        for i, (level, median) in enumerate(zip(levels, self._medians(levels), strict=True)):
            rows = self.cells
            for key in level:
                rows = rows.filter(F.col(key).isNotNull())
            s = rows.groupBy(*level).agg(
                *[F.sum(c).alias(c) for c in _COUNTS], *[(F.sum(f"coarse_{c}") + F.sum(f"rest_{c}")).alias(c) for c in _TOTALS]
            )
            mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n))
            known = F.col("sided") > 0
            s = s.withColumns(
                {
                    "win_rate": F.col("wins") / F.col("trades"),
                    "expectancy": mean("sum_returns", "returns"),
                    "profit_factor": profit_factor(F.col("gain"), F.col("loss")),
                    # exported durations count if the group has any, else the dates do
                    "avg_duration_minutes": F.coalesce(mean("sum_duration", "durations"), mean("sum_span", "spans")),
                    "long_trades": F.when(known, F.col("long_trades")),
                    "short_trades": F.when(known, F.col("short_trades")),
                }
            ).withColumnRenamed("sum_returns", "sum_adjusted_returns")
            s = s.join(median, list(level), "left")
            if drawdowns:
                s = s.join(drawdowns[i], list(level), "left")
            out.append(s.select(
                *level, "trades", "wins", "draws", "losses", "win_rate", "expectancy", "median_return", "profit_factor", "sum_adjusted_returns",
                *(["max_drawdown_compounded"] if drawdowns else []), "avg_duration_minutes", *(["long_trades", "short_trades"] if sides else []), "funding_fees_sum",
            ))
        return out

    def pairs(self) -> DataFrame:
        """Metrics per run and pair."""
        keys = [*RUN, "pair"]
        return self.metrics([keys], drawdowns=max_drawdown(self.trades, keys))[0]

    def overall(self) -> DataFrame:
        """Metrics per run. No drawdown: trades of several pairs run at the same time."""
        return self.metrics([list(RUN)])[0]

    def directions(self) -> DataFrame:
        """Long and short metrics per run: over all pairs (``__ALL__``) and per pair.

        Only for runs whose trades export a side. The drawdown over all pairs runs through
        the pairs one after the other.
        """
        fine, coarse = [*RUN, "direction", "pair"], [*RUN, "direction"]
        falls = max_drawdown(self.trades, fine, coarse)
        per_pair, over_all = self.metrics([fine, coarse], drawdowns=falls, sides=False)
        both = per_pair.unionByName(over_all.withColumn("pair", F.lit(ALL_PAIRS)))
        known = self.cells.groupBy(*RUN).agg(F.sum("sided").alias("_k")).filter("_k > 0").select(*RUN)
        return both.join(known, list(RUN), "left_semi").select(*RUN, "pair", "direction", *[c for c in both.columns if c not in fine])


def pair_metrics(trades: DataFrame, *, slippage_bps_round_trip: float = 4.0) -> DataFrame:
    return TradeLattice(trades, slippage_bps_round_trip).pairs()


def overall_metrics(trades: DataFrame, *, slippage_bps_round_trip: float = 4.0) -> DataFrame:
    metrics = TradeLattice(trades, slippage_bps_round_trip).overall()
    return metrics.withColumn("slippage_bps_round_trip", F.lit(float(slippage_bps_round_trip)))


def direction_metrics(trades: DataFrame, *, slippage_bps_round_trip: float = 4.0) -> DataFrame:
    return TradeLattice(trades, slippage_bps_round_trip).directions()


def exit_reason_metrics(trades: DataFrame, *, slippage_bps_round_trip: float = 4.0) -> DataFrame:
    adjusted = adjusted_trades(trades, slippage_bps_round_trip)
    return (
        adjusted.filter(F.col("exit_reason").isNotNull())
        .groupBy(*RUN, "exit_reason")
        .agg(F.count(F.lit(1)).alias("trades"), F.avg("adjusted").alias("expectancy"))
    )


def smoke_status(trades: Column, expectancy: Column, factor: Column, *, no_trades: bool = True) -> Column:
    """Diagnostic label of a run; without ``no_trades`` an empty run counts as negative."""
    positive = F.coalesce((trades > 0) & (expectancy > 0) & (factor > 1), F.lit(False))
    label = F.when(positive, "POSITIVE_SMOKE").otherwise("NEGATIVE_SMOKE")
    return F.when(F.coalesce(trades, F.lit(0)) <= 0, "NO_TRADES").otherwise(label) if no_trades else label


def suite_summary(
    runs: DataFrame, trades: DataFrame, *, slippage_bps_round_trip: float = 4.0, no_trades: bool = True
) -> DataFrame:
    """One row per run with overall, long and short metrics and status.

    ``runs`` lists (strategy, timeframe) and any further columns to keep; a run
    without trades keeps its row.
    """
    keys = list(RUN)
    adjusted = adjusted_trades(trades, slippage_bps_round_trip)
    sided = adjusted.withColumn("direction", direction_of(F.col("is_short")))
    r = F.col("adjusted")
    gross = lambda test: F.coalesce(F.abs(F.sum(F.when(test, r))), F.lit(0.0))
    elapsed = (F.unix_micros("close_date") - F.unix_micros("open_date")) / 60_000_000

    def side_columns(side: str) -> list[Column]:
        here = F.col("direction") == side
        wins = F.coalesce(F.sum(F.when(here & (r > 0), r)), F.lit(0.0))
        losses = F.coalesce(-F.sum(F.when(here & (r < 0), r)), F.lit(0.0))
        n = F.count(F.when(here, 1))
        return [
            n.alias(f"{side}_trades"),
            F.avg(F.when(here, r)).alias(f"{side}_expectancy"),
            F.when(n > 0, profit_factor(wins, losses)).alias(f"{side}_profit_factor"),
        ]

    overall = sided.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(r).alias("expectancy"),
        profit_factor(gross(r > 0), gross(r < 0)).alias("profit_factor"),
        F.coalesce(F.avg("trade_duration"), F.avg(elapsed)).alias("avg_duration_minutes"),
        *side_columns("long"),
        *side_columns("short"),
    )
    counts = ["trades", "long_trades", "short_trades"]
    return (
        runs.join(overall, keys, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        .withColumn(
            "status",
            smoke_status(F.col("trades"), F.col("expectancy"), F.col("profit_factor"), no_trades=no_trades),
        )
    )


def as_percent(value: Column) -> Column:
    """``12.3457%`` with four decimals, ``-`` for a missing value."""
    return F.when(value.isNotNull(), F.format_string("%.4f%%", value * 100)).otherwise("-")


def as_number(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).otherwise("-")
