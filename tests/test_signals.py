import pandas as pd
import pytest
from bars import frame, to_spark, walk
from pyspark.sql import functions as F

from tidebars.operators.audit import look_ahead_violations, system_violations
from tidebars.operators.series import SERIES, bar_blocks, bar_chunk, with_position
from tidebars.operators.signals import REGISTRY, compute_signals, macd_exits, register, reject_overlap

SMALL_MACD = {"fast_period": 2, "slow_period": 4, "signal_period": 2}


def fired(spark, pdf, system, **parameters):
    rows = compute_signals(to_spark(spark, pdf), system, **parameters).orderBy("date").collect()
    long = [i for i, r in enumerate(rows) if r.long_signal]
    short = [i for i, r in enumerate(rows) if r.short_signal]
    return long, short, {i: rows[i].tag for i in long + short}


@pytest.fixture(scope="module")
def panel(spark):
    pdf = pd.concat([walk("HOT", 900, 1, flat=60), walk("A", 120, 2), walk("B", 40, 3), walk("C", 3, 4)])
    return to_spark(spark, pdf).cache()


@pytest.mark.parametrize("system", sorted(REGISTRY))
def test_blocks_do_not_change_signals(panel, system):
    """Cutting the hot series into many small blocks gives the signals of the uncut series."""
    parameters = SMALL_MACD if system == "macd_crossover" else {}
    whole = compute_signals(panel, system, **parameters)
    cut = compute_signals(panel, system, block_rows=64, **parameters)
    assert whole.count() == panel.count()
    assert whole.filter("long_signal or short_signal").count() > 0
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


@pytest.fixture(scope="module")
def standing(spark):
    """A long series whose price stands still again and again, for longer than any average remembers."""
    pdf = walk("STILL", 16_000, 9, gaps=0.0)
    for start in (1_000, 6_000, 11_000):
        still = slice(start, start + 3_500)
        price = pdf.loc[start, "close"]
        pdf.loc[pdf.index[still], ["open", "high", "low", "close"]] = price
    return to_spark(spark, pdf).cache()


@pytest.mark.parametrize("system", ["macd_crossover", "follow_line", "turtle_vhf", "progressive_trend_tracker"])
def test_blocks_do_not_change_signals_of_a_price_that_stands_still(standing, system):
    whole = compute_signals(standing, system)
    for rows in (1_500, 4_096):
        cut = compute_signals(standing, system, block_rows=rows)
        assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty(), rows


@pytest.mark.parametrize(
    "system",
    ["liquidity_sweep_reclaim", "breakout_retest", "bos_choch", "turtle_vhf", "follow_line", "progressive_trend_tracker"],
)
def test_no_look_ahead(panel, system):
    assert system_violations(panel, system, ["2026-01-01 05:00", "2026-01-01 10:00"], block_rows=64).isEmpty()


def test_repainting_signal_is_found(panel):
    def leaky(bars):
        top = bars.groupBy("pair").agg(F.max("close").alias("top"))
        return bars.join(top, "pair").select(
            *SERIES, "date", (F.col("close") == F.col("top")).alias("long_signal"), F.lit(False).alias("short_signal")
        )

    assert look_ahead_violations(panel, leaky, ["2026-01-01 00:20"]).count() > 0


def test_positions_and_halo(spark, panel):
    placed = with_position(panel, SERIES, ["date"], bar_chunk(50)).toPandas()
    for _, series in placed.groupby("pair"):
        assert series.sort_values("date").pos.tolist() == list(range(len(series)))
        assert set(series.series_rows) == {len(series)}
    blocks = bar_blocks(panel, rows=100, back=7, ahead=11).toPandas()
    assert blocks[blocks.core].groupby("pair").size().to_dict() == placed.groupby("pair").size().to_dict()
    hot = blocks[blocks.pair == "HOT"]
    middle = hot[hot.block == 3]
    assert (middle.pos.min(), middle.pos.max()) == (293, 410)


def test_stored_positions_are_used(panel):
    placed = with_position(panel, SERIES, ["date"], bar_chunk())
    again = compute_signals(placed, "turtle_vhf", block_rows=64)
    assert again.exceptAll(compute_signals(panel, "turtle_vhf")).isEmpty()


def test_liquidity_sweep(spark):
    pdf = frame(
        [101, 102, 103, 104, 105, 103, 106.2], [99, 100, 101, 102, 103, 98, 101], [100, 101, 102, 103, 104, 101.5, 103]
    )
    long, short, tags = fired(spark, pdf, "liquidity_sweep_reclaim", lookback=5)
    assert (long, short) == ([5], [6])
    assert tags[5] == "liquidity_sweep_reclaim_long"
    unreclaimed = frame([101, 102, 103, 104, 105, 100], [99, 100, 101, 102, 103, 98], [100, 101, 102, 103, 104, 98.5])
    assert fired(spark, unreclaimed, "liquidity_sweep_reclaim", lookback=5)[0] == []
    pdf["volume"] = 0.0
    assert fired(spark, pdf, "liquidity_sweep_reclaim", lookback=5)[:2] == ([], [])


def test_breakout_retest(spark):
    up = frame(
        [101, 102, 103, 104, 105, 106, 106], [99, 100, 101, 102, 103, 104.8, 105], [100, 101, 102, 103, 104, 105.2, 105.8]
    )
    down = frame(
        [111, 110, 109, 108, 107, 105.2, 105], [109, 108, 107, 106, 105, 104, 104], [110, 109, 108, 107, 106, 104.8, 104.2]
    )
    assert fired(spark, up, "breakout_retest", lookback=5)[0] == [6]
    assert fired(spark, down, "breakout_retest", lookback=5)[1] == [6]


def test_compression_expansion(spark):
    settings = {"compression_window": 3, "baseline_window": 3}
    up = frame([102] * 6 + [100.2] * 3 + [102], [98] * 6 + [99.8] * 3 + [99.9], [100] * 7 + [100.1, 100.1, 101.8])
    down = frame([102] * 6 + [100.2] * 3 + [100.1], [98] * 6 + [99.8] * 3 + [98], [100] * 7 + [99.9, 99.9, 98.2])
    assert fired(spark, up, "compression_expansion", **settings)[0] == [9]
    assert fired(spark, down, "compression_expansion", **settings)[1] == [9]


def test_bos_choch(spark):
    pdf = frame(
        [101, 102, 103, 104, 106.8, 108.5, 108],
        [99, 100, 101, 102, 104.2, 105.5, 99],
        [100, 101, 102, 103, 106.2, 108.2, 100.2],
        open_=[100, 101, 102, 103, 104.5, 106.5, 107],
    )
    settings = {"lookback": 3, "displacement_ratio": 1.01, "close_strength_fraction": 0.60}
    long, short, tags = fired(spark, pdf, "bos_choch", **settings)
    assert (long, short) == ([5], [6])
    assert tags == {5: "bos_long", 6: "choch_short"}


def test_macd_exits_need_no_volume(spark, panel):
    entries = compute_signals(panel, "macd_crossover")
    exits = macd_exits(panel)
    both = entries.join(exits.select(*SERIES, "date", "exit_long", "exit_short"), [*SERIES, "date"])
    assert both.filter("short_signal and not exit_long or long_signal and not exit_short").isEmpty()
    assert both.filter("exit_long and volume = 0").count() > 0


@pytest.mark.parametrize(
    "system, parameters, message",
    [
        ("macd_crossover", {"fast_period": 30}, "0 < fast < slow"),
        ("macd_crossover", {"signal_period": 0}, "signal_period"),
        ("liquidity_sweep_reclaim", {"lookback": 1}, "lookback"),
        ("liquidity_sweep_reclaim", {"min_sweep_bps": -1}, "min_sweep_bps"),
        ("liquidity_sweep_reclaim", {"rejection_close_fraction": 0.5}, "rejection_close_fraction"),
        ("breakout_retest", {"retest_tolerance_bps": -1}, "retest_tolerance_bps"),
        ("compression_expansion", {"baseline_window": 5}, "baseline_window"),
        ("compression_expansion", {"expansion_ratio": 1}, "expansion_ratio"),
        ("bos_choch", {"lookback": 2}, "lookback"),
        ("bos_choch", {"displacement_ratio": 1.0}, "displacement_ratio"),
        ("turtle_channel", {"unknown": 1}, "no parameter"),
    ],
)
def test_parameters_are_checked(panel, system, parameters, message):
    with pytest.raises(ValueError, match=message):
        compute_signals(panel, system, **parameters)


def test_missing_columns_are_refused(panel):
    with pytest.raises(ValueError, match="missing columns: volume"):
        compute_signals(panel.drop("volume"), "turtle_channel")


def test_overlapping_signals_are_refused(panel):
    both = panel.withColumns({"long_signal": F.lit(True), "short_signal": F.col("pair") == "A"})
    with pytest.raises(Exception, match="cannot overlap"):
        reject_overlap(both).count()
        reject_overlap(both).collect()


def test_user_defined_system(panel):
    def build(df, windows, p, rows):
        rising = F.coalesce(F.col("close") > windows.lag("close", p["n"]), F.lit(False))
        return df.select("*", rising.alias("long_signal"), F.lit(False).alias("short_signal"), F.lit("up").alias("tag"))

    register("rising", build, defaults={"n": 3}, reach=lambda p: p["n"])
    try:
        whole, cut = compute_signals(panel, "rising"), compute_signals(panel, "rising", block_rows=16)
        assert whole.exceptAll(cut).isEmpty() and whole.filter("long_signal").count() > 0
        with pytest.raises(ValueError, match="already registered"):
            register("rising", build, reach=lambda p: 0)
    finally:
        del REGISTRY["rising"]
