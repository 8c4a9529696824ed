"""Signal systems: boolean ``long_signal`` / ``short_signal`` and a ``tag`` per closed bar.

Every system is a function of a block-wise panel (see ``series``) and states how
many earlier rows it reads, so blocks can carry enough halo.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.carry import run_recurrence
from tidebars.operators.recursive import (
    EwmWithGaps,
    FollowLine,
    Vidya,
    alpha_of_span,
    SAME_VALUE,
    macd_lookback,
    warm_up,
    with_macd_crosses,
)
from tidebars.operators.series import (
    BLOCK_ROWS,
    SERIES,
    Panel,
    bar_blocks,
    carry_last,
    core_rows,
    median_of,
)
from tidebars.session import stage

SIGNAL_COLUMNS = ("long_signal", "short_signal", "tag")
BAR_COLUMNS = ("date", "open", "high", "low", "close", "volume")

Rules = Sequence[tuple[Callable[[Mapping], bool], str]]


@dataclass(frozen=True)
class System:
    """A registered signal system."""

    name: str
    defaults: Mapping[str, float]
    lookback: Callable[[Mapping], int]
    build: Callable[[DataFrame, Panel, Mapping, int], DataFrame]
    rules: Rules

    def parameters(self, overrides: Mapping[str, float]) -> dict[str, float]:
        unknown = sorted(set(overrides) - set(self.defaults))
        if unknown:
            raise ValueError(f"{self.name} has no parameter: " + ", ".join(unknown))
        chosen = {**self.defaults, **overrides}
        for accept, message in self.rules:
            if not accept(chosen):
                raise ValueError(message)
        return chosen


REGISTRY: dict[str, System] = {}


def _system(defaults: Mapping[str, float], *, reach: Callable[[Mapping], int], rules: Rules = ()):
    def register(build):
        REGISTRY[build.__name__] = System(build.__name__, defaults, reach, build, rules)
        return build

    return register


def is_true(condition: Column) -> Column:
    """A comparison with a missing side is false."""
    return F.coalesce(condition, F.lit(False))


def _all(*conditions: Column) -> Column:
    met = conditions[0]
    for condition in conditions[1:]:
        met = met & condition
    return is_true(met)


def close_location() -> Column:
    """Where the close sits in the bar's range; missing for a bar without range."""
    return F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low")))


def tradable() -> Column:
    return F.col("volume") > 0


def band(level: Column, bps: float) -> Column:
    return level * (1.0 + bps / 10_000.0)


def true_range(panel: Panel) -> Column:
    """Largest of the bar's range and its reach from the previous close."""
    before = panel.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def crosses(panel: Panel, a: str, b: str) -> tuple[Column, Column]:
    """Column ``a`` crossing above, and below, column ``b``."""
    before_a, before_b = panel.lag(a), panel.lag(b)
    above = (F.col(a) > F.col(b)) & (before_a <= before_b)
    below = (F.col(a) < F.col(b)) & (before_a >= before_b)
    return is_true(above), is_true(below)


def _signals(
    df: DataFrame, long: Column, short: Column, long_tag, short_tag, *, drop_both: bool = False
) -> DataFrame:
    long, short = is_true(long), is_true(short)
    if drop_both:
        long, short = long & ~short, short & ~long
    as_col = lambda tag: F.lit(tag) if isinstance(tag, str) else tag
    return df.select(
        "*",
        long.alias("long_signal"),
        short.alias("short_signal"),
        F.when(long, as_col(long_tag)).when(short, as_col(short_tag)).alias("tag"),
    )


# Rules shared by several systems: (test, message).
_BUFFER = (lambda p: p["breakout_buffer_bps"] >= 0, "breakout_buffer_bps cannot be negative")
_STRENGTH = (
    lambda p: 0.5 < p["close_strength_fraction"] < 1.0,
    "close_strength_fraction must be between 0.5 and 1.0",
)
_LOOKBACK2 = (lambda p: p["lookback"] >= 2, "lookback must be at least 2")
_MACD_RULES = (
    (lambda p: 0 < p["fast_period"] < p["slow_period"], "MACD periods must satisfy 0 < fast < slow"),
    (lambda p: p["signal_period"] > 0, "signal_period must be positive"),
)


def _macd_reach(p: Mapping) -> int:
    return macd_lookback(p["fast_period"], p["slow_period"], p["signal_period"])


@_system(
    {"fast_period": 12, "slow_period": 26, "signal_period": 9}, reach=_macd_reach, rules=_MACD_RULES
)
def macd_crossover(df, panel, p, rows):
    df = with_macd_crosses(df, panel, fast=p["fast_period"], slow=p["slow_period"], signal=p["signal_period"])
    return _signals(
        df, F.col("_above") & tradable(), F.col("_below") & tradable(), "macd_cross_long", "macd_cross_short"
    )


def macd_exits(bars: DataFrame, *, block_rows: int = BLOCK_ROWS, **overrides) -> DataFrame:
    """Opposite-cross exits, which hold on untraded bars too."""
    system = REGISTRY["macd_crossover"]
    p = system.parameters(overrides)
    back = system.lookback(p)
    blocks = bar_blocks(bars, rows=max(block_rows, 4 * back), back=back)
    crossed = with_macd_crosses(
        blocks, Panel(), fast=p["fast_period"], slow=p["slow_period"], signal=p["signal_period"]
    )
    opposite = F.when(F.col("_below") | F.col("_above"), "opposite_cross")
    marked = crossed.withColumns(
        {"exit_long": F.col("_below"), "exit_short": F.col("_above"), "exit_tag": opposite}
    )
    return core_rows(marked).drop("macd", "macd_signal", "_above", "_below")


@_system(
    {"lookback": 20, "min_sweep_bps": 5.0, "rejection_close_fraction": 0.60},
    reach=lambda p: p["lookback"],
    rules=(
        _LOOKBACK2,
        (lambda p: p["min_sweep_bps"] >= 0, "min_sweep_bps cannot be negative"),
        (
            lambda p: 0.5 < p["rejection_close_fraction"] < 1.0,
            "rejection_close_fraction must be between 0.5 and 1.0",
        ),
    ),
)
def liquidity_sweep_reclaim(df, panel, p, rows):
    n, bps, strong = p["lookback"], p["min_sweep_bps"], p["rejection_close_fraction"]
    df = df.withColumns(
        {
            "_floor": panel.trailing(F.min, "low", n, shift=1),
            "_roof": panel.trailing(F.max, "high", n, shift=1),
        }
    )
    floor, roof, close = F.col("_floor"), F.col("_roof"), F.col("close")
    return _signals(
        df,
        _all(F.col("low") <= band(floor, -bps), close > floor, close_location() >= strong, tradable()),
        _all(F.col("high") >= band(roof, bps), close < roof, close_location() <= 1.0 - strong, tradable()),
        "liquidity_sweep_reclaim_long",
        "liquidity_sweep_reclaim_short",
    )


@_system(
    {
        "lookback": 20,
        "breakout_buffer_bps": 5.0,
        "retest_tolerance_bps": 10.0,
        "close_strength_fraction": 0.55,
    },
    reach=lambda p: p["lookback"] + 1,
    rules=(
        _LOOKBACK2,
        _BUFFER,
        (lambda p: p["retest_tolerance_bps"] >= 0, "retest_tolerance_bps cannot be negative"),
        (
            lambda p: 0.5 <= p["close_strength_fraction"] < 1.0,
            "close_strength_fraction must be in [0.5, 1.0)",
        ),
    ),
)
def breakout_retest(df, panel, p, rows):
    n, buffer, near = p["lookback"], p["breakout_buffer_bps"], p["retest_tolerance_bps"]
    strong = p["close_strength_fraction"]
    df = df.withColumns(
        {
            "_roof": panel.trailing(F.max, "high", n, shift=2),
            "_floor": panel.trailing(F.min, "low", n, shift=2),
            "_before": panel.lag("close"),
        }
    )
    roof, floor, before, close = F.col("_roof"), F.col("_floor"), F.col("_before"), F.col("close")
    return _signals(
        df,
        _all(
            before >= band(roof, buffer),
            F.col("low").between(band(roof, -near), band(roof, near)),
            close > roof,
            close_location() >= strong,
            tradable(),
        ),
        _all(
            before <= band(floor, -buffer),
            F.col("high").between(band(floor, -near), band(floor, near)),
            close < floor,
            close_location() <= 1.0 - strong,
            tradable(),
        ),
        "breakout_retest_long",
        "breakout_retest_short",
    )


def relative_range(panel: Panel) -> Column:
    """Bar range over the previous close."""
    return F.try_divide(F.col("high") - F.col("low"), panel.lag("close"))


@_system(
    {
        "compression_window": 10,
        "baseline_window": 50,
        "compression_ratio": 0.60,
        "expansion_ratio": 1.50,
        "breakout_buffer_bps": 5.0,
        "close_strength_fraction": 0.65,
    },
    reach=lambda p: 2 * p["compression_window"] + p["baseline_window"],
    rules=(
        (lambda p: p["compression_window"] >= 3, "compression_window must be at least 3"),
        (
            lambda p: p["baseline_window"] >= p["compression_window"],
            "baseline_window must be >= compression_window",
        ),
        (lambda p: 0 < p["compression_ratio"] < 1, "compression_ratio must be between 0 and 1"),
        (lambda p: p["expansion_ratio"] > 1, "expansion_ratio must be greater than 1"),
        _BUFFER,
        _STRENGTH,
    ),
)
def compression_expansion(df, panel, p, rows):
    n, base, buffer = p["compression_window"], p["baseline_window"], p["breakout_buffer_bps"]
    strong = p["close_strength_fraction"]
    width = panel.trailing(F.max, "high", n) - panel.trailing(F.min, "low", n)
    df = df.withColumns(
        {
            "_width": F.try_divide(width, F.col("close")),
            "_range": relative_range(panel),
            "_roof": panel.trailing(F.max, "high", n, shift=1),
            "_floor": panel.trailing(F.min, "low", n, shift=1),
        }
    )
    df = df.withColumns(
        {
            "_before": panel.lag("_width"),
            "_widths": panel.values("_width", base, shift=n + 1, missing=n - 1),
            "_ranges": panel.values("_range", n, shift=1, missing=1),
        }
    )
    close = F.col("close")
    up = _all(close >= band(F.col("_roof"), buffer), close_location() >= strong, tradable())
    down = _all(close <= band(F.col("_floor"), -buffer), close_location() <= 1.0 - strong, tradable())
    squeezed = F.col("_before") <= median_of(F.col("_widths"), base) * p["compression_ratio"]
    expanding = F.col("_range") >= median_of(F.col("_ranges"), n) * p["expansion_ratio"]
    df = df.withColumns({"_up": up, "_down": down})
    df = df.withColumn("_ready", F.when(F.col("_up") | F.col("_down"), squeezed & expanding))
    return _signals(
        df,
        F.col("_up") & F.col("_ready"),
        F.col("_down") & F.col("_ready"),
        "compression_expansion_long",
        "compression_expansion_short",
    )


@_system(
    {
        "lookback": 20,
        "break_buffer_bps": 5.0,
        "displacement_ratio": 1.20,
        "close_strength_fraction": 0.65,
    },
    reach=lambda p: p["lookback"] + 2,
    rules=(
        (lambda p: p["lookback"] >= 3, "lookback must be at least 3"),
        (lambda p: p["break_buffer_bps"] >= 0, "break_buffer_bps cannot be negative"),
        (lambda p: p["displacement_ratio"] > 1, "displacement_ratio must be greater than 1"),
        _STRENGTH,
    ),
)
def bos_choch(df, panel, p, rows):
    n, buffer, strong = p["lookback"], p["break_buffer_bps"], p["close_strength_fraction"]

    def breaks(df):
        df = df.withColumns(
            {
                "_range": relative_range(panel),
                "_roof": panel.trailing(F.max, "high", n, shift=1),
                "_floor": panel.trailing(F.min, "low", n, shift=1),
            }
        )
        close = F.col("close")
        up = _all(close >= band(F.col("_roof"), buffer), close_location() >= strong, tradable())
        down = _all(close <= band(F.col("_floor"), -buffer), close_location() <= 1.0 - strong, tradable())
        df = df.withColumns({"_ranges": panel.values("_range", n, shift=1, missing=1), "_up": up, "_down": down})
        # a bar breaking both ways is ignored
        side = F.when(F.col("_up") & ~F.col("_down"), 1).when(F.col("_down") & ~F.col("_up"), -1)
        displaced = F.col("_range") >= median_of(F.col("_ranges"), n) * p["displacement_ratio"]
        df = df.withColumn("_side", side)
        moved = F.when(F.col("_side").isNotNull(), F.when(displaced, F.col("_side")))
        return df.withColumn("_break", moved).drop("_range", "_roof", "_floor", "_ranges", "_up", "_down", "_side")

    df = carry_last(df, panel, breaks, "_break", "_structure", rows=rows)
    known = F.col("_structure").isNotNull()
    side = lambda sign, name: F.when(F.col("_structure") == sign, f"bos_{name}").otherwise(f"choch_{name}")
    return _signals(
        df,
        (F.col("_break") == 1) & known,
        (F.col("_break") == -1) & known,
        side(1, "long"),
        side(-1, "short"),
    )


def _turtle(df, panel, n):
    return df.withColumns(
        {
            "_roof": panel.trailing(F.max, "high", n, shift=1),
            "_floor": panel.trailing(F.min, "low", n, shift=1),
        }
    )


@_system({"entry_length": 20}, reach=lambda p: p["entry_length"])
def turtle_channel(df, panel, p, rows):
    df = _turtle(df, panel, p["entry_length"])
    return _signals(
        df,
        _all(F.col("high") >= F.col("_roof"), tradable()),
        _all(F.col("low") <= F.col("_floor"), tradable()),
        "tutci_breakout_long",
        "tutci_breakout_short",
        drop_both=True,
    )


@_system(
    {"entry_length": 20, "vhf_length": 18, "vhf_ema_length": 14},
    reach=lambda p: max(p["entry_length"], p["vhf_length"]) + 2,
)
def turtle_vhf(df, panel, p, rows):
    n = p["vhf_length"]

    def inputs(df):
        df = _turtle(df, panel, p["entry_length"])
        df = df.withColumn("_step", F.abs(F.col("close") - panel.lag("close")))
        reach = panel.trailing(F.max, "close", n) - panel.trailing(F.min, "close", n)
        path = panel.trailing(F.sum, "_step", n, missing=1)
        df = df.withColumns({"_reach": reach, "_path": path})
        df = df.withColumn("_vhf", F.when(F.col("_path") != 0, F.col("_reach") / F.col("_path")))
        return df.withColumn("_vhf_before", panel.lag("_vhf")).drop("_step", "_reach", "_path")

    machine = EwmWithGaps("_vhf", "_vhf_ema", span=p["vhf_ema_length"])
    df = run_recurrence(df, panel, machine, inputs=inputs, rows=rows)
    trending = (F.col("_vhf") > F.col("_vhf_ema")) & (F.col("_vhf") > F.col("_vhf_before"))
    return _signals(
        df,
        _all(trending, F.col("high") >= F.col("_roof"), tradable()),
        _all(trending, F.col("low") <= F.col("_floor"), tradable()),
        "turtle_vhf_long",
        "turtle_vhf_short",
        drop_both=True,
    )


@_system({}, reach=lambda p: 4)
def isolated_peak_bottom(df, panel, p, rows):
    df = df.withColumns(
        {f"_{c}{k}": panel.lag(c, k) for c in ("high", "low") for k in range(1, 5)}
    )
    highs = [F.col("high"), *(F.col(f"_high{k}") for k in range(1, 5))]
    lows = [F.col("low"), *(F.col(f"_low{k}") for k in range(1, 5))]
    peak1 = _all(
        *(highs[1] > highs[k] for k in (0, 2, 3)),
        lows[0] < F.least(lows[1], lows[2]),
    )
    peak2 = _all(
        *(highs[2] > highs[k] for k in (0, 3, 4)),
        highs[2] >= highs[1],
        lows[1] > F.least(lows[2], lows[3]),
        lows[0] < F.least(lows[2], lows[3]),
    )
    bottom1 = _all(
        *(lows[1] < lows[k] for k in (0, 2, 3)),
        highs[0] > F.greatest(highs[1], highs[2]),
    )
    bottom2 = _all(
        *(lows[2] < lows[k] for k in (0, 1, 3, 4)),
        highs[1] < F.greatest(highs[2], highs[3]),
        highs[0] > F.greatest(highs[2], highs[3]),
    )
    return _signals(
        df,
        (bottom1 | bottom2) & tradable(),
        (peak1 | peak2) & tradable(),
        "isolated_bottom",
        "isolated_peak",
        drop_both=True,
    )


@_system({"volume_length": 30, "volume_ratio": 1.5}, reach=lambda p: p["volume_length"])
def volume_coloured_bars(df, panel, p, rows):
    df = df.withColumn("_usual_volume", panel.trailing(F.avg, "volume", p["volume_length"]))
    strong = F.col("volume") > F.col("_usual_volume") * p["volume_ratio"]
    return _signals(
        df,
        _all(strong, F.col("close") > F.col("open")),
        _all(strong, F.col("close") < F.col("open")),
        "vbcb_strong_bull",
        "vbcb_strong_bear",
    )


@_system(
    {"atr_period": 5, "bb_period": 21, "bb_deviation": 1.0},
    reach=lambda p: max(p["bb_period"], p["atr_period"] + warm_up(1.0 / p["atr_period"])) + 3,
)
def follow_line(df, panel, p, rows):
    n, width = p["bb_period"], p["bb_deviation"]

    def inputs(df):
        df = df.withColumns(
            {
                "_mid": panel.trailing(F.avg, "close", n),
                "_dev": panel.trailing(F.stddev_pop, "close", n) * width,
                "true_range": true_range(panel),
            }
        )
        above, below = F.col("_mid") + F.col("_dev"), F.col("_mid") - F.col("_dev")
        outside = F.when(F.col("close") > above, 1).when(F.col("close") < below, -1)
        return df.withColumn("outside", outside).drop("_mid", "_dev")

    machine = FollowLine(atr_period=p["atr_period"])
    df = run_recurrence(df, panel, machine, inputs=inputs, rows=rows, lead_in=1)
    df = stage(df.drop("true_range", "outside"))  # read twice below

    def moves(df):
        # the line before a series' first bar counts as 0
        before = F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(panel.lag("follow_line"))
        step = F.col("follow_line") - before
        moved = F.abs(step) > SAME_VALUE * F.abs(before)
        df = df.withColumn("_step", F.when(moved, F.signum(step)).when(step.isNotNull(), 0.0))
        return df.withColumn("_move", F.when(F.col("_step") != 0, F.col("_step"))).drop("_step")

    df = carry_last(df, panel, moves, "_move", "_trend_before", rows=rows)
    return _signals(
        df,
        _all(F.col("_trend_before") == -1, F.col("_move") == 1, tradable()),
        _all(F.col("_trend_before") == 1, F.col("_move") == -1, tradable()),
        "follow_line_buy",
        "follow_line_sell",
    )


def end_point_weights(n: int) -> list[float]:
    """Weights w[k] of the value k rows back in the end point of an n-row least-squares line."""
    mean = (n - 1) / 2
    spread = sum((x - mean) ** 2 for x in range(n))
    return [1 / n + (x - mean) * (n - 1 - mean) / spread for x in range(n - 1, -1, -1)]


@_system({"length": 20, "signal_period": 5}, reach=lambda p: 2 * p["length"] + p["signal_period"])
def squeeze_momentum(df, panel, p, rows):
    n = p["length"]
    middle = (panel.trailing(F.max, "high", n) + panel.trailing(F.min, "low", n)) / 2
    df = df.withColumn("_raw", F.col("close") - (middle + panel.trailing(F.avg, "close", n)) / 2)
    value = F.lit(0.0)
    for k, weight in enumerate(end_point_weights(n)):
        value = value + F.lit(weight) * (panel.lag("_raw", k) if k else F.col("_raw"))
    df = df.withColumn("_value", value)
    df = df.withColumn("_signal", panel.trailing(F.avg, "_value", p["signal_period"], missing=2 * (n - 1)))
    above, below = crosses(panel, "_value", "_signal")
    df = df.withColumns({"_above": above, "_below": below})
    return _signals(
        df, F.col("_above") & tradable(), F.col("_below") & tradable(), "sqzmom_v2_buy", "sqzmom_v2_sell"
    )


def _tracker_back(p: Mapping) -> int:
    """Rows of the bands a bar reads."""
    return p["ma_period"] + p["slower_period"]


_CMO_ROWS = 9


@_system(
    {"faster_period": 5, "period": 5, "ma_period": 2, "slower_period": 10, "stddev_multiplier": 2.0},
    reach=lambda p: _tracker_back(p) + p["faster_period"] + p["period"] + _CMO_ROWS + 2,
)
def progressive_trend_tracker(df, panel, p, rows):
    # the extreme over `period` windows of `faster_period` bars is one longer window
    n = p["faster_period"] + p["period"] - 1
    sides = {"upper": (F.max, "high"), "lower": (F.min, "low")}
    alpha = alpha_of_span(p["ma_period"])
    gain = lambda c: F.when(c > 0, c).otherwise(F.lit(0.0))
    total = lambda c: panel.trailing(F.sum, gain(c), _CMO_ROWS, missing=n)

    def inputs(df):
        df = df.withColumns({f"_{s}": panel.trailing(agg, c, n) for s, (agg, c) in sides.items()})
        df = df.withColumns({f"_{s}_step": F.col(f"_{s}") - panel.lag(f"_{s}") for s in sides})
        sums = {f"_{s}_up": total(F.col(f"_{s}_step")) for s in sides}
        sums |= {f"_{s}_down": total(-F.col(f"_{s}_step")) for s in sides}
        df = df.withColumns(sums)
        weights = {}
        for s in sides:
            up, down = F.col(f"_{s}_up"), F.col(f"_{s}_down")
            weights[f"_{s}_weight"] = F.when(up + down != 0, F.abs((up - down) / (up + down)) * alpha)
        return df.withColumns(weights).drop(*sums, *(f"_{s}_step" for s in sides))

    machine = Vidya({f"_{s}_ma": (f"_{s}", f"_{s}_weight") for s in sides})
    df = run_recurrence(df, panel, machine, inputs=inputs, rows=rows, lead_in=_tracker_back(p))
    spread = {
        s: panel.trailing(F.stddev_pop, f"_{s}", p["ma_period"], missing=n - 1) * p["stddev_multiplier"]
        for s in sides
    }
    df = df.withColumns(
        {
            "_upper_band": F.col("_upper_ma") + spread["upper"],
            "_lower_band": F.col("_lower_ma") - spread["lower"],
        }
    )
    head = n - 1 + p["ma_period"] - 1
    df = df.withColumns(
        {
            "_ptt_upper": panel.trailing(F.min, "_upper_band", p["slower_period"], missing=head),
            "_ptt_lower": panel.trailing(F.max, "_lower_band", p["slower_period"], missing=head),
        }
    )
    above, _ = crosses(panel, "close", "_ptt_lower")
    _, below = crosses(panel, "close", "_ptt_upper")
    df = df.withColumns({"_above": above, "_below": below})
    return _signals(
        df, F.col("_above") & tradable(), F.col("_below") & tradable(), "ptt_buy", "ptt_sell", drop_both=True
    )


def register(
    name: str,
    build: Callable[[DataFrame, Panel, Mapping, int], DataFrame],
    *,
    defaults: Mapping[str, float] | None = None,
    reach: Callable[[Mapping], int],
) -> None:
    """Add a user-defined system.

    ``build(blocks, panel, parameters, block_rows)`` adds the signal columns using
    windows of ``panel``; ``reach`` tells how many earlier rows they read.
    """
    if name in REGISTRY:
        raise ValueError(f"system already registered: {name}")
    REGISTRY[name] = System(name, defaults or {}, reach, build, ())


def require_bars(df: DataFrame) -> None:
    missing = sorted({*SERIES, *BAR_COLUMNS} - set(df.columns))
    if missing:
        raise ValueError("OHLCV frame missing columns: " + ", ".join(missing))


def signal_blocks(
    bars: DataFrame, system: str, *, ahead: int = 0, block_rows: int = BLOCK_ROWS, **overrides
) -> DataFrame:
    """Blocks with signal columns, keeping halo rows for windows that follow."""
    require_bars(bars)
    if system not in REGISTRY:
        raise ValueError(f"unknown signal system: {system}")
    chosen = REGISTRY[system]
    parameters = chosen.parameters(overrides)
    back = chosen.lookback(parameters)
    rows = max(block_rows, 4 * back)  # keep the copied share of a block small
    base = [c for c in (*SERIES, *BAR_COLUMNS, "pos", "series_rows") if c in bars.columns]
    blocks = bar_blocks(bars.select(*base), rows=rows, back=back, ahead=ahead)
    kept = blocks.columns
    return chosen.build(blocks, Panel(), parameters, rows).select(*kept, *SIGNAL_COLUMNS)


def compute_signals(bars: DataFrame, system: str, *, block_rows: int = BLOCK_ROWS, **overrides) -> DataFrame:
    """Bars with ``long_signal``, ``short_signal`` and ``tag``."""
    return core_rows(signal_blocks(bars, system, block_rows=block_rows, **overrides))


def reject_overlap(signals: DataFrame) -> DataFrame:
    """Make a bar that is long and short at once an error when the rows are read."""
    both = F.col("long_signal") & F.col("short_signal")
    message = F.lit("Long and short signals cannot overlap on the same candle")
    return signals.withColumn(
        "long_signal", F.when(both, F.raise_error(message).cast("boolean")).otherwise(F.col("long_signal"))
    )
