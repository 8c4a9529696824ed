"""Recursive indicators: exponential averages, VIDYA and the follow line."""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidebars.functions.scans import affine_scan, clamp_scan, last_nonzero
from tidebars.operators.runs import ddl, doubles, map_runs
from tidebars.operators.series import Panel


def alpha_of_span(span: float) -> float:
    return 2.0 / (span + 1.0)


#: Averages closer than this share of the price are one value. What history is left in an
#: average after its warm-up, and rounding, stay far below, so where a series is cut cannot matter.
SAME_VALUE = 1e-12


def warm_up(alpha: float) -> int:
    """Rows after which what is left of an exponential average's start is below any rounding."""
    return 0 if alpha >= 1.0 else ceil(log(1e-20) / log(1.0 - alpha))


def ewm(values: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(values).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def macd_lookback(fast: int, slow: int, signal: int) -> int:
    return max(slow, warm_up(alpha_of_span(slow))) + max(signal, warm_up(alpha_of_span(signal))) + 1


def with_macd_crosses(blocks: DataFrame, panel: Panel, *, fast: int, slow: int, signal: int) -> DataFrame:
    """Add ``macd``, ``macd_signal`` and whether one crosses ``_above`` or ``_below`` the other.

    Closes are never missing, so an average started ``warm_up`` rows before a
    block agrees with one started at the first bar but for rounding. Rounding would
    decide crosses where the price stands still and both averages run together, so a
    gap under ``SAME_VALUE`` of the price counts as none, in short and long series.
    """
    kept = blocks.columns

    def kernel(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        close, pos = pdf["close"].to_numpy(), pdf["pos"].to_numpy()
        line, average = np.empty(len(pdf)), np.empty(len(pdf))
        for start, end in zip(starts.tolist(), ends.tolist()):
            part = close[start:end]
            spread = ewm(part, alpha_of_span(fast)) - ewm(part, alpha_of_span(slow))
            spread[pos[start:end] < slow - 1] = np.nan
            line[start:end] = spread
            average[start:end] = ewm(spread, alpha_of_span(signal))
        average[pos < slow + signal - 2] = np.nan
        gap = line - average  # comparisons with a missing side are false
        gap[np.abs(gap) <= SAME_VALUE * np.abs(close)] = 0.0
        before = np.roll(gap, 1)
        before[starts] = np.nan
        return pdf.assign(
            macd=line,
            macd_signal=average,
            _above=(gap > 0) & (before <= 0),
            _below=(gap < 0) & (before >= 0),
        )

    schema = f"{ddl(blocks, kept)}, {doubles(['macd', 'macd_signal'])}, _above boolean, _below boolean"
    return map_runs(blocks, panel.block_keys, ["pos"], kernel, schema)


class EwmWithGaps:
    """Exponential average of a column that may be missing on some rows.

    A missing row leaves the average as it is but lets the weight of the past
    decay one step more. A stretch is described by the rows before its first
    observation, that observation, the affine map of the rest, the rows after its
    last observation, and its counts.
    """

    state = {"average": np.nan, "idle": 0.0, "observed": 0.0}
    summary = ("lead", "first", "scale", "shift", "tail", "observations", "length")

    def __init__(self, column: str, output: str, *, span: int):
        self.inputs = (column,)
        self.column = column
        self.outputs = (output,)
        self.alpha = alpha_of_span(span)
        self.minimum = span

    def prepare(self, rows):
        return rows

    def _enter(self, average: float, idle: float, lead: float, first: float) -> float:
        """Average right after a stretch's first observation."""
        if np.isnan(average):
            return first
        past = (1.0 - self.alpha) ** (idle + lead + 1)
        return (past * average + self.alpha * first) / (past + self.alpha)

    def summarise(self, rows):
        values = rows[self.column]
        seen = np.flatnonzero(~np.isnan(values))
        if not seen.size:
            return [len(values), np.nan, np.nan, np.nan, 0, 0, len(values)]
        past = (1.0 - self.alpha) ** np.diff(seen)
        scale = float(np.prod(past / (past + self.alpha)))
        # value reached when the first observation counts as zero
        from_zero = values[seen[0] :].copy()
        from_zero[0] = 0.0
        shift = ewm(from_zero, self.alpha)[-1]
        return [seen[0], values[seen[0]], scale, shift, len(values) - 1 - seen[-1], seen.size, len(values)]

    def apply(self, state, summary):
        average, idle, observed = state
        lead, first, scale, shift, tail, observations, length = summary
        if not observations:
            return [average, idle + length, observed]
        return [scale * self._enter(average, idle, lead, first) + shift, tail, observed + observations]

    def run(self, rows, state):
        average, idle, observed = state
        values = rows[self.column]
        out = np.full(len(values), average)
        present = ~np.isnan(values)
        if present.any():
            head = int(present.argmax())
            rest = values[head:].copy()
            rest[0] = self._enter(average, idle, head, rest[0])
            out[head:] = ewm(rest, self.alpha)
        out[observed + present.cumsum() < self.minimum] = np.nan
        return [out]


class Vidya:
    """Averages y = w*x + (1-w)*y_prev whose weight differs on every row.

    The past of the first row is 0; a missing x gives a missing y and a past of 0.
    ``series`` maps each output to its x and w columns.
    """

    def __init__(self, series: dict[str, tuple[str, str]]):
        self.series = series
        self.outputs = tuple(series)
        self.inputs = tuple(column for pair in series.values() for column in pair)
        self.state = {name: 0.0 for name in series}
        self.summary = tuple(f"{part}_{name}" for name in series for part in ("scale", "shift"))

    def prepare(self, rows):
        return {name: np.nan_to_num(v) if name.endswith("_weight") else v for name, v in rows.items()}

    @staticmethod
    def _scan(x: np.ndarray, w: np.ndarray, past: float) -> np.ndarray:
        """Averages of a stretch; after a missing x the past is 0."""
        gone = np.isnan(x)
        out = affine_scan(np.where(gone, 0.0, 1.0 - w), np.where(gone, 0.0, w * x), past)
        out[gone] = np.nan
        return out

    def summarise(self, rows):
        numbers = []
        for value, weight in self.series.values():
            x, w = rows[value], rows[weight]
            reached = self._scan(x, w, 0.0)[-1] if x.size else 0.0
            scale = 0.0 if np.isnan(x).any() else float(np.prod(1.0 - w))
            numbers += [scale, 0.0 if np.isnan(reached) else reached]
        return numbers

    def apply(self, state, summary):
        return [summary[2 * i] * past + summary[2 * i + 1] for i, past in enumerate(state)]

    def run(self, rows, state):
        return [self._scan(rows[value], rows[weight], past) for (value, weight), past in zip(self.series.values(), state)]


class FollowLine:
    """Ratchet: rises to ``low - atr`` on the upper side, falls to ``high + atr`` on the lower.

    The side is that of the latest close outside its band. Each step clamps the
    previous value from one side, so a stretch whose side is known is a clamp to
    [floor, ceiling]; rows before its first outside close act by the side carried
    in and are kept apart as ``pre_max`` / ``pre_min``. Chaining involves
    comparisons only and is exact.
    """

    inputs = ("low", "high", "true_range", "outside")
    state = {"side": 0.0, "line": 0.0}
    summary = ("pre_max", "pre_min", "side", "floor", "ceiling")
    outputs = ("follow_line",)

    def __init__(self, *, atr_period: int):
        self.alpha = 1.0 / atr_period
        self.minimum = atr_period

    def prepare(self, rows):
        """Add the levels a row offers; bars are never missing, so ATR needs only a warm-up."""
        atr = ewm(rows["true_range"], self.alpha)
        atr[rows["pos"] < self.minimum - 1] = np.nan
        return {
            "pos": rows["pos"],
            "outside": np.nan_to_num(rows["outside"]),
            "rise_to": rows["low"] - atr,
            "fall_to": rows["high"] + atr,
        }

    @staticmethod
    def _bounds(rows, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each row clamps the line to: from below on the upper side, from above on the lower."""
        known = ~np.isnan(rows["rise_to"])
        low = np.where(known & (side > 0), rows["rise_to"], -np.inf)
        return low, np.where(known & (side < 0), rows["fall_to"], np.inf)

    def summarise(self, rows):
        side = last_nonzero(rows["outside"], 0.0)
        if not side.size:
            return [-np.inf, np.inf, 0.0, -np.inf, np.inf]
        before = (side == 0) & ~np.isnan(rows["rise_to"])
        low, high = self._bounds(rows, side)
        return [
            np.max(rows["rise_to"], where=before, initial=-np.inf),
            np.min(rows["fall_to"], where=before, initial=np.inf),
            side[-1],
            clamp_scan(low, high, -np.inf)[-1],
            clamp_scan(low, high, np.inf)[-1],
        ]

    def apply(self, state, summary):
        side, line = state
        pre_max, pre_min, last_side, floor, ceiling = summary
        line = max(line, pre_max) if side > 0 else min(line, pre_min) if side < 0 else line
        return [last_side or side, min(ceiling, max(floor, line))]

    def run(self, rows, state):
        side, line = state
        return [clamp_scan(*self._bounds(rows, last_nonzero(rows["outside"], side)), line)]
