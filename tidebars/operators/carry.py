"""Recurrences over block-wise series.

A recurrence such as an exponential average needs the state left by every
earlier bar. Series of one block simply run. For longer ones each block is first
reduced to a few numbers describing what it does to an incoming state, these are
chained along the series, and then every block runs with the state it really
receives. No task holds more than one block of bars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators.runs import ddl, doubles, map_runs, whole_runs
from tidebars.operators.series import BLOCK_ROWS, Panel

Columns = dict[str, np.ndarray]


class Recurrence(Protocol):
    """A state machine that can describe a whole stretch of rows."""

    inputs: Sequence[str]  # columns it reads, besides pos
    state: dict[str, float]  # initial state by name
    summary: Sequence[str]  # numbers describing a stretch
    outputs: Sequence[str]  # columns it adds

    def prepare(self, rows: Columns) -> Columns:
        """Derive columns from a block, its halo included."""

    def summarise(self, rows: Columns) -> Sequence[float]:
        """Describe what a stretch of rows does to a state."""

    def apply(self, state: Sequence[float], summary: Sequence[float]) -> Sequence[float]:
        """State after a described stretch."""

    def run(self, rows: Columns, state: Sequence[float]) -> Sequence[np.ndarray]:
        """Output columns of a stretch entered with ``state``."""


def _cut(rows: Columns, selected: np.ndarray) -> Columns:
    return {name: values[selected] for name, values in rows.items()}


def _blocks_of(machine: Recurrence, pdf: pd.DataFrame, starts, ends) -> Iterator[tuple[int, int, Columns]]:
    columns = {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in machine.inputs}
    columns["pos"] = pdf["pos"].to_numpy()
    for start, end in zip(starts.tolist(), ends.tolist()):
        yield start, end, machine.prepare({c: v[start:end] for c, v in columns.items()})


def _entry_states(
    blocks: DataFrame, panel: Panel, machine: Recurrence, rows: int, lead_in: int
) -> DataFrame:
    """Incoming state of every block: describe blocks in parallel, then chain them per series."""
    keys, series = panel.block_keys, list(panel.keys)
    names = list(machine.state)

    def describe(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        block = pdf["block"].to_numpy()
        found = []
        for start, _, columns in _blocks_of(machine, pdf, starts, ends):
            # rows a block accounts for: up to where the next block's lead-in starts
            first = block[start] * rows - lead_in
            found.append(machine.summarise(_cut(columns, (columns["pos"] >= first) & (columns["pos"] < first + rows))))
        out = pdf.loc[starts, keys].reset_index(drop=True)
        out[list(machine.summary)] = np.asarray(found, dtype=float)
        return out

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf, _, _ in whole_runs(batches, keys):
            entered = []
            heads = pdf[series].itertuples(index=False, name=None)
            for head, summary in zip(heads, pdf[list(machine.summary)].itertuples(index=False, name=None)):
                if head != key:
                    key, state = head, list(machine.state.values())
                entered.append(state)
                state = machine.apply(state, summary)
            out = pdf[keys].copy()
            out[[f"_in_{n}" for n in names]] = np.asarray(entered, dtype=float)
            yield out

    key_ddl = ddl(blocks, keys)
    described = map_runs(
        blocks.select(*keys, "pos", *machine.inputs), keys, ["pos"], describe, f"{key_ddl}, {doubles(machine.summary)}"
    )
    return (
        described.repartition(*series)
        .sortWithinPartitions(*keys)
        .mapInPandas(chain, f"{key_ddl}, {doubles([f'_in_{n}' for n in names])}")
    )


def run_recurrence(
    blocks: DataFrame,
    panel: Panel,
    machine: Recurrence,
    *,
    inputs: Callable[[DataFrame], DataFrame],
    rows: int = BLOCK_ROWS,
    lead_in: int = 0,
) -> DataFrame:
    """Add the recurrence's output columns to the core rows and ``lead_in`` rows before them.

    ``inputs`` adds the columns the machine reads. Earlier halo rows serve warm-ups
    and get no output.
    """
    keys, names = panel.block_keys, list(machine.state)
    entered = [f"_in_{n}" for n in names]
    # only series of several blocks have anything to carry
    several = inputs(blocks.filter(F.col("series_rows") > rows - lead_in))
    states = _entry_states(several, panel, machine, rows, lead_in)
    ready = inputs(blocks)
    kept = ready.columns
    defaults = list(machine.state.values())

    def emit(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        block = pdf["block"].to_numpy()
        incoming = pdf.loc[starts, entered].to_numpy(dtype=float)
        known = pdf["_known"].notna().to_numpy()
        columns = [np.full(len(pdf), np.nan) for _ in machine.outputs]
        for i, (start, end, rows_of) in enumerate(_blocks_of(machine, pdf, starts, ends)):
            live = rows_of["pos"] >= block[start] * rows - lead_in
            state = incoming[i].tolist() if known[start] else defaults
            for column, values in zip(columns, machine.run(_cut(rows_of, live), state), strict=True):
                column[start:end][live] = values
        return pdf[kept].assign(**dict(zip(machine.outputs, columns)))

    joined = ready.join(states.withColumn("_known", F.lit(1)), keys, "left")
    return map_runs(joined, keys, ["pos"], emit, f"{ddl(ready, kept)}, {doubles(machine.outputs)}")
