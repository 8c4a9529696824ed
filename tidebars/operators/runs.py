"""Arrow kernels over sorted runs of rows with equal keys.

Rows are hash-partitioned by key and sorted by Spark; a kernel then sees batches
holding many whole runs at once, so thousands of short series cost no more than a
few long ones, and no task holds more than one batch plus one run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Kernel = Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]


def ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in names)


def doubles(names: Sequence[str]) -> str:
    return ", ".join(f"`{name}` double" for name in names)


def run_starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    changed = np.zeros(len(pdf), dtype=bool)
    changed[0] = True
    for key in keys:
        column = pdf[key].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changed)


def whole_runs(
    batches: Iterator[pd.DataFrame], keys: Sequence[str]
) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Regroup sorted batches so that no run is cut; yields rows, run starts and run ends."""
    held: list[pd.DataFrame] = []

    def release() -> pd.DataFrame:
        return held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)

    for pdf in batches:
        if not len(pdf):
            continue
        cuts = run_starts(pdf, keys)
        joins = bool(held) and all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys)
        if joins and len(cuts) == 1:
            held.append(pdf)  # the open run goes on through this whole batch
            continue
        held.append(pdf.iloc[: cuts[-1]])
        done = release()
        if len(done):
            done = done.reset_index(drop=True)
            starts = run_starts(done, keys)
            yield done, starts, np.append(starts[1:], len(done))
        held = [pdf.iloc[cuts[-1] :]]
    if held:
        done = release().reset_index(drop=True)
        yield done, np.array([0]), np.array([len(done)])


def map_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: Kernel, schema: str) -> DataFrame:
    """Apply ``kernel(rows, starts, ends)`` to batches of whole runs sorted by ``order``."""
    keys = list(keys)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, ends in whole_runs(batches, keys):
            yield kernel(rows, starts, ends)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(over, schema)
