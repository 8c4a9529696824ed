"""Look-ahead audit: does a signal change once later bars are known?"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.config import as_utc
from tidebars.operators.series import SERIES
from tidebars.operators.signals import compute_signals

Compute = Callable[[DataFrame], DataFrame]


def look_ahead_violations(bars: DataFrame, compute: Compute, cutoffs: Sequence, *, name: str = "custom") -> DataFrame:
    """Bars whose signal differs between a study ending at a cut-off and the full study.

    Empty for a system that uses closed bars only.
    """
    keys = [*SERIES, "date"]
    pick = lambda df, side: df.select(
        *keys, F.col("long_signal").alias(f"long_{side}"), F.col("short_signal").alias(f"short_{side}")
    )
    full = pick(compute(bars), "full")
    found = []
    for cutoff in cutoffs:
        known = F.col("date") <= F.lit(as_utc(cutoff))
        then = pick(compute(bars.filter(known)), "then")
        differs = ~F.col("long_full").eqNullSafe(F.col("long_then")) | ~F.col("short_full").eqNullSafe(
            F.col("short_then")
        )
        found.append(
            full.filter(known)
            .join(then, keys, "full_outer")
            .filter(differs)
            .select(F.lit(name).alias("system"), F.lit(as_utc(cutoff)).alias("cutoff"), *keys,
                    "long_full", "long_then", "short_full", "short_then")
        )
    return reduce(DataFrame.unionByName, found)


def system_violations(bars: DataFrame, system: str, cutoffs: Sequence, **parameters) -> DataFrame:
    return look_ahead_violations(bars, lambda b: compute_signals(b, system, **parameters), cutoffs, name=system)
