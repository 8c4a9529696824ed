"""Finding an earlier run that answers a request exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.config import RunRequest, as_utc

# Manifest field -> value standing in for a missing one.
_MISSING = {
    "pair_count": -1,
    "pair_offset": 0,
    "fee_per_side": -1.0,
    "post_backtest_slippage_bps_round_trip": -1.0,
}
MATCH_FIELDS = (
    "strategy",
    "strategy_sha256",
    "timeframe",
    "timeframe_detail",
    "start_inclusive",
    "end_exclusive",
    *_MISSING,
)


def requests_table(spark, requests: Sequence[tuple[RunRequest, Sequence[str]]]) -> DataFrame:
    """Requests and their ordered pairs as rows, numbered in ``request``."""
    rows = [
        (
            i,
            r.strategy,
            r.strategy_sha256,
            r.timeframe,
            r.timeframe_detail,
            as_utc(r.start).isoformat(),
            as_utc(r.end).isoformat(),
            len(pairs),
            r.pair_offset,
            float(r.fee_per_side),
            float(r.slippage_bps_round_trip),
            list(pairs),
        )
        for i, (r, pairs) in enumerate(requests)
    ]
    types = "string, string, string, string, string, string, int, int, double, double".split(", ")
    fields = ", ".join(f"{name} {kind}" for name, kind in zip(MATCH_FIELDS, types))
    return spark.createDataFrame(rows, f"request int, {fields}, pairs array<string>")


def reusable_runs(requests: DataFrame, manifests: DataFrame, pair_lists: DataFrame, archives: DataFrame) -> DataFrame:
    """Per request, the first run folder that matches every field and the pair list.

    The run must still hold a result archive (``archives``: ``run_dir`` of each).
    Comparison treats two missing values as equal.
    """
    stored = manifests.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in _MISSING.items()})
    stored = stored.join(pair_lists, "run_dir").join(archives.select("run_dir"), "run_dir", "left_semi")
    a, b = requests.alias("a"), stored.alias("b")
    same = None
    for field in (*MATCH_FIELDS, "pairs"):
        equal = F.col(f"a.{field}").eqNullSafe(F.col(f"b.{field}"))
        same = equal if same is None else same & equal
    return a.join(b, same).groupBy("a.request").agg(F.min("b.run_dir").alias("run_dir"))
