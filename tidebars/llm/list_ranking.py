"""Places of the items of a linked list, without walking it in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.session import stage

IN_ONE_TASK = 1 << 14


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    items = {int(r.id): r for r in pd.concat(batches).itertuples()}
    ids, ranks, rank = [], [], 0
    at = next((i for i, r in items.items() if pd.isna(r.prev)), None)
    while at is not None:
        ids.append(at)
        ranks.append(rank)
        rank += int(items[at].w)
        at = None if pd.isna(items[at].next) else int(items[at].next)
    if len(ids) != len(items):
        raise ValueError("the items are not one list")
    yield pd.DataFrame({"id": ids, "rank": ranks}, dtype="int64")


def list_ranks(items: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``id, rank`` of ``id, prev, next`` (longs; missing at the ends): places from 0.

    Each round takes out the items whose random number is below those of both
    neighbours, about a third and never two in a row, and joins their neighbours by a
    link that knows how many items it spans; a round is one aggregation by id. When
    ``in_one_task`` are left they are walked, and the items taken out get their places
    from their next one, round by round backwards. All rounds together move three times
    the items. A list in several pieces or with a ring raises an error.
    """
    now, gone, n = stage(items.withColumn("w", F.lit(1).cast("long"))), [], items.count()
    while n > in_one_task:
        draw = lambda c: F.xxhash64(F.lit(len(gone)), c)  # noqa: E731, B023
        out = (draw("id") < draw("prev")) & (draw("id") < draw("next")) & F.col("prev").isNotNull() & F.col("next").isNotNull()
        marked = stage(now.withColumn("out", out))
        taken, left = marked.filter("out"), marked.filter("NOT out")
        none = F.lit(None).cast("long")
        messages = taken.select(F.col("prev").alias("id"), none.alias("prev"), none.alias("next"), "w", none.alias("new_prev"), F.col("next").alias("new_next")).unionAll(
            taken.select(F.col("next").alias("id"), none, none, none, F.col("prev"), none)
        )
        both = left.select("id", "prev", "next", "w", none.alias("new_prev"), none.alias("new_next")).unionAll(messages)
        largest = [F.max(c).alias(c) for c in ("prev", "next", "new_prev", "new_next")]
        joined = both.groupBy("id").agg(*largest, F.sum("w").alias("w"))
        now = stage(joined.select("id", F.coalesce("new_prev", "prev").alias("prev"), F.coalesce("new_next", "next").alias("next"), "w"))
        gone.append(taken.select("id", "next", "w"))
        n = now.count()
    ranks = stage(now.coalesce(1).mapInPandas(_walked, "id long, rank long")) if n else now.selectExpr("id", "w AS rank")
    for taken in reversed(gone):
        after = taken.join(ranks.select(F.col("id").alias("next"), "rank"), "next")
        ranks = stage(ranks.unionAll(after.select("id", (F.col("rank") - F.col("w")).alias("rank"))))
    return ranks
