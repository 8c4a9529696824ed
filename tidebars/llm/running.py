"""Running totals over a distributed sort, and folding of small states over a tree."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.session import stage

FAN = 8  # states that meet in one task of a fold
STATE = "id long, state binary"


def _local(batches: Iterator[pa.RecordBatch], key: str, sums: list[str], xors: list[str]) -> Iterator[pa.RecordBatch]:
    """Totals since the key began in this range; the last row of the range is marked."""
    ops = [(c, np.add) for c in sums] + [(c, np.bitwise_xor) for c in xors]
    first = last_key = None
    carry = dict.fromkeys(sums + xors, 0)

    def finished(batch: pa.RecordBatch, totals: list[np.ndarray], last: bool) -> pa.RecordBatch:
        mark = np.zeros(batch.num_rows, bool)
        mark[-1] = last
        more = [pa.array(t) for t in totals] + [pa.array(np.full(batch.num_rows, first)), pa.array(mark)]
        names = [f"{c}_sum" for c, _ in ops] + ["first_key", "last"]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            yield finished(*held, False)
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        if first is None:
            first = keys[0]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts, segment = np.flatnonzero(new), np.cumsum(new) - 1
        totals = []
        for c, op in ops:
            v = batch.column(batch.schema.get_field_index(c)).to_numpy()
            run = op.accumulate(v)
            before = (run[starts] - v[starts] if op is np.add else run[starts] ^ v[starts])[segment]
            run = run - before if op is np.add else run ^ before
            if keys[0] == last_key:
                open_ = segment == 0
                run[open_] = op(run[open_], carry[c])
            carry[c] = run[-1]
            totals.append(run)
        last_key = keys[-1]
        held = batch, totals
    if held:
        yield finished(*held, True)


def running_totals(rows: DataFrame, key: str, order: list[str], sums: list[str] = [], xors: list[str] = []) -> DataFrame:  # noqa: B006
    """``rows`` with ``<c>_sum`` for each long column c of ``sums`` (added) and ``xors`` (joined
    by exclusive or): the total over the rows of the same ``key`` (long, not missing) up to
    and with this one in ``order``.

    Rows are dealt by ranges of (key, order), so a key that holds a third of all rows is
    spread over tasks; rows that agree in all of these are interchangeable and may be
    spread too. Each range runs its own totals; what is open at its end is one small
    row, and these rows (one a shuffle partition) are chained. ``rows`` is read twice.
    """
    by = [key, *order]
    ranged = rows.withColumn("tie", F.rand(7)).repartitionByRange(*by, "tie").sortWithinPartitions(*by, "tie")
    ranged = ranged.select(*rows.columns, F.spark_partition_id().cast("long").alias("range_no"))
    totals = [f"{c}_sum" for c in sums + xors]
    extra = [T.StructField(c, T.LongType()) for c in [*totals, "first_key"]] + [T.StructField("last", T.BooleanType())]
    schema = T.StructType([*ranged.schema.fields, *extra])
    local = stage(ranged.mapInArrow(lambda it: _local(it, key, sums, xors), schema))
    carried, open_key, total = [], None, [0] * len(totals)
    ends = local.filter("last").select("range_no", "first_key", F.col(key).alias("end_key"), *totals)
    for r in sorted(ends.collect()):  # one row a shuffle partition, whatever the table's size
        into = total if r.first_key == open_key else [0] * len(totals)
        carried.append((r.range_no, *into))
        chained = [a + b if i < len(sums) else a ^ b for i, (a, b) in enumerate(zip(into, r[3:], strict=True))]
        open_key, total = r.end_key, chained if r.first_key == r.end_key else list(r[3:])
    fields = [T.StructField("range_no", T.LongType())] + [T.StructField(f"{t}_before", T.LongType()) for t in totals]
    before = rows.sparkSession.createDataFrame(carried, T.StructType(fields))
    joined = local.join(F.broadcast(before), "range_no")

    def whole(i: int, t: str):
        add = F.when(F.col(key) == F.col("first_key"), F.col(f"{t}_before")).otherwise(0)
        return (F.col(t) + add if i < len(sums) else F.col(t).bitwiseXOR(add)).alias(t)

    return joined.select(*rows.columns, *[whole(i, t) for i, t in enumerate(totals)])


def fold_states(states: DataFrame, join: Callable[[list[Any]], Any]) -> Any:
    """One state out of the pickled ``states`` (``id, state``; one row a task, ids gapless
    or not), joined ``FAN`` at a time up a tree; ``None`` if there is none. Only the last
    one reaches the driver."""
    states = stage(states)
    width = states.agg(F.max("id")).first()[0]

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        found = [pickle.loads(s) for s in group.sort_values("id")["state"]]
        return pd.DataFrame({"id": [group["to"].iloc[0]], "state": [pickle.dumps(join(found))]})

    width = 0 if width is None else width + 1
    while width > 1:
        width = -(-width // FAN)
        states = states.withColumn("to", F.col("id") % width).groupBy("to").applyInPandas(joined, STATE)
    row = states.select("state").first()
    return pickle.loads(row.state) if row else None


def one_state(task_id: int, state: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task_id]), pa.array([pickle.dumps(state)], pa.binary())], names=["id", "state"])
