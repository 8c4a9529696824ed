"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.documents import ids_and_texts
from tidebars.session import stage

ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit finaliser; wraps on overflow."""
    x = x ^ _U(key & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Permutation:
    """A bijection of 0..n-1 fixed by ``seed``, computable in both directions.

    The network works on pairs (left, right) below side = ceil(sqrt(n)), which covers
    side * side numbers; a value that lands at n or beyond walks on along its cycle
    until it is below n. At most about 2 * sqrt(n) numbers lie beyond, so a step of
    walking is rare and the walk always ends.
    """

    def __init__(self, n: int, seed: int = 0) -> None:
        self.n, self.side = n, max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.keys = [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=_U) + _U(seed % 2**32 << 8), 0x9E3779B97F4A7C15)]

    def _forward(self, x: np.ndarray) -> np.ndarray:
        side = _U(self.side)
        left, right = x // side, x % side
        for key in self.keys:
            left, right = right, (left + _mix(right, key) % side) % side
        return left * side + right

    def _backward(self, x: np.ndarray) -> np.ndarray:
        side = _U(self.side)
        left, right = x // side, x % side
        for key in reversed(self.keys):
            left, right = (right + side - _mix(left, key) % side) % side, left
        return left * side + right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, dtype=_U))
        while (out := x >= _U(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def position(self, rows: np.ndarray) -> np.ndarray:
        """Place in the shuffled order of each row number."""
        return self._walk(rows, self._forward)

    def row(self, positions: np.ndarray) -> np.ndarray:
        """Row number at each place; the inverse of ``position``."""
        return self._walk(positions, self._backward)


def row_numbers(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``row_number`` from 0 in the given order, and their count.

    Rows are dealt by ranges of the order and numbered inside each range; ranges get
    their offsets from one small row per range. A random last key lets many rows that
    agree in all of ``order`` be dealt to several ranges.
    """
    ranged = rows.withColumn("tie", F.rand(7)).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    numbered = stage(
        ranged.select(
            *rows.columns,
            F.spark_partition_id().alias("range_no"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("in_range"),
        )
    )
    counts = numbered.groupBy("range_no").agg(F.count("*").alias("rows"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range_no", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    # one row per shuffle partition: bounded by the partition count, whatever the table's size
    joined = numbered.join(F.broadcast(offsets), "range_no")
    return joined.select(*rows.columns, (F.col("offset") + F.col("in_range")).alias("row_number")), total


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Law ``rows``: counts of any two shards differ by one at most. The row number in
    order of (doc_id, checksum, size) is permuted; the place gives shard (remainder)
    and slot (quotient), so both can be computed from the row number, and ``Permutation.row``
    leads back. ``grown_shard`` is missing, as this law moves rows between all shards.

    ``size`` is the text's UTF-8 bytes plus one; a missing text has none. Missing ids
    come first in the order. Repeated rows get places of their own. An empty table
    gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    sized = ids_and_texts(docs).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    )
    numbered, total = row_numbers(sized, ["doc_id", "text_crc32", "size"])
    order = Permutation(total, seed)

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(order.position(rows.to_numpy()))

    position = F.pandas_udf(place, "long")(F.col("row_number"))
    return numbered.withColumn("position", position).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
