"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distances."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.components import components
from tidebars.llm.documents import LOWER, UPPER, ids_and_texts, text_blocks
from tidebars.session import stage

SHINGLE_WORDS = 3
DISTANCE = 3
SEED = 42
BLOCKS, AGREEING = 6, 3  # of 6 runs of the 64 bits, fingerprints within 3 bits agree in 3 at least
BUCKET = 20_000  # distinct fingerprints compared in one task at once
REST_BITS = 12  # a bucket that agrees in all but so many bits has 2^12 fingerprints at most
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_LOWER = str.maketrans(UPPER, LOWER)
_U = np.uint64


class _Votes:
    """How many shingle hashes have each bit set."""

    def __init__(self) -> None:
        self.set_bits, self.n = np.zeros(64, np.int64), 0

    def add(self, hashes: list[int]) -> None:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.set_bits += bits.sum(0, dtype=np.int64)
        self.n += len(hashes)

    def fingerprint(self) -> int:
        return sum(1 << i for i in np.flatnonzero(self.set_bits * 2 > self.n).tolist())


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the XXH64 values of the text's word shingles."""
    votes, words, any_shingle = _Votes(), [], False
    for block in text_blocks(text):
        words += _WORD.findall(block.translate(_LOWER))
        if len(words) >= width:
            columns = (words[i:] for i in range(width))
            votes.add([xxhash.xxh64_intdigest(" ".join(s), SEED) for s in zip(*columns, strict=False)])
            words, any_shingle = words[len(words) - width + 1 :], True
    if not any_shingle and words:
        votes.add([xxhash.xxh64_intdigest(" ".join(words), SEED)])
    return votes.fingerprint()


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id`` and ``print`` (the 64 bits as a signed long) of every row's whole text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])

    return ids_and_texts(docs).mapInArrow(sign, "doc_id long, print long")


def _masks(bits: list[int], blocks: int, agreeing: int) -> list[int]:
    """For each choice of ``agreeing`` of ``blocks`` runs of the given bits, their mask."""
    runs = [int(sum(1 << int(b) for b in run)) for run in np.array_split(bits, blocks)]
    return [sum(choice) for choice in combinations(runs, agreeing)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _near(prints: np.ndarray, nodes: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within one bucket, each link verified."""
    label = np.arange(len(prints))
    for i in range(1, len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= distance)
        if len(near):
            groups, first = np.unique(label[near], return_index=True)
            for group, j in zip(groups.tolist(), near[first].tolist(), strict=True):
                yield int(nodes[i]), int(nodes[j])
                label[:i][label[:i] == group] = i


def _near_in_runs(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """``_near`` of each run of rows of one (table, key); buckets are bounded, and so is what is held."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
        found = []
        for start, end in zip([0, *ends.tolist()], [*ends.tolist(), rows.shape[1]], strict=True):
            found += _near(rows[2, start:end].view(_U), rows[3, start:end], distance)
        columns = list(zip(*found, strict=True)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if not rows.shape[1]:
            continue
        rows = np.concatenate([*held, rows], axis=1)
        open_from = int(np.flatnonzero((rows[:2] != rows[:2, -1:]).any(0)).max(initial=-1)) + 1
        if open_from:
            yield links(np.ascontiguousarray(rows[:, :open_from]))
        held = [rows[:, open_from:]]
    if held:
        yield links(np.ascontiguousarray(held[0]))


def _bucket_links(keyed: DataFrame, distance: int, bucket: int) -> list[DataFrame]:
    """Links between rows (``table, key, print, node``) that agree in table and key; last, rows left over.

    A bucket of two is one comparison; a bucket whose prints differ in no more than
    ``distance`` bits altogether is one star; both come out of one aggregation with
    map-side combining. Others meet in one task if they are no more than ``bucket``. The
    rows of larger ones are left to be cut again: of the bits they may differ in, one of
    distance + 1 runs agrees for any linked pair. What may differ shrinks each time, so
    buckets end with a bounded number of distinct fingerprints.
    """
    pair = F.struct("print", "node")
    stats = keyed.groupBy("table", "key").agg(
        F.count("*").alias("n"), F.min(pair).alias("low"), F.max(pair).alias("high"),
        F.bit_or("print").alias("any_bit"), F.bit_and("print").alias("all_bits"),
    )
    shared = stage(stats.filter("n > 1"))
    spread = F.bit_count(F.col("any_bit").bitwiseXOR(F.col("all_bits")))
    two = shared.filter(F.col("n") == 2).filter(F.bit_count(F.col("low.print").bitwiseXOR(F.col("high.print"))) <= distance)
    links = [two.select(F.col("low.node").alias("a"), F.col("high.node").alias("b"))]
    more = shared.filter("n > 2").select("table", "key", "n", F.col("low.node").alias("low"), (spread <= distance).alias("tight"))
    members = stage(keyed.join(more, ["table", "key"]))
    links.append(members.filter("tight").select(F.col("node").alias("a"), F.col("low").alias("b")))
    loose = members.filter("not tight")
    few = loose.filter(F.col("n") <= bucket).select("table", "key", "print", "node")
    links.append(
        few.repartition("table", "key")
        .sortWithinPartitions("table", "key")
        .mapInArrow(lambda batches: _near_in_runs(batches, distance), "a long, b long")
    )
    return [*links, loose.filter(F.col("n") > bucket).select("table", "key", "print", "node")]


def near_links(
    prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, agreeing: int = AGREEING, bucket: int = BUCKET
) -> DataFrame:
    """Links ``a, b`` that join the distinct fingerprints (``print, node``) within ``distance`` bits.

    Every choice of ``agreeing`` of ``blocks`` runs of bits is a table, in which prints
    meet that agree in those runs. All pairs of at most blocks - agreeing bits meet, so
    that must be no less than ``distance``. The links are a subset of those pairs that
    leaves every component whole: a group of many near copies gives no more links than
    rows in a table.
    """
    if not 0 < agreeing <= blocks - distance:
        raise ValueError(f"of {blocks} runs, pairs of {distance} bits agree in {max(blocks - distance, 0)} only, not in {agreeing}")
    masks = _masks(list(range(64)), blocks, agreeing)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)]))
    keyed = prints.select("print", "node", table.alias("t")).select(
        "print", "node", F.col("t.table").alias("table"), F.col("t.mask").bitwiseAND(F.col("print")).alias("key")
    )
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    *links, large = _bucket_links(keyed, distance, bucket)
    while tables := sorted(r.table for r in large.select("table").distinct().collect()):
        # cut the free bits of each table that has large buckets; a sub-bucket agrees in one run more
        choices, left = [], []
        for i in tables:
            own = []
            for run in np.array_split(free[i], distance + 1):
                own.append(F.struct(F.lit(len(left)).alias("table"), F.lit(_signed(sum(1 << int(b) for b in run))).alias("mask")))
                left.append([b for b in free[i] if b not in set(run.tolist())])
            choices += [F.lit(i), F.array(*own)]
        again = large.select("print", "node", "key", F.explode(F.try_element_at(F.create_map(*choices), F.col("table"))).alias("t"))
        keyed = again.select(
            "print", "node", F.col("t.table").alias("table"),
            F.col("key").bitwiseOR(F.col("t.mask").bitwiseAND(F.col("print"))).alias("key"),
        )
        free = left
        last = max(map(len, free)) <= REST_BITS
        *more, large = _bucket_links(keyed, distance, 1 << REST_BITS if last else bucket)
        links += more
    return reduce(DataFrame.unionAll, links)


def alike_rows(docs: DataFrame, width: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a, b`` of rows (``doc_id``, which differ) whose fingerprints are linked as in
    ``near_duplicates``; they leave every component whole.

    A row is paired with the least one of its fingerprint, and the least rows of
    linked fingerprints with each other.
    """
    signed = stage(fingerprints(docs, width))
    nodes = stage(signed.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    same = signed.join(nodes.filter("n > 1"), "print").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    near = near_links(nodes.select("print", "node"), distance)
    return stage(same.unionAll(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE_WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, agreeing: int = AGREEING
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Rows are linked if their fingerprints differ in ``distance`` bits or fewer;
    ``component_id`` is the smallest identifier reachable over links, the row's own
    included. A text of fewer than ``width`` words is one shingle of them all; one
    without words, or missing, has fingerprint zero and is linked like any other. A
    missing identifier is never the smallest: rows that reach nothing else have a
    missing component. Repeated rows share their fingerprint and so their component.
    An empty table gives no rows; extra columns are ignored.

    Equal fingerprints are one node, whatever their number, so copies are never
    compared. Texts are not shuffled.
    """
    signed = stage(fingerprints(docs, width))
    nodes = stage(signed.groupBy("print").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("print")))
    roots = components(near_links(nodes.select("print", "node"), distance, blocks, agreeing))
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.select("print", "root").join(named, "root").select("print", "component_id")
    text = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return signed.join(classes, "print").select("doc_id", text.alias("fingerprint"), "component_id")
