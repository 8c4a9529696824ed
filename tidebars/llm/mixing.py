"""Mixing sources to target weights: blocks of words drawn by permuted indices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.documents import text_blocks
from tidebars.llm.phrases import split_words
from tidebars.llm.running import running_totals
from tidebars.llm.sharding import Permutation, row_numbers
from tidebars.session import stage

BLOCK_WORDS = 128
SHARDS = 16
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = 42
CHUNK = 1 << 16  # slots that one row of the plan stands for at most


@dataclass
class Mixture:
    """What ``mix_sources`` decided.

    ``documents``: ``doc_id, size, source_rank, row_no, offset`` (first word's place among
    the words of its source); ``sources``: ``source_rank, source, source_size, target,
    blocks, draws``; ``slots``: ``source_rank, shard, slot, epoch, block``, one row for each
    block of the mixture.
    """

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source_rank, source, source_size, target`` from ``source, size`` of all documents.

    Sources are ranked by code point, the missing one last, and take the weights in turn.
    Together they share all words; no target exceeds ``most`` times its source, and what
    is over goes to the others by weight until none is above. Only sums reach the driver.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("missing", F.col("source").isNull())
    ranked, _ = row_numbers(stage(summed), ["missing", "source"])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumnRenamed("row_number", "source_rank").drop("missing")
    ranked = stage(ranked.withColumn("weight", F.get(cycle, (F.col("source_rank") % len(weights)).cast("int"))))
    top = most * F.col("source_size")
    total, share, below = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = top <= share * F.col("weight")
        full = F.sum(F.when(over, top).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count(F.when(over, 1))
        capped, weight, n = ranked.agg(*full).first()
        if n == below or not weight:
            break
        below, share = n, (total - capped) / weight
    target = F.when(top <= share * F.col("weight"), top.cast("double")).otherwise(share * F.col("weight"))
    return ranked.select("source_rank", "source", "source_size", target.alias("target"))


def _dealt(batches: Iterator[pd.DataFrame], slots: int, shards: int, seed: int) -> Iterator[pd.DataFrame]:
    """Slots of each source in each shard: multinomial counts in proportion to the slots
    that are still free, so that every shard comes out full and every source drawn whole."""
    free = np.array([slots // shards + (k < slots % shards) for k in range(shards)], np.int64)
    for batch in batches:
        for rank, draws in zip(batch["source_rank"], batch["draws"], strict=True):
            random, counts, left = np.random.default_rng([seed, int(rank)]), np.zeros(shards, np.int64), int(draws)
            while left:
                room = free - counts
                more = np.minimum(random.multinomial(left, room / room.sum()), room)
                counts += more
                left -= int(more.sum())
            free -= counts
            first = np.cumsum(counts) - counts
            yield pd.DataFrame({"source_rank": rank, "shard": np.arange(shards), "first": first, "count": counts})


def _drawn(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Epoch and block of each slot: places of an epoch mapped through its permutation."""
    for batch in batches:
        for r in batch.itertuples():
            slot = np.arange(r.first, r.first + r.count)
            epoch, block = slot // r.blocks, slot % r.blocks
            for e in np.unique(epoch):
                order = Permutation(r.blocks, int(np.random.SeedSequence([seed, r.source_rank, int(e)]).generate_state(1)[0]))
                block[epoch == e] = order.position(block[epoch == e])
            yield pd.DataFrame({"source_rank": r.source_rank, "shard": r.shard, "slot": slot, "epoch": epoch, "block": block})


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shards: int = SHARDS,
    most: int = MOST_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mixture:
    """The plan of a mixture of all documents in ``shards`` output shards.

    The words of a source, its documents in order of id, are packed into blocks of
    ``block_words``. Each shard's slots are shared among sources by multinomial draws. The
    j-th slot of a source holds the block at place j of its permuted index, a new
    permutation for each pass over the source, ``most`` passes at most; so of a document
    no word is drawn more often. A source's blocks are drawn as often as its target says,
    to the nearest block.

    Missing ids come first; repeated rows and ids are packed one after another. Documents
    without words (missing texts too) take no place. Tables without words give no slots.
    A hot source is spread by ranges of (source, id).
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sized = stage(docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("size"), F.xxhash64(text).alias("print"),
    ))
    blocks = F.ceil(F.col("source_size") / block_words)
    draws = F.when(F.col("target") >= most * F.col("source_size"), most * blocks).otherwise(F.least(F.round(F.col("target") / block_words).cast("long"), most * blocks))
    sources = stage(source_targets(sized, weights, most).withColumns({"blocks": blocks, "draws": draws}))
    ranked = sized.join(sources.select(F.col("source").alias("name"), "source_rank"), F.col("source").eqNullSafe(F.col("name")))
    # row_no is a running count over all rows, offset a running sum in each source
    placed = running_totals(stage(ranked.select("doc_id", "size", "print", "source_rank").withColumn("row", F.monotonically_increasing_id())), "source_rank", ["doc_id", "print", "size"], ["size"])
    placed = placed.select("doc_id", "size", "print", "source_rank", F.col("row").alias("row_no"), (F.col("size_sum") - F.col("size")).alias("offset"))
    slots = sources.agg(F.sum("draws")).first()[0] or 0
    # one row a source, streamed by one task that holds a number for each shard
    counts = sources.select("source_rank", "draws").coalesce(1).sortWithinPartitions("source_rank")
    dealt = stage(counts.mapInPandas(lambda it: _dealt(it, slots, shards, seed), "source_rank long, shard int, first long, count long"))
    chunked = dealt.filter("count > 0").withColumn("at", F.explode(F.expr(f"sequence(0L, count - 1, {CHUNK}L)")))
    chunked = chunked.select("source_rank", "shard", (F.col("first") + F.col("at")).alias("first"), F.least(F.lit(CHUNK), F.col("count") - F.col("at")).alias("count"))
    chunked = chunked.join(sources.select("source_rank", "blocks"), "source_rank").repartition("source_rank", "shard", "first")
    drawn = chunked.mapInPandas(lambda it: _drawn(it, seed), "source_rank long, shard int, slot long, epoch long, block long")
    return Mixture(placed, sources, drawn)


def taken_words(mixture: Mixture, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document: words the mixture
    takes of it, repeats counted. A document's parts in its blocks are joined with the
    times each block was drawn."""
    docs = stage(mixture.documents)
    end = F.col("offset") + F.col("size")
    spans = F.expr(f"sequence(offset div {block_words}, (offset + size - 1) div {block_words})")
    parts = docs.filter("size > 0").select("row_no", "source_rank", "offset", end.alias("end"), F.explode(spans).alias("block"))
    first, last = F.col("block") * block_words, (F.col("block") + 1) * block_words
    parts = parts.select("row_no", "source_rank", "block", (F.least("end", last) - F.greatest("offset", first)).alias("words"))
    times = mixture.slots.groupBy("source_rank", "block").agg(F.count("*").alias("times"))
    taken = parts.join(times, ["source_rank", "block"]).groupBy("row_no").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = docs.join(taken, "row_no", "left").join(mixture.sources.select("source_rank", "source_size", "target"), "source_rank")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _parts(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    """Words of each document cut at the borders of its source's blocks."""
    for batch in batches:
        rows = []
        for text, rank, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = [w.decode() for piece in text_blocks(text) for w in split_words(piece)]
            cuts = [0, *range(block_words - offset % block_words, len(words), block_words), len(words)]
            rows += [(rank, (offset + a) // block_words, offset + a, " ".join(words[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source_rank", "block", "at", "part"])


def mixed_texts(docs: DataFrame, mixture: Mixture, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard, source_rank, slot, epoch, block, text``: the mixture itself, one row a slot,
    the words of its block joined by single spaces."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("p")).dropDuplicates(["id", "p"])
    placed = mixture.documents.filter("size > 0").select("doc_id", "print", "source_rank", "offset")
    found = placed.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("print") == F.col("p"))).select("text", "source_rank", "offset")
    parts = found.mapInArrow(lambda it: _parts(it, block_words), "source_rank long, block long, at long, part string")
    whole = parts.groupBy("source_rank", "block").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))  # block_words parts at most
    return mixture.slots.join(whole, ["source_rank", "block"]).select(
        "shard", "source_rank", "slot", "epoch", "block", F.array_join(F.col("parts.part"), " ").alias("text")
    )
