"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.documents import LOWER, UPPER, ids_and_texts, text_blocks

WIDTH = 5
THRESHOLD = 0.8
MISS = 1e-9  # chance that an item at the threshold shares no minimum with the document
BLOCK_BYTES = 16 << 20
MEMO_WORDS = 400_000
_WORD = re.compile(r"\w+")
_LOWER = str.maketrans(UPPER, LOWER)
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("shingles", pa.int64())])
_U = np.uint64


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str) -> Iterator[list[str]]:
    """Words (runs of letters, digits and underscores; A-Z in lower case) by block of text."""
    for block in text_blocks(text):
        yield _WORD.findall(block.translate(_LOWER))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes; order matters."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    h = np.zeros(n, _U)
    for i in range(width):
        h = (h ^ words[i : i + n]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return h


def _permuted(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th permutation of 64-bit values."""
    x = (h ^ _U((k + 1) * 0xD6E8FEB86659FD93 % 2**64)) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)


@dataclass
class Item:
    item_id: int
    width: int
    shingles: dict[int, set[tuple[str, ...]]]  # by hash


@dataclass
class ItemIndex:
    """MinHash signatures of one block of items, partitioned by shingle count.

    The k-th minimum of an item is one of its shingles, and lies in a document with a
    chance equal to the share of the item the document contains, however long the
    document is. So an item's signature is looked up in the document's own shingles.
    A partition holds the items of 2^c to 2^(c+1) - 1 shingles and draws as many
    minima as keep the chance of a miss under ``MISS``; where that is no fewer than
    the item's shingles the signature is all of them and nothing can be missed.
    """

    items: list[Item]
    widths: list[int]
    keys: np.ndarray  # sorted hashes of all signatures
    owners: list[list[int]]  # places in ``items`` for each key

    @classmethod
    def build(cls, rows: list[tuple[int, str]], width: int, threshold: float) -> ItemIndex:
        hashes, items, owners = WordHashes(), [], defaultdict(set)
        draws = math.ceil(math.log(MISS) / math.log(1 - threshold)) if threshold < 1 else 1
        for item_id, text in rows:
            words = [w for block in words_of(text) for w in block]
            if not words:
                continue
            own = min(width, len(words))
            values = shingle_hashes(np.fromiter(map(hashes.__getitem__, words), _U, len(words)), own)
            shingles = defaultdict(set)
            for i, h in enumerate(values.tolist()):
                shingles[h].add(tuple(words[i : i + own]))
            distinct = np.array(sorted(shingles), _U)
            partition = int(math.log2(len(distinct)))
            minima = distinct if draws >= 1 << partition else {
                int(distinct[_permuted(distinct, k).argmin()]) for k in range(draws)
            }
            for h in map(int, minima):
                owners[h].add(len(items))
            items.append(Item(item_id, own, dict(shingles)))
        keys = sorted(owners)
        return cls(items, sorted({i.width for i in items}), np.array(keys, _U), [sorted(owners[k]) for k in keys])

    def search(self, text: str, hashes: WordHashes, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(item id, shared shingles, shingles) of each item contained in the text."""
        if not self.items:
            return
        candidates: set[int] = set()
        for _, one in self._blocks(text, hashes):
            for width in self.widths:
                h = shingle_hashes(one, width)
                at = np.searchsorted(self.keys, h)
                at[at == len(self.keys)] = 0
                for place in np.unique(at[self.keys[at] == h]).tolist():
                    candidates.update(i for i in self.owners[place] if self.items[i].width == width)
        if not candidates:
            return
        seen: dict[int, set[tuple[str, ...]]] = {i: set() for i in sorted(candidates)}
        for words, one in self._blocks(text, hashes):
            for i, own in seen.items():
                item = self.items[i]
                h = shingle_hashes(one, item.width)
                for p in np.flatnonzero(np.isin(h, np.fromiter(item.shingles, _U, len(item.shingles)))).tolist():
                    if (s := tuple(words[p : p + item.width])) in item.shingles[int(h[p])]:
                        own.add(s)
        for i, own in seen.items():
            total = sum(map(len, self.items[i].shingles.values()))
            if len(own) >= threshold * total - 1e-9:
                yield self.items[i].item_id, len(own), total

    def _blocks(self, text: str, hashes: WordHashes) -> Iterator[tuple[list[str], np.ndarray]]:
        """Words and their hashes by block, the last words of one block before the next."""
        words: list[str] = []
        for block in words_of(text):
            words = words[len(words) - min(len(words), self.widths[-1] - 1) :] + block
            yield words, np.fromiter(map(hashes.__getitem__, words), _U, len(words))


def item_blocks(benchmark: DataFrame, threshold: float, width: int, block_bytes: int) -> Iterator[Broadcast[ItemIndex]]:
    """The distinct items in blocks of about ``block_bytes`` of text by hash, indexed and broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r.item_id, r.text) for r in own.toLocalIterator()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(ItemIndex.build(rows, width, threshold))


def contained_items(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, item_id, shared, shingles, containment`` of each item a document contains.

    Containment is the share of the item's distinct shingles of ``width`` words that
    occur in the document, checked on the words themselves, at least ``threshold``.
    An item of fewer words is one shingle of all its words; items without words, or
    missing ones, never match, nor do missing and empty texts. Each pair of ids comes
    once: of documents or of items that share an id, each is judged by itself and the
    largest containment is given.

    The items are the query set. They are broadcast in blocks of about ``block_bytes``
    of text by id hash, and each block meets every document in one pass without a
    shuffle; a benchmark of usual size is one block. Extra columns are ignored.
    """
    texts, parts = ids_and_texts(docs), []
    for index in item_blocks(benchmark, threshold, width, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    best: dict[int, tuple[int, int]] = {}
                    for item_id, shared, total in index.value.search(text, hashes, threshold):
                        if item_id not in best or shared * best[item_id][1] > best[item_id][0] * total:
                            best[item_id] = shared, total
                    found += [(doc_id, item_id, *counts) for item_id, counts in best.items()]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

        parts.append(texts.mapInArrow(scan, "doc_id long, item_id long, shared long, shingles long"))
    found = reduce(DataFrame.union, parts)
    best = F.max(F.struct((F.col("shared") / F.col("shingles")).alias("containment"), "shingles", "shared")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.shared", "best.shingles", "best.containment")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no benchmark item; no shuffle."""
    for index in item_blocks(benchmark, threshold, width, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                found = [any(index.value.search(t or "", hashes, threshold)) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
