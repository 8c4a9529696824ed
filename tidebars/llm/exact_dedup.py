"""Exact deduplication with Patricia-trie owners."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.documents import ids_and_texts

MEMORY_BYTES = 32 << 20
_SCHEMA = "n_bytes long, content_hash long, content binary, owner long"
_ARROW = pa.schema(
    [("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("content", pa.binary()), ("owner", pa.int64())]
)


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    __slots__ = ("children", "label", "owner", "terminal")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.terminal, self.owner = label, {}, False, None

    def own(self, owner: int | None) -> None:
        self.terminal = True
        if owner is not None and (self.owner is None or owner > self.owner):
            self.owner = owner


class PatriciaTrie:
    """Compressed radix tries of byte strings, one subtree per (length, content hash).

    Every edge carries a run of bytes; a terminal node keeps the largest identifier
    of the strings that end there. ``spill`` gives back whole subtrees, oldest first,
    so that what is held stays under a bound.
    """

    def __init__(self) -> None:
        self.subtrees: dict[tuple[int, int], _Node] = {}
        self.held = 0

    def insert(self, key: tuple[int, int], content: bytes, owner: int | None) -> None:
        node = self.subtrees.get(key)
        if node is None:
            node = self.subtrees[key] = _Node(b"")
        rest = content
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                child = node.children[rest[0]] = _Node(rest)
                self.held += len(rest) + 200
                child.own(owner)
                return
            n = len(child.label) if rest.startswith(child.label) else shared_prefix(child.label, rest)
            if n < len(child.label):
                fork = _Node(child.label[:n])
                self.held += 200
                child.label = child.label[n:]
                fork.children[child.label[0]] = child
                node.children[rest[0]] = child = fork
            rest, node = rest[n:], child
        node.own(owner)

    def spill(self, down_to: int | None = None) -> Iterator[tuple[int, int, bytes, int | None]]:
        """Terminals of the oldest subtrees, until no more than ``down_to`` bytes are held; or of all."""
        while self.subtrees and (down_to is None or self.held > down_to):
            key = next(iter(self.subtrees))
            stack = [(b"", self.subtrees.pop(key))]
            while stack:
                above, node = stack.pop()
                content = above + node.label
                if node.label:
                    self.held -= len(node.label) + 200
                if node.terminal:
                    yield *key, content, node.owner
                stack += [(content, child) for child in node.children.values()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _emit(rows: Iterator[tuple], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[2]) + 64
        if size > limit:
            yield _batch(kept)
            kept, size = [], 0
    if kept:
        yield _batch(kept)


def _combine(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    """Texts of one input task through a trie: equal ones leave as one row per spill."""
    trie = PatriciaTrie()
    for batch in batches:
        for owner, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = text.as_buffer().to_pybytes()
            trie.insert((len(content), xxhash.xxh64_intdigest(content) - (1 << 63)), content, owner)
        if trie.held > memory:
            yield from _emit(trie.spill(memory // 2))
    yield from _emit(trie.spill())


def _own(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole (length, hash) keys: a subtree is complete when the next key comes."""
    trie, last = PatriciaTrie(), None
    for batch in batches:
        sizes, hashes, owners = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for n, h, content, owner in zip(sizes, hashes, batch.column(2), owners, strict=True):
            if (n, h) != last and trie.held > memory:
                yield from _emit(trie.spill())
            last = (n, h)
            trie.insert(last, content.as_buffer().to_pybytes(), owner)
    yield from _emit(trie.spill())


def text_owners(docs: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """``n_bytes``, ``text_sha256`` and ``owner`` (largest id) of every distinct text."""
    texts = ids_and_texts(docs)
    local = texts.mapInArrow(lambda it: _combine(it, memory), _SCHEMA)
    dealt = local.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    owned = dealt.mapInArrow(lambda it: _own(it, memory), _SCHEMA)
    return owned.select("n_bytes", F.sha2("content", 256).alias("text_sha256"), "owner")


def exact_duplicates(docs: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Input tasks put their texts into a trie first, so a text that many rows share is
    shuffled once per task; partitions by (byte length, content hash) then merge those
    into tries of full byte strings. Identifiers and digests alone are joined back;
    Spark splits the rows of a hot text in that join.

    A missing text counts as empty. ``keep_id`` is the largest identifier that is not
    missing, or missing if all are. Of repeated rows (same identifier, same text) one
    is kept. An empty table gives no rows. Extra columns are ignored.
    """
    owners = text_owners(docs, memory)
    rows = (
        ids_and_texts(docs)
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
        .groupBy("doc_id", "n_bytes", "text_sha256")
        .agg(F.count("*").alias("repeats"))
    )
    sizes = rows.groupBy("n_bytes", "text_sha256").agg(F.sum("repeats").alias("group_size"))
    groups = owners.join(sizes, ["n_bytes", "text_sha256"])
    found = rows.join(groups, ["n_bytes", "text_sha256"])
    each = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("nth"))
    return each.select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )
