"""Quality scores: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.documents import ids_and_texts, remainder, text_blocks

SAMPLE_PER_LABEL = 2000  # labelled rows the classifier is fitted on, at most, for each label
TERMS = 1024
RANK = 32
NEIGHBOURS = 15
THRESHOLD = 0.3
HELD_OUT = 5
MARKS = ".,!?;:|-_#$%&*()[]{}<>\"'/\\@+=~^`"  # characters that are a class of their own
_KINDS = {"Lu": 1, "Lt": 1, "Nd": 3, "Zs": 4}
_CLASSES = 9 + len(MARKS)
_RATIOS = 3
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _class_table() -> np.ndarray:
    """Character classes: letters by case, digits, spaces, other marks and symbols, one per mark."""
    table = np.full(0x110000, 2, np.uint8)
    for point in range(0x3000):
        kind = unicodedata.category(chr(point))
        table[point] = _KINDS.get(kind) or {"L": 2, "P": 5, "S": 6}.get(kind[0], 7)
    table[ord("\n")] = 8
    for i, mark in enumerate(MARKS):
        table[ord(mark)] = 9 + i
    return table


_table: list[np.ndarray] = []


def term_frequencies(text: str, size: int = 1 << 20) -> np.ndarray:
    """Shares of character-class trigrams, hashed to ``TERMS`` terms, and of repetition.

    The last entries are the shares of words equal to the word before, of words and of
    lines that occurred earlier in the text. Works through the text in blocks of about
    ``size`` characters; the last two classes, the last word and the hash of the open line
    go into the next block, so the blocks do not show in the result.
    """
    if not _table:
        _table.append(_class_table())
    out = np.zeros(TERMS + _RATIOS)
    words, lines, seen_words, seen_lines, again, last = 0, 0, set(), set(), 0, None
    tail, line = np.empty(0, np.int64), xxhash.xxh64()
    for block in text_blocks(text, size):
        points = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = np.concatenate([tail, _table[0][points]])
        tail = classes[-2:]
        if len(classes) > 2:
            trigrams = (classes[:-2] * _CLASSES + classes[1:-1]) * _CLASSES + classes[2:]
            out[:TERMS] += np.bincount((trigrams * 2654435761 >> 7) % TERMS, minlength=TERMS)
        found = block.split()
        if found:
            again += sum(map(str.__eq__, found, found[1:])) + (found[0] == last)
            last = found[-1]
        words += len(found)
        seen_words.update(found)
        *closed, rest = block.encode("utf-8", "surrogatepass").split(b"\n")
        if closed:
            line.update(closed[0])
            seen_lines.add(line.intdigest())
            seen_lines.update(map(xxhash.xxh64_intdigest, closed[1:]))
            lines += len(closed)
            line.reset()
        line.update(rest)
    if text:
        lines += 1
        seen_lines.add(line.intdigest())
    out[:TERMS] /= max(1.0, out[:TERMS].sum())
    out[TERMS:] = again / max(1, words), 1 - len(seen_words) / max(1, words), 1 - len(seen_lines) / max(1, lines)
    return out.astype(np.float32)


@dataclass
class Neighbourhood:
    """Labelled latent vectors: at most 2 x ``SAMPLE_PER_LABEL`` rows of ``RANK`` numbers."""

    mean: np.ndarray
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, frequencies: np.ndarray, labels: np.ndarray, rank: int) -> Neighbourhood:
        """Latent axes of root frequencies, centred and weighted by inverse document frequency."""
        terms = frequencies.astype(np.float64)
        np.sqrt(terms, out=terms)
        mean = terms.mean(0)
        weight = np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))) + 1
        terms -= mean
        terms *= weight
        _, vectors = np.linalg.eigh(terms.T @ terms)
        fitted = cls(mean, weight, vectors[:, ::-1][:, :rank], np.empty((0, rank)), labels.astype(np.float64))
        fitted.vectors = fitted._directions(terms)
        return fitted

    def embed(self, frequencies: np.ndarray) -> np.ndarray:
        return self._directions((np.sqrt(frequencies) - self.mean) * self.weight)

    def _directions(self, terms: np.ndarray) -> np.ndarray:
        latent = terms @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, frequencies: np.ndarray, neighbours: int) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, each weighing its cosine."""
        if not len(self.labels):
            return np.full(len(frequencies), 0.5)
        cosine = np.round(self.embed(frequencies) @ self.vectors.T, 9)
        k = min(neighbours, len(self.labels))
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, nearest, 1), 1e-9)
        return np.clip((weight * self.labels[nearest]).sum(1) / weight.sum(1), 0.0, 1.0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms as the bytes of big-endian floats, which are in the order of the numbers, none below zero."""
    for batch in batches:
        vectors = pa.array([term_frequencies(t).astype(">f4").tobytes() for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), vectors], names=["quality", "terms"])


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, rank: int = RANK) -> Neighbourhood:
    """Fit on the ``per_label`` labelled rows of each label with the smallest id hashes.

    Rows whose crc32(doc_id) mod 5 is 0 are never used. The driver gets term vectors
    alone, at most 2 x ``per_label`` of fixed length (about 16 MB), as bytes: as numbers
    of Python they would take ten times that. Labels other than
    0 and 1, missing labels and labels without a document are ignored.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    open_rows = named.filter((remainder(F.col("doc_id"), HELD_OUT) != 0) & F.col("quality").isin(0, 1))
    parts = []
    for label in (0, 1):
        own = open_rows.filter(F.col("quality") == label).groupBy("doc_id", "quality").agg(F.lit(1))
        parts.append(own.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label))
    # at most 2 x per_label rows
    wanted = F.broadcast(parts[0].union(parts[1]))
    texts = ids_and_texts(docs).join(wanted, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = sorted((r.quality, bytes(r.terms)) for r in texts.select("quality", "text").mapInArrow(_frequencies, "quality int, terms binary").collect())
    if not found:
        empty = np.zeros((0, 0))
        return Neighbourhood(empty, empty, empty, empty, np.zeros(0))
    frequencies = np.stack([np.frombuffer(terms, ">f4") for _, terms in found]).astype(np.float32)
    qualities = np.array([quality for quality, _ in found])
    del found
    return Neighbourhood.fit(frequencies, qualities, rank)


def score_quality(docs: DataFrame, model: Neighbourhood, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    The score sees the whole text and nothing else; every document is compared with
    every labelled vector, in blocks. A missing or empty text has no terms and is
    scored as such; without any labelled row every score is 0.5. A row without
    identifier is not held out. Repeated rows are scored each; an empty table gives
    no rows; extra columns are ignored. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                terms = np.stack([term_frequencies(t) for t in batch.column(1).to_pylist()])
                scores = pa.array(sent.value.score(terms, neighbours))
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], schema=_SCORED)

    scored = ids_and_texts(docs).mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), HELD_OUT) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, model: Neighbourhood, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                terms = np.stack([term_frequencies(t or "") for t in batch.column("text").to_pylist()])
                yield batch.filter(pa.array(sent.value.score(terms, neighbours) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
