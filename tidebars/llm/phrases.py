"""Substring deduplication: recurring passages found by phrases, located by automata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.documents import ids_and_texts, text_blocks
from tidebars.session import stage

WINDOW = 35
PHRASE = 8
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # of the phrase filter; 32 MB at most
BUCKET_BITS = 1 << 15  # of one bitmap made by Spark
MEMO_WORDS = 400_000
SPLIT_ONCE = 1 << 12  # characters of a text whose words are kept for the second look
_U = np.uint64
_FACTORS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def split_words(text: str) -> list[bytes]:
    """Words in UTF-8. ``bytes.split`` cuts at the six separators alone, and faster than a pattern."""
    return text.encode().split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def sliding(op: Callable, x: np.ndarray, k: int) -> np.ndarray:
    """``op`` over each ``k`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= k:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - k + done], x[k - done :]) if done < k else x


def sequence_hashes(h: np.ndarray, k: int, factor: int) -> np.ndarray:
    """A hash of each ``k`` consecutive word hashes, in order, by doubling."""

    def joined(a: np.ndarray, b: np.ndarray, a_words: int, b_words: int) -> np.ndarray:
        n = len(h) - a_words - b_words + 1
        return a[:n] * _U(pow(factor, b_words, 2**64)) + b[a_words : a_words + n]

    if len(h) < k:
        return np.empty(0, _U)
    powers, width = {1: h}, 1
    while width * 2 <= k:
        powers[width * 2] = joined(powers[width], powers[width], width, width)
        width *= 2
    out, have = powers[width], width
    for w in sorted(powers, reverse=True):
        if have + w <= k:
            out, have = joined(out, powers[w], have, w), have + w
    out = (out ^ (out >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return out ^ (out >> _U(29))


def word_blocks(text: str, hashes: _Hashes, window: int, split: list[bytes] | None = None) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """First word's place, words and word hashes, in blocks of which each window lies in exactly one;
    ``split`` has the words of a text that is one block."""
    at: int = 0
    words: list[bytes] = []
    for block in text_blocks(text) if split is None else [split]:
        words += split_words(block) if split is None else split
        if len(words) >= window:
            yield at, words, np.fromiter(map(hashes.__getitem__, words), _U, len(words))
            at += len(words) - window + 1
            words = words[len(words) - window + 1 :]


class Windows:
    """Windows of one block of words, each with the least of its phrases' hashes.

    Equal windows have the same least phrase, so a window can only recur if that phrase does.
    """

    def __init__(self, h: np.ndarray, window: int, phrase: int) -> None:
        self.phrases = sequence_hashes(h, phrase, _FACTORS[0])
        self.span = window - phrase + 1
        self.least = sliding(np.minimum, self.phrases, self.span)

    def chosen(self) -> np.ndarray:
        """Places of phrases that are the least of some window."""
        pad = np.zeros(self.span - 1, _U)
        return np.flatnonzero(sliding(np.maximum, np.concatenate([pad, self.least, pad]), self.span) == self.phrases)


def _phrases(batches: Iterator[pa.RecordBatch], window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """Each document's chosen phrases and whether it has them more than once."""
    hashes = _Hashes()
    for batch in batches:
        values, counts = [np.empty(0, _U)], [np.empty(0, np.int64)]
        for text in batch.column(0).to_pylist():
            for _, _, h in word_blocks(text, hashes, window):
                w = Windows(h, window, phrase)
                v, n = np.unique(w.phrases[w.chosen()], return_counts=True)
                values.append(v)
                counts.append(np.minimum(n, 2))
        columns = [pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(counts))]
        yield pa.RecordBatch.from_arrays(columns, names=["phrase", "n"])


def _has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & _U(len(bits) * 8 - 1)
    return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 > 0


def recurring_phrases(texts: DataFrame, window: int, phrase: int) -> np.ndarray:
    """A filter of the phrases that occur more than once, one bit for each hash remainder.

    Spark counts the phrases and sets the bits. The filter has about sixteen bits a
    phrase, up to ``MOST_BITS``; whatever its size it misses no recurring phrase, and a
    bit set for another phrase only means that more windows are counted.
    """
    counted = texts.select("text").mapInArrow(lambda it: _phrases(it, window, phrase), "phrase long, n long")
    again = stage(counted.groupBy("phrase").agg(F.sum("n").alias("n")).filter("n > 1").select("phrase"))
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * again.count()):
        bits *= 2
    place = F.col("phrase").bitwiseAND(bits - 1) + 1
    marked = again.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    filled = np.zeros(bits // 8, np.uint8)
    width = BUCKET_BITS // 8
    # at most MOST_BITS / BUCKET_BITS rows of 4 KB
    for row in marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        start = (row.bucket - 1) * width
        filled[start : start + width] = np.frombuffer(row.bits, np.uint8)
    return filled


def _candidates(batches: Iterator[pa.RecordBatch], bits: np.ndarray, window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """Windows whose least phrase passes the filter: 96 bits of hash, and where they start."""
    hashes = _Hashes()
    names = ["w", "c", "k1", "k2", "start"]
    for batch in batches:
        parts: list[tuple[np.ndarray, ...]] = []
        for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at, _, h in word_blocks(text, hashes, window):
                starts = np.flatnonzero(_has(bits, Windows(h, window, phrase).least))
                if len(starts):
                    w = sequence_hashes(h, window, _FACTORS[0])[starts].view(np.int64)
                    c = (sequence_hashes(h, window, _FACTORS[1])[starts] >> _U(33)).astype(np.int64)
                    key = [np.full(len(starts), k, np.int64) for k in (k1, k2)]
                    parts.append((w, c, *key, starts + at))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


class PassageAutomaton:
    """Aho-Corasick automaton of the phrases that stand for a shard's recurring windows."""

    def __init__(self, phrases: set[tuple[bytes, ...]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for words in phrases:
            self.automaton.add_word(f" {b' '.join(words).decode()} ", len(words))
        if phrases:
            self.automaton.make_automaton()

    def places(self, words: list[bytes]) -> np.ndarray:
        """Word places where a phrase starts."""
        if not len(self.automaton):
            return np.empty(0, np.int64)
        text = f" {b' '.join(words).decode()} "
        found = np.array(list(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        if not len(found):
            return found[:, 0]
        # a phrase ends at the space after its last word; spaces are counted to get the place
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
        return np.searchsorted(spaces, found[:, 0]) - found[:, 1]


def _remove(batches: Iterator[pa.RecordBatch], bits: np.ndarray, window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """Words left of each document.

    A shard is a batch of at most 256 documents. Its confirmed windows (those that pass
    the filter and are not single) give the phrases of its automaton, through which all
    its documents are streamed; every confirmed window around an occurrence is covered.
    """
    hashes = _Hashes()
    for whole in batches:
        for first in range(0, whole.num_rows, 256):
            batch = whole.slice(first, 256)
            texts, singles = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            phrases: set[tuple[bytes, ...]] = set()
            split: list[list[bytes] | None] = []  # words of short texts, so that they are split once
            confirmed: list[list[tuple[int, np.ndarray]]] = []
            for text, single in zip(texts, singles, strict=True):
                found = []
                alone = np.array(single or [], np.int64)
                split.append(split_words(text) if len(text) <= SPLIT_ONCE else None)
                for at, words, h in word_blocks(text, hashes, window, split[-1]):
                    w = Windows(h, window, phrase)
                    sure = _has(bits, w.least)
                    inside = alone[(alone >= at) & (alone < at + len(sure))] - at
                    sure[inside] = False
                    if sure.any():
                        least = np.unique(w.least[sure])
                        own = w.chosen()
                        own = own[np.isin(w.phrases[own], least)]
                        phrases.update(tuple(words[p : p + phrase]) for p in own.tolist())
                        found.append((at, sure))
                confirmed.append(found)
            automaton = PassageAutomaton(phrases)
            rows = []
            for text, found, words in zip(texts, confirmed, split, strict=True):
                if words is None:
                    words = [w for block in text_blocks(text) for w in split_words(block)]
                if not found:
                    rows.append((len(words), 0, b" ".join(words).decode()))
                    continue
                covered = np.zeros(len(words) + 1, np.int64)
                for at, sure in found:
                    places = automaton.places(words[at : at + len(sure) + window - 1])
                    near = np.zeros(len(sure) + 1, np.int64)  # windows with an occurrence inside
                    np.add.at(near, np.clip(places - (window - phrase), 0, len(sure)), 1)
                    np.add.at(near, np.minimum(places + 1, len(sure)), -1)
                    starts = np.flatnonzero((np.cumsum(near)[:-1] > 0) & sure) + at
                    np.add.at(covered, starts, 1)
                    np.add.at(covered, starts + window, -1)
                gone = np.cumsum(covered)[:-1] > 0
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                rows.append((len(words), int(gone.sum()), b" ".join(left).decode()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row: the text without its repeated passages.

    A word goes if it lies in a window of ``window`` words whose sequence starts at
    another place too, in the same document or any other. ``kept`` is the words left,
    joined by single spaces. Documents of fewer words than a window, missing and empty
    ones keep all they have. Repeated rows repeat each other: all words of windows go.
    An empty table gives no rows; extra columns are ignored.

    Of each window one phrase stands for it, the least by hash; phrases are counted, and
    only windows whose phrase recurs are counted in turn, with map-side combining, so a
    passage in a third of all documents is one row for each task. A window counted once
    gives back its own place; these places alone return to their documents (keyed by
    text), and Spark splits the rows of a text that many documents share.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase must fit into a window")
    texts = ids_and_texts(docs).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    bits = docs.sparkSession.sparkContext.broadcast(recurring_phrases(texts, window, phrase))
    found = texts.select("k1", "k2", "text").mapInArrow(
        lambda it: _candidates(it, bits.value, window, phrase), "w long, c long, k1 long, k2 long, start long"
    )
    where = [F.min(x).alias(x) for x in ("k1", "k2", "start")]
    once = found.groupBy("w", "c").agg(F.count("*").alias("n"), *where).filter("n = 1")
    singles = stage(once.groupBy("k1", "k2").agg(F.collect_list("start").alias("singles")))
    joined = texts.join(singles, ["k1", "k2"], "left").select("doc_id", "text", "singles")
    return joined.mapInArrow(
        lambda it: _remove(it, bits.value, window, phrase), "doc_id long, n_words long, n_removed long, kept string"
    )
