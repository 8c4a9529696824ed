"""SentencePiece encoding and decoding with merge-type vocabularies.

Encoding is a score-ordered agenda of adjacent symbol pairs; the sentencepiece library
checks it in every Arrow batch.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_format

from tidebars.llm.documents import ids_and_texts

SPACE = "▁"
NORMAL, BYTE, BPE = 1, 6, 2
LONG_CHUNK = 48
MEMO_ENTRIES = 400_000
ROWS_PER_BATCH = 512
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


class MergeVocabulary:
    """Pieces of a serialised model as a table of pairs that may merge.

    A symbol is a piece or a single character of one. For each two symbols that
    together are a piece, under left * size + right, ``merged`` has the symbol they
    give and ``ranks`` its place by falling score, equal scores alike.
    """

    def __init__(self, model: bytes) -> None:
        proto = model_format.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != BPE or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must be of the merge type with white space as prefix")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("the model must leave text as it is but for escaped spaces")
        if any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        bytes_ = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.byte_ids = [bytes_[b] for b in range(256)] if proto.trainer_spec.byte_fallback else None
        self.symbols = {piece: i for piece, (i, _) in pieces.items()}
        for c in sorted({c for piece in pieces for c in piece}):
            self.symbols.setdefault(c, len(proto.pieces) + len(self.symbols))
        self.size = max(self.symbols.values()) + 2
        self.outside = self.size - 1
        self.names = {i: s for s, i in self.symbols.items()}
        self.real = {i for i, _ in pieces.values()}
        rank = {s: r for r, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        self.ranks: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        for piece, (i, score) in pieces.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    key = left * self.size + right
                    self.ranks[key], self.merged[key] = rank[score], i
        self.never = len(rank)
        self.neighbours = {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1)}
        # No merge crosses a place that no piece has inside: before a space, around a line break.
        inner_space = any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        inner_break = any("\n" in piece and len(piece) > 1 for piece in pieces)
        word = f"{SPACE}*[^{SPACE}]+|{SPACE}+" if inner_break else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+"
        self.chunks = re.compile("(?s).+" if inner_space else word)

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut between characters that are neighbours in no piece."""
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.neighbours]
        return [chunk[i:j] for i, j in zip([0, *cuts], [*cuts, len(chunk)], strict=True)] if cuts else [chunk]

    def ids(self, symbols: list[int], text: str) -> list[int]:
        """Vocabulary ids of merged symbols; what no piece covers as bytes or unknown."""
        if self.real.issuperset(symbols):
            return symbols
        out, at = [], 0
        for s in symbols:
            name = self.names.get(s) or text[at]
            at += len(name)
            if s in self.real:
                out.append(s)
            elif self.byte_ids is not None:
                out += [self.byte_ids[b] for b in name.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode_short(self, text: str) -> list[int]:
        """The agenda as a list of ranks by place; the first of the smallest comes next."""
        get, size, ranks, never = self.symbols.get, self.size, self.ranks.get, self.never
        s = [get(c, self.outside) for c in text]
        agenda = [ranks(a * size + b, never) for a, b in pairwise(s)]
        while agenda and (best := min(agenda)) < never:
            i = agenda.index(best)
            s[i] = self.merged[s[i] * size + s.pop(i + 1)]
            del agenda[i]
            if i:
                agenda[i - 1] = ranks(s[i - 1] * size + s[i], never)
            if i < len(agenda):
                agenda[i] = ranks(s[i] * size + s[i + 1], never)
        return self.ids(s, text)

    def encode_long(self, text: str) -> list[int]:
        """The agenda as a heap of (rank, place) over a linked list of symbols."""
        s = [self.symbols.get(c, self.outside) for c in text]
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(s) and (key := s[left] * self.size + s[right]) in self.ranks:
                heapq.heappush(agenda, (self.ranks[key], left, right, key))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, key = heapq.heappop(agenda)
            if s[left] < 0 or s[right] < 0 or after[left] != right or s[left] * self.size + s[right] != key:
                continue
            s[left], s[right] = self.merged[key], -1
            after[left] = after[right]
            if after[right] < len(s):
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return self.ids([x for x in s if x >= 0], text)


class Codec:
    """Encoder with a bounded memory of chunks it has seen, in two generations."""

    def __init__(self, model: bytes) -> None:
        self.vocabulary = MergeVocabulary(model)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        v = self.vocabulary
        return v.chunks.findall((v.prefix + text).replace(" ", SPACE)) if text else []

    def _learn(self, chunks: Iterable[str]) -> list[str]:
        """Put chunks into the memory; returns those for which the agenda had to run."""
        v, fresh = self.vocabulary, []
        for c in chunks:
            ids = self.older.get(c)
            if ids is None:
                ids, ran = b"", False
                for part in v.parts(c):
                    known = self.memo.get(part) or self.older.get(part)
                    if known is None:
                        found = v.encode_short(part) if len(part) <= LONG_CHUNK else v.encode_long(part)
                        known = self.memo[part] = array("i", found).tobytes()
                        ran = True
                    ids += known
                if ran:
                    fresh.append(c)
            self.memo[c] = ids
        return fresh

    def _joined(self, chunks: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, chunks)), np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The agenda runs once for each new chunk of the batch, and the
        library checks all of them; should it differ, its ids are the ones returned."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo, self.older = {}, self.memo
        split = [self._chunks(t) for t in texts]
        fresh = self._learn(set().union(*split).difference(self.memo))
        if self._library_differs(fresh):
            self.memo, self.older = {}, {}
            return [np.array(ids, np.int32) for ids in self.vocabulary.library.encode(texts, num_threads=1)]
        return [self._joined(chunks) for chunks in split]

    def _library_differs(self, fresh: list[str]) -> bool:
        """Whether the library encodes one text made of all new chunks in another way.

        Chunks that start with a space follow each other as they are; others stand
        between line breaks, so that the text falls into the same chunks again.
        """
        v = self.vocabulary
        probe = "".join(c if c[0] == SPACE and c.strip(SPACE) else f"\n{c}\n" for c in fresh)
        if probe and not probe.startswith(v.prefix):
            probe = v.prefix + probe
        text = probe[len(v.prefix) :].replace(SPACE, " ")
        again = self._chunks(text)
        self._learn(set(again).difference(self.memo))
        return v.library.encode(text, num_threads=1) != self._joined(again).tolist()

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.vocabulary.library.decode([x.tolist() for x in ids], num_threads=1) if ids else []


_codecs: dict[int, Codec] = {}


def _codec(model: bytes) -> Codec:
    """One codec per worker process and model, kept over tasks."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def _encode(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    codec = _codec(model)
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_PER_BATCH):
            batch = whole.slice(start, ROWS_PER_BATCH)
            ids = codec.encode(batch.column(1).to_pylist())
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(codec.decode(ids), pa.string())], schema=_ARROW)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every row's whole text.

    ``ids`` are those of the sentencepiece library without begin and end marks, and
    ``decoded`` is what its decoder makes of them. A missing or empty text has no ids
    and decodes to the empty text. Very long texts and words go through the same
    agenda, kept as a heap. Repeated rows are encoded each; an empty table gives no
    rows; extra columns are ignored. No shuffle: every task works on its own rows and
    a memory of at most twice ``MEMO_ENTRIES`` chunks, so a lost task is simply run again.
    The model file is read by the driver and travels with the tasks (half a megabyte).
    """
    with open(model_path, "rb") as file:
        model = file.read()
    return ids_and_texts(docs).mapInArrow(
        lambda batches: _encode(batches, model), "doc_id long, ids array<int>, decoded string"
    )


def piece_digests(encoded: DataFrame) -> DataFrame:
    """Token counts and digests of what ``encode_pieces`` returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
