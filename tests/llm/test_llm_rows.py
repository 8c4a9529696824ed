"""Exact deduplication, sharding, piece encoding, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd_documents import empty, odd, plain

from tidebars.llm.documents import keep_rows, read_table
from tidebars.llm.exact_dedup import PatriciaTrie, exact_duplicates, shared_prefix
from tidebars.llm.pieces import Codec, encode_pieces, piece_digests
from tidebars.llm.sharding import Permutation, shard_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_shared_prefix():
    assert [shared_prefix(a, b) for a, b in ((b"", b"x"), (b"abc", b"abd"), (b"ab", b"abc"), (b"x", b"y"))] == [0, 2, 2, 0]


def test_trie_keeps_largest_owner_when_it_spills():
    draw = random.Random(3)
    trie, want, got = PatriciaTrie(), {}, {}
    for _ in range(3000):
        content = bytes(draw.choices(b"ab", k=draw.randint(0, 9)))
        owner = draw.choice([None, *range(50)])
        trie.insert((len(content), draw.randint(0, 1)), content, owner)
        want[content] = max(want.get(content, -1), -1 if owner is None else owner)
        if trie.held > 4000:
            for *_, c, o in trie.spill(1000):
                got[c] = max(got.get(c, -1), -1 if o is None else o)
    for *_, c, o in trie.spill():
        got[c] = max(got.get(c, -1), -1 if o is None else o)
    assert got == want and not trie.subtrees and trie.held == 0


@pytest.mark.parametrize("memory", [1, 32 << 20])
def test_exact_duplicates(spark, memory):
    docs = odd(spark)
    rows = plain(docs)
    groups = Counter(t for _, t in rows)
    owner = {t: max((i for i, u in rows if u == t and i is not None), default=None) for t in groups}
    found = exact_duplicates(docs, memory).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == Counter(
        (i, owner[t], groups[t], _sha(t)) for i, t in rows
    )
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter({_sha(t): 1 for t in groups})
    assert exact_duplicates(empty(spark)).count() == 0


def test_keep_rows_returns_the_columns_of_documents(spark):
    docs = odd(spark)
    kept = keep_rows(docs, exact_duplicates(docs).filter("kept"))
    assert kept.columns == docs.columns
    assert Counter(t for _, t in plain(kept)) == Counter({t: 1 for _, t in plain(docs)})


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation_is_a_bijection_with_inverse(n):
    order = Permutation(n, seed=9)
    places = order.position(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert order.row(places).tolist() == list(range(n))


def test_shards(spark):
    docs = odd(spark)
    found = shard_documents(docs, shards=4).collect()
    rows = plain(docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows
    )
    slots = {s: sorted(r.slot for r in found if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(r.row_number for r in found) == list(range(len(rows)))
    again = shard_documents(docs.repartition(3), shards=4).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in found)
    assert shard_documents(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        shard_documents(docs, shards=0)


def test_shards_of_the_table(spark):
    found = shard_documents(read_table(spark, "/root/testdata/sf0.01", "documents")).groupBy("shard").count().collect()
    assert len(found) == 16 and {r["count"] for r in found} <= {62, 63}


def test_agenda_equals_the_library():
    with open(MODEL, "rb") as file:
        codec = Codec(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(5)
    texts = ["", " ", "  a", "a  b", "\n\n", " \n x", "▁a ▁", "<s> <0x0A>", "x" * 500, "ab" * 300 + "  " * 40, "日本語 😀", "\x00"]
    texts += ["".join(draw.choices("abcdet  \n▁é日.,!0", k=draw.randint(0, 60))) for _ in range(800)]
    vocabulary = codec.vocabulary
    want = library.encode(texts)
    differed = []
    codec._library_differs = lambda fresh, check=codec._library_differs: differed.append(check(fresh))  # the agenda alone
    assert [list(ids) for ids in codec.encode(texts)] == want
    assert differed == [False]
    for text, ids in zip(texts, want, strict=True):
        if text:
            assert vocabulary.encode_long(("▁" + text).replace(" ", "▁")) == ids


def test_pieces_of_rows(spark):
    docs = odd(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter()
    for i, t in plain(docs):
        ids = library.encode(t)
        want[i, len(ids), _sha(",".join(map(str, ids))), _sha(library.decode(ids))] += 1
    found = piece_digests(encode_pieces(docs, MODEL)).collect()
    assert Counter(map(tuple, found)) == want
    assert encode_pieces(empty(spark), MODEL).count() == 0
