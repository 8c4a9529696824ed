"""Near duplicates, components, decontamination and substring deduplication against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from odd_documents import empty, odd, plain

from tidebars.llm.components import components, more_links
from tidebars.llm.decontaminate import contained_items, drop_contaminated
from tidebars.llm.documents import read_table, text_blocks
from tidebars.llm.phrases import remove_repeats, sequence_hashes, sliding
from tidebars.llm.simhash import fingerprint, near_duplicates, near_links
from tidebars.session import stage

SMALL = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for i in range(n):
        least.setdefault(find(i), i)
    return [least[find(i)] for i in range(n)]


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _roots(461, links)
    assert found == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr("tidebars.llm.components.stage", lambda df: written.append(1) or stage(df))
    stars = [(i, i % 3) for i in range(3, 40)]
    roots = components(spark.createDataFrame(stars, "a long, b long"))
    assert {tuple(r) for r in roots.collect()} == {(i, i % 3) for i in range(40)} and len(written) == 2
    assert {tuple(r) for r in more_links(roots, spark.createDataFrame([], "a long, b long")).collect()} == {(i, i % 3) for i in range(40)}
    assert len(written) == 4
    more = [(39, 50), (38, 50), (60, 61), (61, 62)]
    found = {r.node: r.root for r in more_links(roots, spark.createDataFrame(more, "a long, b long")).collect()}
    want = _roots(63, stars + more)
    assert found == {i: want[i] for i in [*range(40), 50, 60, 61, 62]}


def _fingerprint(text):
    words = SPACED.findall(text.translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_near_duplicates(spark):
    docs = odd(spark).unionByName(read_table(spark, SMALL, "documents").selectExpr("doc_id + 1000 AS doc_id", "text"), allowMissingColumns=True)
    rows = sorted(plain(docs), key=lambda r: (r[0] is None, r[0] or 0))
    prints = {t: _fingerprint(t) for _, t in rows}
    values = np.array([prints[t] for _, t in rows], np.uint64)
    links = [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist()]
    roots = _roots(len(rows), links)
    want = Counter((i, f"{int(v):016x}", rows[r][0]) for (i, _), v, r in zip(rows, values, roots, strict=True))
    assert Counter(map(tuple, near_duplicates(docs).collect())) == want
    assert near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [20_000, 50])
def test_a_large_group_of_near_copies_loses_no_link(spark, bucket):
    draw = random.Random(8)
    centre = draw.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in set(draw.choices(range(64), k=draw.randint(0, 6)))) for _ in range(900)})
    values = np.array(prints, np.uint64)
    nodes = values.view(np.int64).tolist()
    found = {r.node: r.root for r in components(near_links(spark.createDataFrame([(x, x) for x in nodes], "print long, node long"), bucket=bucket)).collect()}
    groups = {}
    for i, r in enumerate(_roots(len(nodes), [(i, j) for i in range(len(nodes)) for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist()])):
        groups.setdefault(r, []).append(nodes[i])
    assert found == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_blocks_cut_no_word():
    for sign in "\x1c\x1f\x85\xa0\u2003\u2028\u3000":
        text = f"ab{sign}cd ef\tg{'h' * 30}\x0b{sign}i  j{sign}"
        for size in range(1, 20):
            blocks = list(text_blocks(text, size))
            assert "".join(blocks) == text and [w for b in blocks for w in SPACED.findall(b)] == SPACED.findall(text)


@pytest.mark.parametrize("word", ["left\xa0right", "x" * (5 << 19)])
def test_a_word_at_a_cut_stays_whole(spark, word):
    before = ("w" * 1023 + " ") * 1024
    text = before[: (1 << 20) - 6] + " " + word + " and words after it"  # U+00A0 is the last sign of the first block
    assert fingerprint(text) == _fingerprint(text)
    left = remove_repeats(odd(spark, [(1, text)])).first()
    assert (left.n_words, left.n_removed + len(SPACED.findall(left.kept))) == (len(SPACED.findall(text)),) * 2


def test_tables_that_lose_pairs_are_refused(spark):
    values = [0, sum(1 << b for b in (0, 10, 20, 30, 40, 50, 60))]  # 7 bits apart, one in each of 7 runs
    prints = spark.createDataFrame([(x, x) for x in values], "print long, node long")
    with pytest.raises(ValueError, match="agree in 0 only"):
        near_links(prints, distance=7, blocks=7, agreeing=2)
    assert near_links(prints, distance=7, blocks=9, agreeing=2).distinct().count() == 1


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (2, "three short words"),
    (3, ""),
    (4, None),
    (None, "an item without any id at all"),
    (5, "red green blue yellow black white red green blue yellow black white"),
]


def _contained(docs, items):
    words = lambda t: re.findall(r"\w+", t.translate(LOWER))
    want = {}
    for doc_id, text in docs:
        d = words(text)
        for item_id, item in items:
            w = words(item or "")
            k = min(5, len(w))
            if k:
                own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
                shared = own & {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}
                if len(shared) >= 0.8 * len(own) - 1e-9:
                    want[doc_id, item_id] = max(want.get((doc_id, item_id), (0, 0, 0)), (len(shared) / len(own), len(own), len(shared)))
    return {(i, k, shared, total, c) for (i, k), (c, total, shared) in want.items()}


@pytest.mark.parametrize("block_bytes", [16 << 20, 100])
def test_contained_items(spark, block_bytes):
    whole = "ALPHA beta, gamma; delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    texts = [(100, f"before it. {whole} after it"), (101, whole.replace("omicron", "other")), (102, whole[:40]), (103, "filler " * 9000 + whole), (104, "three\nshort words"), (105, "white red green blue yellow black white red green")]
    docs = odd(spark).unionByName(odd(spark, texts))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = contained_items(docs, items, block_bytes=block_bytes)
    assert {tuple(r) for r in found.collect()} == _contained(plain(docs), ITEMS)
    left = drop_contaminated(docs, items, block_bytes=block_bytes)
    bad = {i for i, *_ in _contained(plain(docs), ITEMS)}
    assert left.columns == docs.columns and {i for i, _ in plain(left)} == {i for i, _ in plain(docs)} - bad
    assert contained_items(empty(spark), items).count() == 0
    assert contained_items(docs, items.limit(0)).count() == 0


def test_sequence_hashes_and_sliding():
    h = np.arange(100, dtype=np.uint64)
    for k in (1, 2, 7, 8, 35):
        hashes = sequence_hashes(h, k, 0x9E3779B97F4A7C15)
        assert len(set(hashes.tolist())) == len(hashes) == 101 - k
        assert sequence_hashes(h[5:], k, 0x9E3779B97F4A7C15).tolist() == hashes[5:].tolist()
        assert sliding(np.minimum, h, k).tolist() == h[: 101 - k].tolist()


def _left(rows, window):
    split = [(i, SPACED.findall(t)) for i, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = Counter()
    for doc_id, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


@pytest.mark.parametrize(("window", "phrase", "letters"), [(5, 2, "ab"), (6, 3, "abcd"), (35, 8, "abc")])
def test_repeats(spark, window, phrase, letters):
    draw = random.Random(window)
    passage = " ".join(draw.choices(letters, k=60))
    texts = [(i, " ".join(draw.choices(letters, k=draw.randint(0, 80))) + (f" {passage}\n" if i % 3 == 0 else "")) for i in range(60)]
    docs = odd(spark, [*texts, (None, passage), (7, None), (8, "a " * 300)])
    assert Counter(map(tuple, remove_repeats(docs, window, phrase).collect())) == _left(plain(docs), window)


def test_repeats_of_odd_rows(spark):
    docs = odd(spark)
    assert Counter(map(tuple, remove_repeats(docs).collect())) == _left(plain(docs), 35)
    assert remove_repeats(empty(spark)).count() == 0
