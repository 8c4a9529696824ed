"""The mixture against a packing and a sharing of its own."""

from collections import Counter, defaultdict

import pytest
from odd_documents import CLASHING, TEXTS, empty
from pyspark.sql import functions as F
from test_llm_near import SPACED

from tidebars.llm.documents import read_table
from tidebars.llm.mixing import mix_sources, mixed_texts, source_targets, taken_words


def _targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is over the limit goes round again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = dict.fromkeys(order, 0.0), set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] >= most * sizes[s]}
        for s in over:
            target[s] = float(most * sizes[s])
        if not over or full == set(order):
            return target
        full |= over


def _documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *[F.lit("clash").alias(c) for c in [*CLASHING, "source_rank", "block", "shard", "taken", "weight", "missing"]])


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 10, "b": 10, "c": 500, None: 4}, {"z": 3, "é": 900, "Z": 40, "m": 0, None: 7}, {f"s{i:02}": 10 + i**2 for i in range(40)}, {"a": 0}])
def test_targets(spark, sizes):
    found = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = _targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in found} == want
    assert [r.source for r in sorted(found)] == sorted(sizes, key=lambda s: (s is None, s))
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("block", [4, 7])
def test_blocks_are_drawn_as_planned(spark, block):
    rows = [(i, f"{'  '.join(f'w{i}.{k}' for k in range(i * 7 % 23))}\n", "hot" if i % 3 else f"s{i % 4}") for i in range(1000, 1090)]
    rows += [(i, t, None) for i, t in TEXTS if i not in (10, 11)] + [(5, "long " * 3000, "hot")] * 2
    docs = _documents(spark, rows)
    plan = mix_sources(docs, block_words=block, shards=5)
    taken = taken_words(plan, block).collect()
    assert Counter((r.doc_id, r.size) for r in taken) == Counter((i, len(SPACED.findall(t or ""))) for i, t, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in taken)
    sources = {r.source_rank: r for r in plan.sources.collect()}
    slots = plan.slots.collect()
    shards = Counter(r.shard for r in slots)
    assert max(shards.values()) - min(shards.values()) <= 1
    seen = defaultdict(list)
    for r in slots:
        seen[r.source_rank].append(r)
    for rank, own in seen.items():
        s = sources[rank]
        assert sorted(r.slot for r in own) == list(range(s.draws)) and len({(r.epoch, r.block) for r in own}) == s.draws
        assert {r.epoch for r in own} <= set(range(3)) and all(r.epoch == r.slot // s.blocks for r in own)
        assert abs(s.draws * block - s.target) <= max(block, 3 * block * (s.target >= 3 * s.source_size))
    # the mixture itself: each block holds the words at its place of its source
    words = defaultdict(list)
    for r in sorted(plan.documents.collect(), key=lambda r: (r.source_rank, r.offset)):
        words[r.source_rank].append(r.size)
    texts = mixed_texts(docs, plan, block).collect()
    assert len(texts) == len(slots)
    drawn = Counter(w for r in texts for w in r.text.split(" "))
    assert sum(drawn.values()) == sum(r.taken for r in taken)
    by_doc = Counter()
    for w, n in drawn.items():
        if w[0] == "w" and "." in w:
            by_doc[int(w[1:].split(".")[0])] += n
            assert n <= 3
    assert {r.doc_id: r.taken for r in taken if r.doc_id in by_doc} == dict(by_doc)
    for rank, sizes in words.items():
        total = sum(sizes)
        lengths = {r.block: len(r.text.split(" ")) for r in texts if r.source_rank == rank}
        assert all(n == min(block, total - b * block) for b, n in lengths.items())


def test_reruns_agree_and_targets_are_met(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    first, second = (Counter(map(tuple, taken_words(mix_sources(d)).collect())) for d in (docs, docs.repartition(5)))
    assert first == second
    sizes, sums, target = Counter(), Counter(), {}
    for r in docs.select("source", "doc_id", "text").collect():
        sizes[r.source] += len(SPACED.findall(r.text or ""))
    for _, _, size, goal, taken in first.elements():
        sums[size] += taken
        target[size] = goal
    assert {sizes[s]: pytest.approx(t) for s, t in _targets(sizes).items()} == target
    assert all(abs(sums[s] - t) <= 0.02 * t + 128 for s, t in target.items())


def test_tables_without_words(spark):
    assert taken_words(mix_sources(empty(spark))).count() == 0
    none = taken_words(mix_sources(_documents(spark, [(1, "", "a"), (2, None, None)]))).collect()
    assert [(r.size, r.taken, r.target) for r in none] == [(0, 0, 0.0)] * 2
