"""The prefix trie, list ranking and running totals against plain walks."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidebars.llm.list_ranking import list_ranks
from tidebars.llm.prefix_trie import conversation_trie
from tidebars.llm.running import running_totals


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_list_ranks(spark, n):
    draw = random.Random(n)
    ids = draw.sample(range(10**6), n)
    items = [(i, a, b) for a, i, b in zip([None, *ids], ids, [*ids[1:], None], strict=False)]
    draw.shuffle(items)
    found = list_ranks(spark.createDataFrame(items, "id long, prev long, next long"), in_one_task=40)
    assert sorted(map(tuple, found.collect())) == sorted((i, k) for k, i in enumerate(ids))


def test_a_ring_is_refused(spark):
    with pytest.raises(Exception, match="not one list"):
        list_ranks(spark.createDataFrame([(1, None, None), (2, 3, 3), (3, 2, 2)], "id long, prev long, next long")).count()


def test_running_totals_of_hot_keys(spark):
    draw = random.Random(3)
    rows = [(draw.choice([1, 7, 7, 7, 9, draw.randrange(1000)]), i, draw.randrange(100), draw.getrandbits(63)) for i in range(3000)]
    found = running_totals(spark.createDataFrame(rows, "k long, o long, v long, x long").repartition(9), "k", ["o"], ["v"], ["x"])
    sums, xors, want = defaultdict(int), defaultdict(int), []
    for k, o, v, x in sorted(rows):
        sums[k] += v
        xors[k] ^= x
        want.append((k, o, v, x, sums[k], xors[k]))
    assert sorted(map(tuple, found.collect())) == want


def _trie(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        built[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k] if k in children else 0, leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest())
        for k, m in members.items()
    )


def _rows(found):
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


def _conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "*", *[F.lit("clash").alias(c) for c in "depth p1 p2 one part place bytes id rank leaf i k1 h first".split()]
    )


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie(spark, rebuild):
    draw = random.Random(11)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "b", "ü"])) for c in range(0, 260, 2) for t in range(draw.randint(1, 7))]
    rows += [(7, t, "user", "again" if t % 2 else "and") for t in range(900)]  # one conversation of a third of all rows
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1300, 5) for t in range(3)]
    rows += [(None, 0, "user", "nobody"), (3001, None, None, None), (3001, None, "user", None), (3001, 0, None, ""), (3002, 5, "x", "y"), (3002, 5, "x", "y"), (3003, 1, "Ünïcödé", "\x00日本 😀" * 500)]
    draw.shuffle(rows)
    found = conversation_trie(_conversations(spark, rows), rebuild, in_one_task=100)
    assert _rows(found) == _trie(rows, rebuild)


def test_small_tries(spark):
    assert conversation_trie(_conversations(spark, []), True).count() == 0
    for rows in ([(1, 0, "user", "a")], [(1, 0, "user", "a"), (2, 0, "user", "a"), (0, 0, "system", "s")], [(None, 1, "a", "b"), (4, None, None, None)]):
        assert _rows(conversation_trie(_conversations(spark, rows))) == _trie(rows)
