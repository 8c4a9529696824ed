"""Links by five-word shingles against all pairs."""

import math
import random

import numpy as np
from odd_documents import odd, plain
from test_llm_near import LOWER, SPACED, _roots

import corpus_pipeline
from tidebars.llm.phrases import _Hashes
from tidebars.llm.simhash import fingerprint
from tidebars.llm.similar import BANDS, LEAST_EQUAL, ROWS, band_keys, bit_table, minima, shingles, similar_groups


def _shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {()}


def _similar(texts):
    own = [_shingles(t) for t in texts]
    return [(i, j) for i in range(len(own)) for j in range(i) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]


def _family(draw, n, words, edits):
    base = [f"w{draw.randrange(10**9)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in draw.sample(range(words), draw.randint(0, edits)):
            own[at] = f"x{draw.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def test_links_are_all_pairs_of_four_fifths(spark):
    draw = random.Random(4)
    texts = [*_family(draw, 60, 200, 9), *_family(draw, 120, 100, 8), *_family(draw, 40, 30, 2), "", " \n", "a b", "A  b", "a b c"]
    texts += [t + " end" for t in texts[:20]]
    draw.shuffle(texts)
    links = _similar(texts)
    want = _roots(len(texts), links)
    found = {r.row: r.root for r in similar_groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    assert found == {i: want[i] for i in {x for pair in links for x in pair}}


def test_the_near_stage_finds_pairs_over_and_no_pairs_under_four_fifths(spark):
    draw = random.Random(5)
    texts = []
    for edits in [3, 4, 5] * 20:  # of 196 shingles about 15 to 25 change: 0.77 to 0.86 are shared
        base = _family(draw, 1, 200, 0)[0].split()
        other = list(base)
        for at in draw.sample(range(10, 190, 10), edits):
            other[at] = "changed"
        texts += [" ".join(base), " ".join(other)]
    docs = odd(spark, list(enumerate(texts)))
    kept = {i for i, _ in plain(corpus_pipeline.near(spark, docs, None))}
    links = _similar(texts)
    assert 20 <= len(links) <= 58
    assert kept == set(range(len(texts))) - {i for i, _ in links}


def test_the_near_stage_links_a_pair_that_shares_a_fingerprint_but_no_band(spark):
    repeated = "x " * 20 + "a102850 b c"  # found by trying: one of 140 000 such pairs shares no band
    texts = [repeated, repeated + " d", "x " * 20 + "y z u v w", "other words of another text"]
    mine = [band_keys(minima(shingles(t, _Hashes()))) for t in texts[:2]]
    assert not (mine[0] == mine[1]).any() and fingerprint(texts[0]) == fingerprint(texts[1]) == fingerprint(texts[2])
    assert _similar(texts) == [(1, 0)]  # an equal fingerprint alone is no link: row 2 stays
    assert sorted(i for i, _ in plain(corpus_pipeline.near(spark, odd(spark, list(enumerate(texts))), None))) == [0, 2, 3]


def test_a_pair_at_the_limit_is_missed_once_in_a_hundred_thousand():
    assert (1 - 0.8**ROWS) ** BANDS < 1e-5


def test_a_pair_at_the_limit_has_too_few_equal_minima_once_in_a_hundred_million():
    n = BANDS * ROWS
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(LEAST_EQUAL)) < 1e-8


def test_bit_tables_bound_what_two_sets_share():
    draw = np.random.default_rng(9)
    for size in (0, 1, 30, 150, 900, 5000):
        x = np.unique(draw.integers(-(2**31), 2**31, size).astype(np.int32))
        y = np.unique(np.concatenate([x[: size // 2], draw.integers(-(2**31), 2**31, size // 2).astype(np.int32)]))
        (a, over_a), (b, over_b) = bit_table(x), bit_table(y)
        most = int(np.bitwise_count(a & b).sum()) + min(over_a, over_b)
        assert len(np.intersect1d(x, y)) <= most <= min(len(x), len(y))


def test_a_large_family_loses_no_link(spark):
    """3 000 rows of one family: many are unlike the least one, some unlike all."""
    draw = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)]
    for i in range(3000):
        own = list(base)
        for at in draw.sample(range(120), draw.choice([1, 1, 2, 3, 4, 5, 7, 9])):
            own[at] = f"x{i}.{at}"
        texts.append(" ".join(own))
    draw.shuffle(texts)
    sets = [_shingles(t) for t in texts]
    index = {s: k for k, s in enumerate({s for x in sets for s in x})}
    has = np.zeros((len(sets), len(index)), np.float32)
    for i, x in enumerate(sets):
        has[i, [index[s] for s in x]] = 1
    shared, sizes = has @ has.T, has.sum(1)
    i, j = np.nonzero(np.triu(5 * shared >= 4 * (sizes[:, None] + sizes - shared), 1))
    want = _roots(len(texts), list(zip(j.tolist(), i.tolist(), strict=True)))
    assert (shared[0] / (sizes[0] + sizes - shared[0]) < 0.8).mean() > 0.3
    found = {r.row: r.root for r in similar_groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    assert found == {k: want[k] for k in {*i.tolist(), *j.tolist()}}
