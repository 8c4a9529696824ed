"""Whitening against numpy on the exact integers."""

import math

import numpy as np
import pytest

from tidebars.llm.documents import read_table
from tidebars.llm.whitening import Spectrum, rank_one, whiten


def _scaled(vector):
    return [math.floor(64 * float(c)) + 1_000_000 for c in vector]


def _check(found, vectors, components=32):
    """``vectors``: (id, x) of every row that stays."""
    x = np.array([v for _, v in vectors], float)
    centred = x - x.mean(0)
    covariance = centred.T @ centred / len(x)
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1], basis[:, ::-1]
    sums = [sum(c) for c in zip(*[v for _, v in vectors], strict=True)]
    exact = {i: sum((len(vectors) * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in vectors}
    used = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(found) == used * len(vectors)
    assert {r.component for r in found} == set(range(1, used + 1))
    assert all(r.n == len(vectors) and r.deviation == exact[r.vec_id] for r in found)
    assert all(r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) for r in found)
    place = {i: k for k, (i, _) in enumerate(vectors)}
    white = np.zeros((len(vectors), used))
    for r in found:
        white[place[r.vec_id], r.component - 1] = r.whitened
    error = np.abs(white.T @ white / len(x) - np.eye(used)).max()
    assert error < 1e-9 and all(abs(r.identity_error - error) < 1e-9 for r in found)
    for k in range(used):  # alone among the eigenvalues: the same component but for its sign
        if min(abs(values[k] - values[j]) for j in range(len(values)) if j != k) > 1e-6 * values[0]:
            want = centred @ basis[:, k] / np.sqrt(values[k])
            assert np.abs(white[:, k] * np.sign(white[:, k] @ want) - want).max() < 1e-6


def test_test_tables(spark):
    rows = read_table(spark, "/root/testdata/sf0.001", "embeddings").repartition(20)
    _check(whiten(rows).collect(), [(r.vec_id, _scaled(r.embedding)) for r in rows.collect()])


def test_odd_vectors(spark):
    draw = np.random.default_rng(1)
    good = [(i, (draw.normal(size=5) * [9, 9, 3, 0.1, 0]).tolist()) for i in range(300)]
    good += [(i + 300, good[7][1]) for i in range(100)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4), (904, [1e30] * 5), (905, [1.0]), (906, [])]
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS width", "3 AS n").repartition(11)
    for components in (32, 3):
        _check(whiten(rows, components).collect(), [(i, _scaled(v)) for i, v in good], components)


def test_deviations_beyond_a_long_are_missing(spark):
    rows = spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (None, [0.0, 3.0])], "vec_id long, embedding array<double>")
    found = whiten(rows).collect()
    assert {r.deviation for r in found if r.vec_id == 1} == {None}
    x = [_scaled(v) for v in ([1e12, 0.0], [0.0, 1.0], [0.0, 3.0], [0.0, 3.0])]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert all(sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) >= 1 << 63 for v in x)


def test_tables_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)], [(1, [])]):
        assert whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("width", [1, 2, 7, 64])
def test_rank_one_updates(width):
    draw = np.random.default_rng(width)
    values, vectors, whole = np.zeros(width), np.eye(width), np.zeros((width, width))
    for k in range(3 * width):
        v = draw.normal(size=width) * 10.0 ** draw.integers(-3, 4)
        if k % 5 == 4:
            v = vectors[:, 0] * 3  # meets one eigenvector alone
        whole += np.outer(v, v)
        values, vectors = rank_one(values, vectors, v)
    assert np.abs((vectors * values) @ vectors.T - whole).max() <= 1e-12 * values[-1] * width
    assert np.abs(vectors.T @ vectors - np.eye(width)).max() < 1e-11


def test_equal_eigenvalues_are_deflated():
    values, vectors = rank_one(np.array([2.0, 2.0, 2.0, 5.0]), np.eye(4), np.array([1.0, 1.0, 0.0, 0.0]))
    assert values == pytest.approx([2, 2, 4, 5]) and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-14


def test_spectra_join_in_any_parts():
    x = np.random.default_rng(3).integers(-50, 50, (200, 6))
    whole, parts = Spectrum.none(6), Spectrum.none(6)
    whole.take(x)
    for part in np.array_split(x, 13):
        other = Spectrum.none(6)
        other.take(part)
        parts.absorb(other.n, other.sums, (other.vectors * np.sqrt(other.values)).T)
    assert parts.n == 200 and parts.sums == whole.sums == x.sum(0).tolist()
    assert parts.values == pytest.approx(whole.values)
