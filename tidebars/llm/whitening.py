"""Embedding whitening: spectra by rank-one updates, refined by Rayleigh-Ritz steps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.running import STATE, fold_states, one_state
from tidebars.session import stage

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
FOLD_ENTRIES = 1 << 21  # entries of the vectors that are folded into one triangle
_EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """``poles[i] - root[j]`` of all roots of 1 + sum(squares / (poles - x)) = 0.

    The poles rise and differ, the squares are positive; root j lies above pole j. Each
    root is held as its distance from the nearer pole, so that differences keep full
    relative accuracy, and is found by rational interpolation inside a bracket.
    """
    k, at = len(poles), np.arange(len(poles))
    total = squares.sum()
    gap = np.append(np.diff(poles), total)
    weights = squares[:, None]

    def value(shift: np.ndarray) -> np.ndarray:
        return 1 + (weights / shift).sum(0)

    right = value(poles[:, None] - (poles + gap / 2)) < 0
    origin = at + right
    origin[-1] = k - 1
    delta = poles[:, None] - poles[origin]
    lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    if right[-1]:
        lo[-1], hi[-1] = gap[-1] / 2, gap[-1]
    tau, below = (lo + hi) / 2, at[:, None] <= at
    above = np.append(poles[1:], poles[-1] + 2 * total) - poles[origin]  # the last root has no pole above
    own = poles - poles[origin]
    for _ in range(64):
        shift = delta - tau
        terms = weights / shift
        f = 1 + terms.sum(0)
        slopes = terms / shift
        psi = (slopes * below).sum(0)
        phi = slopes.sum(0) - psi
        lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
        d1, d2 = own - tau, above - tau
        c, a, b = f - d1 * psi - d2 * phi, (d1 + d2) * f - d1 * d2 * (psi + phi), d1 * d2 * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = tau + step
        inside = (new > lo) & (new < hi)
        new = np.where(inside, new, (lo + hi) / 2)
        done = (np.abs(f) <= 8 * _EPS * (1 + np.abs(terms).sum(0))) | (np.abs(new - tau) <= 2 * _EPS * np.abs(tau))
        tau = np.where(done, tau, new)
        if done.all():
            break
    return delta - tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors of the matrix given by both, plus v v^T.

    Equal eigenvalues are turned so that one of them alone meets ``v``, and eigenpairs that
    do not meet it stay as they are; the rest solve the secular equation, whose weights
    are then computed anew from the roots, so that the eigenvectors stay orthogonal.
    """
    z = v @ vectors
    length = np.linalg.norm(z)
    tolerance = 8 * _EPS * max(values[-1], length * length)
    if not length or tolerance == 0:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    edges = np.flatnonzero(np.diff(values) > tolerance) + 1
    for a, b in zip([0, *edges], [*edges, len(values)], strict=True):
        if b - a > 1 and (size := np.linalg.norm(z[a:b])):
            mirror = z[a:b].copy()
            mirror[-1] += np.copysign(size, mirror[-1])
            vectors[:, a:b] -= np.outer(vectors[:, a:b] @ mirror, mirror * (2 / (mirror @ mirror)))
            z[a:b] = 0
            z[b - 1] = size
    met = np.abs(z) * length > tolerance
    poles, weights = values[met], z[met] ** 2
    if not len(poles):
        return values, vectors
    shift = secular_roots(poles, weights)
    apart = poles[:, None] - poles
    np.fill_diagonal(apart, 1)
    anew = np.exp((np.log(np.abs(shift)).sum(1) - np.log(np.abs(apart)).sum(1)) / 2)
    turn = anew[:, None] / shift
    turn /= np.linalg.norm(turn, axis=0)
    # the signs of the weights belong to the old eigenvectors
    signs = np.sign((vectors[:, met] * v[:, None]).sum(0))
    signs[signs == 0] = 1
    vectors[:, met] = (vectors[:, met] * signs) @ turn
    nearest = np.abs(shift).argmin(0)
    values[met] = poles[nearest] - shift[nearest, np.arange(len(poles))]
    order = values.argsort(kind="stable")
    return np.maximum(values[order], 0), vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums and the eigenpairs of the centred scatter of some vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def none(cls, width: int) -> Spectrum:
        return cls(0, [0] * width, np.zeros(width), np.eye(width))

    def absorb(self, n: int, sums: list[int], rows: np.ndarray) -> None:
        """Take in ``n`` vectors whose centred scatter is the sum of r r^T over ``rows``:
        a rank-one update for each, and one for the step between the two means."""
        for row in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)
        if self.n:
            step = np.array([s / n - t / self.n for s, t in zip(sums, self.sums, strict=True)])
            self.values, self.vectors = rank_one(self.values, self.vectors, step * np.sqrt(n * self.n / (n + self.n)))
        self.n, self.sums = self.n + n, [s + t for s, t in zip(sums, self.sums, strict=True)]
        self.vectors = np.linalg.qr(self.vectors)[0]  # rounding of many products

    def take(self, x: np.ndarray) -> None:
        """Take in the rows of ``x``, turned into at most as many rows as they are wide:
        their triangle has the same scatter."""
        bound = int(np.abs(x).max()) * len(x)
        sums = x.sum(0).tolist() if bound < 1 << 62 else [sum(c) for c in x.T.tolist()]
        centred = x - np.array([s / len(x) for s in sums])
        self.absorb(len(x), sums, np.linalg.qr(centred, mode="r"))


    def state(self) -> tuple:
        return self.n, self.sums, self.values, self.vectors


def _merged(states: list[tuple]) -> tuple:
    own = Spectrum(*states[0])
    for n, sums, values, vectors in states[1:]:
        own.absorb(n, sums, (vectors * np.sqrt(values)).T)
    return own.state()


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return sum(a for a, _ in found), sum(b for _, b in found)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _chunks(batches: Iterator[pa.RecordBatch], width: int, column: int = 0) -> Iterator[np.ndarray]:
    most = max(1, FOLD_ENTRIES // width)
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield _matrix(batch.slice(i, most).column(column), width)


def _spectrum(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    own = Spectrum.none(width)
    for x in _chunks(batches, width):
        own.take(x)
    if own.n:
        yield one_state(TaskContext.get().partitionId(), own.state())


def _scatter(batches: Iterator[pa.RecordBatch], mean: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = basis.shape[1]
    total, first, any_ = np.zeros((width, width)), np.zeros(width), False
    for x in _chunks(batches, len(mean)):
        seen = (x - mean) @ basis
        total += seen.T @ seen
        first += seen.sum(0)
        any_ = True
    if any_:
        yield one_state(TaskContext.get().partitionId(), (total, first))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; missing where it does not fit a long."""
    rough = ((x.astype(float) * n - np.array(sums, float)) ** 2).sum(1)
    if (rough < 1e17).all() and n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return ((x * n - np.array(sums)) ** 2).sum(1).tolist()
    exact = (sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [d if d < 1 << 63 else None for d in exact]


def scaled(vector: Column) -> Column:
    """floor(64 c) of every entry; missing if the vector or an entry is missing, not finite
    or too large for a long."""
    fits = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(1 << 55))
    doubles = F.transform(vector, lambda e: e.cast("double"))
    return F.when(F.forall(doubles, fits), F.transform(doubles, lambda e: F.floor(e * SCALE)))


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector
    and component.

    Entries c become x = floor(64 c) + 1000000. Each task turns its vectors into the
    spectrum of their centred scatter by rank-one updates; spectra are joined up a tree
    by the same updates. The joint eigenvectors then span a Rayleigh-Ritz step over all
    vectors, which makes the eigenpairs exact to double precision, and one more pass
    measures how far the covariance of the whitened vectors is from the identity.

    Vectors that are missing or hold missing or infinite entries, NaN or entries of 2^55 and more are
    left out, and so are vectors of another length than most (of two lengths as frequent,
    the longer stays). Components without variance are not returned: a single vector, or
    equal ones, give no rows; nor do empty tables. A deviation that does not fit a long
    is missing. Repeated rows count each time; missing ids stay.
    """
    # the shift of all entries changes neither covariance nor deviation; without it nothing cancels
    clean = rows.select(F.col(f"`{id_col}`").alias("vec_id"), scaled(F.col(f"`{vector_col}`")).alias("x")).filter("x IS NOT NULL")
    clean = stage(clean.withColumn("width", F.size("x")))
    common = clean.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not common or not common.width:
        return rows.sparkSession.createDataFrame([], schema)
    width = common.width
    kept = clean.filter(F.col("width") == width)
    n, sums, _, basis = fold_states(kept.select("x").mapInArrow(lambda it: _spectrum(it, width), STATE), _merged)
    mean = np.array([s / n for s in sums])

    def scatter(onto: np.ndarray) -> np.ndarray:
        total, first = fold_states(kept.select("x").mapInArrow(lambda it: _scatter(it, mean, onto), STATE), _added)
        return total / n - np.outer(first / n, first / n)

    projected = scatter(basis)
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    trace = values.sum()
    used = int((values[:components] > width * _EPS * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if not used:
        return rows.sparkSession.createDataFrame([], schema)
    whitening = vectors[:, :used] / np.sqrt(values[:used])
    error = float(np.abs(scatter(whitening) - np.eye(used)).max())
    explained = values[:used] / trace

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                x = _matrix(batch.column(1), width)
                of_row = np.repeat(np.arange(len(x)), used)
                times = lambda v: np.tile(v, len(x))
                columns = [
                    batch.column(0).take(pa.array(of_row)),
                    pa.array(times(np.arange(1, used + 1, dtype=np.int32))),
                    pa.array(np.full(len(of_row), n)),
                    pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(of_row)),
                    pa.array(((x - mean) @ whitening).ravel()),
                    pa.array(times(explained)),
                    pa.array(np.full(len(of_row), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.select("vec_id", "x").mapInArrow(whitened, schema)
