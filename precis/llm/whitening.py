"""Embedding whitening by incremental eigendecomposition.

Vectors are integers on a grid (256 steps a unit), so that their number, sums and
deviations are exact. The distinct ones are fitted:

1. Every task runs through its vectors and keeps the spectrum of their scatter: each
   new one is a centred rank-one update, whose eigenvalues are the roots of a
   secular equation. Directions without a part in the update, and equal
   eigenvalues, are deflated first.
2. Spectra are combined, some at a time in tasks, round after round: the one
   gives the other its eigenpairs, and the distance of the means, as rank-one updates.
3. With the exact mean, one more pass gives the covariance within the final basis
   (Rayleigh-Ritz): rounding of the updates is gone from the components.

A spectrum has as many numbers as the square of the dimension, whatever the rows;
it is all that a task holds and, once, all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import quoted
from precis.session import written

SCALE, COMPONENTS = 256, 4
#: Grid values beyond this are cut to it, so that they and their sums stay whole.
MOST = 1 << 31
#: Spectra that one task combines in a round.
FAN_IN = 16

_EPS = np.finfo(float).eps


# ------------------------------------------------------------------------------------------ rank-one updates

def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (poles - t)) = 0`` and their differences to all poles.

    Poles rise strictly, weights are positive: one root lies above every pole and
    below the next (the last within the sum of the weights). Each is found as a
    distance from its nearest pole, so that small differences keep their digits, by
    steps of a two-pole model that are held inside a shrinking bracket.
    Returns roots (m,) and ``gaps[i, j] = root_j - pole_i`` (m, m)."""
    m = len(poles)
    total = weights.sum()
    if m == 1:
        return poles + total, np.array([[total]])
    upper = np.append(poles[1:], poles[-1] + total)
    middle = (upper - poles) / 2
    spread = poles[:, None] - poles[None, :]  # [i, j]: pole_i - pole_j
    at_middle = 1 + (weights[:, None] / (spread - middle)).sum(axis=0)
    left = at_middle >= 0
    left[-1] = True
    near = np.where(left, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    delta = poles[:, None] - poles[near][None, :]
    low = np.where(left, 0.0, -middle)
    high = np.where(left, middle, 0.0)
    high[-1] = total
    mu = np.where(left, middle, -middle) / 2
    mu[-1] = total / 2
    column = np.arange(m)
    below = column[:, None] <= column[None, :]
    open_ = column  # the roots that are still sought
    for _ in range(100):
        gap = delta[:, open_] - mu[open_]
        part = weights[:, None] / gap
        value = 1 + part.sum(axis=0)
        low[open_], high[open_] = np.where(value < 0, mu[open_], low[open_]), np.where(value < 0, high[open_], mu[open_])
        slope = part / gap
        psi = np.where(below[:, open_], slope, 0.0).sum(axis=0)
        slope = slope.sum(axis=0)
        at = np.arange(len(open_))
        d1, d2 = gap[open_, at], gap[np.minimum(open_ + 1, m - 1), at]
        c = value - d1 * psi - d2 * (slope - psi)
        a = (d1 + d2) * value - d1 * d2 * slope
        b = d1 * d2 * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # no pole lies above the last root
            step = np.where(open_ == m - 1, d1 + d1 * d1 * psi / (value - d1 * psi), step)
        new = mu[open_] + step
        lo, hi = low[open_], high[open_]
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        done = (np.abs(value) <= 4 * _EPS * (1 + np.abs(part).sum(axis=0))) | (np.abs(new - mu[open_]) <= 2 * _EPS * np.abs(new))
        mu[open_] = np.where(done, mu[open_], new)
        open_ = open_[~done]
        if not len(open_):
            break
    return poles[near] + mu, mu - delta


def rank_one_update(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``vectors @ diag(values) @ vectors.T + rho * outer(x, x)`` for ``rho >= 0``; values rise."""
    z = vectors.T @ x
    size = np.sqrt(z @ z)
    if rho <= 0 or size == 0:
        return values, vectors
    z = z / size
    rho = rho * size * size
    tol = 8 * _EPS * max(abs(values[-1]), abs(values[0]), rho)
    # equal eigenvalues: a reflection leaves one direction of their space in the update
    starts = np.flatnonzero(np.append(True, np.diff(values) > tol))
    if len(starts) < len(values):
        vectors, z = vectors.copy(), z.copy()
        for s, e in zip(starts, np.append(starts[1:], len(values))):
            part = z[s:e].copy()
            length = np.sqrt(part @ part)
            if e - s > 1 and length > 0:
                mirror = part.copy()
                mirror[-1] += np.copysign(length, part[-1])
                mirror /= np.sqrt(mirror @ mirror)
                vectors[:, s:e] -= 2 * np.outer(vectors[:, s:e] @ mirror, mirror)
                z[s:e] = 0
                z[e - 1] = -np.copysign(length, part[-1])
    live = rho * np.abs(z) > tol
    if not live.any():
        return values, vectors
    poles, zs = values[live], z[live]
    weights = rho * zs * zs
    roots, gaps = secular_roots(poles, weights)
    m = len(poles)
    # the weights for which the roots found are exact keep the vectors orthogonal
    i, j = np.arange(m)[:, None], np.arange(m)[None, :]
    # row i: roots below over poles below, roots above over the poles above them; the last root over none
    other = np.where(j < i, poles[:, None] - poles[None, :], np.append(poles[1:], 0.0)[None, :] - poles[:, None])
    other[:, -1] = 1.0
    exact = np.sqrt(np.prod(np.abs(gaps) / other, axis=1))
    turned = np.copysign(exact, zs)[:, None] / gaps
    turned /= np.sqrt((turned * turned).sum(axis=0))
    new_values, new_vectors = values.copy(), np.empty_like(vectors)
    new_values[live] = roots
    new_vectors[:, ~live] = vectors[:, ~live]
    new_vectors[:, live] = vectors[:, live] @ turned
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, and the eigenpairs of the scatter around the mean."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d, dtype=np.int64), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        """One vector: a centred rank-one update."""
        if self.n:
            self.values, self.vectors = rank_one_update(
                self.values, self.vectors, x - self.sums / self.n, self.n / (self.n + 1))
        self.n, self.sums = self.n + 1, self.sums + x

    def merge(self, other: Spectrum) -> None:
        """Another spectrum, pair by pair, and the distance of the means."""
        if other.n and self.n:
            between = other.sums / other.n - self.sums / self.n
            self.values, self.vectors = rank_one_update(
                self.values, self.vectors, between, self.n * (other.n / (self.n + other.n)))
            for value, vector in zip(other.values, other.vectors.T):
                if value > _EPS * other.values[-1]:
                    self.values, self.vectors = rank_one_update(self.values, self.vectors, vector, value)
        elif other.n:
            self.values, self.vectors = other.values, other.vectors
        self.n, self.sums = self.n + other.n, self.sums + other.sums

    def row(self) -> tuple:
        return self.n, self.sums.tolist(), self.values.tolist(), self.vectors.ravel().tolist()


_SPECTRUM = "id long, n long, sums array<long>, vals array<double>, vecs array<double>"
_SPECTRUM_ARROW = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))


def _batch(ident: int, held: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((ident, *held.row()), _SPECTRUM_ARROW)],
                                      names=["id", "n", "sums", "vals", "vecs"])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of ``d`` numbers, none null, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _scan(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    held = Spectrum.empty(d)
    for batch in batches:
        for x in _matrix(batch.column(0), d):
            held.add(x)
    if held.n:
        yield _batch(TaskContext.get().partitionId(), held)


def _combine(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Spectra sorted by number: one for every ``FAN_IN`` numbers."""
    group, held = None, Spectrum.empty(d)
    for batch in batches:
        for ident, n, sums, values, vectors in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if ident // FAN_IN != group:
                if held.n:
                    yield _batch(group, held)
                group, held = ident // FAN_IN, Spectrum.empty(d)
            held.merge(Spectrum(n, np.array(sums, dtype=np.int64), np.array(values), np.array(vectors).reshape(d, d)))
    if held.n:
        yield _batch(group, held)


# ------------------------------------------------------------------------------------------ fit and apply

@dataclass
class Whitening:
    """A fitted model: bounded by the square of the dimension."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the components, falling
    vectors: np.ndarray  # components as columns
    trace: float
    identity_error: float


def grid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(``_id``, ``_x``): the usable rows with their vectors as longs, ``floor(scale * c)``.

    Dropped are rows whose vector is null or holds a null or non-finite entry.
    Values beyond 2**31 on the grid are cut to that."""
    vector = quoted(vector_col)
    entry = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    grid = F.transform(entry, lambda c: F.least(F.greatest(F.floor(
        F.least(F.greatest(c, F.lit(-1e300)), F.lit(1e300)) * F.lit(float(scale))).cast("double"), F.lit(float(-MOST))),
        F.lit(float(MOST))).cast("long"))
    return rows.where(vector.isNotNull() & ~bad).select(quoted(id_col).alias("_id"), grid.alias("_x"))


def _padded(rows: DataFrame, d: int) -> DataFrame:
    short = F.concat("_x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("_x")))
    return rows.withColumn("_x", F.when(F.size("_x") < d, short).otherwise(F.col("_x")))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of the distinct vectors of ``_x``, whose lists have one length; none without vectors."""
    distinct = written(vectors.select("_x").distinct(), "whitening-fit")
    first = distinct.select(F.size("_x")).first()
    if first is None:
        return None
    d = int(first[0])
    if d == 0:
        return Whitening(distinct.count(), [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    # equal spectra from run to run: vectors are dealt by their content and scanned in order
    dealt = distinct.repartition("_x").sortWithinPartitions("_x")
    spectra = written(dealt.mapInArrow(lambda b: _scan(b, d), _SPECTRUM), "spectra")
    while spectra.count() > 1:  # a task's numbers are those of a group of the round before
        group = F.floor(F.col("id") / FAN_IN)
        dealt = spectra.repartition(group).sortWithinPartitions("id")
        spectra = written(dealt.mapInArrow(lambda b: _combine(b, d), _SPECTRUM), "spectra")
    _, n, sums, values, basis = spectra.first()
    mean = np.array([s / n for s in sums])
    basis = np.linalg.qr(np.array(basis).reshape(d, d)[:, ::-1])[0]
    inner, trace = _second_moments(distinct, mean, basis, n)
    ritz, turn = np.linalg.eigh(inner)
    order = np.argsort(ritz, kind="stable")[::-1][:min(components, d)]
    values, chosen = np.maximum(ritz[order], 0.0), basis @ turn[:, order]
    # a sign of its own for every component, the same on every run
    chosen *= np.where(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])] < 0, -1.0, 1.0)
    values = np.where(values > 16 * d * _EPS * max(trace, 0.0), values, 0.0)
    white = chosen[:, values > 0] / np.sqrt(values[values > 0])
    error = 0.0
    if white.shape[1]:
        covariance, _ = _second_moments(distinct, mean, white, n)
        error = float(np.abs(covariance - np.eye(white.shape[1])).max())
    return Whitening(int(n), [int(s) for s in sums], values, chosen, trace, error)


def _second_moments(vectors: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The covariance of the centred vectors in ``basis``, and the trace of the whole one: a sum per task and entry."""
    k = basis.shape[1]
    upper = np.triu_indices(k)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = np.zeros((k, k)), 0.0
        for batch in batches:
            centred = _matrix(batch.column(0), len(mean)) - mean
            trace += float((centred * centred).sum())
            p = centred @ basis
            total += p.T @ p
        entries = np.append(total[upper], trace)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(entries)), pa.int64()), pa.array(entries)], names=["at", "part"])

    parts = vectors.select("_x").mapInArrow(moments, "at long, part double").groupBy("at").agg(F.sum("part").alias("s"))
    sums = np.zeros(len(upper[0]) + 1)
    for at, s in parts.collect():  # the square of the dimension
        sums[at] = s
    inner = np.zeros((k, k))
    inner[upper] = sums[:-1] / n
    return inner + np.triu(inner, 1).T, sums[-1] / n


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """One row for each usable row of ``rows`` and each component: id, ``component`` (from 1, by falling
    variance), ``n`` and ``deviation`` (squared distance from the mean, times n squared; exact),
    ``whitened``, ``explained`` (share of the variance) and ``identity_error``.

    Rows without a usable vector (see ``grid_vectors``) are dropped; equal vectors
    count once in the fit and every row is returned. Vectors shorter than the
    longest are filled up with zeros. A component without variance (one vector, or
    fewer directions than components) has whitened and explained 0 and no part in
    the error. A deviation beyond the range of a long is null. No usable vector, or
    none with an entry: no rows. Ids may be null or repeated; other columns are not
    read. The dimension bounds all state: a task holds its square."""
    usable = written(grid_vectors(rows, id_col, vector_col, scale), "whitening-rows")
    d = usable.agg(F.max(F.size("_x")), F.min(F.size("_x"))).first()
    if d[0] is not None and d[0] != d[1]:
        usable = _padded(usable, d[0])
    kind = usable.schema["_id"].dataType
    schema = (f"`_id` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    model = fit(usable, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    n, sums = model.n, np.array(model.sums, dtype=object)
    mean = np.array([s / n for s in model.sums])
    k = len(model.values)
    scales = np.where(model.values > 0, np.sqrt(np.where(model.values > 0, model.values, 1.0)), np.inf)
    project = model.vectors / scales
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
    error = model.identity_error

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(mean))
            if not len(x):
                continue
            reach = int(np.abs(x).max()) * n + max(abs(int(s)) for s in sums)
            if reach * reach * len(mean) < 1 << 63:
                away = x * n - sums.astype(np.int64)
                deviation = (away * away).sum(axis=1)
            else:  # whole numbers of any size
                deviation = ((x.astype(object) * n - sums) ** 2).sum(axis=1)
                deviation = np.array([v if v < 1 << 63 else None for v in deviation], dtype=object)
            white = (x - mean) @ project
            rows_in = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows_in), k))),
                pa.array(np.tile(np.arange(1, k + 1), rows_in), pa.int32()), pa.array(np.full(rows_in * k, n), pa.int64()),
                pa.array(np.repeat(deviation, k).tolist(), pa.int64()), pa.array(white.ravel()),
                pa.array(np.tile(explained, rows_in)), pa.array(np.full(rows_in * k, error))],
                names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(applied, schema).withColumnRenamed("_id", id_col)
