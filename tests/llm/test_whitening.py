"""Whitening: secular roots and rank-one updates, then the fit against numpy's eigenvalues."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def test_secular_roots_against_dense():
    rng = np.random.default_rng(0)
    for m in (1, 2, 5, 40):
        for spacing in (1.0, 1e-9):
            poles = np.cumsum(rng.random(m) * spacing + spacing * 1e-3)
            weights = rng.random(m) ** 4 + 1e-12
            roots, gaps = W.secular_roots(poles, weights)
            z = np.sqrt(weights)
            assert np.allclose(np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z)), roots, rtol=1e-12, atol=1e-13)
            assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()
            assert np.allclose(gaps, roots[None, :] - poles[:, None], atol=1e-12)


@pytest.mark.parametrize("kind", ["dense", "few values", "one direction", "graded", "constant"])
@pytest.mark.parametrize("d", [1, 2, 3, 17])
def test_spectrum_and_merge(kind, d):
    rng = np.random.default_rng(d)
    x = {"dense": rng.integers(-80, 80, (90, d)), "few values": rng.integers(-1, 2, (90, d)),
         "one direction": np.outer(rng.integers(-9, 9, 90), rng.integers(-3, 4, d)),
         "graded": (rng.normal(size=(90, d)) * np.geomspace(1, 1e-6, d) * 1e7).astype(np.int64),
         "constant": np.full((90, d), 7)}[kind]
    parts = [W.Spectrum.empty(d) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i % 2].add(row)  # the third stays empty
    whole = W.Spectrum.empty(d)
    for p in parts:
        whole.merge(p)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    scale = max(1.0, np.abs(scatter).max())
    assert whole.n == 90 and (whole.sums == x.sum(axis=0)).all()
    assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - scatter).max() < 1e-11 * scale
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(d)).max() < 1e-11


def plain(rows, components=4):
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=float)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sums = [int(s) for s in fit.sum(axis=0)]
    out = {}
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        white = (np.array(x) - mean) @ vectors / np.sqrt(values)
        for c in range(len(values)):
            out.setdefault(i, {})[c + 1] = (n, deviation, white[c], values[c] / np.trace((fit - mean).T @ (fit - mean) / n))
    return out


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12)) * np.geomspace(1, 0.05, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a large group of equal vectors
    rows += [(2000, None), (2001, [None] + rows[1][1][1:]), (2002, [float("nan")] + rows[1][1][1:]),
             (2003, [float("-inf")] + rows[1][1][1:])]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(40)).collect()
    want = plain(rows)
    assert len(got) == 4 * 700 and {r.vec_id for r in got} == set(want)
    for c in range(1, 5):
        mine = [r for r in got if r.component == c]
        sign = np.sign(sum(r.whitened * want[r.vec_id][c][2] for r in mine))
        for r in mine:
            n, deviation, white, explained = want[r.vec_id][c]
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.whitened - sign * white) < 1e-8 and abs(r.explained / explained - 1) < 1e-10
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_odd_tables(spark):
    make = lambda rows: W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert make([]) == [] and make([(1, None), (2, [float("nan")])]) == [] and make([(1, [])]) == []
    one = make([(None, [0.5, 0.25]), (None, [0.5, 0.25])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (c, 1, 0, 0.0, 0.0, 0.0) for c in (1, 2, 1, 2)]
    # shorter vectors are filled up; minus zero is zero; one direction leaves the second component without variance
    short = sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.deviation) for r in make([(1, [1.0]), (2, [-0.0, 0.0]), (3, [0.0])]))
    assert short == [(1, 1, 1.0, 65536), (1, 2, 0.0, 65536), (2, 1, 1.0, 65536), (2, 2, 0.0, 65536), (3, 1, 1.0, 65536), (3, 2, 0.0, 65536)]
    clash = spark.createDataFrame([(1, [0.5, 1.0], 3), (2, [1.5, 0.0], 4), (3, [0.0, 0.0], 4)], SCHEMA + ", component int")
    assert {r.vec_id for r in W.whiten(clash.withColumn("_x", F.lit(1))).collect()} == {1, 2, 3}


def test_deviation_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in W.whiten(rows).collect()} == {1: None, 2: None, 3: 0}
    rows = spark.createDataFrame([(1, [4e6]), (2, [-4e6])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in W.whiten(rows).collect()} == {i: (2 * 1024000000) ** 2 for i in (1, 2)}
