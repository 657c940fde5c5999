"""Bootstrap intervals: parameter checks, ordering, determinism, docstring example."""

import hashlib

import numpy as np
import pytest

from precis.operators import bootstrap as B


def score_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, score_type string, precision double, recall double, fmeasure double")


def as_dict(df):
    return {(r["score_type"], r["measure"]): (r["low"], r["mid"], r["high"]) for r in df.collect()}


def test_param_validation(spark):
    s = score_frame(spark, [(0, "rouge1", 1.0, 1.0, 1.0)])
    with pytest.raises(ValueError):
        B.bootstrap_exact(s, confidence=1.5)
    with pytest.raises(ValueError):
        B.bootstrap_poisson(s, n_samples=0)


def test_docstring_example(spark):
    # ("one two three", "one two") and ("one two five six", "seven eight")
    rows = [(0, "rouge1", 1.0, 2 / 3, 0.8), (1, "rouge1", 0.0, 0.0, 0.0)]
    got = as_dict(B.bootstrap_exact(score_frame(spark, rows), n_samples=1000, seed=1))
    lo, mid, hi = got[("rouge1", "precision")]
    assert lo == 0.0 and hi == 1.0 and mid == pytest.approx(0.5)
    lo, mid, hi = got[("rouge1", "recall")]
    assert lo == 0.0 and hi == pytest.approx(2 / 3) and mid == pytest.approx(1 / 3)


def exact_reference(x, B_, seed, conf):
    """Plain numpy statement of the hashed exact resampling."""
    n = len(x)
    means = []
    for b in range(B_):
        picks = []
        for k in range(n):
            h = hashlib.md5(f"{seed}-{b}-{k // 4}".encode()).hexdigest()
            part = k % 4
            picks.append(int(int(h[8 * part: 8 * part + 8], 16) / 2**32 * n))
        means.append(np.mean(x[picks]))
    d = (1 - conf) / 2
    return np.percentile(means, [100 * d, 50, 100 * (1 - d)])


def test_exact_equals_numpy_statement(spark):
    rng = np.random.default_rng(0)
    x = rng.random(37)
    rows = [(i * 7, "rougeL", float(v), float(v), float(v)) for i, v in enumerate(x)]
    got = as_dict(B.bootstrap_exact(score_frame(spark, rows), n_samples=50, seed=3))
    exp = exact_reference(x, 50, 3, 0.95)
    assert got[("rougeL", "precision")] == pytest.approx(tuple(exp), abs=1e-12)


def test_poisson_ordering_and_partition_independence(spark):
    rng = np.random.default_rng(1)
    rows = [(i, t, float(a), float(b), float(c)) for i in range(300) for t in ("rouge1", "rouge2")
            for a, b, c in [rng.random(3)]]
    s = score_frame(spark, rows)
    a = as_dict(B.bootstrap_poisson(s.repartition(3), n_samples=200))
    b = as_dict(B.bootstrap_poisson(s.repartition(11), n_samples=200))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)
        lo, mid, hi = a[k]
        assert lo <= mid <= hi
    # the interval covers the plain mean
    for t in ("rouge1", "rouge2"):
        m = np.mean([r[2] for r in rows if r[1] == t])
        lo, _, hi = a[(t, "precision")]
        assert lo <= m <= hi


def test_aggregate_report_rows(spark):
    rows = [(i, "rouge1", 0.5, 0.25, 1 / 3) for i in range(5)]
    rep = B.aggregate_report(B.bootstrap_exact(score_frame(spark, rows), n_samples=20)).collect()
    names = sorted((r["_type"], r["_ord"], r["score_type"]) for r in rep)
    assert [n[2] for n in names] == ["rouge1-R", "rouge1-P", "rouge1-F"]


def test_the_method_is_the_callers_and_sizes_change_nothing(spark, monkeypatch):
    from precis import session

    rows = [(i, "rouge1", i / 10, i / 10, i / 10) for i in range(10)]
    s = score_frame(spark, rows)
    exact = as_dict(B.bootstrap_exact(s, n_samples=100))
    assert as_dict(B.aggregate_scores(s, n_samples=100)) == exact
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    got = as_dict(B.aggregate_scores(s, n_samples=100))
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in exact.items())
    with pytest.raises(ValueError):
        B.aggregate_scores(s, "auto")


def test_poisson_takes_wide_scores(spark):
    from precis.operators.rouge import score_columns, score_pairs

    pairs = spark.createDataFrame([(i, "a b c d", "a b " + "x " * i) for i in range(30)], "id long, target string, prediction string")
    types = ["rouge1", "rougeL"]
    wide = as_dict(B.bootstrap_poisson_wide(score_columns(pairs, types), types, n_samples=60))
    long = as_dict(B.bootstrap_poisson(score_pairs(pairs, types), n_samples=60))
    assert wide.keys() == long.keys()
    assert all(wide[k] == pytest.approx(long[k], abs=1e-12) for k in wide)


def test_binomial_draw_follows_the_distribution():
    from math import comb

    from precis.operators.bootstrap import binomial_draw

    for n, p in ((1, 0.5), (7, 0.3), (40, 0.9), (1000, 0.01)):
        k = max(0, int(n * p) - 1)
        grid = [(i + 0.5) / 20_000 for i in range(20_000)]
        share = sum(binomial_draw(u, n, p) == k for u in grid) / len(grid)
        assert abs(share - comb(n, k) * p**k * (1 - p) ** (n - k)) < 2e-4
    draws = [binomial_draw((i + 0.5) / 500, 10**9, 0.25) for i in range(500)]
    assert abs(np.mean(draws) / 2.5e8 - 1) < 1e-4 and 0.9 < np.std(draws) / np.sqrt(1e9 * 0.25 * 0.75) < 1.1
    assert binomial_draw(0.999999, 0, 0.5) == 0 and binomial_draw(1.0, 3, 0.5) <= 3


def test_tree_counts_add_up_and_leaves_are_even():
    from precis.operators.bootstrap import leaf_counts

    totals = np.zeros(13)
    for rep in range(400):
        counts = dict(leaf_counts(rep, 1290, 100, 5))
        assert sum(counts.values()) == 1290
        totals += [counts.get(leaf, 0) for leaf in range(13)]
    expected = np.array([100] * 12 + [90]) * 400
    assert (np.abs(totals - expected) < 5 * np.sqrt(expected)).all()


@pytest.mark.parametrize("partitions", [1, 7])
def test_tree_intervals_are_those_of_plain_resampling(spark, partitions):
    from precis.operators.bootstrap import bootstrap_tree

    rng = np.random.default_rng(2)
    values = rng.random((300, 3))
    rows = [(i, "t", *map(float, v)) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "id long, score_type string, precision double, recall double, fmeasure double")
    got = {r.measure: (r.low, r.mid, r.high) for r in bootstrap_tree(table.repartition(partitions), 2000, 0.9, 1, leaf_rows=40).collect()}
    means = values[rng.integers(0, 300, (2000, 300))].mean(axis=1)
    for k, m in enumerate(("precision", "recall", "fmeasure")):
        assert np.abs(np.array(got[m]) - np.percentile(means[:, k], [5, 50, 95])).max() < 0.004
    whole = {r.measure: (r.low, r.mid, r.high) for r in bootstrap_tree(table, 2000, 0.9, 1, leaf_rows=40).collect()}
    assert all(np.allclose(got[m], whole[m]) for m in whole)  # equal draws whatever the partitions
    assert bootstrap_tree(table.where("false"), 10).collect() == []
