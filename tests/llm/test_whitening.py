"""Whitening against an eigendecomposition in numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from textloom.llm import whiten

ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.IntegerType()), T.StructField("dim", T.StringType()), T.StructField("n", T.LongType())])


def table(spark, vectors):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], 1, "d", None) for i, v in vectors], ROW).repartition(3)


def plain(vectors, top=4):
    """{dim: (ids, x, n, sums, variances, components, trace)} by numpy."""
    out = {}
    sound = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    for dim in {len(v) for _, v in sound}:
        ids = [i for i, v in sound if len(v) == dim]
        x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in sound if len(v) == dim])
        fit = np.unique(x, axis=0)
        n, sums = len(fit), fit.sum(axis=0)
        centred = fit - sums / n
        e, u = np.linalg.eigh(centred.T @ centred / n)
        out[dim] = (ids, x, n, sums, e[::-1][:top], u[:, ::-1][:, :top], e.sum())
    return out


def compare(rows, want):
    for dim, (ids, x, n, sums, e, u, trace) in want.items():
        mine = [r for r in rows if r["vec_id"] in set(ids)]
        top = min(4, dim)
        assert len(mine) == top * len(ids)
        w = (x - sums / n) @ u / np.sqrt(e)
        by = {(r["vec_id"], r["component"]): r for r in mine}
        for c in range(top):
            column = np.array([by[i, c + 1]["whitened"] for i in ids])
            assert min(np.abs(column - w[:, c]).max(), np.abs(column + w[:, c]).max()) < 1e-8
        for k, i in enumerate(ids):
            for c in range(top):
                r = by[i, c + 1]
                assert r["n"] == n
                assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True))
                assert abs(r["explained"] - e[c] / trace) < 1e-9
                assert r["identity_error"] < 1e-9


def test_whitened_components(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6)) * 0.3
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    vectors += [(200 + i, vectors[3][1]) for i in range(70)]  # one vector many times counts once
    vectors += [(300, None), (301, [1.0, None, 0, 0, 0, 0]), (302, [math.nan] * 6), (303, [math.inf, 0, 0, 0, 0, 0]), (304, [])]
    rows = whiten.whiten(table(spark, vectors)).collect()
    assert not {r["vec_id"] for r in rows} & {300, 301, 302, 303, 304}
    compare(rows, plain(vectors))


def test_lengths_are_fitted_apart(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(2 if i % 3 else 5)]) for i in range(90)]
    compare(whiten.whiten(table(spark, vectors)).collect(), plain(vectors))


def test_directions_without_extent(spark):
    """Constant and equal entries: as many components as there are directions with variance."""
    rng = random.Random(2)
    vectors = []
    for i in range(60):
        a, b = rng.gauss(0, 1), rng.gauss(0, 2)
        vectors.append((i, [a, a, 3.0, b, 0.0]))
    rows = whiten.whiten(table(spark, vectors)).collect()
    assert {r["component"] for r in rows} == {1, 2}
    assert max(r["identity_error"] for r in rows) < 1e-6
    want = plain(vectors)[5]
    first = {r["vec_id"]: r["whitened"] for r in rows if r["component"] == 1}
    w = (want[1] - want[3] / want[2]) @ want[5][:, 0] / math.sqrt(want[4][0])
    got = np.array([first[i] for i in want[0]])
    assert min(np.abs(got - w).max(), np.abs(got + w).max()) < 1e-6


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [0.5, 0.5])]])
def test_no_variance_gives_no_rows(spark, vectors):
    got = whiten.whiten(table(spark, vectors))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


def test_null_and_equal_ids_stay_rows(spark):
    vectors = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [0.0, 1.5]), (4, [3.0, -1.0]), (5, [-2.0, 0.25])]
    assert len(whiten.whiten(table(spark, vectors)).collect()) == 10


def test_badly_conditioned(spark):
    """Spreads a million to one: the plain covariance would lose the small direction's last digits."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 3)) * np.array([4e3, 3.0, 0.02])
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows = whiten.whiten(table(spark, vectors)).collect()
    assert {r["component"] for r in rows} == {1, 2, 3}
    assert max(r["identity_error"] for r in rows) < 1e-8


def test_large_counts_stay_exact():
    m = whiten.Whitening(10**9, [3 * 10**9 + 1, 5], np.eye(2), np.ones(2), 1.0)
    assert m.deviations(np.array([[3, 0], [4, -2]])) == [1 + 25, (10**9 - 1) ** 2 + (2 * 10**9 + 5) ** 2]
    with pytest.raises(OverflowError):
        m.deviations(np.array([[10**6, -4]]))
