"""Whitening against numpy's eigendecomposition of the whole covariance."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from corpusloom.llm import whitening as wh

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("y", T.IntegerType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], VECTORS)


def exact(vectors, count):
    x = np.floor(64 * np.asarray(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1][:, :count]
    white = (x - sums / n) @ axes / np.sqrt(values[:count])
    return n, ((n * x - sums) ** 2).sum(axis=1), white, values[:count] / values.sum()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 30), st.integers(0, 5), st.integers(0, 2**32 - 1))
def test_updates_keep_the_decomposition(d, count, kind, seed):
    draw = np.random.default_rng(seed)
    values, basis, total = np.zeros(d), np.eye(d), np.zeros((d, d))
    vector = np.ones(d)
    for k in range(count):
        fresh = draw.normal(size=d) * 10.0 ** draw.integers(-4, 4)
        fresh[draw.random(d) < kind / 6] = 0
        vector = vector if k % 3 == 2 else fresh
        values, basis = wh.rank_one(values, basis, vector)
        total += np.outer(vector, vector)
    scale = max(np.abs(total).max(), 1e-300)
    assert np.all(np.diff(values) >= 0) and np.abs(basis.T @ basis - np.eye(d)).max() < 1e-12
    assert np.abs(basis * values @ basis.T - total).max() < 1e-11 * scale


@pytest.mark.parametrize(("d", "group", "fold"), [(5, 16, 4096), (20, 2, 16)])
def test_equals_whole_decomposition(spark, monkeypatch, d, group, fold):
    monkeypatch.setattr(wh, "_GROUP", group)
    monkeypatch.setattr(wh, "_FOLD", fold)
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(300, d)) * np.linspace(1, 3, d)
    vectors = np.concatenate((vectors, vectors[:40], np.repeat(vectors[:1], 100, axis=0))).astype(np.float32)
    got = wh.whitened(table(spark, [(k, v.tolist()) for k, v in enumerate(vectors)]).repartition(5), 16).collect()
    count = min(16, d)
    n, deviation, white, explained = exact(vectors, count)
    got.sort(key=lambda r: (r.vec_id, r.component))
    assert [r.component for r in got] == list(range(1, count + 1)) * len(vectors) and {r.n for r in got} == {n}
    assert [r.deviation for r in got[::count]] == deviation.tolist()
    found = np.array([r.whitened for r in got]).reshape(-1, count)
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() < 1e-8
    assert np.abs(np.array([r.explained for r in got[:count]]) / explained - 1).max() < 1e-10
    assert {r.identity_error < 1e-10 for r in got} == {True} and len({r.identity_error for r in got}) == 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]),
        (None, [4.0, 1.0, 0.0]), (6, [3.0]), (7, []), (8, [3e38, -3e38]),
    ]
    got = wh.whitened(table(spark, rows[:9])).collect()
    assert sorted({(r.vec_id is None, r.vec_id or 0) for r in got}) == [(False, 5), (False, 6), (False, 7), (True, 0)]
    assert len(got) == 5 * 3 and {r.n for r in got} == {4}
    # The third dimension never varies.
    assert {(r.component, r.whitened is None, r.explained == 0) for r in got} == {(1, False, False), (2, False, False), (3, True, True)}
    _, deviation, _, _ = exact([[1, 2, 0], [4, 1, 0], [3, 0, 0], [0, 0, 0]], 2)
    assert sorted({r.deviation for r in got}) == sorted(deviation.tolist())
    huge = {r.vec_id: r for r in wh.whitened(table(spark, rows[4:])).where("component = 1").collect()}
    assert huge[8].deviation is None and np.isfinite(huge[8].whitened)
    alone = wh.whitened(table(spark, rows[4:6])).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in alone} == {(None, None, None, 0, 1)}
    assert wh.whitened(table(spark, [])).collect() == [] and wh.whitened(table(spark, [(1, []), (2, None)])).collect() == []
