"""Whitening against a dense eigensolver and exact integers."""

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyloom.llm import whitening

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    *(T.StructField(n, T.StringType()) for n in ("x", "id", "n", "component")),
])


def frame(spark, vectors, parts=4):
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v], *"wwww") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors):
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    distinct = np.array(sorted(set(map(tuple, x))), np.int64)
    mean = distinct.mean(axis=0)
    cov = (distinct - mean).T @ (distinct - mean) / len(distinct)
    e, u = np.linalg.eigh(cov)
    sums = distinct.sum(axis=0).tolist()
    dev = [sum((len(distinct) * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return np.array(x), distinct, mean, e[::-1], u[:, ::-1], dev, np.trace(cov)


@pytest.mark.parametrize("d", [3, 40])
def test_whitening_equals_dense(spark, d):
    rng = np.random.default_rng(d)
    vectors = list(rng.standard_normal((300, d)) * np.linspace(3, 0.5, d))
    vectors += [vectors[0]] * 50 + [vectors[1]]
    bad = [None, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1.0] * (d + 1), []]
    df = frame(spark, vectors + bad)
    w = whitening.fit(df)
    out = whitening.whiten(df, w).collect()
    x, distinct, mean, e, u, dev, trace = brute(vectors)
    k = min(16, d)
    assert len(out) == len(vectors) * k and {r.component for r in out} == set(range(1, k + 1))
    found = np.zeros((len(vectors), k))
    for r in out:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.n == len(distinct) and r.deviation == dev[r.vec_id] and r.identity_error < 1e-10
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-10)
    wanted = (x - mean) @ u[:, :k] / np.sqrt(e[:k])
    sign = np.sign((found * wanted).sum(axis=0))
    assert np.abs(found - wanted * sign).max() < 1e-8


def test_edges(spark):
    none = whitening.fit(frame(spark, []))
    assert whitening.whiten(frame(spark, []), none).collect() == []
    same = frame(spark, [[1.0, 2.0]] * 5)
    assert whitening.whiten(same, whitening.fit(same)).collect() == []
    line = frame(spark, [[k, 2 * k, 0] for k in range(5)])  # one direction only
    out = whitening.whiten(line, whitening.fit(line)).collect()
    assert {r.component for r in out} == {1} and all(r.explained == pytest.approx(1) for r in out)


def test_large_numbers_stay_exact(spark):
    vectors = [[2.0**30 * k, 1.0] for k in range(6)]
    df = frame(spark, vectors)
    out = {r.vec_id: r.deviation for r in whitening.whiten(df, whitening.fit(df)).collect()}
    dev = brute(vectors)[5]
    assert out == {k: v if v < 1 << 63 else None for k, v in enumerate(dev)}


def test_pairs_of_a_wide_matrix():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((700, 300)) * np.linspace(2, 1, 300)
    a = a.T @ a / 700
    asked = []

    def product(v):
        asked.append(v.shape[1])
        return a @ v

    values, vectors = whitening.leading_pairs(product, 300, 16)
    e, u = np.linalg.eigh(a)
    assert np.abs(np.sort(values)[::-1] - e[::-1][:16]).max() < 1e-11
    assert np.abs(np.abs((vectors[:, np.argsort(-values)] * u[:, ::-1][:, :16]).sum(axis=0)) - 1).max() < 1e-10
    assert len(asked) < 200 and np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((12, 12))
    a, b = a + a.T, rng.standard_normal((12, 3))
    x = whitening.minres(lambda v: a @ v, b, 40, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-8
