"""Spectra and whitened components against numpy's eigenvalues of the whole covariance."""

import math

import numpy as np
import pytest

from gridspark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, component string, label int"


@pytest.mark.parametrize("d,n,lanes,kind", [(5, 60, 1, "plain"), (12, 200, 4, "plain"), (12, 7, 2, "plain"), (9, 90, 3, "copies"), (6, 50, 2, "flat"), (8, 64, 4, "units")])
def test_spectra(d, n, lanes, kind):
    r = np.random.default_rng(d * n)
    x = np.floor(1024 * r.normal(size=(n, d)) * np.linspace(0.1, 2, d))
    if kind == "copies":
        x[10:70] = x[3]
    if kind == "flat":
        x[:, 2:5] = 7
    if kind == "units":  # equal eigenvalues
        x = np.tile(np.eye(d), (n // d, 1))
    s = W.Spectra(lanes, d)
    for at in range(0, n, lanes):
        rows = x[at:at + lanes]
        times = np.append(np.ones(len(rows)), np.zeros(lanes - len(rows)))
        s.add(np.concatenate([rows, np.zeros((lanes - len(rows), d))]), times)
    one = s.one()
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    top = np.linalg.eigvalsh(scatter).max()
    assert one.n[0] == n and one.mean[0] == pytest.approx(x.mean(axis=0), abs=1e-9)
    assert np.abs(one.values[0] - np.linalg.eigvalsh(scatter)).max() < 1e-8 * top
    v = one.vectors[0]
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-10 and np.abs(v @ np.diag(one.values[0]) @ v.T - scatter).max() < 1e-8 * top


def test_weights_are_repeated_rows():
    r = np.random.default_rng(3)
    x, times = r.normal(size=(20, 6)), r.integers(1, 9, 20)
    one, many = W.Spectra(1, 6), W.Spectra(1, 6)
    for row, t in zip(x, times, strict=True):
        one.add(row[None], np.array([t]))
        for _ in range(t):
            many.add(row[None], np.array([1]))
    assert one.values == pytest.approx(many.values, rel=1e-9) and one.mean == pytest.approx(many.mean)


def test_secular_roots():
    poles, square = np.array([[0.0, 1.0, 1.5, 4.0]]), np.array([[0.3, 1e-9, 2.0, 0.01]])
    after = np.array([[1.0, 1.5, 4.0, np.inf]])
    with np.errstate(all="ignore"):
        away = W.secular_roots(poles, after, square).copy()
    roots = poles[0] - np.diagonal(away[0])
    assert roots == pytest.approx(np.linalg.eigvalsh(np.diag(poles[0]) + np.outer(np.sqrt(square[0]), np.sqrt(square[0]))), rel=1e-12)
    assert away[0] == pytest.approx(poles[0][:, None] - roots[None], abs=1e-12)


def check(got, x, components=8):
    """Rows of one length against the whole covariance."""
    n, sums = len(x), x.sum(axis=0)
    y = (x - sums / n).astype(float)
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, x.shape[1])
    assert [r.component for r in got] == list(range(1, k + 1)) * n and {r.n for r in got} == {n}
    white = np.array([np.nan if r.whitened is None else r.whitened for r in got]).reshape(n, k)
    usable = values[:k] > 1e-9 * max(values[0], 1e-300)
    assert np.isnan(white[:, ~usable]).all()
    want = (y @ vectors[:, :k])[:, usable] / np.sqrt(values[:k][usable])
    sign = np.sign((want * white[:, usable]).sum(axis=0))
    assert white[:, usable] * sign == pytest.approx(want, abs=1e-7)
    assert [r.explained for r in got[:k]] == pytest.approx(list(np.maximum(values[:k], 0) / max(cov.trace(), 1e-300)), abs=1e-9)
    assert max(r.identity_error for r in got) < 1e-9
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert [r.deviation for r in got[::k]] == [e if e < 1 << 63 else None for e in exact]


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening(spark, parts):
    r = np.random.default_rng(parts)
    vectors = [(i, (r.normal(size=12) * np.linspace(0.1, 1, 12)).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(400 + i, vectors[5][1]) for i in range(150)] + [(7, vectors[7][1])]
    short = [(1000 + i, r.normal(size=3).astype(np.float32).tolist()) for i in range(20)]
    odd = [(2000, None), (2001, [1.0, None] * 6), (2002, [math.nan] * 12), (2003, [math.inf] * 12), (2004, []), (2005, [3e38] * 12)]
    rows = vectors + short + odd + [(None, vectors[0][1])]
    df = spark.createDataFrame([(*v, 1, "x", 1) for v in rows], SCHEMA).repartition(parts)
    out = W.whiten(df, fan_in=2)
    assert [f.simpleString() for f in out.schema] == ["vec_id:bigint", "component:int", "n:bigint", "deviation:bigint", "whitened:double", "explained:double", "identity_error:double"]
    got = out.collect()
    ints = {}
    for i, v in vectors + short + [(None, vectors[0][1])]:
        ints.setdefault(i, []).append([math.floor(1024 * float(np.float32(x))) + 100_000 for x in v])
    for length, ids in ((12, [i for i, _ in vectors] + [None]), (3, [i for i, _ in short])):
        keys = sorted(set(ids), key=lambda i: (i is None, i or 0))
        own, x = [], []
        for i in keys:  # equal rows of an id come one after the other
            mine = [r for r in got if r.vec_id == i]
            for copy in range(len(ints[i])):
                own += [[r for r in mine if r.component == c][copy] for c in range(1, min(8, length) + 1)]
                x.append(ints[i][copy])
        check(own, np.array(x))
    assert {r.vec_id for r in got} == {i for i in ints}


@pytest.mark.parametrize("rows", [[[1.0, 2.0]], [[1.0, 2.0]] * 5, [[0.0, 0.0], [1.0, 1.0]], [[2.0 ** 40, 1.0], [1.0, 2.0], [-2.0 ** 41, 5.0]], [[1.0], [2.0], [4.0]]])
def test_few_and_large_rows(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x", 1) for i, v in enumerate(rows)], SCHEMA)
    got = sorted(W.whiten(df).collect(), key=lambda r: (r.vec_id, r.component))
    x = [[math.floor(1024 * v) + 100_000 for v in row] for row in rows]
    check(got, np.array(x))


def test_no_vectors(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None, 1, "x", 1), (2, [], 1, "x", 1)], SCHEMA)).count() == 0
