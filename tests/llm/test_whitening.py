import numpy as np
import pytest

from fojas.llm import whitening as W

SCHEMA = "id long, vec array<float>"


def made(n, d, seed, rank=None):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, rank or d)) @ (r.normal(size=(rank or d, d)) * np.geomspace(3, 0.05, d) if rank is None else r.normal(size=(rank, d)))
    return base.astype(np.float32)


def brute(rows):
    """x, V and eigenpairs of the vectors, by other means: exact integers and numpy's symmetric solver."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    apart = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], object)
    v = (apart.T @ apart).astype(object)
    v = np.array([[float(c) for c in row] for row in v]) / n**3
    values, vectors = np.linalg.eigh(v)
    return n, apart, v, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("components", [32, 5])
def test_equals_brute_force(spark, components):
    rows = [(i, v.tolist()) for i, v in enumerate(made(700, 12, 1))] + [(3, made(1, 12, 2)[0].tolist())] * 300 + [(None, made(1, 12, 3)[0].tolist())]
    junk = [(900, None), (901, []), (902, [1.0] * 11), (903, [1.0] * 11 + [None]), (904, [float("nan")] * 12), (905, [float("inf")] + [0.0] * 11), (906, [1e30] + [0.0] * 11)]
    df = spark.createDataFrame(rows + junk, SCHEMA).repartition(5).selectExpr("*", "1 AS component", "2 AS a", "3 AS v", "4 AS whitened", "5 AS n", "6 AS place")
    got = W.whitened_components(df, components).collect()
    n, apart, v, values, vectors = brute(rows)
    k = min(components, 12)
    assert len(got) == n * k and {r.n for r in got} == {n}
    want = [((i, int((a * a).sum())), (a.astype(float) / n) @ vectors[:, :k] / np.sqrt(values[:k])) for (i, _), a in zip(rows, apart)]
    mine = {}
    for r in got:
        mine.setdefault((r.id, r.deviation), {}).setdefault(r.component, set()).add(r.whitened)
    assert set(mine) == {key for key, _ in want}
    first = max(want, key=lambda w: np.abs(w[1]).min())
    sign = np.array([np.sign(next(iter(mine[first[0]][c + 1])) / first[1][c]) for c in range(k)])
    for key, w in want:
        for c in range(k):
            assert min(abs(x - sign[c] * w[c]) for x in mine[key][c + 1]) < 1e-9
    explained = {r.component: r.explained for r in got}
    assert np.allclose([explained[c + 1] for c in range(k)], values[:k] / np.trace(v), rtol=1e-10)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_fewer_dimensions_than_components(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(made(200, 3, 4))]
    rows = [(i, [v[0], v[1], v[0], v[2], 5.0]) for i, v in rows]
    got = W.whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4])
def test_without_spread_no_rows(spark, rows):
    assert W.whitened_components(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + i * 2**20), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    n, apart, v, values, _ = brute(rows)
    got = W.whitened_components(df).collect()
    assert {r.component: round(r.explained / (values[r.component - 1] / np.trace(v)), 9) for r in got if r.component == 1} == {1: 1.0}
    exact = {i: int((a * a).sum()) for (i, _), a in zip(rows, apart)}
    assert all(r.deviation == (exact[r.id] if exact[r.id] < 2**63 else None) for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_factor_and_turns(seed):
    a = np.random.default_rng(seed).normal(size=(30, 9 + seed)) * np.geomspace(1e4, 1e-3, 9 + seed)
    v = a.T @ a
    factor = W.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v, rtol=1e-10, atol=1e-12 * np.abs(v).max())
    values, vectors = W.jacobi(factor)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(values, np.linalg.svd(factor, compute_uv=False) ** 2, rtol=1e-9)
