import numpy as np
import pytest
from pyspark.sql import functions as F

from fojas.llm import ann_scan as A

ROWS = "id long, vec array<float>, list int, rank int"


def brute(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(0)
    centres = r.standard_normal((30, 24))
    x = centres[r.integers(0, 30, 4000)] + 0.4 * r.standard_normal((4000, 24))
    x[1000:2500] = x[1000]  # one vector of many rows
    return [(i, x[i].tolist(), 1, 2) for i in range(4000)]


def test_recall_and_exact_scores(spark, rows):
    bad = [(7, None, 0, 0), (9000, None, 0, 0), (9100, [0.0] * 24, 0, 0), (9200, [float("nan")] * 24, 0, 0), (9300, [1.0, None] * 12, 0, 0), (9400, [1.0] * 5, 0, 0), (9500, [], 0, 0), (None, [1.0] * 24, 0, 0), (9600, [float("inf")] * 24, 0, 0)]
    repeated = [rows[5], rows[5], rows[100]]
    got = found(A.search(spark.createDataFrame(rows + bad + repeated, ROWS), F.col("id") % 100 == 0))
    want = brute(rows, range(0, 4000, 100), 10)
    assert set(got) == set(want)
    near = sum(len(set(a for a, _ in got[q]) & set(a for a, _ in want[q])) for q in want)
    assert near >= 0.9 * 10 * len(want)
    scores = {q: dict(brute(rows, [q], 3999)[q]) for q in list(want)[:5]}
    assert all(s == scores[q][i] for q in scores for i, s in got[q])
    assert [i for i, _ in got[1100]] == [1000 + j for j in range(10)]


def test_few_rows(spark):
    rows = [(i, [float(i), 1.0], 0, 0) for i in range(0, 500, 100)]
    assert found(A.search(spark.createDataFrame(rows, ROWS), F.col("id") % 100 == 0)) == brute(rows, range(0, 500, 100), 10)
    assert A.search(spark.createDataFrame([], ROWS), F.col("id") % 100 == 0).collect() == []
    assert A.search(spark.createDataFrame(rows[:1], ROWS), F.col("id") % 100 == 0).collect() == []


def test_scan_keeps_all_within_the_bound():
    r = np.random.default_rng(2)
    x, q = r.standard_normal((5000, 64)), r.standard_normal(64)
    turn = A.rotation(64)
    d = A.distances(x, q)
    bound = np.sort(d)[10]
    left = A.scan(x, x @ turn, q, q @ turn, bound)
    assert np.isin(np.flatnonzero(d <= bound), left).mean() >= 0.9
    assert len(left) < 4000
