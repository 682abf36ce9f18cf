"""Whitening against an eigendecomposition of the covariance, exact deviations, and rows that can't take part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm.whitening import whiten


def direct(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return ((n * x - s) ** 2).sum(1), centred, e[::-1], q[:, ::-1]


def held_to(rows, ids, vectors, components):
    deviation, centred, e, q = direct(vectors)
    for c in range(1, components + 1):
        got = {r.vec_id: r for r in rows if r.component == c}
        assert [got[i].deviation for i in ids] == deviation.tolist() and {r.n for r in got.values()} == {len(ids)}
        want, have = centred @ q[:, c - 1] / np.sqrt(e[c - 1]), np.array([got[i].whitened for i in ids])
        assert np.abs(want * np.sign(want @ have) - have).max() < 1e-9
        assert all(abs(r.explained / (e[c - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in got.values())


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(3)
    rows = df.collect()
    got = whiten(df).collect()
    assert len(got) == 8 * len(rows)
    held_to(got, [r.vec_id for r in rows], [r.embedding for r in rows], 8)


@pytest.mark.parametrize("rank", [2, 3, 5])
def test_fewer_directions_than_components(spark, rank):
    rng = np.random.default_rng(rank)
    v = (rng.integers(-50, 50, (40, rank)) @ rng.integers(-3, 4, (rank, 6))).astype(float)
    got = whiten(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), 6).collect()
    real = np.linalg.matrix_rank(v - v.mean(0))
    assert {r.component for r in got} == set(range(1, real + 1))
    held_to(got, list(range(40)), v, real)


def test_equal_variances(spark):
    """Each of the four directions has the same variance: all are found, and each whitened column is its own."""
    v = [[s * (10.0 if i == j else 0.0) for j in range(4)] for i in range(4) for s in (1, -1)]
    got = whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 * 4 and all(abs(r.explained - 0.25) < 1e-12 and r.identity_error < 1e-9 for r in got)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 5.0]), (2, [3.0, 1.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "x", "n", "component", "sums")})
    got = whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)] and {r.n for r in got} == {4}
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 4"), df.where("vec_id = 2")):
        assert whiten(none).collect() == []


def test_numbers_past_a_long(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([1e300, -1e300, 0.0, 1e9])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[max(-(1 << 53), min(1 << 53, int(1024 * v))) + 100_000 for v in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((4 * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert {r.vec_id: r.deviation for r in got} == {i: w if w < 1 << 63 else None for i, w in enumerate(want)}
    assert {r.component for r in got} == {1}
