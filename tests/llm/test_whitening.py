import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouch.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(rows):
    """n, whole numbers, their sums: plain Python."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _i, v in rows]
    return len(x), x, [sum(c) for c in zip(*x)]


def check(got, rows, most=32):
    n, x, s = exact(rows)
    c = np.array([[float(Fraction(n * e - t, n)) for e, t in zip(v, s)] for v in x])
    cov = c.T @ c / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > 1e-13 * e[0]).sum()))
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == n * k and set(by_id) == {i for i, _v in rows}
    w = np.array([[by_id[i][j + 1]["whitened"] for j in range(k)] for i, _v in rows])
    for (i, _v), row in zip(rows, x):
        assert by_id[i][1]["deviation"] == sum((n * a - t) ** 2 for a, t in zip(row, s)) and by_id[i][1]["n"] == n
    for j in range(k):
        assert by_id[rows[0][0]][j + 1]["explained"] == pytest.approx(e[j] / e.sum(), rel=1e-8)
    flat = w - w.mean(axis=0)
    err = np.abs(flat.T @ flat / n - np.eye(k)).max()
    assert err < 1e-8 and abs(got[0]["identity_error"] - err) < 1e-8
    # The direction is the eigenvector: project with numpy's and compare up to sign.
    for j in range(k):
        gap = min([abs(e[j] - e[i]) for i in range(len(e)) if i != j], default=e[j])
        if gap > 1e-6 * e[0]:
            want = c @ q[:, j] / math.sqrt(e[j])
            assert min(np.abs(w[:, j] - want).max(), np.abs(w[:, j] + want).max()) < 1e-7


@pytest.mark.parametrize("dim,n", [(64, 500), (40, 90), (5, 400), (1, 30), (48, 20)])
def test_whitened_rows_equal_numpy(spark, dim, n):
    rng = np.random.default_rng(dim)
    mix = rng.normal(size=(dim, dim)) * np.exp(-np.arange(dim) / 9)
    data = (rng.normal(size=(n, dim)) @ mix).astype(np.float32)
    data[n // 2:n // 2 + n // 3] = data[0]  # one vector is a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(40)
    check(W.whitened(df).collect(), rows)


def test_dirty_rows_are_left_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(50)]
    dirty = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + dirty], SCHEMA)
    for name in ("vector", "n", "piece", "component", "a.b"):
        df = df.withColumn(name, F.lit(name))
    check(W.whitened(df).collect(), rows)


def test_no_variance_nulls_repeats_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    assert W.whitened(same).count() == 0
    assert W.whitened(same.limit(0)).count() == 0
    assert W.whitened(spark.createDataFrame([(1, [], 0)], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(None, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (3, [0.0, 0.5], 0)], SCHEMA)
    out = W.whitened(twice).collect()
    assert len(out) == 3 and {r["component"] for r in out} == {1}
    assert len({r["whitened"] for r in out if r["vec_id"] is None}) == 1


def test_values_beyond_long_are_defined(spark):
    rows = [(0, [3e38, 0.0]), (1, [0.0, 1.0]), (2, [1.0, -1.0])]
    out = W.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {r["deviation"] for r in out} == {None} and all(math.isfinite(r["whitened"]) for r in out)


def solve(r):
    values, vectors, total = W.directions(r, len(r))
    u, s, vt = np.linalg.svd(r)
    k = len(values)
    assert k == int((s > 1e-12 * s[0]).sum()) and total == pytest.approx((s ** 2).sum(), rel=1e-12)
    assert np.allclose(np.sqrt(values), s[:k], rtol=1e-11, atol=1e-13 * s[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() < 1e-12 * s[0] ** 2 * len(r)


def test_solver_on_repeated_close_graded_and_missing_values():
    rng = np.random.default_rng(4)
    for d in (2, 3, 17, 64, 120):
        q1, q2 = np.linalg.qr(rng.normal(size=(d, d)))[0], np.linalg.qr(rng.normal(size=(d, d)))[0]
        for s in (rng.random(d) + 0.1, np.ones(d), np.exp(-np.arange(d) / 4.0), np.where(np.arange(d) < d // 2 + 1, 3.0, 1.0) + 1e-7 * rng.random(d),
                  np.where(np.arange(d) < d // 2 + 1, 1.0, 0.0), 1 + 1e-5 * np.arange(d)):
            keep = s > 1e-9 * s.max()
            solve(np.triu(np.linalg.qr(q1 @ np.diag(np.where(keep, s, 0)) @ q2)[1]))
    solve(np.diag([3.0, 3.0, 2.0, 0.0]))
    solve(np.diag(np.full(20, 2.0)) + np.diag(np.full(19, 1.0), 1))


def test_dqds_has_high_relative_accuracy():
    a = np.array([1e8, 1.0, 1e-4, 1e-9])
    b = np.array([1e2, 1e-3, 1e-8])
    got = sorted(W.squared_singular_values(a, b))
    from decimal import Decimal, getcontext

    getcontext().prec = 120
    d = [Decimal(float(x)) for x in a]
    o = [Decimal(float(x)) for x in b]

    def below(x):  # Sturm count of B'B in 120 digits
        t, n = None, 0
        for i in range(len(d)):
            diag = d[i] ** 2 + (o[i - 1] ** 2 if i else 0) - x
            t = diag - ((d[i - 1] * o[i - 1]) ** 2 / t if i else 0)
            n += t < 0
        return n

    for k, v in enumerate(got):
        lo, hi = Decimal(v) * (1 - Decimal(10) ** -13), Decimal(v) * (1 + Decimal(10) ** -13)
        assert below(lo) == k and below(hi) == k + 1
