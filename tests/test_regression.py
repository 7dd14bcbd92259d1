import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import dist
from ledgerspark.plans import regression

D = "/root/testdata/sf0.001"


def test_least_squares_equals_dense_algebra(spark):
    rows = regression.design(spark, D)
    got = {r.term: r for r in regression.least_squares(rows).collect()}
    names, data = list(got), rows.collect()
    x = np.array([[dict((t.term, t.x) for t in r.terms).get(n, 0.0) for n in names] for r in data])
    y = np.array([r.y for r in data])
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inverse, x)
    w = np.where(h < 1 - 1e-9, (e / np.where(h < 1 - 1e-9, 1 - h, 1)) ** 2, 0)
    error = np.sqrt(np.diag(inverse @ (x.T * w) @ x @ inverse))
    assert got["const"].n == len(y)
    assert np.allclose([got[n].estimate for n in names], beta, rtol=1e-5, atol=1e-6)
    assert np.allclose([got[n].std_error for n in names], error, rtol=1e-4, atol=1e-6)
    r = got[names[-1]]
    k, total = np.linalg.matrix_rank(x), (y - y.mean()) @ (y - y.mean())
    f = ((total - e @ e) / (k - 1)) / ((e @ e) / (len(y) - k))
    assert (r.f_statistic, r.adjusted_r2) == pytest.approx((f, 1 - (e @ e) / (len(y) - k) / (total / (len(y) - 1))), rel=1e-5)
    assert r.f_p_value == pytest.approx(dist.f_sf(f, k - 1, len(y) - k), abs=1e-12)
    assert r.condition == pytest.approx(np.linalg.cond(x / np.linalg.norm(x, axis=0)), rel=1e-3)
    assert r.low == pytest.approx(r.estimate - 1.959964 * r.std_error, rel=1e-5) and r.high > r.estimate > r.low
    assert got["const"].r2 == pytest.approx(1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())), abs=1e-6)


def test_least_squares_of_nothing(spark):
    assert regression.least_squares(regression.design(spark, D).filter(F.lit(False))).count() == 0


def test_studentized_range():
    assert dist.studentized_range_sf(3.877, 3, 10) == pytest.approx(0.05, abs=5e-4)
    assert dist.studentized_range_sf(3.314, 3, 1e6) == pytest.approx(0.05, abs=5e-4)
    assert dist.studentized_range_sf(0.0, 3, 10) == 1


def test_pairs(spark):
    rows = regression.t16_tukey_pairs(spark, D).collect()
    assert len(rows) == 10 and all(0 <= r.p_value <= 1 for r in rows)


def test_whole_of_a_regression():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(50), rng.normal(size=(50, 2))])
    rank, adjusted, f, p, condition = regression.overall(x.T @ x, 50, 0.5)
    assert (rank, round(adjusted, 6)) == (3, round(1 - 0.5 * 49 / 47, 6)) and f == pytest.approx(0.25 / (0.5 / 47)) and 0 < p < 1e-4 and condition < 3
    same = np.column_stack([x, x[:, 1]])
    assert regression.overall(same.T @ same, 50, 0.5)[0] == 3 and regression.overall(same.T @ same, 50, 0.5)[4] == float("inf")
    assert regression.overall(x.T @ x, 50, 1.0)[2] is None and regression.overall(x[:3].T @ x[:3], 3, 0.5)[2] is None
