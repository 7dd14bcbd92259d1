"""Ranks by ranges: equal to those of the whole relation, whatever the values; frequent values stay where they are."""

import random

import numpy as np
import pandas as pd
import pytest

from ledgerspark.operators import ranges

R = random.Random(5)
ROWS = [(R.choice([0.0, 0.0, 1.5, R.random()]), None if i % 11 == 0 else R.gauss(0, 1), float(i % 7), 3.0) for i in range(6000)]


def test_spearman_equals_ranks_of_the_whole_relation(spark):
    df = spark.createDataFrame(ROWS, "a double, b double, c double, d double").repartition(3)
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "b"), ("a", "d"), ("b", "b")]
    got = {r["pair"]: r for r in ranges.spearman(df, pairs).collect()}
    own = pd.DataFrame(ROWS, columns=list("abcd"))
    for p, (a, b) in enumerate(pairs):
        both = pd.DataFrame({"x": own[a], "y": own[b]}).dropna()
        want = both["x"].rank().corr(both["y"].rank())
        assert got[p]["n"] == len(both)
        assert got[p]["rho"] is None if np.isnan(want) else got[p]["rho"] == pytest.approx(want, abs=1e-9)
    assert ranges.spearman(df.limit(0), pairs).count() == 0 and ranges.spearman(df.filter("b IS NULL"), [("a", "b")]).count() == 0


def test_a_frequent_value_is_a_bound_and_never_travels(spark):
    df = spark.createDataFrame(ROWS, "a double, b double, c double, d double")
    at = ranges.bounds(df, len(ROWS), {"a": df.a, "c": df.c})
    assert set(at[("a",)]) >= {0.0, 1.5} and len(at[("a",)]) <= ranges.ranges_for(len(ROWS)) + 1
    assert list(ranges.place(np.array([0.0, 1.5]), at[("a",)]) % 2) == [1, 1]
    assert ranges.ranges_for(10**12) == ranges.MOST
