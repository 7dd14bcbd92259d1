import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import series
from ledgerspark.plans import seasonal


def months(n, f):
    return [(f"{2020 + i // 12}-{i % 12 + 1:02d}-01", float(f(i))) for i in range(n)]


def long_of(spark, named):
    rows = [(name, m, v) for name, ms in named.items() for m, v in ms]
    return spark.createDataFrame(rows, "series string, month_start string, value double").withColumn("month_start", F.to_date("month_start"))


def test_stl_adds_up_and_finds_the_season():
    i = np.arange(60)
    y = 5 + 0.01 * i + np.where(i % 12 == 11, 0.7, 0.0) + 0.02 * np.cos(i * i)
    trend, season, rest = series.stl(y)
    assert np.allclose(trend + season + rest, y)
    assert all(np.argmax(season[k : k + 12]) == 11 for k in range(0, 60, 12))
    assert np.abs(rest).max() < 0.1 and abs(np.polyfit(i, trend, 1)[0] - 0.01) < 0.002


def test_outliers_and_series_without_rows(spark):
    wave = lambda i: 1000 * 1.01**i * (1.5 if i % 12 == 11 else 1) * (1 + 0.01 * np.cos(i * i))
    data = {"planted": months(48, lambda i: wave(i) * (0.5 if i == 30 else 1)), "short": months(23, wave), "negative": months(30, lambda i: i - 5), "gap": months(40, wave)[:20] + months(40, wave)[21:], "flat": months(30, lambda i: 7)}
    found = seasonal.decompose(long_of(spark, data)).collect()
    assert {r.series for r in found} == {"planted", "flat", "gap"}  # a missing month is put in
    assert max((r for r in found if r.series == "planted"), key=lambda r: abs(r.score)).month_start.isoformat() == "2022-07-01"
    assert all(abs(r.score) < 2.5 for r in found if r.series == "flat")
    tests = seasonal.stationarity(long_of(spark, data)).collect()
    assert {r.series for r in tests} == {"planted", "flat", "gap"} and all(r.p_value is None for r in tests if r.series == "flat" and r.test.startswith("ljung"))
    assert {r.series for r in seasonal.correlogram(long_of(spark, data)).collect()} == {"planted", "gap"}


def test_unit_root_tests_hold_their_size():
    # Under its own null each test rejects about one series in twenty; under the other's it mostly does.
    rng = np.random.default_rng(1)
    noise = rng.normal(size=(200, 150))
    walk = noise.cumsum(axis=1)
    share = lambda test, ys: np.mean([test(y)[1] < 0.05 for y in ys])
    assert 0.01 <= share(series.adf, walk[:60]) + 0.01 <= 0.15 and share(series.adf, noise[:60]) > 0.8
    assert 0.01 <= share(series.kpss, noise) <= 0.10 and share(series.kpss, walk) > 0.6
    assert series.adf(np.ones(40)) is None and series.kpss(np.arange(40.0)) is None


def test_partial_autocorrelation_of_an_autoregression():
    rng, y = np.random.default_rng(3), [0.0]
    for e in rng.normal(size=4000):
        y.append(0.6 * y[-1] + e)
    p = series.pacf(np.array(y), 3)
    assert p[1] == pytest.approx(0.6, abs=0.05) and abs(p[2]) < 0.05 and abs(p[3]) < 0.05
    assert series.ljung_box(np.array(y), 6)[1] < 1e-6


def test_bootstrap_agrees_with_the_closed_form(spark):
    df = spark.range(20_000).select("id", (F.abs(F.hash("id")) % 1000).alias("v"))
    m = df.agg(F.avg("v").alias("m"), F.stddev("v").alias("s")).first()
    r = seasonal.bootstrap(df, F.col("id"), F.col("v"), F.lit(1), draws=2000, blocks=500).first()
    half = 1.96 * m.s / 20_000**0.5
    assert r.draws == 2000 and r.estimate == pytest.approx(m.m)
    assert r.low == pytest.approx(m.m - half, abs=half * 0.25) and r.high == pytest.approx(m.m + half, abs=half * 0.25)
    assert seasonal.bootstrap(df.limit(0), F.col("id"), F.col("v"), F.lit(1)).first().estimate is None


def test_missing_months_are_put_in(spark):
    import datetime

    months = [datetime.date(2018 + k // 12, k % 12 + 1, 1) for k in range(60)]
    value = [float(100 * 1.01**k * (1.4 if k % 12 == 11 else 1)) for k in range(60)]
    rows = [("whole", m, v) for m, v in zip(months, value)] + [("gap", m, v) for k, (m, v) in enumerate(zip(months, value)) if k not in (20, 21, 33)]
    long = spark.createDataFrame(rows, "series string, month_start date, value double")
    full = seasonal.complete(long, "series")
    assert full.filter("series = 'gap'").count() == 60 and full.filter("NOT present").count() == 3 == full.filter("value IS NULL").count()
    back = seasonal.lagged(full, "value", 12, "series")
    year = {r.month_start: r.b for r in full.filter("series = 'gap'").select("month_start", back.alias("b")).collect()}
    assert year[months[45]] is None and year[months[46]] == value[34] and year[months[32]] is None and year[months[30]] == value[18]
    got = seasonal.decompose(long).collect()
    own = {r.month_start: r for r in got if r.series == "gap"}
    assert len(own) == 57 and months[20] not in own and len([r for r in got if r.series == "whole"]) == 60
    assert abs(own[months[47]].residual) < 0.05 and own[months[47]].seasonal > 0.2  # December stays December behind a gap
    assert {r.series for r in seasonal.stationarity(long).collect()} == {"whole", "gap"}
    assert seasonal.complete(long.limit(0), "series").count() == 0


def test_intervals_of_a_median(spark):
    """Known samples: the interval's width is that of the median's own error, and it covers the truth about as often as it says."""
    rng = np.random.default_rng(12)
    hit, widths = 0, []
    for k in range(6):
        x = rng.lognormal(0, 1, 4000)
        got = seasonal.bootstrap_quantile(spark.createDataFrame([(float(v),) for v in x], "x double"), F.col("x"), draws=300, seed=k).first()
        assert got.estimate == pytest.approx(float(np.median(x))) and got.draws == 300 and got.n == 4000
        hit += got.low <= 1 <= got.high
        widths.append(got.high - got.low)
    error = 1 / (2 * np.sqrt(4000) / np.sqrt(2 * np.pi))  # 1 / (2 f(m) sqrt(n)), with f(1) = 1 / sqrt(2 pi)
    assert hit >= 4 and np.mean(widths) == pytest.approx(2 * 1.96 * error, rel=0.25)
    small = seasonal.bootstrap_quantile(spark.createDataFrame([(float(v),) for v in (1, 2, 2, 9)], "x double"), F.col("x"), draws=200).first()
    assert small.estimate == 2 and 1 <= small.low <= small.high <= 9
    none = seasonal.bootstrap_quantile(spark.createDataFrame([(None,)], "x double"), F.col("x"), draws=10).first()
    assert none.estimate is None and none.n == 0
