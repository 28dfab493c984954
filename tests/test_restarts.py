"""All alarms of restarting detectors against a plain loop over the stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import restarts as rs


def frame(spark, x):
    rows = [(i, None if math.isnan(v) else float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "i bigint, err double").repartition(6)


def page_hinkley(x, delta=0.005, threshold=50.0, least=30):
    n = total = m = 0
    low, out = math.inf, []
    for i, v in enumerate(x):
        if math.isnan(v):
            continue
        v = math.floor(v * 1_000_000 + 0.5)
        n, total = n + 1, total + v
        m += math.floor(v - total / n - delta * 1_000_000 + 0.5)
        low = min(low, m)
        if n >= least and m - low > threshold * 1_000_000:
            out.append(i)
            n = total = m = 0
            low = math.inf
    return out


def ddm(errors, least=30, level=3.0):
    n = e = 0
    best, edge, out = math.inf, math.inf, []
    for i, v in enumerate(errors):
        if v is None:
            continue
        n, e = n + 1, e + int(v)
        p = e / n
        s = math.sqrt(p * (1 - p) / n)
        if n < least:
            continue
        if p + s <= best:
            best, edge = p + s, p + level * s
        if p + s > edge:
            out.append(i)
            n = e = 0
            best = edge = math.inf
    return out


def got(df, *cols):
    return sorted(tuple(r[c] for c in (*cols, "i")) for r in df.collect())


def stream(kind, n=12_000):
    rng = np.random.default_rng(5)
    x = rng.normal(20, 4, n)
    if kind == "quiet":  # one rise after many blocks without an alarm
        x = rng.normal(20, 0.3, n)
        x[9000:9200] += 1
    if kind == "steps":
        for a in range(1000, n, 1700):
            x[a:a + 300] += 9
    if kind == "nulls":
        x = rng.normal(20, 25, n)
        x[::7] = np.nan
        x[3000:3600] = np.nan  # whole blocks
    if kind == "busy":
        x = rng.exponential(40, n)
    return x


@pytest.mark.parametrize("kind", ["quiet", "steps", "nulls", "busy"])
def test_page_hinkley_alarms_equal_a_plain_loop(spark, kind):
    x = stream(kind)
    wanted = page_hinkley(x)
    assert wanted
    block, ahead = (250, 16) if kind in ("quiet", "nulls") else (2000, 2)
    assert [i for (i,) in got(rs.page_hinkley_alarms(frame(spark, x), block=block, ahead=ahead))] == wanted


def test_ddm_alarms_equal_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    rate = np.full(10_000, 0.2)
    rate[4000:4400], rate[7000:] = 0.6, 0.45
    x = np.where(rng.random(10_000) < rate, 1.0, 0.0)
    x[::11] = np.nan
    wanted = ddm([None if math.isnan(v) else v for v in x])
    assert len(wanted) > 1
    assert [i for (i,) in got(rs.ddm_alarms(frame(spark, x), F.col("err") > 0.5, block=1500, ahead=8))] == wanted


def test_series_have_detectors_of_their_own(spark):
    parts = {"a": stream("steps", 4000), "b": stream("busy", 2500), None: stream("nulls", 3000)}
    rows = [(k, i, None if math.isnan(v) else float(v)) for k, x in parts.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i bigint, err double").repartition(5)
    alarms = rs.page_hinkley_alarms(df, series=["k"], block=400, ahead=4).collect()
    for k, x in parts.items():
        assert sorted(r.i for r in alarms if r.k == k) == page_hinkley(x)


def test_long_stream(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(10, 3, 100_000)
    x[40_000:41_000] += 3
    x[41_000:60_000] += 12 * (rng.random(19_000) < 0.3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i bigint, err double")
    assert [i for (i,) in got(rs.page_hinkley_alarms(df, block=4096))] == page_hinkley(x) != []


def test_empty_short_and_constant_streams(spark):
    assert got(rs.page_hinkley_alarms(frame(spark, []).limit(0))) == []
    assert got(rs.page_hinkley_alarms(frame(spark, [1.0, math.nan]))) == []
    x = stream("busy", 1500)
    x[::9] = np.nan
    bad = spark.createDataFrame([(i, float("nan") if i % 2 and v != v else float("inf") if v != v else float(v)) for i, v in enumerate(x)], "i bigint, err double")
    assert [i for (i,) in got(rs.page_hinkley_alarms(bad, block=700))] == page_hinkley(x) != []
    assert got(rs.ddm_alarms(frame(spark, [1.0] * 500), F.col("err") > 0.5, block=100)) == []


def test_a_scan_joins_the_one_before_at_a_shared_alarm():
    x = np.floor(np.random.default_rng(8).exponential(40, 3000) * rs.UNIT).astype(np.int64)
    det = rs.PageHinkleyUnits()
    known, left = rs.scan(det, det.fresh, x)
    other = (50, 50 * 30 * rs.UNIT, 0, 0)
    assert rs.scan(det, other, x, known, left) == rs.scan(det, other, x)
    assert rs.scan(det, other, x)[0][0] != known[0]
