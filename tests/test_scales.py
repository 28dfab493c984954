"""Alarms over all scales against a plain walk, the permutation control and what they must catch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scales as sc


def frame(spark, x, series=None):
    rows = [(i, None if v is None or math.isnan(v) else float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "i bigint, err double").repartition(6)


def walk(x, block, delta=0.002):
    """Plain loop: block by block, all scales, the window starting anew at the cut."""
    x = [None if v is None or math.isnan(v) else round(v, 12) for v in x]
    blocks = [[v for v in x[a:a + block] if v is not None] for a in range(0, len(x), block)]
    start, out = 0, {}
    fired = []
    for hi in range(2, len(blocks) + 1):
        level = 0
        while 2 << level <= hi:
            cut, lo = hi - (1 << level), hi - (2 << level)
            before, after = [v for b in blocks[lo:cut] for v in b], [v for b in blocks[cut:hi] for v in b]
            if min(len(before), len(after)) >= 5:
                n, inv = len(before) + len(after), 1 / len(before) + 1 / len(after)
                d = math.log(2 * math.log(n) / delta)
                bound = math.sqrt(2 * inv * np.var(before + after) * d) + 2 / 3 * inv * d
                if abs(np.mean(after) - np.mean(before)) > bound:
                    fired.append((hi, level, cut, lo))
            level += 1
    while True:
        later = [f for f in fired if f[3] >= start]
        if not later:
            return [(i, cut, level) for i, (cut, level) in sorted(out.items())]
        hi, level, start, _ = min(later)
        at = min(hi * block, len(x)) - 1
        out[at] = (start, out.get(at, (0, level))[1])


def alarms(df, **kw):
    return sorted((r.i, r.cut, r.level) for r in sc.scale_alarms(df, **kw).collect())


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(5, 1, n)


def test_alarms_equal_a_plain_walk(spark):
    x = noise(2500)
    x[600:900] += 2
    x[1400:] += np.linspace(0, 2, 1100)
    x[::37] = np.nan
    assert alarms(frame(spark, x)) == walk(x, 32) != []
    assert alarms(frame(spark, x[:1999]), block=100) == walk(x[:1999], 100)


def test_slow_drift_small_shift_and_nulls(spark):
    """0.1 standard deviations a block of 500 rows over ten blocks; a lasting shift of 0.1; a step with a null behind it."""
    slow = noise(20_000)
    slow += 0.1 * np.clip((np.arange(20_000) - 8000) // 500, 0, 10)
    small = noise(60_000, 1)
    small[30_000:] += 0.1
    step = noise(4000, 2)
    step[2000:] += 1
    step[2100] = np.nan
    got = [sc.scale_alarms(frame(spark, x)).collect() for x in (slow, small, step, noise(60_000, 3))]
    assert got[0] and got[1] and got[2] and not got[3]
    assert all(r.i > 30_000 for r in got[1]) and all(r.mean_after > r.mean_before for rows in got for r in rows)


def test_series_have_windows_of_their_own(spark):
    x, y = noise(1500), noise(1500, 1)
    x[700:] += 1.5
    y[300:500] += 3
    df = frame(spark, x).withColumn("s", F.lit("x")).unionByName(frame(spark, y).withColumn("s", F.lit(None)))
    got = {}
    for r in sc.scale_alarms(df, series=["s"]).collect():
        got.setdefault(r.s, []).append((r.i, r.cut, r.level))
    assert {k: sorted(v) for k, v in got.items()} == {"x": walk(x, 32), None: walk(y, 32)}


def test_empty_and_short_streams(spark):
    assert sc.scale_alarms(frame(spark, noise(40)).where("false")).collect() == []
    assert sc.scale_alarms(frame(spark, noise(40))).collect() == []
    assert sc.scale_alarms(frame(spark, [float("nan")] * 400)).collect() == []


@pytest.mark.parametrize("total", [1, 2, 3, 10, 99, 1000, 12_345])
def test_permutation_is_a_bijection(spark, total):
    cols = [sc.permuted(F.col("id"), total, s).alias(f"j{s}") for s in (0, 1)]
    rows = spark.range(total).select(*cols).collect()
    for s in (0, 1):
        assert sorted(r[f"j{s}"] for r in rows) == list(range(total))
    if total >= 1000:
        j = np.array([r.j0 for r in rows])
        assert abs(np.corrcoef(np.arange(total), j)[0, 1]) < 0.1 and np.mean(np.abs(np.diff(j)) < total / 10) < 0.3
        assert [r.j0 for r in rows] != [r.j1 for r in rows]


def test_control_has_no_alarms_where_the_stream_has(spark):
    x = noise(4000)
    x[2000:] += 1
    df = frame(spark, x)
    got = sc.permutation_control(df, 4000, range(5)).collect()
    assert sorted(r.seed for r in got) == list(range(5)) and sum(r.alarms for r in got) == 0
    assert alarms(df)


def test_stream_equals_batch_on_any_cut(spark, tmp_dir):
    """Random micro-batches, one of them run twice, a series that starts late and null errors."""
    from tidemark.streaming.scale_state import ScaleStream

    x, y = noise(1700), noise(900, 1)
    x[800:] += 1.5
    x[::29] = np.nan
    y[400:] -= 2
    rows = [("x", i, None if math.isnan(v) else float(v)) for i, v in enumerate(x)] + [(None, i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "s string, i bigint, err double")
    cuts = [0, 7, 640, 1005, 1300, 1700]
    stream = ScaleStream(f"{tmp_dir}/state", f"{tmp_dir}/out", ["s"])
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = df.where((F.col("s").isNotNull() & F.col("i").between(a, b - 1)) | (F.col("s").isNull() & F.col("i").between(a - 640, b - 641)))
        for _ in range(2 if n == 2 else 1):
            stream.process(part, n)
    got = spark.read.parquet(f"{tmp_dir}/out").drop("batch_id").unionByName(stream.finish(spark))
    seen = df.where("s IS NOT NULL OR i < 1060")
    key = lambda r: (r.s or "", r.i, r.cut, r.level, round(r.score, 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, sc.scale_alarms(seen, series=["s"]).collect())) != []


def test_runs_of_a_streamed_query_are_few_and_take_every_arrival_once():
    from tidemark.plans.alarms import MOST_ARRIVALS
    from tidemark.plans.trees import stretches

    assert stretches(0) == [] and stretches(1) == [(0, 1)]
    for total in (3, 147, 9000):
        runs = stretches(total, MOST_ARRIVALS)
        assert [a for lo, hi in runs for a in range(lo, hi)] == list(range(total))
    assert len(stretches(147, MOST_ARRIVALS)) <= 5 and len(runs) <= 6 + 9000 / MOST_ARRIVALS


def test_boundaries_travel_by_chunks_not_by_test(spark, monkeypatch):
    """Many chunks, with a series that ends early: same alarms, and no join that carries a row for every test."""
    monkeypatch.setattr(sc, "CHUNK", 8)
    x, y = noise(2500), noise(700, 1)
    x[600:900] += 2
    y[400:] += 2
    df = frame(spark, x).withColumn("s", F.lit("x")).unionByName(frame(spark, y).withColumn("s", F.lit(None)))
    got = {k: sorted((r.i, r.cut, r.level) for r in sc.scale_alarms(df, series=["s"]).collect() if r.s == k) for k in ("x", None)}
    assert got == {"x": walk(x, 32), None: walk(y, 32)}
    prefix = sc.block_prefix(sc.block_sums(frame(spark, x)))
    assert "Join" not in sc.scale_tests(prefix)._jdf.queryExecution().toString()


def test_differences_of_exact_sums_are_exact():
    from decimal import Decimal

    rng = np.random.default_rng(5)
    a = [int(v) * 10 ** int(k) + int(w) for v, w, k in zip(rng.integers(-10 ** 15, 10 ** 15, 300), rng.integers(0, 10 ** 9, 300), rng.integers(0, 20, 300), strict=True)]
    halves = lambda v: np.frombuffer(b"".join(x.to_bytes(16, "little", signed=True) for x in v), np.int64).reshape(-1, 2)
    got = sc._difference(halves(a), halves(a[1:] + a[:1]))
    want = [float((Decimal(x) - Decimal(y)) / Decimal(10 ** 12)) for x, y in zip(a, a[1:] + a[:1], strict=True)]
    assert np.allclose(got, want, rtol=2e-16, atol=0)
