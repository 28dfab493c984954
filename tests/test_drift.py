"""Drift detectors and PSI (modelled on the reference's drift tests)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import psi as ps


def test_adwin_fires_on_jump(spark):
    rng = np.random.default_rng(1)
    err = np.abs(np.concatenate([rng.normal(0, 0.1, 1000), rng.normal(5, 0.1, 1000)]))
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(2000), "err": err}))
    alarms = dr.detect(df, "err", ["i"], detector="adwin").collect()
    assert alarms and min(r["i"] for r in alarms) >= 1000


def test_adwin_quiet_on_stable_stream():
    rng = np.random.default_rng(2)
    d = dr.Adwin()
    assert sum(d.update(x) for x in np.abs(rng.normal(0, 1, 3000))) <= 1


def test_page_hinkley_and_ddm_first_alarm_match_scan(spark):
    from tidemark.plans.ordering import sequence

    rng = np.random.default_rng(3)
    err = np.concatenate([np.abs(rng.normal(0, 1, 500)), np.abs(rng.normal(4, 1, 500))])
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(1000), "err": err}))
    seq = sequence(df, ["i"])
    first = dr.page_hinkley_first(seq).first()["first_alarm"]
    ph = dr.PageHinkley()
    scan = next(i for i, x in enumerate(err) if ph.update(x))
    assert first == scan
    ddm_first = dr.ddm_first(seq, F.col("err") > 2.0).first()["first_alarm"]
    d = dr.Ddm()
    scan = next(i for i, x in enumerate(err > 2.0) if d.update(float(x)))
    assert ddm_first == scan


def _psi_frames(spark, shift):
    rng = np.random.default_rng(4)
    ref = pd.DataFrame({"f": rng.normal(0, 1, 300)})
    cur = pd.DataFrame({"f": rng.normal(shift, 1, 300)})
    return spark.createDataFrame(ref), spark.createDataFrame(cur)


def test_psi_detects_shift(spark):
    ref, cur = _psi_frames(spark, 6.0)
    assert ps.psi_numeric(ref, cur, ["f"]).first()["psi"] > 0.2


def test_psi_quiet_on_stable(spark):
    ref, cur = _psi_frames(spark, 0.0)
    assert ps.psi_numeric(ref, cur, ["f"]).first()["psi"] < 0.2


def test_psi_schedule_flags_shift(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(0, 1, 300), rng.normal(6, 1, 600)])
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(900), "f": vals}))
    out = ps.psi_over_time(df, "idx", ["f"], [], reference_size=300, window=300, every=50, total=900)
    flags = ps.psi_flag(out).where("feature_drift").count()
    assert flags > 0


def test_validate_trailing_needs_two_windows(spark):
    from tidemark.plans.ordering import sequence

    err = [1.0] * 100 + [3.0] * 100
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(200), "err": err}))
    seq = sequence(df, ["i"])
    ev = spark.createDataFrame([(50,), (199,)], "i long")
    rows = {r["i"]: r for r in dr.validate_trailing(seq, ev, w=100).collect()}
    assert rows[50]["direction"] == "insufficient" and not rows[50]["validated"]
    assert rows[199]["validated"] and rows[199]["direction"] == "worse"
    assert abs(rows[199]["rel_shift"] - 2.0) < 1e-9


def test_retrain_alert_cooldown(spark):
    ev = spark.createDataFrame([(i, True, "worse") for i in (10, 15, 40, 45, 80)], "i long, validated boolean, direction string")
    got = sorted(r["i"] for r in dr.retrain_alerts(ev, cooldown=30).collect())
    assert got == [10, 40, 80]


def test_alerts_follow_the_cooldown_in_every_series(spark):
    rng = np.random.default_rng(8)
    rows = [(s, int(i), bool(v), "worse" if w else "better") for s in ("a", None, "b") for i, v, w in
            zip(sorted(rng.choice(5000, 300, replace=False)), rng.random(300) < 0.8, rng.random(300) < 0.8)]
    df = spark.createDataFrame(rows, "s string, i long, validated boolean, direction string").repartition(5)
    want = set()
    for s in ("a", None, "b"):
        last = None
        for _, i, v, d in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if v and d == "worse" and (last is None or i - last >= 90):
                want.add((s, i))
                last = i
    assert {(r["s"], r["i"]) for r in dr.retrain_alerts(df, cooldown=90, series=["s"]).collect()} == want
    assert dr.retrain_alerts(df.where("i < 0"), cooldown=90).count() == 0


def test_edges_are_order_statistics(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 3000), "b": rng.integers(0, 5, 3000).astype(float)})  # b: heavy ties
    long = ps.unpivot(spark.createDataFrame(pdf), ["a", "b"])
    x = {r["feature"]: r["edges"] for r in ps.numeric_edges(long).collect()}
    for f in ("a", "b"):
        s = np.sort(pdf[f].to_numpy())
        assert x[f] == [s[min(int(q * len(s)), len(s) - 1)] for q in [i / 10 for i in range(1, 10)]]


def test_scan_first_alarm_equals_window_first_alarm(spark):
    import __spark_entry__ as E
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    q = E.queries()
    scan = q["g02_page_hinkley_scan"](spark, sf).agg(F.min("i")).first()[0]
    first = q["g02_page_hinkley_first"](spark, sf).first()["first_alarm"]
    assert scan == first
    scan = q["g03_ddm_scan"](spark, sf).agg(F.min("i")).first()[0]
    first = q["g03_ddm_first"](spark, sf).first()["first_alarm"]
    assert scan == first


def test_absent_values_are_not_part_of_a_distribution(spark):
    rows = [(i, float(i % 10), "ab"[i % 2]) for i in range(400)]
    ref = spark.createDataFrame(rows, "i long, x double, c string")
    cur = ref.withColumn("x", F.when(F.col("i") % 20 < 10, F.col("x"))).withColumn("c", F.when(F.col("i") % 4 < 2, F.col("c")))
    assert abs(ps.psi_numeric(ref, cur, ["x"]).first()["psi"]) < 1e-12
    assert abs(ps.psi_categorical(ref, cur, ["c"]).first()["psi"]) < 1e-12


def test_psi_over_time_equals_one_by_one(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"idx": np.arange(1000), "f": rng.normal(0, 1, 1000) + np.arange(1000) / 400, "c": rng.choice(list("abcde"), 1000)})
    pdf.loc[pdf.idx > 700, "c"] = "z"
    df = spark.createDataFrame(pdf)
    got = {(r["check"], r["feature"]): r["psi"] for r in ps.psi_over_time(df, "idx", ["f"], ["c"], 300, 150, 100, total=1000).collect()}
    ref = df.where("idx < 300")
    for check in (400, 700, 1000):
        cur = df.where((F.col("idx") >= max(300, check - 150)) & (F.col("idx") < check))
        assert abs(got[(check, "f")] - ps.psi_numeric(ref, cur, ["f"]).first()["psi"]) < 1e-9
        assert abs(got[(check, "c")] - ps.psi_categorical(ref, cur, ["c"]).first()["psi"]) < 1e-9


def test_scan_of_one_series_reads_values_only(spark):
    """Same alarms as a plain loop, with ties in the order's first column, nulls and wide rows; the task of the scan gets packed values."""
    rng = np.random.default_rng(7)
    err = np.abs(np.concatenate([rng.normal(0, 0.1, 9000), rng.normal(5, 0.1, 9000), rng.normal(1, 0.1, 7000)]))
    rows = [("k%05d" % (i // 2), i, None if i % 97 == 0 else float(x)) for i, x in enumerate(err)]
    df = spark.createDataFrame(rows, "key string, i bigint, err double").repartition(7)
    for name in ("adwin", "page_hinkley"):
        d = dr.DETECTORS[name]()
        want = [(k, i, x) for k, i, x in rows if x is not None and d.update(x)]
        got = dr.detect(df, "err", ["key", "i"], detector=name)
        assert got.columns == ["key", "i", "err"] and sorted(map(tuple, got.collect())) == want != []
    plan = got._jdf.queryExecution().toString()
    assert "Coalesce 1" not in plan and "coalesce(1" not in plan


def test_binned_counts_equal_the_join(spark):
    """Values on edges, equal edges, NaN, infinities, absent values and a feature without a reference."""
    rng = np.random.default_rng(8)
    odd = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, None]
    rows = [(i % 3, float(round(v, 1)), odd[i % 6], None if i % 2 else float(i % 4)) for i, v in enumerate(rng.normal(0, 1, 600))]
    df = spark.createDataFrame(rows, "slot int, a double, b double, c double")
    ref = df.limit(200).withColumn("c", F.lit(None).cast("double"))
    edges = ps.numeric_edges(ps.unpivot(ref, ["a", "b", "c"]))
    want = ps.bin_numeric(ps.unpivot(df, ["a", "b", "c"], ["slot"]), edges).groupBy("slot", "feature", "bin").count()
    got = ps.bin_counts(df, ps.edge_values(edges), ["a", "b", "c"], "slot")
    assert "Join" not in got._jdf.queryExecution().toString() and "Generate" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
