"""Encoders and geography (modelled on the reference's feature tests)."""

import math

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import encoders as en
from tidemark.operators import geo
from tidemark.plans.ordering import sequence


def _frame(spark, ys, cat="x"):
    pdf = pd.DataFrame({"i": range(len(ys)), "cat": [cat] * len(ys), "a": [1.0] * len(ys), "y": ys})
    return spark.createDataFrame(pdf, "i long, cat string, a double, y double")


def test_encoder_cold_is_zero(spark):
    df = _frame(spark, [None])
    out = en.multi_encode(sequence(df, ["i"]), y="y", encoders=[("cat",)], k=1.0).first()
    for h in ("long", "med", "short"):
        assert out[f"te_cat_{h}"] == 0.0


def test_encoder_warm_within_bounds(spark):
    df = _frame(spark, [100.0] * 4 + [None])
    rows = en.multi_encode(sequence(df, ["i"]), y="y", encoders=[("cat",)], k=1.0).orderBy("i").collect()
    last = rows[-1]
    for h in ("long", "med", "short"):
        assert 50.0 < last[f"te_cat_{h}"] <= 100.0


def test_short_horizon_reacts_faster(spark):
    df = _frame(spark, [100.0] * 50 + [300.0] * 5 + [None])
    last = en.multi_encode(sequence(df, ["i"]), y="y", encoders=[("cat",)], k=0.0,
                           horizons={"long": 0.0, "short": 0.5}).orderBy(F.col("i").desc()).first()
    assert last["te_cat_short"] > last["te_cat_long"]


def test_encoder_skipped_when_columns_missing(spark):
    df = _frame(spark, [1.0, 2.0])
    out = en.multi_encode(sequence(df, ["i"]), y="y", encoders=[("cat", "missing")])
    assert not [c for c in out.columns if c.startswith("te_cat_missing")]


def test_ewma_matches_sequential_definition(spark):
    ys = [float((i * 37) % 101) for i in range(3000)]
    df = _frame(spark, ys)
    out = en.encode_ewma(sequence(df, ["i"]), ["cat"], y="y", alphas={"med": 0.05, "short": 0.3}, prefix="p")
    got = {r["i"]: (r["p_med"], r["p_short"]) for r in out.collect()}
    v = {}
    for i, y in enumerate(ys):
        for h, a in (("med", 0.05), ("short", 0.3)):
            exp = v.get(h)
            g = got[i][0 if h == "med" else 1]
            if exp is None:
                assert g is None
            else:
                assert abs(g - exp) <= 1e-9 * max(1.0, abs(exp))
            v[h] = y if exp is None else exp + a * (y - exp)


def test_old_labels_count_however_far_back(spark):
    ys = [1e30] + [0.0] * 1001
    df = _frame(spark, ys)
    out = en.encode_ewma(sequence(df, ["i"]), ["cat"], y="y", alphas={"med": 0.05, "slow": 1e-6}, prefix="p")
    last = out.where("i = 1001").first()
    assert math.isclose(last["p_med"], 1e30 * 0.95 ** 1000, rel_tol=1e-9)
    assert math.isclose(last["p_slow"], 1e30 * (1 - 1e-6) ** 1000, rel_tol=1e-9)
    state = en.fit_encoder(df, ["i"], y="y", encoders=[("cat",)])
    assert math.isclose(state[("cat",)].first()["med"], 1e30 * 0.95 ** 1001, rel_tol=1e-9)


def test_folds_of_gapped_and_null_keys_match_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, "c,d"]), rng.choice([None, rng.uniform(-5, 9)]) if i % 7 else None) for i in range(2500)]
    df = spark.createDataFrame(rows, "i long, cat string, y double").repartition(6)
    got = {r["i"]: r for r in en.encode_ewma(sequence(df, ["i"], n_buckets=7), ["cat"], y="y", alphas={"m": 0.1, "one": 1.0}, prefix="p").collect()}
    state = {}
    for i, cat, y in rows:
        n, m, one = state.get(cat, (0, None, None))
        assert got[i]["p_n"] == n
        for v, name in ((m, "p_m"), (one, "p_one")):
            assert (v is None and got[i][name] is None) or math.isclose(got[i][name], v, rel_tol=1e-9, abs_tol=1e-12)
        if y is not None:
            state[cat] = (n + 1, y if n == 0 else m + 0.1 * (y - m), y)
    frozen = en.fit_encoder(df, ["i"], y="y", encoders=[("cat",)], horizons={"long": 0.0, "m": 0.1})
    assert {r["cat"]: r["n"] for r in frozen[("cat",)].collect()} == {k: v[0] for k, v in state.items()}
    for r in frozen[("cat",)].collect():
        assert math.isclose(r["m"], state[r["cat"]][1], rel_tol=1e-9)
    applied = en.apply_encoder(df.where("cat IS NULL").limit(1), frozen, k=0.0, horizons={"long": 0.0, "m": 0.1}).first()
    assert math.isclose(applied["te_cat_m"], state[None][1], rel_tol=1e-9)


def test_zone_pair_missing_and_same(spark):
    from tidemark.sources import fixtures as fx

    zones = fx.zones(spark, "/root/testdata/sf0.001")
    req = spark.createDataFrame([("25", "3"), ("3", "3"), ("1", "17")], "pu_zone string, do_zone string")
    rows = {(r["pu_zone"], r["do_zone"]): r for r in geo.with_zone_pair(req, zones).collect()}
    miss = rows[("25", "3")]
    assert miss["gc_distance_km"] == 0.0 and miss["bearing_sin"] == 0.0 and miss["bearing_cos"] == 0.0
    assert miss["pu_borough"] == "Unknown" and miss["do_airport"] == 1.0 and miss["same_borough"] == 0.0
    same = rows[("3", "3")]
    assert same["gc_distance_km"] == 0.0 and same["bearing_sin"] == 0.0 and same["bearing_cos"] == 1.0
    assert same["same_borough"] == 1.0
    r = rows[("1", "17")]
    assert r["gc_distance_km"] > 1.0 and r["do_airport"] == 1.0
    assert abs(r["bearing_sin"] ** 2 + r["bearing_cos"] ** 2 - 1.0) < 1e-3


def test_degenerate_ring_falls_back_to_point_mean(spark):
    v = spark.createDataFrame([(7, 0, 0, 1.0, 1.0), (7, 0, 1, 2.0, 2.0), (7, 0, 2, 3.0, 3.0), (7, 0, 3, 1.0, 1.0)],
                              "id int, part int, seq int, x double, y double")
    c = geo.polygon_centroids(v).first()
    assert math.isclose(c["x"], 7.0 / 4) and math.isclose(c["y"], 7.0 / 4)


def test_calendar_weekday_monday_zero(spark):
    from tidemark.operators.cleaning import with_calendar

    df = spark.sql("SELECT CAST('2024-01-01 08:30:00' AS TIMESTAMP_NTZ) AS t")  # a Monday
    r = with_calendar(df, "t").first()
    assert r["pickup_dayofweek"] == 0 and r["pickup_hour"] == 8 and r["is_rush_hour"] == 1 and r["is_weekend"] == 0
