"""Registered queries: one per operator of the inventory that has a result
over the driver tables. Every computed double is rounded to 6 decimals (the
oracle rounds the same way); rounding done by the operator itself is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import r6
from tidemark.operators import evaluation as ev
from tidemark.plans.trips import memory_predictions, sequenced_trips

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def scored_trips(spark: SparkSession, sf_dir: str, label_gap_every: int | None = None):
    """Sequenced trips with memory predictions and their errors."""
    seq = memory_predictions(sequenced_trips(spark, sf_dir, label_gap_every))
    return seq.with_df(ev.with_errors(seq.df))


@query("flagship_prequential")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = scored_trips(spark, sf_dir)
    pq = ev.prequential(seq)
    rm = ev.rolling_metrics(pq)
    return rm.select("record_id", "gidx", r6("prediction").alias("prediction"), "n",
                     r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("r2").alias("r2"),
                     r6("rolling_mae").alias("rolling_mae"))


# ---------------------------------------------------------------- B: cleaning
from tidemark.operators import cleaning as cl  # noqa: E402
from tidemark.sources import fixtures as fx  # noqa: E402

KEYS = list(fx.RAW_TIE_BREAK)


def _raw(spark, sf_dir):
    return fx.raw_trips(spark, sf_dir)


def _prepared(spark, sf_dir):
    return cl.prepare_trips(_raw(spark, sf_dir), fx.RAW_MIN_S, fx.RAW_MAX_S, keep=KEYS + ["src_month"])


@query("b01_duration")
def b01(spark, sf_dir):
    return cl.with_duration(_raw(spark, sf_dir)).select(*KEYS, r6("duration_s").alias("duration_s"))


@query("b02_clean_trips")
def b02(spark, sf_dir):
    df = cl.clean_trips(cl.with_duration(_raw(spark, sf_dir)), fx.RAW_MIN_S, fx.RAW_MAX_S)
    return df.select(*KEYS, r6("duration_s").alias("duration_s"))


@query("b03_in_month")
def b03(spark, sf_dir):
    return cl.in_month(_raw(spark, sf_dir), "pickup", "src_month").select(*KEYS, "pickup", "src_month")


@query("b04_calendar")
def b04(spark, sf_dir):
    t = fx.trips(spark, sf_dir)
    return cl.with_calendar(t, "pickup_datetime").select(
        "seq", "pickup_hour", "pickup_dayofweek", "pickup_month", "is_weekend", "is_rush_hour")


@query("b05_normalize_ids")
def b05(spark, sf_dir):
    return cl.normalize_ids(_raw(spark, sf_dir)).select(*KEYS, "pu_zone", "do_zone", "ratecode", "passenger_count")


@query("b06_route_km")
def b06(spark, sf_dir):
    return cl.with_route_km(_raw(spark, sf_dir)).select(*KEYS, r6("route_distance_km").alias("route_distance_km"))


@query("b07_prepared_trips")
def b07(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return p.select(*KEYS, *[r6(c).alias(c) if c in ("target_duration_s", "route_distance_km") else c
                             for c in cl.PREPARED_COLUMNS])


@query("b08_cap_per_month")
def b08(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return cl.cap_per_group(p, "src_month", 100, 42, KEYS).select(*KEYS, "src_month")


@query("b09_order_by_time")
def b09(spark, sf_dir):
    return cl.order_by_time(_prepared(spark, sf_dir), "pickup_datetime", KEYS).select(*KEYS, "pickup_datetime")


@query("b10_sequential_id")
def b10(spark, sf_dir):
    from tidemark.plans.ordering import sequence

    seq = sequence(_prepared(spark, sf_dir), ["pickup_datetime", *KEYS])
    return cl.with_sequential_id(seq).df.select(*KEYS, "record_id")


@query("b11_cleaning_report")
def b11(spark, sf_dir):
    raw = cl.with_duration(_raw(spark, sf_dir))
    return cl.cleaning_report(raw, cl.is_clean(fx.RAW_MIN_S, fx.RAW_MAX_S), "src_month")


@query("b11_prepared_summary")
def b11s(spark, sf_dir):
    s = cl.prepared_summary(_prepared(spark, sf_dir))
    return s.select("n", "first_ts", "last_ts", r6("mean_target").alias("mean_target"),
                    r6("median_target").alias("median_target"))


@query("b12_coerce")
def b12(spark, sf_dir):
    t = cl.with_calendar(fx.trips(spark, sf_dir), "pickup_datetime")
    c = cl.coerce(t, numeric=["passenger_count", "pickup_hour"], categorical=["ratecode", "pu_zone"])
    return c.select("seq", "passenger_count", "pickup_hour", "ratecode", "pu_zone")


@query("b13_drop_features")
def b13(spark, sf_dir):
    from tidemark.plans.trips import trip_features

    return cl.drop_features(trip_features(spark, sf_dir), ["pu_zone", "do_zone", "pickup_datetime", "record_id"])


@query("b14_feature_set")
def b14(spark, sf_dir):
    p = cl.feature_set(_prepared(spark, sf_dir), use_route=True)
    return p.select(*KEYS, r6("route_distance_km").alias("route_distance_km"))


# ---------------------------------------------------------------- C: geography
from tidemark.operators import geo  # noqa: E402
from tidemark.sources.tables import read_table  # noqa: E402


def _attrs(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("id"), F.col("r_name").alias("borough"), F.col("n_name").alias("zone"))


@query("c01_ring_centroids")
def c01(spark, sf_dir):
    r = geo.ring_centroids(fx.zone_vertices(spark, sf_dir))
    return r.select("id", "part", "n_points", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("area").alias("area"))


@query("c02_polygon_centroids")
def c02(spark, sf_dir):
    p = geo.polygon_centroids(fx.zone_vertices(spark, sf_dir))
    return p.select("id", r6("x").alias("x"), r6("y").alias("y"))


@query("c03_zone_table")
def c03(spark, sf_dir):
    return geo.zone_table(geo.polygon_centroids(fx.zone_vertices(spark, sf_dir)), _attrs(spark, sf_dir))


@query("c04_zone_pair")
def c04(spark, sf_dir):
    t = fx.trips(spark, sf_dir)
    z = fx.zones(spark, sf_dir)
    return geo.with_zone_pair(t, z).select(
        "seq", "gc_distance_km", "bearing_sin", "bearing_cos", "same_borough", "pu_airport", "do_airport",
        "pu_borough", "do_borough")


@query("c05_zone_catalog")
def c05(spark, sf_dir):
    return geo.zone_catalog(fx.zones(spark, sf_dir))


@query("c06_zone_distance")
def c06(spark, sf_dir):
    pairs = fx.trips(spark, sf_dir).select(F.col("pu_zone").alias("a"), F.col("do_zone").alias("b")).distinct()
    d = geo.zone_distance(fx.zones(spark, sf_dir), pairs)
    return d.select("a", "b", r6("distance_km").alias("distance_km"))


def trip_requests(spark, sf_dir):
    """Requests derived from trips, with some fields left out on purpose."""
    t = fx.trips(spark, sf_dir)
    ts = F.col("pickup_datetime")
    return t.select(
        "seq", "pu_zone", "do_zone",
        F.when(F.col("ratecode") != "view", F.hour(ts)).alias("pickup_hour"),
        F.weekday(ts).alias("pickup_dayofweek"),
        F.when(F.col("ratecode") != "signup", F.month(ts)).alias("pickup_month"),
        F.when(F.col("ratecode") != "click", F.col("passenger_count")).alias("passenger_count"),
        F.when(F.col("ratecode") != "error", F.col("ratecode")).alias("ratecode"))


@query("c07_trip_requests")
def c07(spark, sf_dir):
    f = geo.trip_requests_to_features(trip_requests(spark, sf_dir), fx.zones(spark, sf_dir))
    return f.select("seq", "pickup_hour", "pickup_dayofweek", "pickup_month", "passenger_count", "ratecode",
                    "is_weekend", "is_rush_hour", "gc_distance_km", "bearing_sin", "bearing_cos",
                    "same_borough", "pu_airport", "do_airport", "pu_borough", "do_borough")


# ---------------------------------------------------------------- D: features and encoders
from tidemark.operators import encoders as en  # noqa: E402
from tidemark.operators import features as fe  # noqa: E402
from tidemark.plans.trips import sequenced_trips as _seq_trips  # noqa: E402
from tidemark.plans.ordering import sequence as _seq  # noqa: E402
from tidemark.plans.trips import trip_features  # noqa: E402

TE_COLS = [en.encoder_name(e, h) for e in en.DEFAULT_ENCODERS for h in en.DEFAULT_HORIZONS]


@query("d01_cyclical")
def d01(spark, sf_dir):
    f = fe.with_cyclical(trip_features(spark, sf_dir))
    cols = [f"{c}_{s}" for c in ("pickup_hour", "pickup_dayofweek", "pickup_month") for s in ("sin", "cos")]
    return f.select("seq", *[r6(c).alias(c) for c in cols])


@query("d02_running_stats")
def d02(spark, sf_dir):
    s = fe.running_stats(trip_features(spark, sf_dir), ["passenger_count", "pickup_hour", "gc_distance_km", "target"])
    return s.select("feature", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query("d02_running_stats_prefix")
def d02p(spark, sf_dir):
    s = fe.running_stats_prefix(_seq_trips(spark, sf_dir, indexed=False), "passenger_count")
    return s.df.select("seq", r6("passenger_count_run_mean").alias("run_mean"),
                       r6("passenger_count_run_std").alias("run_std"), F.col("passenger_count_run_n").alias("run_n"))


@query("d03_prior_global_mean")
def d03(spark, sf_dir):
    s = en.prior_global_mean(_seq_trips(spark, sf_dir, indexed=False))
    return s.df.select("seq", r6("g").alias("g"))


@query("d04_encode_long")
def d04(spark, sf_dir):
    s = en.encode_long(_seq_trips(spark, sf_dir, indexed=False), ["pu_zone", "do_zone"], prefix="te")
    return s.df.select("seq", F.col("te_n").alias("n"), r6("te_long").alias("long"))


@query("d05_encode_ewma")
def d05(spark, sf_dir):
    df = en.encode_ewma(_seq_trips(spark, sf_dir, indexed=False), ["do_zone"], prefix="te")
    return df.select("seq", F.col("te_n").alias("n"), r6("te_med").alias("med"), r6("te_short").alias("short"))


def _gapped(spark, sf_dir):
    """Features with one label in ten missing and one drop-off zone unknown (null)."""
    f = trip_features(spark, sf_dir, 10)
    return _seq(f.withColumn("do_zone", F.when(F.col("do_zone") != "7", F.col("do_zone"))), ["pickup_datetime", "seq"])


@query("d05_encode_ewma_gaps")
def d05g(spark, sf_dir):
    df = en.encode_ewma(_gapped(spark, sf_dir), ["do_zone"], prefix="te")
    return df.select("seq", F.col("te_n").alias("n"), r6("te_med").alias("med"), r6("te_short").alias("short"))


@query("d07_multi_encode_gaps")
def d07g(spark, sf_dir):
    df = en.multi_encode(_gapped(spark, sf_dir))
    return df.select("seq", *[r6(c).alias(c) for c in TE_COLS])


@query("d06_shrink")
def d06(spark, sf_dir):
    s = memory_predictions(_seq_trips(spark, sf_dir, indexed=False))
    return s.df.select("seq", r6("g").alias("g"), F.col("te_pair_n").alias("n"),
                       r6("prediction").alias("te_pu_zone_do_zone_long"))


@query("d07_multi_encode")
def d07(spark, sf_dir):
    df = en.multi_encode(_seq_trips(spark, sf_dir, indexed=False))
    return df.select("seq", *[r6(c).alias(c) for c in TE_COLS])


def frozen_split(spark, sf_dir, frac=0.8):
    seq = _seq_trips(spark, sf_dir)
    return ev.time_split(seq, frac)


@query("d08_frozen_encoder")
def d08(spark, sf_dir):
    train, hold = frozen_split(spark, sf_dir)
    state = en.fit_encoder(train, ["pickup_datetime", "seq"])
    out = en.apply_encoder(hold, state)
    return out.select("seq", r6("g_frozen").alias("g_frozen"), *[r6(c).alias(c) for c in TE_COLS])


@query("d10_target_scale")
def d10(spark, sf_dir):
    s = fe.target_scale(_seq_trips(spark, sf_dir, indexed=False))
    return s.df.select("seq", r6("t_mean_prior").alias("t_mean_prior"), r6("t_std_prior").alias("t_std_prior"),
                       r6("y_scaled").alias("y_scaled"))


@query("d11_warmup_mask")
def d11(spark, sf_dir):
    s = fe.warmup_mask(_seq_trips(spark, sf_dir, 10, indexed=False), warmup=100)
    return s.df.select("seq", "label_n", "learns", "model_active")


@query("d12_lags")
def d12(spark, sf_dir):
    df = fe.with_lags(_seq_trips(spark, sf_dir, indexed=False))
    return df.select("seq", "target_lag1", "target_lag2", "target_lag3")


@query("d12_rolling_mean")
def d12r(spark, sf_dir):
    df = fe.with_rolling_mean(_seq_trips(spark, sf_dir, indexed=False), w=50)
    return df.select("seq", r6("target_roll50").alias("target_roll50"))


# ---------------------------------------------------------------- F: evaluation
def _scored(spark, sf_dir):
    return scored_trips(spark, sf_dir)


@query("f01_prequential")
def f01(spark, sf_dir):
    pq = ev.prequential(_scored(spark, sf_dir))
    return pq.df.select("seq", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("r2").alias("r2"))


@query("f02_rolling_metrics")
def f02(spark, sf_dir):
    rm = ev.rolling_metrics(_scored(spark, sf_dir))
    return rm.select("seq", "lidx", r6("rolling_mae").alias("rolling_mae"), r6("rolling_rmse").alias("rolling_rmse"),
                     r6("rolling_r2").alias("rolling_r2"))


@query("f03_snapshot")
def f03(spark, sf_dir):
    rm = ev.rolling_metrics(ev.prequential(_scored(spark, sf_dir)))
    s = ev.snapshot(rm)
    return s.select(*[r6(c).alias(c) for c in ("mae", "rmse", "r2", "rolling_mae", "rolling_rmse", "rolling_r2")], "n")


def _holdout_memory(spark, sf_dir):
    train, hold = frozen_split(spark, sf_dir)
    state = en.fit_encoder(train, ["pickup_datetime", "seq"], encoders=[("pu_zone", "do_zone")],
                           horizons={"long": 0.0})
    return en.apply_encoder(hold, state, horizons={"long": 0.0}).withColumn(
        "prediction", F.col("te_pu_zone_do_zone_long"))


@query("f04_holdout_metrics")
def f04(spark, sf_dir):
    m = ev.holdout_metrics(_holdout_memory(spark, sf_dir))
    return m.select(r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("r2").alias("r2"), "n")


@query("f05_segment_mae")
def f05(spark, sf_dir):
    return ev.segment_mae(_scored(spark, sf_dir).df, "pu_borough")


@query("f06_rolling_segment_mae")
def f06(spark, sf_dir):
    return ev.rolling_segment_mae(_scored(spark, sf_dir).df, "pu_borough", ["pickup_datetime", "seq"])


@query("f06_rolling_segment_hour")
def f06h(spark, sf_dir):
    return ev.rolling_segment_mae(_scored(spark, sf_dir).df, "pickup_hour", ["pickup_datetime", "seq"])


@query("f06_rolling_segment_rows")
def f06r(spark, sf_dir):
    out = ev.rolling_segment_mae_rows(_scored(spark, sf_dir), "pu_borough")
    return out.select("seq", r6("segment_rolling_mae").alias("segment_rolling_mae"))


@query("f07_time_split")
def f07(spark, sf_dir):
    train, hold = ev.time_split(_seq_trips(spark, sf_dir), 0.8)
    return train.select("seq", F.lit("train").alias("part")).unionByName(hold.select("seq", F.lit("holdout").alias("part")))


@query("f08_rolling_window_split")
def f08(spark, sf_dir):
    win, hold = ev.rolling_window_split(_seq_trips(spark, sf_dir), 0.8, 0.1)
    return win.select("seq", F.lit("window").alias("part")).unionByName(hold.select("seq", F.lit("holdout").alias("part")))


@query("f10_ablation_floors")
def f10(spark, sf_dir):
    from tidemark.operators import models as mo

    train, hold = frozen_split(spark, sf_dir)
    a = mo.global_mean_baseline(train, hold)
    b = mo.memory_baseline(train, hold, ["pickup_datetime", "seq"])
    return a.unionByName(b).select("setup", r6("mae").alias("mae"), r6("r2").alias("r2"))


@query("f11_promotion_decision")
def f11(spark, sf_dir):
    train, hold = frozen_split(spark, sf_dir)
    mean = train.agg(F.avg("target")).first()[0]
    champ = ev.holdout_metrics(hold.withColumn("prediction", F.lit(mean)))
    cand = ev.holdout_metrics(_holdout_memory(spark, sf_dir))
    d = ev.promotion_decision(cand, champ, margin=0.0)
    return d.select(r6("candidate_mae").alias("candidate_mae"), r6("champion_mae").alias("champion_mae"),
                    "promote", "decision")


@query("f12_residual_summary")
def f12(spark, sf_dir):
    s = ev.residual_summary(_scored(spark, sf_dir).df)
    return s.select("n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("bias").alias("bias"))


@query("f13_residual_by")
def f13(spark, sf_dir):
    s = ev.residual_by(_scored(spark, sf_dir).df)
    return s.select("dim", "value", r6("bias").alias("bias"), r6("mae").alias("mae"), "n")


@query("f14_autocorr")
def f14(spark, sf_dir):
    a = ev.autocorr(_scored(spark, sf_dir), "residual", idx="lidx")
    return a.select("lag", r6("autocorr").alias("autocorr"))


@query("f15_error_percentiles")
def f15(spark, sf_dir):
    p = ev.error_percentiles(_scored(spark, sf_dir).df)
    return p.select(*[r6(c).alias(c) for c in p.columns])


@query("f16_recent_points")
def f16(spark, sf_dir):
    return ev.recent_points(_scored(spark, sf_dir).df)


@query("f17_perf_history")
def f17(spark, sf_dir):
    return ev.perf_history(ev.rolling_metrics(_scored(spark, sf_dir)))


# ---------------------------------------------------------------- E: models
@query("e01_ridge")
def e01(spark, sf_dir):
    from tidemark.operators import models as mo

    c = mo.fit_linear(trip_features(spark, sf_dir), ["gc_distance_km", "passenger_count"], l2=2.0)
    return c.select("term", r6("coef").alias("coef"))


def _tree_query(kind):
    def run(spark, sf_dir):
        from tidemark.operators import models as mo

        train, hold = frozen_split(spark, sf_dir)
        if kind == "tree":
            m = mo.fit_tree(train)
        elif kind == "adaptive":
            win, _ = ev.rolling_window_split(_seq_trips(spark, sf_dir), 0.5, 0.2)
            m = mo.fit_tree(win)
        else:
            m = mo.fit_forest(train)
        return m.transform(hold).select("seq", r6("prediction").alias("prediction"))
    return run


QUERIES["e02_tree"] = _tree_query("tree")
QUERIES["e03_adaptive_tree"] = _tree_query("adaptive")
QUERIES["e04_forest"] = _tree_query("forest")


@query("e05_global_mean_baseline")
def e05(spark, sf_dir):
    from tidemark.operators import models as mo

    train, hold = frozen_split(spark, sf_dir)
    return mo.global_mean_baseline(train, hold).select("setup", r6("mae").alias("mae"), "r2")


@query("e06_memory_baseline")
def e06(spark, sf_dir):
    from tidemark.operators import models as mo

    train, hold = frozen_split(spark, sf_dir)
    return mo.memory_baseline(train, hold, ["pickup_datetime", "seq"]).select("setup", r6("mae").alias("mae"),
                                                                               r6("r2").alias("r2"))


@query("e08_score_trips")
def e08(spark, sf_dir):
    from tidemark.operators import models as mo

    return mo.score_trips(_holdout_memory(spark, sf_dir)).select(
        "seq", "eta_seconds", "eta_minutes", "distance_km", "pu_borough", "do_borough", "rush_hour")


@query("e12_metric_log")
def e12(spark, sf_dir):
    rm = ev.rolling_metrics(ev.prequential(_scored(spark, sf_dir)))
    log = ev.metric_log(rm, "gidx", 500)
    return log.select("step", *[r6(c).alias(c) for c in ("mae", "rmse", "r2", "rolling_mae")])


# ---------------------------------------------------------------- G: drift
from tidemark.operators import drift as dr  # noqa: E402
from tidemark.operators import psi as ps  # noqa: E402
from tidemark.plans.ordering import sequence as _sequence  # noqa: E402

PSI_NUMERIC = ["passenger_count", "pickup_hour", "gc_distance_km"]
PSI_CATEGORICAL = ["pu_borough", "ratecode"]


def error_stream(spark, sf_dir):
    return _sequence(fx.error_series(spark, sf_dir), ["i"])


def grid_events(seq, every=1000):
    """Check positions on a fixed grid of the error index (every ``every`` rows)."""
    return seq.df.where((F.col("i") + 1) % every == 0).select("i")


@query("g01_adwin")
def g01(spark, sf_dir):
    return dr.detect(fx.error_series(spark, sf_dir), "err", ["i"], detector="adwin").select("i", r6("err").alias("err"))


@query("g02_page_hinkley_first")
def g02(spark, sf_dir):
    return dr.page_hinkley_first(error_stream(spark, sf_dir))


@query("g03_ddm_first")
def g03(spark, sf_dir):
    return dr.ddm_first(error_stream(spark, sf_dir), F.col("err") > 60)


def _trailing(spark, sf_dir):
    seq = error_stream(spark, sf_dir)
    return dr.validate_trailing(seq, grid_events(seq), w=1500)


@query("g04_validate_trailing")
def g04(spark, sf_dir):
    v = _trailing(spark, sf_dir)
    return v.select("i", r6("mean_before").alias("mean_before"), r6("mean_after").alias("mean_after"),
                    r6("rel_shift").alias("rel_shift"), r6("effect").alias("effect"), "validated", "direction")


@query("g05_validate_centred")
def g05(spark, sf_dir):
    seq = error_stream(spark, sf_dir)
    total = seq.df.count()
    s = dr.centred_summary(dr.validate_centred(seq, grid_events(seq), total, w=2000))
    return s.select("checked", "valid", "spurious", r6("pct_valid").alias("pct_valid"), "degradations",
                    "improvements", r6("median_abs_rel").alias("median_abs_rel"))


@query("g06_shuffle_control")
def g06(spark, sf_dir):
    return dr.shuffle_control(fx.error_series(spark, sf_dir), "err", "i", seed=0).select("i")


@query("g07_outlier_autocorr")
def g07(spark, sf_dir):
    o = dr.outlier_autocorr(error_stream(spark, sf_dir))
    return o.select("lag", r6("autocorr").alias("autocorr"), r6("threshold").alias("threshold"))


def _psi_split(spark, sf_dir, ref_size=5000):
    seq = _seq_trips(spark, sf_dir)
    return seq.df.where(F.col("lidx") < ref_size), seq.df.where(F.col("lidx") >= ref_size)


@query("g08_psi_numeric")
def g08(spark, sf_dir):
    ref, cur = _psi_split(spark, sf_dir)
    return ps.psi_numeric(ref, cur, PSI_NUMERIC + ["target"]).select("feature", r6("psi").alias("psi"))


@query("g09_psi_categorical")
def g09(spark, sf_dir):
    ref, cur = _psi_split(spark, sf_dir)
    return ps.psi_categorical(ref, cur, PSI_CATEGORICAL + ["do_zone"]).select("feature", r6("psi").alias("psi"))


def _psi_time(spark, sf_dir):
    seq = _seq_trips(spark, sf_dir)
    total = seq.df.where(F.col("lidx").isNotNull()).count()
    return ps.psi_over_time(seq.df.where(F.col("lidx").isNotNull()), "lidx", PSI_NUMERIC, PSI_CATEGORICAL,
                            5000, 2000, 1000, total=total)


@query("g10_psi_over_time")
def g10(spark, sf_dir):
    return _psi_time(spark, sf_dir).select("check", "feature", r6("psi").alias("psi"))


@query("g11_psi_flag")
def g11(spark, sf_dir):
    f = ps.psi_flag(_psi_time(spark, sf_dir))
    return f.select("check", r6("max_psi").alias("max_psi"), "worst_feature", "feature_drift")


@query("g12_retrain_alerts")
def g12(spark, sf_dir):
    return dr.retrain_alerts(_trailing(spark, sf_dir), "i", cooldown=3000)


def _events(spark, sf_dir):
    concept = _trailing(spark, sf_dir).select(F.lit("concept").alias("type"), "i", "validated")
    feat = ps.psi_flag(_psi_time(spark, sf_dir)).where("feature_drift").select(
        F.lit("feature").alias("type"), (F.col("check") - 1).alias("i"), F.lit(True).alias("validated"))
    return concept.unionByName(feat)


@query("g13_drift_log")
def g13(spark, sf_dir):
    recent, _ = dr.drift_log(_events(spark, sf_dir))
    return recent


@query("g13_drift_counts")
def g13c(spark, sf_dir):
    _, counts = dr.drift_log(_events(spark, sf_dir))
    return counts


@query("e12_metric_log_drift")
def e12d(spark, sf_dir):
    """The metric log with the validated drift events up to each step."""
    rm = ev.rolling_metrics(ev.prequential(_scored(spark, sf_dir)))
    log = ev.metric_log(rm, "gidx", 500, events=_events(spark, sf_dir))
    return log.select("step", r6("rolling_mae").alias("rolling_mae"), "concept_drift_events", "feature_drift_events")


def _psi_null_views(spark, sf_dir):
    """The PSI split with two in five numeric and one in three categorical values absent."""
    ref, cur = _psi_split(spark, sf_dir)
    gaps = lambda d: (d.withColumn("gc_distance_km", F.when(F.col("seq") % 5 >= 2, F.col("gc_distance_km")))
                      .withColumn("ratecode", F.when(F.col("seq") % 3 != 0, F.col("ratecode"))))
    return gaps(ref), gaps(cur)


@query("g08_psi_numeric_gaps")
def g08n(spark, sf_dir):
    ref, cur = _psi_null_views(spark, sf_dir)
    return ps.psi_numeric(ref, cur, ["gc_distance_km", "target"]).select("feature", r6("psi").alias("psi"))


@query("g09_psi_categorical_gaps")
def g09n(spark, sf_dir):
    ref, cur = _psi_null_views(spark, sf_dir)
    return ps.psi_categorical(ref, cur, ["ratecode", "do_zone"]).select("feature", r6("psi").alias("psi"))


# ---------------------------------------------------------------- A: sources
from tidemark.sources import io as sio  # noqa: E402


@query("a01_raw_trips")
def a01(spark, sf_dir):
    return fx.raw_trips(spark, sf_dir).select(*KEYS, "pickup", "dropoff", "passenger_count", "trip_distance",
                                              "ratecode_id", "pu_id", "do_id")


@query("a02_union_months")
def a02(spark, sf_dir):
    """Monthly parts read separately (one per return flag, each a pushed-down
    filter of the same scan) and combined by name."""
    li = read_table(spark, sf_dir, "lineitem")
    parts = [li.where(F.col("l_returnflag") == f) for f in ("A", "N", "R")]
    parts.append(li.where(~F.col("l_returnflag").isin("A", "N", "R") | F.col("l_returnflag").isNull()))
    return sio.union_months(parts).select(*KEYS, "l_returnflag", "l_shipdate")


@query("a03_prepared_trips")
def a03(spark, sf_dir):
    df, _ = sio.build_source("trips", spark, sf_dir=sf_dir, use_route=True)
    return df.select("seq", "record_id", "pickup_datetime", "target", "gc_distance_km", "pu_borough", "do_borough",
                     "route_distance_km")


@query("a05_build_source")
def a05(spark, sf_dir):
    df, roles = sio.build_source("trips", spark, sf_dir=sf_dir)
    return df.select(roles.id, roles.time, roles.target, *roles.categorical)


# ---------------------------------------------------------------- H: streaming and monitoring
from tidemark.streaming import monitoring as mon  # noqa: E402


@query("h01_prequential_stream")
def h01(spark, sf_dir):
    """The flagship computed as a stream: day files replayed 10 per trigger."""
    from tidemark.session import remove_paths, scratch_path
    from tidemark.streaming.prequential import PrequentialStream

    feats = trip_features(spark, sf_dir)
    src = scratch_path(spark, "h01-src")
    sio.write_stream_files(feats, src, "pickup_datetime")
    schema = spark.read.parquet(src).drop("_part").schema
    stream = sio.replay_stream(spark, src, schema, files_per_trigger=10)
    out, state = scratch_path(spark, "h01-out"), scratch_path(spark, "h01-state")
    ckpt = scratch_path(spark, "h01-ckpt")
    q = PrequentialStream(state, out).start(stream, ckpt)
    q.awaitTermination()
    remove_paths(spark, src, state, ckpt)
    res = spark.read.parquet(out)
    return res.select("record_id", "gidx", *[r6(c).alias(c) for c in ("prediction", "mae", "rmse", "r2", "rolling_mae")], "n")


@query("h02_encoder_state_stream")
def h02(spark, sf_dir):
    from tidemark.session import remove_paths, scratch_path
    from tidemark.streaming.state import EncoderStream

    t = fx.trips(spark, sf_dir)
    src = scratch_path(spark, "h02-src")
    sio.write_stream_files(t, src, "pickup_datetime")
    schema = spark.read.parquet(src).drop("_part").schema
    stream = sio.replay_stream(spark, src, schema, files_per_trigger=10).drop("_part")
    out = scratch_path(spark, "h02-out")
    state, ckpt = scratch_path(spark, "h02-state"), scratch_path(spark, "h02-ckpt")
    q = EncoderStream(state, out, ["do_zone"], ["pickup_datetime", "seq"]).start(stream, ckpt)
    q.awaitTermination()
    remove_paths(spark, src, state, ckpt)
    r = spark.read.parquet(out)
    return r.select("seq", "n", r6("long").alias("long"), r6("med").alias("med"), r6("short").alias("short"))


@query("h03_detector_state_stream")
def h03(spark, sf_dir):
    from tidemark.session import scratch_path
    from tidemark.streaming.state import detector_state_stream

    e = fx.error_series(spark, sf_dir).withColumn("series", F.lit("all"))
    src = scratch_path(spark, "h03-src")
    sio.write_stream_files(e, src, "ts")
    schema = spark.read.parquet(src).drop("_part").schema
    stream = sio.replay_stream(spark, src, schema, files_per_trigger=10).drop("_part")
    alarms = detector_state_stream(stream, ["series"], ["i"], "err", "adwin")
    out = scratch_path(spark, "h03-out")
    q = (alarms.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "h03-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("i")


@query("h04_unlabelled")
def h04(spark, sf_dir):
    seq = scored_trips(spark, sf_dir, label_gap_every=10)
    rm = ev.rolling_metrics(ev.prequential(seq))
    return rm.select("record_id", "gidx", "lidx", r6("prediction").alias("prediction"), "n", r6("mae").alias("mae"),
                     r6("r2").alias("r2"), r6("rolling_mae").alias("rolling_mae"))


@query("h05_metrics_long")
def h05(spark, sf_dir):
    rm = ev.rolling_metrics(ev.prequential(_scored(spark, sf_dir)))
    return mon.metrics_long(ev.snapshot(rm), labels={"source": "trips"})


def _hist(spark, sf_dir):
    bounds = [b * 1000 for b in mon.LATENCY_BOUNDS]
    return mon.histogram(fx.trips(spark, sf_dir), "target", bounds)


@query("h06_histogram")
def h06(spark, sf_dir):
    return _hist(spark, sf_dir)


@query("h06_bucket_quantile")
def h06q(spark, sf_dir):
    h = _hist(spark, sf_dir)
    return mon.bucket_quantile(h, 0.5).unionByName(mon.bucket_quantile(h, 0.95)).select("q", r6("value").alias("value"))


@query("h07_throughput")
def h07(spark, sf_dir):
    t = mon.throughput(fx.trips(spark, sf_dir), "pickup_datetime", "1 minute")
    return t.select("window_start", "rows", r6("rate_per_sec").alias("rate_per_sec"))


@query("h08_status_snapshot")
def h08(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    rm = ev.rolling_metrics(ev.prequential(scored))
    snap = ev.snapshot(rm)
    seg = ev.rolling_segment_mae(scored.df, "pu_borough", ["pickup_datetime", "seq"])
    recent = ev.recent_points(scored.df)
    hist = ev.perf_history(rm)
    events = _events(spark, sf_dir)
    log, counts = dr.drift_log(events)
    return mon.status_snapshot(snap, seg, recent, hist, None, log, counts, "trips").select(
        "source", "performance", "segments", F.size("recent").alias("n_recent"), F.size("history").alias("n_history"),
        "concept_events", "spurious_events", "feature_events")


@query("f09_train_regime")
def f09(spark, sf_dir):
    from tidemark.operators import models as mo

    seq = _seq_trips(spark, sf_dir)
    total = ev.total_rows(seq)
    cont, hold = mo.train_regime(seq.df, ["passenger_count", "gc_distance_km", "pickup_hour"], "target", "gidx",
                                 total, warm_frac=0.4, holdout_frac=0.2, batch_rows=1000)
    m = ev.holdout_metrics(hold)
    c = ev.holdout_metrics(cont)
    return m.select(F.lit("holdout").alias("part"), "mae", "r2", "n").unionByName(
        c.select(F.lit("continual").alias("part"), "mae", "r2", "n"))


@query("f10_ablation")
def f10a(spark, sf_dir):
    from tidemark.operators import models as mo

    seq = _seq_trips(spark, sf_dir)
    total = ev.total_rows(seq)
    return mo.ablation(seq.df, "gidx", total, ["pickup_datetime", "seq"]).select(
        "setup", r6("mae").alias("mae"), r6("r2").alias("r2"), r6("vs_batch").alias("vs_batch"))


@query("g01_adwin_by_segment")
def g01s(spark, sf_dir):
    """ADWIN on the memory predictor's absolute errors, one series per pickup
    borough (series are scanned in parallel)."""
    s = _scored(spark, sf_dir)
    return dr.detect(s.df, "abs_err", ["pickup_datetime", "seq"], series=["pu_borough"], detector="adwin").select(
        "pu_borough", "seq")


@query("g02_page_hinkley_scan")
def g02s(spark, sf_dir):
    return dr.detect(fx.error_series(spark, sf_dir), "err", ["i"], detector="page_hinkley").select("i")


@query("g03_ddm_scan")
def g03s(spark, sf_dir):
    e = fx.error_series(spark, sf_dir).withColumn("is_error", (F.col("err") > 60).cast("double"))
    return dr.detect(e, "is_error", ["i"], detector="ddm").select("i")


@query("h09_join_labels")
def h09(spark, sf_dir):
    """Predictions stream joined with a labels stream that arrives ``target``
    seconds after pickup (watermarks on both sides, labels within one day)."""
    from tidemark.session import remove_paths, scratch_path

    t = fx.trips(spark, sf_dir)
    preds = t.select("record_id", F.col("pickup_datetime").cast("timestamp").alias("pred_ts"), "pickup_datetime")
    labels = t.select("record_id", (F.col("pickup_datetime").cast("timestamp")
                                    + F.make_interval(secs=F.col("target"))).alias("label_ts"),
                      F.col("target").alias("label"))
    src_p, src_l = scratch_path(spark, "h09-preds"), scratch_path(spark, "h09-labels")
    sio.write_stream_files(preds, src_p, "pickup_datetime")
    sio.write_stream_files(labels, src_l, "label_ts")
    ps_ = sio.replay_stream(spark, src_p, spark.read.parquet(src_p).schema, 10).drop("_part", "pickup_datetime")
    ls_ = sio.replay_stream(spark, src_l, spark.read.parquet(src_l).schema, 10).drop("_part")
    joined = mon.join_labels(ps_, ls_, watermark="1 hour", bound="1 day")
    out = scratch_path(spark, "h09-out")
    ckpt = scratch_path(spark, "h09-ckpt")
    q = (joined.writeStream.format("parquet").option("path", out).outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    remove_paths(spark, src_p, src_l, ckpt)
    res = spark.read.parquet(out)
    return res.select("record_id", F.col("pred_ts").cast("timestamp_ntz").alias("pred_ts"),
                      F.col("label_ts").cast("timestamp_ntz").alias("label_ts"), r6("label").alias("label"))


@query("e11_registry_champion")
def e11(spark, sf_dir):
    """Register the global-mean model (champion), then the zone-pair memory
    candidate; move the alias only if the promotion rule says so."""
    from tidemark.operators import registry as rg
    from tidemark.session import scratch_path

    train, hold = frozen_split(spark, sf_dir)
    mean = train.agg(F.avg("target")).first()[0]
    champ = ev.holdout_metrics(hold.withColumn("prediction", F.lit(mean))).first()
    cand = ev.holdout_metrics(_holdout_memory(spark, sf_dir)).first()
    root = scratch_path(spark, "e11-registry")
    v1 = rg.register(spark, root, "global-mean", int(train.count()), {"mae": champ["mae"]}, "trips")
    rg.set_alias(spark, root, v1)
    v2 = rg.register(spark, root, "zone-pair memory", int(train.count()), {"mae": cand["mae"]}, "trips")
    schema = "mae double, r2 double"
    row = lambda m: spark.createDataFrame([(m["mae"], m["r2"])], schema)
    if ev.promotion_decision(row(cand), row(champ)).first()["promote"]:
        rg.set_alias(spark, root, v2)
    return rg.champion(spark, root).select("version", "reason", "step", r6(F.col("metrics")["mae"]).alias("mae"))
