"""Composed flows as queries: sources and sinks written and read back, learners
on the full feature set, the detector-to-alert chain and the metric export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import r6
from tidemark.operators import drift as dr
from tidemark.operators import encoders as en
from tidemark.operators import evaluation as ev
from tidemark.operators import features as fe
from tidemark.operators import models as mo
from tidemark.operators import psi as ps
from tidemark.plans.ordering import sequence
from tidemark.plans.trips import ORDER, memory_predictions, sequenced_trips, trip_features
from tidemark.session import scratch_path
from tidemark.sources import fixtures as fx
from tidemark.sources import io as sio
from tidemark.streaming import monitoring as mon

FLOWS: dict = {}


def flow(name: str):
    def deco(fn):
        FLOWS[name] = fn
        return fn
    return deco


# ------------------------------------------------------------- sources and sinks
@flow("a01_raw_scan")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips under their file names, scanned for the needed columns only."""
    path = scratch_path(spark, "a01")
    keys = list(fx.RAW_TIE_BREAK)
    raw = fx.raw_trips(spark, sf_dir).select(
        F.col("pickup").alias("tpep_pickup_datetime"), F.col("dropoff").alias("tpep_dropoff_datetime"), "passenger_count", "trip_distance",
        F.col("ratecode_id").alias("RatecodeID"), F.col("pu_id").alias("PULocationID"), F.col("do_id").alias("DOLocationID"),
        F.lit("not read").alias("store_and_fwd_flag"), *keys)
    raw.write.parquet(path)
    return sio.read_raw_trips(spark, path, (*sio.RAW_COLUMNS, *keys))


@flow("a03_prepared_scan")
def a03(spark, sf_dir):
    """Prepared trips written by month and read with zone-pair features."""
    path = scratch_path(spark, "a03")
    trips = fx.trips(spark, sf_dir).withColumn("pickup_month", F.month("pickup_datetime")).withColumn(
        "route_distance_km", F.when(F.col("seq") % 4 != 0, F.col("seq") % 50 / 8.0))
    sio.write_prepared(trips, path)
    df = sio.prepared_trips(spark, path, fx.zones(spark, sf_dir))
    return df.select("seq", "pickup_month", r6("route_distance_km").alias("route_distance_km"), r6("gc_distance_km").alias("gc_distance_km"),
                     "pu_borough", "do_borough")


@flow("a04_zone_csv")
def a04(spark, sf_dir):
    path = scratch_path(spark, "a04")
    sio.write_zones(fx.zones(spark, sf_dir), path)
    return sio.read_zones(spark, path)


@flow("a07_write_prepared")
def a07(spark, sf_dir):
    from tidemark.plans.catalog import QUERIES

    path = scratch_path(spark, "a07")
    sio.write_prepared(QUERIES["b07_prepared_trips"](spark, sf_dir), path)
    return spark.read.parquet(path)


@flow("a08_write_zones")
def a08(spark, sf_dir):
    from tidemark.plans.catalog import QUERIES

    path = scratch_path(spark, "a08")
    sio.write_zones(QUERIES["c03_zone_table"](spark, sf_dir), path)
    return sio.read_zones(spark, path)


@flow("a09_run_report")
def a09(spark, sf_dir):
    path = scratch_path(spark, "a09")
    seg = trip_features(spark, sf_dir).groupBy("pu_borough").agg(F.count("target").alias("n"), F.sum("target").alias("s"))
    report = seg.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean_target"),
                     F.map_from_entries(F.collect_list(F.struct("pu_borough", "n"))).alias("by_borough"))  # six boroughs at most
    sio.write_report(report, path)
    back = spark.read.schema("n bigint, mean_target double, by_borough map<string,bigint>").json(path)
    return back.select("n", r6("mean_target").alias("mean_target"), F.explode("by_borough").alias("borough", "borough_n"))


def _replayed(spark, df, name, ts, schema_of=None):
    src, out = scratch_path(spark, f"{name}-src"), scratch_path(spark, f"{name}-out")
    sio.write_stream_files(df, src, ts)
    stream = sio.replay_stream(spark, src, spark.read.parquet(src).drop("_part").schema, files_per_trigger=10)
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, f"{name}-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@flow("a10_replay")
def a10(spark, sf_dir):
    return _replayed(spark, fx.trips(spark, sf_dir), "a10", "pickup_datetime").select("seq", "record_id", r6("target").alias("target"))


@flow("a11_append_records")
def a11(spark, sf_dir):
    """Labelled and unlabelled records pushed separately into one folder."""
    path, t = scratch_path(spark, "a11"), fx.trips(spark, sf_dir, 10).select("seq", "record_id", "target")
    sio.append_records(t.where("target IS NOT NULL"), path)
    sio.append_records(t.where("target IS NULL"), path)
    return spark.read.parquet(path).select("seq", "record_id", r6("target").alias("target"))


# ----------------------------------------------------------------- features, learners
@flow("d09_one_hot_scale")
def d09(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    f = trip_features(spark, sf_dir)
    pipeline = fe.feature_pipeline(["passenger_count", "gc_distance_km"], ["ratecode"])
    x = vector_to_array("features")
    out = pipeline.fit(f).transform(f).withColumn("x", x)
    return out.select("seq", r6(F.col("x")[0]).alias("passenger_scaled"), r6(F.col("x")[1]).alias("distance_scaled"),
                      (F.array_position(F.slice("x", 3, 1000), 1.0) - 1).cast("bigint").alias("hot"))


def _split(spark, sf_dir):
    return ev.time_split(sequenced_trips(spark, sf_dir), 0.8)


def _stump(train, fit=mo.fit_tree, **kw):
    return fit(train, numeric=["is_weekend"], categorical=[], ignore=(), max_depth=1, **kw)


@flow("e02_tree_stump")
def e02(spark, sf_dir):
    """A depth-one tree on one binary feature predicts the group means."""
    train, hold = _split(spark, sf_dir)
    return _stump(train, min_instances=1).transform(hold).select("seq", r6("prediction").alias("prediction"))


@flow("e03_tree_since_drift")
def e03(spark, sf_dir, alarms=None):
    """The tree refit on the rows after the last validated drift."""
    seq = sequenced_trips(spark, sf_dir)
    start = (alarms or chain)(spark, sf_dir).where("validated").agg(F.max("i")).first()[0]
    model = mo.fit_tree_since(seq.df, "gidx", int(start if start is not None else -1) + 1, numeric=["is_weekend"], categorical=[], ignore=(),
                              max_depth=1, min_instances=1)
    return model.transform(seq.df).select("seq", r6("prediction").alias("prediction"))


@flow("e04_forest_single")
def e04(spark, sf_dir):
    """A forest of one tree on the plain sample equals the tree."""
    train, hold = _split(spark, sf_dir)
    return _stump(train, mo.fit_forest, trees=1, bootstrap=False).transform(hold).select("seq", r6("prediction").alias("prediction"))


@flow("e07_score")
def e07(spark, sf_dir):
    """Inference on held-out rows: frozen encoders, then the model; nothing learns."""
    train, hold = _split(spark, sf_dir)
    state = en.fit_encoder(train, list(ORDER), encoders=[("do_zone",)])
    out = mo.score(_stump(train, min_instances=1), hold, state)
    return out.select("seq", r6("prediction").alias("prediction"), r6("te_do_zone_long").alias("te_do_zone_long"), r6("te_do_zone_med").alias("te_do_zone_med"))


def _from_bundle(spark, sf_dir, load):
    train, hold = _split(spark, sf_dir)
    path = scratch_path(spark, "bundle")
    mo.save_bundle(mo.Bundle(None, en.fit_encoder(train, list(ORDER)), {"name": "trips"}, {"rows": train.count()}), path)
    out = en.apply_encoder(hold, load(path).encoder_state)
    cols = [en.encoder_name(e, h) for e in en.DEFAULT_ENCODERS for h in en.DEFAULT_HORIZONS]
    return out.select("seq", r6("g_frozen").alias("g_frozen"), *[r6(c).alias(c) for c in cols])


@flow("e09_bundle")
def e09(spark, sf_dir):
    return _from_bundle(spark, sf_dir, lambda path: mo.load_bundle(spark, path))


@flow("e10_warm_start")
def e10(spark, sf_dir):
    return _from_bundle(spark, sf_dir, lambda path: mo.maybe_warm_start(spark, path, "trips"))


@flow("e01_continual_ridge")
def e01c(spark, sf_dir):
    """Each batch of 1000 rows predicted by the ridge fit on all rows before it."""
    df = mo.continual_linear(sequenced_trips(spark, sf_dir).df, ["gc_distance_km", "passenger_count"], "target", "gidx", 1000)
    return df.select("seq", r6("prediction").alias("prediction"))


LEARNER_NUMERIC = ("passenger_count", "is_weekend", "is_rush_hour", "gc_distance_km", "bearing_sin", "bearing_cos", "same_borough",
                   "pu_airport", "do_airport")


def learner_predictions(spark, sf_dir, batch_rows: int = 500, warmup: int = 100, label_gap_every: int | None = None):
    """The learner on its whole feature set: cyclical calendar, geography and
    all nine encoders (D1, C4, D5-D7), the standardized target (D10) and the
    warm-up gate (D11) around the continual ridge (E1)."""
    seq = sequenced_trips(spark, sf_dir, label_gap_every)
    encoded = en.multi_encode(seq)
    gated = fe.warmup_mask(fe.target_scale(sequence(fe.with_cyclical(encoded), ORDER)), warmup=warmup)
    te = [en.encoder_name(e, h) for e in en.DEFAULT_ENCODERS for h in en.DEFAULT_HORIZONS]
    cyc = [f"{c}_{s}" for c in ("pickup_hour", "pickup_dayofweek", "pickup_month") for s in ("sin", "cos")]
    rows = gated.df.withColumn("_learn", F.when(F.col("learns"), F.col("y_scaled")))
    pred = mo.continual_linear(rows, [*LEARNER_NUMERIC, *cyc, *te], "_learn", "gidx", batch_rows, name="_scaled")
    value = F.when(F.col("model_active"), F.col("_scaled") * F.col("t_std_prior") + F.col("t_mean_prior")).otherwise(F.col("t_mean_prior"))
    return pred.withColumn("prediction", value).drop("_scaled", "_learn", "_bucket")


@flow("e01_learner_pipeline")
def e01p(spark, sf_dir):
    """Test-then-train metrics of the full learner along the stream."""
    seq = sequence(ev.with_errors(learner_predictions(spark, sf_dir)), ORDER)
    rm = ev.rolling_metrics(ev.prequential(seq))
    return rm.select("seq", "gidx", r6("prediction").alias("prediction"), "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"),
                     r6("r2").alias("r2"), r6("rolling_mae").alias("rolling_mae"))


# ------------------------------------------------------------------- drift chain
def error_seq(spark, sf_dir):
    return sequence(fx.error_series(spark, sf_dir), ["i"])


def chain(spark, sf_dir):
    seq = error_seq(spark, sf_dir)
    return dr.alarm_chain(seq, dr.block_alarms(seq), cooldown=3000)


@flow("g01_block_alarms")
def g01(spark, sf_dir):
    a = dr.block_alarms(error_seq(spark, sf_dir))
    return a.select("i", r6("score").alias("score"), r6("mean_before").alias("mean_before"), r6("mean_after").alias("mean_after"))


@flow("g13_alarm_chain")
def g13(spark, sf_dir, chain=chain):
    c = chain(spark, sf_dir)
    return c.select("type", "i", "detector", r6("score").alias("score"), "validated", "direction", r6("rel_shift").alias("rel_shift"),
                    r6("effect").alias("effect"), "action")


@flow("g12_retrain_flag")
def g12(spark, sf_dir, chain=chain):
    c = chain(spark, sf_dir)
    a, b = dr.retrain_flag(c), dr.retrain_flag(c, promoted_at=10 ** 12)
    return a.withColumn("state", F.lit("before promotion")).unionByName(b.withColumn("state", F.lit("after promotion")))


@flow("e12_metric_log_alarms")
def e12(spark, sf_dir, chain=chain):
    """The metric log with the alarm chain's validated drifts and the PSI flags up to each step."""
    from tidemark.plans.catalog import _psi_time

    seq = memory_predictions(sequenced_trips(spark, sf_dir))
    rm = ev.rolling_metrics(ev.prequential(seq.with_df(ev.with_errors(seq.df))))
    flags = ps.psi_flag(_psi_time(spark, sf_dir)).where("feature_drift").select(
        F.lit("feature").alias("type"), (F.col("check") - 1).alias("i"), F.lit(True).alias("validated"))
    log = ev.metric_log(rm, "gidx", 500, events=chain(spark, sf_dir).select("type", "i", "validated").unionByName(flags))
    return log.select("step", r6("rolling_mae").alias("rolling_mae"), "concept_drift_events", "feature_drift_events")


@flow("g10_psi_encoders")
def g10(spark, sf_dir):
    """PSI of encoder columns between the first 5000 labelled rows and the rest."""
    seq = sequenced_trips(spark, sf_dir)
    df = en.multi_encode(seq, encoders=[("do_zone",)])
    cols = [en.encoder_name(("do_zone",), h) for h in en.DEFAULT_HORIZONS]
    # values that equal in SQL up to the last bits fall into the same bin
    df = df.select("lidx", *[F.round(c, 6).alias(c) for c in cols])
    return ps.psi_numeric(df.where("lidx < 5000"), df.where("lidx >= 5000"), cols).select("feature", r6("psi").alias("psi"))


# --------------------------------------------------------------------- monitoring
@flow("h05_metric_export")
def h05(spark, sf_dir, chain=chain):
    seq = memory_predictions(sequenced_trips(spark, sf_dir))
    scored = seq.with_df(ev.with_errors(seq.df))
    rm = ev.rolling_metrics(ev.prequential(scored))
    snap = ev.snapshot(rm)
    totals = scored.df.agg(F.count(F.lit(1)).alias("samples_total"), F.count("target").alias("labeled_total"), F.count("prediction").alias("predictions_total"),
                           F.max_by("target", F.struct(*ORDER)).alias("last_observed"), F.max_by("prediction", F.struct(*ORDER)).alias("last_predicted"))
    c = chain(spark, sf_dir)
    drift = c.agg(F.count_if("validated").alias("concept_drift_total"), F.count_if(~F.col("validated")).alias("spurious_total"))
    flag = dr.retrain_flag(c).select(F.col("retrain_recommended").cast("int").alias("retrain_recommended"))
    psi = ps.psi_categorical(seq.df.where("lidx < 5000"), seq.df.where("lidx >= 5000"), ["pu_borough", "ratecode"])
    parts = [mon.metric_rows(snap, snap.columns), mon.metric_rows(totals, totals.columns), mon.metric_rows(drift, drift.columns),
             mon.metric_rows(flag, flag.columns), mon.metric_rows(psi, ["psi"], label="feature")]
    for seg in ("pu_borough", "pickup_hour"):
        m = ev.rolling_segment_mae(scored.df, seg, list(ORDER)).withColumnRenamed("segment", seg)
        parts.append(mon.metric_rows(m.withColumnRenamed("rolling_mae", "segment_mae"), ["segment_mae"], label=seg))
    last = scored.df.agg(F.max("pickup_datetime")).first()[0]  # the scrape's time is the stream's
    out = mon.metric_export(parts, F.lit(last).cast("timestamp_ntz"), "trips")
    return out.select("ts", "source", "metric", "label", r6("value").alias("value"))


@flow("h08_status_full")
def h08(spark, sf_dir, chain=chain, version=lambda spark, sf_dir: "v1"):
    """The whole status row; maps and lists are written out as text, in order (PSI in ten-thousandths)."""
    seq = memory_predictions(sequenced_trips(spark, sf_dir))
    scored = seq.with_df(ev.with_errors(seq.df))
    rm = ev.rolling_metrics(ev.prequential(scored))
    events = chain(spark, sf_dir).select("type", "i", "validated", "direction", "action")
    totals = scored.df.agg(F.count(F.lit(1)).alias("samples_processed"), F.count("target").alias("labeled_samples"),
                           F.lit(version(spark, sf_dir)).alias("model_version"), F.lit(1).alias("_one"))
    totals = totals.join(dr.retrain_flag(events).withColumn("_one", F.lit(1)), "_one").drop("_one")  # two one-row frames
    psi = ps.psi_categorical(seq.df.where("lidx < 5000"), seq.df.where("lidx >= 5000"), ["pu_borough", "ratecode"])
    log, counts = dr.drift_log(events)
    by = lambda seg: ev.rolling_segment_mae(scored.df, seg, list(ORDER))
    row = mon.status_snapshot(ev.snapshot(rm), by("pu_borough"), ev.recent_points(scored.df), ev.perf_history(rm), psi, log, counts, "trips",
                              totals, by("pickup_hour"))

    def pairs(m, unit=None):
        text = lambda v: (F.round(v * unit).cast("bigint") if unit else v).cast("string")
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], text(e["value"]))), ";")

    def items(a, *cols):
        return F.array_join(F.transform(F.array_sort(a), lambda e: F.concat_ws(":", *[e[c].cast("string") for c in cols])), ";")

    return row.select(
        "source", "samples_processed", "labeled_samples", "model_version", "alerts", "last_alert", "retrain_recommended", "concept_events",
        "spurious_events", "feature_events", F.col("performance.mae").alias("mae"), F.col("performance.rolling_mae").alias("rolling_mae"),
        pairs("segments").alias("segments"), pairs("hour_segments").alias("hour_segments"), pairs("feature_psi", 10_000).alias("feature_psi"),
        items("recent", "index", "actual", "predicted").alias("recent"), items("history", "index", "rolling_mae").alias("history"),
        items("drift_events", "type", "i", "validated", "direction", "action").alias("drift_events"))


@flow("f09_regime_window")
def f09(spark, sf_dir):
    """Warm-up, continual batches over a window of two, frozen holdout."""
    seq = sequenced_trips(spark, sf_dir)
    cont, hold = mo.train_regime(seq.df, ["gc_distance_km", "passenger_count"], "target", "gidx", ev.total_rows(seq),
                                 warm_frac=0.4, holdout_frac=0.2, batch_rows=500, window_batches=2)
    parts = [ev.holdout_metrics(d).select(F.lit(name).alias("part"), r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("r2").alias("r2"), "n")
             for name, d in (("continual", cont), ("holdout", hold))]
    return parts[0].unionByName(parts[1])


#: Setups of the ridge ablation; their statistics are sub-matrices of one Gram matrix.
RIDGE_SETUPS = {"mean": (), "route": ("gc_distance_km",), "riders": ("passenger_count",), "borough": ("same_borough",),
                "route + riders": ("gc_distance_km", "passenger_count"), "route + borough": ("gc_distance_km", "same_borough"),
                "riders + borough": ("passenger_count", "same_borough")}


@flow("f10_ridge_setups")
def f10_ridge(spark, sf_dir):
    """every ridge setup from one pass over the training rows, scored in one pass."""
    from tidemark.operators.gram import ridge_subsets
    from tidemark.plans.catalog import frozen_split

    train, hold = frozen_split(spark, sf_dir)
    return ridge_subsets(train, hold, RIDGE_SETUPS).select(
        "setup", "n_features", r6("mae").alias("mae"), r6("r2").alias("r2"), "n")
