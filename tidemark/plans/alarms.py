"""Queries that rest on the all-scales alarms: the alarms themselves, on the batch and on
the stream, their permutation control, and the drift chain behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import r6
from tidemark.operators import drift as dr
from tidemark.operators import encoders as en
from tidemark.operators import psi as ps
from tidemark.operators import restarts as rs
from tidemark.operators import scales as sc
from tidemark.plans import flows
from tidemark.plans.catalog import PSI_CATEGORICAL, PSI_NUMERIC, QUERIES, _psi_time
from tidemark.plans.ordering import BUCKET, materialize, sequence, with_global_index
from tidemark.plans.trees import stretches
from tidemark.plans.trips import sequenced_trips
from tidemark.session import remove_paths, scratch_path
from tidemark.sources import fixtures as fx
from tidemark.sources import io as sio

ALARM_FLOWS: dict = {}
SEEDS = range(20)
CHAIN_BLOCK = 500  # rows of the chain's blocks: an alarm waits until a third of the validation window has gone by
RESTART_BLOCK = 4096  # rows of a block of the detectors that start anew, dozens of alarms here
ARRIVAL = 4096  # rows of an arrival in the streamed query
MOST_ARRIVALS = 1024  # arrivals that a micro-batch takes up at most; the alarms do not depend on it


def flow(name: str):
    def deco(fn):
        ALARM_FLOWS[name] = fn
        return fn
    return deco


def _shown(alarms, *keys):
    return alarms.select(*keys, "i", "cut", "level", r6("score").alias("score"), r6("mean_before").alias("mean_before"),
                         r6("mean_after").alias("mean_after"))


def scale_chain(spark, sf_dir):
    seq = flows.error_seq(spark, sf_dir)
    return dr.alarm_chain(seq, sc.scale_alarms(seq.df, block=CHAIN_BLOCK), cooldown=3000, detector="scale-cut")


@flow("g01_scale_alarms")
def g01(spark, sf_dir):
    return _shown(sc.scale_alarms(fx.error_series(spark, sf_dir)))


@flow("g01_scale_alarms_by_type")
def g01_types(spark, sf_dir):
    """A window of its own for every event type; positions count within the type."""
    seq = sequence(fx.error_series(spark, sf_dir, "event_type").withColumnRenamed("i", "at"), ["at"])
    return _shown(sc.scale_alarms(with_global_index(seq, "i", keys=["event_type"]).df, series=["event_type"]), "event_type")


def _by_type(spark, sf_dir):
    """The errors with positions counted within the event type."""
    seq = sequence(fx.error_series(spark, sf_dir, "event_type").withColumnRenamed("i", "at"), ["at"])
    return with_global_index(seq, "i", keys=["event_type"]).df


@flow("g02_page_hinkley_alarms")
def g02(spark, sf_dir):
    """Every alarm, the detector starting anew behind each."""
    return rs.page_hinkley_alarms(fx.error_series(spark, sf_dir), block=RESTART_BLOCK)


@flow("g02_page_hinkley_alarms_by_type")
def g02_types(spark, sf_dir):
    return rs.page_hinkley_alarms(_by_type(spark, sf_dir), series=["event_type"], block=RESTART_BLOCK)


@flow("g03_ddm_alarms")
def g03(spark, sf_dir):
    """Every alarm on a large error (more than 60), rows without a value left out."""
    return rs.ddm_alarms(fx.error_series(spark, sf_dir), F.col("err") > 60, block=RESTART_BLOCK)


@flow("g03_ddm_alarms_by_type")
def g03_types(spark, sf_dir):
    return rs.ddm_alarms(_by_type(spark, sf_dir), F.col("err") > 60, series=["event_type"], block=RESTART_BLOCK)


@flow("g06_permutation_control")
def g06(spark, sf_dir):
    """False alarms on the same errors in 20 pseudo-random orders."""
    df = fx.error_series(spark, sf_dir)
    return sc.permutation_control(df, df.count(), SEEDS)


@flow("h03_scale_alarms_stream")
def h03(spark, sf_dir):
    """The alarms of the replayed stream, micro-batch by micro-batch."""
    from tidemark.streaming.scale_state import ScaleStream

    e = materialize(fx.error_series(spark, sf_dir).select(F.lit("all").alias("series"), "i", "err"))
    src, state, out, ckpt = (scratch_path(spark, f"h03-scale-{x}") for x in ("src", "state", "out", "ckpt"))
    stream = ScaleStream(state, out, ["series"])
    for first, end in stretches(-(-e.count() // ARRIVAL), MOST_ARRIVALS):  # rows arrive in order, a query run takes up what is new
        sio.append_records(e.where((F.col("i") >= first * ARRIVAL) & (F.col("i") < end * ARRIVAL)), src)
        stream.start(spark.readStream.schema(e.schema).parquet(src), ckpt).awaitTermination()
    done = materialize(spark.read.parquet(out).drop("batch_id").unionByName(stream.finish(spark)))
    remove_paths(spark, src, state, out, ckpt)
    return _shown(done)


@flow("g05_centred_on_alarms")
def g05(spark, sf_dir):
    seq = flows.error_seq(spark, sf_dir)
    s = dr.centred_summary(dr.validate_centred(seq, sc.scale_alarms(seq.df, block=CHAIN_BLOCK), seq.df.count(), w=2000))
    return s.select("checked", "valid", "spurious", r6("pct_valid").alias("pct_valid"), "degradations", "improvements",
                    r6("median_abs_rel").alias("median_abs_rel"))


def _events(spark, sf_dir):
    flags = ps.psi_flag(_psi_time(spark, sf_dir)).where("feature_drift").select(
        F.lit("feature").alias("type"), (F.col("check") - 1).alias("i"), F.lit(True).alias("validated"))
    return scale_chain(spark, sf_dir).select("type", "i", "validated").unionByName(flags)


@flow("g13_drift_log_alarms")
def g13_log(spark, sf_dir):
    return dr.drift_log(_events(spark, sf_dir))[0]


@flow("g13_drift_counts_alarms")
def g13_counts(spark, sf_dir):
    return dr.drift_log(_events(spark, sf_dir))[1]


def _psi_schedule(spark, sf_dir):
    """The whole monitored feature set at every check: numeric and categorical features and the nine encoder columns."""
    seq = sequenced_trips(spark, sf_dir)
    te = [en.encoder_name(e, h) for e in en.DEFAULT_ENCODERS for h in en.DEFAULT_HORIZONS]
    keys = dict.fromkeys([c for e in en.DEFAULT_ENCODERS for c in e])
    needed = dict.fromkeys([*seq.order, BUCKET, "lidx", "target", "g", *keys, *PSI_NUMERIC, *PSI_CATEGORICAL])  # what no step reads is not carried
    seq = seq.with_df(seq.df.select(*needed))
    rows = materialize(en.multi_encode(seq).select("lidx", *PSI_NUMERIC, *PSI_CATEGORICAL, *te)).where("lidx IS NOT NULL").withColumns({c: F.round(c, 6) for c in te})  # equal in SQL up to the last bits: same bin
    return ps.psi_over_time(rows, "lidx", [*PSI_NUMERIC, *te], PSI_CATEGORICAL, 5000, 2000, 1000, total=rows.count())


@flow("g10_psi_schedule")
def g10(spark, sf_dir):
    return _psi_schedule(spark, sf_dir).select("check", "feature", r6("psi").alias("psi"))


@flow("g11_psi_schedule_flag")
def g11(spark, sf_dir):
    f = ps.psi_flag(_psi_schedule(spark, sf_dir).withColumn("psi", F.round("psi", 9)))
    return f.select("check", r6("max_psi").alias("max_psi"), "feature_drift")


def champion_version(spark, sf_dir) -> str:
    """The version that the registry's alias names after the promotion."""
    return str(QUERIES["e11_registry_champion"](spark, sf_dir).first()["version"])


ALARM_FLOWS |= {
    "g13_scale_chain": lambda spark, sf_dir: flows.g13(spark, sf_dir, scale_chain),
    "g12_retrain_flag_scales": lambda spark, sf_dir: flows.g12(spark, sf_dir, scale_chain),
    "e12_metric_log_scales": lambda spark, sf_dir: flows.e12(spark, sf_dir, scale_chain),
    "e03_tree_since_scale_alarm": lambda spark, sf_dir: flows.e03(spark, sf_dir, scale_chain),
    "h05_metric_export_scales": lambda spark, sf_dir: flows.h05(spark, sf_dir, scale_chain),
    "h08_status_registry": lambda spark, sf_dir: flows.h08(spark, sf_dir, scale_chain, champion_version),
}
