"""Composed flows over the trips stand-in: features, the ordered stream and
the zone-pair memory predictor whose errors feed evaluation and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import shrink
from tidemark.operators.cleaning import with_calendar
from tidemark.operators.encoders import DEFAULT_SMOOTHING, encode_long, prior_global_mean
from tidemark.operators.geo import with_zone_pair
from tidemark.plans.ordering import Sequenced, running, sequence
from tidemark.sources import fixtures

ORDER = fixtures.TRIP_ORDER


def trip_features(spark: SparkSession, sf_dir: str, label_gap_every: int | None = None) -> DataFrame:
    """Trips with zone-pair (C4) and calendar (B4) features."""
    t = fixtures.trips(spark, sf_dir, label_gap_every)
    z = fixtures.zones(spark, sf_dir)
    return with_calendar(with_zone_pair(t, z), "pickup_datetime")


def sequenced_trips(spark: SparkSession, sf_dir: str, label_gap_every: int | None = None,
                    indexed: bool = True) -> Sequenced:
    """The feature table in stream order with engine index ``gidx``,
    labelled-row index ``lidx`` and prior global label mean ``g``, all from
    one checkpointed pass (which also fixes the range buckets)."""
    seq = sequence(trip_features(spark, sf_dir, label_gap_every), ORDER, materialize=not indexed)
    if not indexed:
        return seq
    y = F.col("target")
    lab = y.isNotNull()
    s = running(seq, sums={"_gc": F.lit(1).cast("long"), "_lc": lab.cast("long"), "_gs": y}, inclusive=True)
    prior_n = F.col("_lc") - lab.cast("long")
    prior_s = F.col("_gs") - F.coalesce(y, F.lit(0.0))
    out = (s.df.withColumn("gidx", F.col("_gc") - 1)
               .withColumn("lidx", F.when(lab, F.col("_lc") - 1))
               .withColumn("g", F.when(prior_n > 0, prior_s / prior_n).otherwise(F.lit(0.0)))
               .drop("_gc", "_lc", "_gs"))
    return seq.with_df(out)


def memory_predictions(seq: Sequenced, k: float = DEFAULT_SMOOTHING, y: str = "target") -> Sequenced:
    """Prediction = shrunk cumulative mean of earlier labels of the zone pair
    (the long horizon of the (pu, do) encoder), global prior mean as fallback."""
    s = seq if "g" in seq.df.columns else prior_global_mean(seq, y, "g")
    s = encode_long(s, ["pu_zone", "do_zone"], y, "te_pair")
    out = s.df.withColumn("prediction", shrink("te_pair_n", "te_pair_long", "g", k))
    return seq.with_df(out)
