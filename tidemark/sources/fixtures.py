"""Stand-in views over the driver tables for the reference's inputs.

* ``zones``: nations as zones, regions as boroughs (ids 25, 26 never exist and
  play the part of unknown zones).
* ``trips``: one labelled trip per event; total order ``(pickup_datetime, seq)``.
* ``raw_trips``: dirty raw trip records from lineitem x orders (about half have
  a negative duration), with a unique tie-break ``(l_orderkey, l_linenumber,
  l_partkey, l_suppkey)`` and the month of the "file" each row came from.
* ``zone_vertices``: closed polygon rings derived from nations.
* ``error_series``: an error stream with a step injected at row 6000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read_table

TRIP_ORDER = ("pickup_datetime", "seq")
RAW_TIE_BREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

# Cleaning limits used with the raw stand-in: 1 day .. 1000 days, in seconds.
RAW_MIN_S = 86_400
RAW_MAX_S = 86_400_000

# Fixed values of the stand-in definitions.
AIRPORT_KEYS = (3, 17)
ZONE_MODULUS = 27
# ring template (part, seq, x, y): a closed 4x3 rectangle, a closed triangle
# (only for even keys) and a 2-point ring that the centroid skips
RING_TEMPLATE = (
    (0, 0, 0.0, 0.0), (0, 1, 4.0, 0.0), (0, 2, 4.0, 3.0), (0, 3, 0.0, 3.0), (0, 4, 0.0, 0.0),
    (1, 0, 6.0, 6.0), (1, 1, 7.0, 6.0), (1, 2, 7.0, 8.0), (1, 3, 6.0, 6.0),
    (2, 0, 9.0, 9.0), (2, 1, 9.0, 9.0),
)
ERROR_STEP_AT = 6000
ERROR_STEP = 40.0


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
            .select(key.cast("string").alias("location_id"),
                    F.col("r_name").alias("borough"),
                    F.col("n_name").alias("zone"),
                    ((key * 7) % 25 * F.lit(1.5)).alias("x_km"),
                    ((key * 11) % 25 * F.lit(1.2)).alias("y_km"),
                    F.when(key.isin(*AIRPORT_KEYS), 1).otherwise(0).alias("is_airport")))


def trips(spark: SparkSession, sf_dir: str, label_gap_every: int | None = None) -> DataFrame:
    """Trips view; with ``label_gap_every`` every n-th trip has no label yet."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    target = F.col("value")
    if label_gap_every:
        target = F.when(F.col("event_id") % label_gap_every == 0, F.lit(None).cast("double")).otherwise(target)
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("record_id"),
        F.col("ts").alias("pickup_datetime"),
        target.alias("target"),
        (F.col("user_id") % ZONE_MODULUS).cast("string").alias("pu_zone"),
        (k % ZONE_MODULUS).cast("string").alias("do_zone"),
        F.col("event_type").alias("ratecode"),
        (k % 6 + 1).alias("passenger_count"),
    )


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders")
    cu = read_table(spark, sf_dir, "customer")
    su = read_table(spark, sf_dir, "supplier")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
         .join(cu, od.o_custkey == cu.c_custkey)
         .join(su, li.l_suppkey == su.s_suppkey))
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("o_orderdate").alias("pickup"),
        F.col("l_shipdate").alias("dropoff"),
        F.nullif(F.col("l_linenumber") - 1, F.lit(3)).alias("passenger_count"),
        (F.col("l_quantity") - 2).alias("trip_distance"),
        F.nullif(F.col("l_linenumber"), F.lit(7)).alias("ratecode_id"),
        F.col("c_nationkey").alias("pu_id"),
        F.col("s_nationkey").alias("do_id"),
        F.date_trunc("month", F.col("l_shipdate")).alias("src_month"),
    )


def zone_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    template = F.array(*[
        F.struct(F.lit(p).alias("part"), F.lit(s).alias("seq"), F.lit(x).alias("x"), F.lit(y).alias("y"))
        for p, s, x, y in RING_TEMPLATE])
    key = F.col("n_nationkey")
    return (nation.select(key, F.explode(template).alias("v"))
            .where((F.col("v.part") != 1) | (key % 2 == 0))
            .select(key.alias("id"), F.col("v.part").alias("part"), F.col("v.seq").alias("seq"),
                    (key * 10 + F.col("v.x")).alias("x"), (key * 5 + F.col("v.y")).alias("y")))


def error_series(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    step = F.when(F.col("event_id") >= ERROR_STEP_AT, F.lit(ERROR_STEP)).otherwise(F.lit(0.0))
    return ev.select(F.col("event_id").alias("i"), F.col("ts"), (F.abs(F.col("value") - 50) + step).alias("err"), *keep)
