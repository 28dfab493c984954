"""Sources (modelled on the reference's data-source tests)."""

import pytest

from tidemark.sources import io as sio
from tidemark.sources.synthetic import drift_table


def test_synthetic_roles_and_rows(spark):
    df, roles = sio.build_source("synthetic", spark, n=100, n_features=3)
    rows = df.collect()
    assert len(rows) == 100 and roles.target == "y" and all(r["y"] is not None for r in rows)
    assert set(roles.numeric) == {"x0", "x1", "x2"}


def test_same_seed_same_table(spark):
    a = [r["y"] for r in drift_table(spark, 50, 4, seed=7).orderBy("i").collect()]
    b = [r["y"] for r in drift_table(spark, 50, 4, seed=7).repartition(3).orderBy("i").collect()]
    assert a == b


def test_drift_flag(spark):
    rows = {r["i"]: r["drifted"] for r in drift_table(spark, 60, 5, at_sample=50).collect()}
    assert rows[49] is False and rows[55] is True


def test_unknown_source_is_error(spark):
    with pytest.raises(ValueError):
        sio.build_source("nope", spark)


def test_zone_csv_round_trip(spark, tmp_dir):
    from tidemark.sources import fixtures as fx

    z = fx.zones(spark, "/root/testdata/sf0.001")
    sio.write_zones(z, f"{tmp_dir}/zones")
    back = sio.read_zones(spark, f"{tmp_dir}/zones")
    assert back.count() == z.count() and dict(back.dtypes)["x_km"] == "double"


def test_raw_scan_reads_only_needed_columns(spark, tmp_dir):
    from tidemark.sources import fixtures as fx

    raw = fx.raw_trips(spark, "/root/testdata/sf0.001").selectExpr(
        "pickup AS tpep_pickup_datetime", "dropoff AS tpep_dropoff_datetime", "passenger_count", "trip_distance",
        "ratecode_id AS RatecodeID", "pu_id AS PULocationID", "do_id AS DOLocationID", "l_orderkey AS extra")
    raw.write.parquet(f"{tmp_dir}/raw")
    df = sio.read_raw_trips(spark, f"{tmp_dir}/raw")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan.split("ReadSchema")[1]


def test_report_json(spark, tmp_dir):
    r = sio.report_row(spark, {"decision": "PROMOTE", "candidate": {"mae": 1.5}, "by_borough": {"A": 2.0}})
    sio.write_report(r, f"{tmp_dir}/rep")
    back = spark.read.json(f"{tmp_dir}/rep").first()
    assert back["decision"] == "PROMOTE" and back["candidate"]["mae"] == 1.5


def test_prepared_write_prunes_partitions(spark, tmp_dir):
    from tidemark.operators.cleaning import prepare_trips
    from tidemark.sources import fixtures as fx

    p = prepare_trips(fx.raw_trips(spark, "/root/testdata/sf0.001"), fx.RAW_MIN_S, fx.RAW_MAX_S)
    sio.write_prepared(p, f"{tmp_dir}/prep")
    back = spark.read.parquet(f"{tmp_dir}/prep").where("pickup_month = 3")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "pickup_month" in plan.split("PartitionFilters")[1][:200]
    assert back.count() == p.where("pickup_month = 3").count()


def test_append_records_feed_the_stream(spark, tmp_dir):
    from tidemark.sources import fixtures as fx

    t = fx.trips(spark, "/root/testdata/sf0.001").limit(10)
    sio.append_records(t.where("seq < 5"), f"{tmp_dir}/in")
    sio.append_records(t.where("seq >= 5").withColumn("target", t.target * 0 + None), f"{tmp_dir}/in")
    stream = sio.replay_stream(spark, f"{tmp_dir}/in", t.schema, files_per_trigger=1)
    q = (stream.writeStream.format("parquet").option("path", f"{tmp_dir}/out")
         .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/out")
    assert out.count() == t.count() and out.where("target IS NULL").count() == t.where("seq >= 5").count()


def test_replay_bounded_by_max_samples(spark, tmp_dir):
    from tidemark.sources import fixtures as fx

    t = fx.trips(spark, "/root/testdata/sf0.001")
    sio.write_stream_files(t, f"{tmp_dir}/src", "pickup_datetime")
    schema = spark.read.parquet(f"{tmp_dir}/src").schema
    s = sio.replay_stream(spark, f"{tmp_dir}/src", schema, files_per_trigger=5, max_samples=123)
    q = (s.writeStream.format("parquet").option("path", f"{tmp_dir}/out")
         .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/out").count() == 123
