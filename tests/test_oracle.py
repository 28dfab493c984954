"""Registered queries against their DuckDB oracles.

A subset that touches every kind of plan runs by default on sf0.01 (drift
windows need its 10,000 rows); set TIDEMARK_ORACLE_ALL=1 to run every query
with an oracle (and TIDEMARK_ORACLE_SF to pick the data)."""

import os

import pytest

import __spark_entry__ as E
from oracle_check import compare

SF = os.environ.get("TIDEMARK_ORACLE_SF", "/root/testdata/sf0.01")
QUICK = ["a03_prepared_scan", "b07_prepared_trips", "b10_sequential_id", "b11_cleaning_report", "c04_zone_pair", "d05_encode_ewma_gaps",
         "d07_multi_encode_gaps", "d08_frozen_encoder", "d09_one_hot_scale", "e01_continual_ridge", "e01_moving_line", "e02_hoeffding_stump_scores", "e02_tree_stump", "e04_member_statistics", "e09_bundle",
         "f02_rolling_metrics", "f06_rolling_segment_hour", "f10_ridge_setups", "f14_autocorr", "flagship_prequential", "g02_page_hinkley_alarms", "g03_ddm_alarms_by_type", "g04_validate_trailing",
         "g08_psi_numeric_gaps", "g10_psi_over_time", "g13_alarm_chain", "h02_encoder_state_stream", "h05_metric_export", "h06_bucket_quantile"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("TIDEMARK_ORACLE_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    problems, left, right = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert not problems, problems[:5]


def test_metric_log_counts_the_alarm_chain(spark):
    name = "e12_metric_log_alarms"
    problems, log, _ = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert not problems, problems[:5]
    alarms = [r["i"] for r in E.queries()["g13_alarm_chain"](spark, SF).where("validated").collect()]
    assert alarms and all(c == sum(i <= s for i in alarms) for s, c in zip(log.step, log.concept_drift_events, strict=True))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "mae" in df.columns


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())
