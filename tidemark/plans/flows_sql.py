"""DuckDB SQL of the queries in ``flows``."""

from __future__ import annotations

import math

from tidemark.plans.flows import RIDGE_SETUPS
from tidemark.plans.oracle import (ERR, FEAT, G04, GRID, HOLD_MEM, ORACLE_SQL, R6, SCORED, W_ALL, PRIOR, _ewma, _psi_cat_sql, _psi_numeric_sql, _REF, _CUR, K)
from tidemark.sources import fixtures_sql as fx

FLOWS_SQL: dict[str, str] = {}

FLOWS_SQL["a01_raw_scan"] = f"""SELECT {K}, pickup AS tpep_pickup_datetime, dropoff AS tpep_dropoff_datetime, passenger_count, trip_distance,
  ratecode_id AS "RatecodeID", pu_id AS "PULocationID", do_id AS "DOLocationID" FROM ({fx.RAW_TRIPS}) r"""
FLOWS_SQL["a03_prepared_scan"] = f"""SELECT seq, pickup_month, CASE WHEN seq % 4 <> 0 THEN {R6('seq % 50 / 8e0')} ELSE 0e0 END AS route_distance_km,
  {R6('gc_distance_km')} AS gc_distance_km, pu_borough, do_borough FROM ({FEAT}) f"""
FLOWS_SQL["a04_zone_csv"] = fx.ZONES
FLOWS_SQL["a07_write_prepared"] = ORACLE_SQL["b07_prepared_trips"]
FLOWS_SQL["a08_write_zones"] = f"SELECT * REPLACE (CAST(location_id AS VARCHAR) AS location_id) FROM ({ORACLE_SQL['c03_zone_table']}) z"
FLOWS_SQL["a09_run_report"] = f"""SELECT sum(count(target)) OVER () AS n, {R6('sum(sum(target)) OVER () / sum(count(target)) OVER ()')} AS mean_target,
  pu_borough AS borough, count(target) AS borough_n FROM ({FEAT}) f GROUP BY pu_borough"""
FLOWS_SQL["a10_replay"] = f"SELECT seq, record_id, {R6('target')} AS target FROM ({fx.TRIPS}) t"
FLOWS_SQL["a11_append_records"] = f"SELECT seq, record_id, {R6('target')} AS target FROM ({fx.TRIPS_GAPPED}) t"
FLOWS_SQL["d09_one_hot_scale"] = f"""WITH f AS ({FEAT}), o AS (
  SELECT ratecode, row_number() OVER (ORDER BY count(*) DESC, ratecode) - 1 AS hot FROM f GROUP BY ratecode)
SELECT seq, {R6('(passenger_count - avg(passenger_count) OVER ()) / stddev_samp(passenger_count) OVER ()')} AS passenger_scaled,
  {R6('(gc_distance_km - avg(gc_distance_km) OVER ()) / stddev_samp(gc_distance_km) OVER ()')} AS distance_scaled, hot
FROM f JOIN o USING (ratecode)"""

_IX = f"SELECT *, row_number() OVER ({W_ALL}) - 1 AS gidx, count(*) OVER () AS total FROM ({FEAT}) f"
_STUMP = f"""WITH ix AS ({_IX}), m AS (SELECT is_weekend, avg(target) AS p FROM ix WHERE gidx < floor(total * 0.8e0) GROUP BY is_weekend)
SELECT seq, {R6('p')} AS prediction FROM ix JOIN m USING (is_weekend) WHERE gidx >= floor(total * 0.8e0)"""
FLOWS_SQL["e02_tree_stump"] = _STUMP
FLOWS_SQL["e04_forest_single"] = _STUMP
FLOWS_SQL["e09_bundle"] = ORACLE_SQL["d08_frozen_encoder"]
FLOWS_SQL["e10_warm_start"] = ORACLE_SQL["d08_frozen_encoder"]
FLOWS_SQL["e07_score"] = f"""SELECT s.seq, s.prediction, d.te_do_zone_long, d.te_do_zone_med FROM ({_STUMP}) s
JOIN ({ORACLE_SQL['d08_frozen_encoder']}) d ON s.seq = d.seq"""
FLOWS_SQL["e01_continual_ridge"] = f"""WITH ix AS ({_IX}), per AS (
  SELECT gidx // 1000 AS b, count(target) AS n, sum(target) AS sy, sum(gc_distance_km) AS s1, sum(CAST(passenger_count AS DOUBLE)) AS s2,
    sum(gc_distance_km * target) AS s1y, sum(passenger_count * target) AS s2y, sum(gc_distance_km * gc_distance_km) AS s11,
    sum(gc_distance_km * passenger_count) AS s12, sum(CAST(passenger_count * passenger_count AS DOUBLE)) AS s22 FROM ix GROUP BY 1),
c AS (SELECT b, {', '.join(f'sum({x}) OVER (ORDER BY b {PRIOR}) AS {x}' for x in ('n', 'sy', 's1', 's2', 's1y', 's2y', 's11', 's12', 's22'))} FROM per),
k AS (SELECT b, sy / n AS my, s1 / n AS m1, s2 / n AS m2, s11 - s1 * s1 / n + 2e0 AS a, s12 - s1 * s2 / n AS o, s22 - s2 * s2 / n + 2e0 AS d,
  s1y - s1 * sy / n AS e, s2y - s2 * sy / n AS f FROM c WHERE n > 0),
w AS (SELECT *, (e * d - o * f) / (a * d - o * o) AS w1, (a * f - o * e) / (a * d - o * o) AS w2 FROM k)
SELECT seq, coalesce({R6('my + w1 * (gc_distance_km - m1) + w2 * (passenger_count - m2)')}, 0e0) AS prediction
FROM ix LEFT JOIN w ON ix.gidx // 1000 = w.b"""

_BLOCK = 500
_DD = repr(math.log(2.0 * math.log(2.0 * _BLOCK) / 0.002))
ALARMS = f"""SELECT i, gap / bound AS score, m0 AS mean_before, m AS mean_after FROM (
  SELECT (b + 1) * {_BLOCK} - 1 AS i, m, m0, abs(m - m0) AS gap,
    sqrt(2e0 / {_BLOCK / 2} * {_DD} * ((v + v0) / 2 + (m - m0) * (m - m0) / 4)) + 2e0 / (3e0 * {_BLOCK / 2}) * {_DD} AS bound FROM (
    SELECT b, n, avg_ AS m, v, lag(avg_) OVER (ORDER BY b) AS m0, lag(v) OVER (ORDER BY b) AS v0 FROM (
      SELECT i // {_BLOCK} AS b, count(err) AS n, avg(err) AS avg_, var_pop(err) AS v FROM ({ERR}) e GROUP BY 1) q WHERE n = {_BLOCK}) x
  WHERE m0 IS NOT NULL) y WHERE gap > bound"""
FLOWS_SQL["g01_block_alarms"] = f"""SELECT i, {R6('score')} AS score, {R6('mean_before')} AS mean_before, {R6('mean_after')} AS mean_after FROM ({ALARMS}) a"""
_CHECKED = G04.replace(f"i IN ({GRID})", f"i IN (SELECT i FROM ({ALARMS}) g)")
CHAIN = f"""WITH RECURSIVE chk AS ({_CHECKED}), ev AS (SELECT i FROM chk WHERE validated AND direction = 'worse'),
alerts(i) AS (SELECT min(i) FROM ev
  UNION ALL SELECT (SELECT min(e.i) FROM ev e WHERE e.i - a.i >= 3000) FROM alerts a WHERE a.i IS NOT NULL)
SELECT 'concept' AS type, c.i, 'block-cut' AS detector, {R6('g.score')} AS score, c.validated, c.direction, c.rel_shift, c.effect,
  CASE WHEN c.i IN (SELECT i FROM alerts WHERE i IS NOT NULL) THEN 'retrain' WHEN c.validated THEN 'log' ELSE 'ignore' END AS action
FROM chk c JOIN ({ALARMS}) g ON c.i = g.i"""
FLOWS_SQL["g13_alarm_chain"] = CHAIN
FLOWS_SQL["e12_metric_log_alarms"] = f"""WITH ev AS (SELECT type, i, validated FROM ({CHAIN}) c
UNION ALL SELECT 'feature' AS type, "check" - 1 AS i, true AS validated FROM ({ORACLE_SQL["g11_psi_flag"]}) f WHERE feature_drift),
m AS ({ORACLE_SQL["e12_metric_log"]})
SELECT step, rolling_mae, (SELECT count(*) FROM ev WHERE validated AND type = 'concept' AND i <= step) AS concept_drift_events,
  (SELECT count(*) FROM ev WHERE validated AND type = 'feature' AND i <= step) AS feature_drift_events FROM m"""
FLOWS_SQL["g12_retrain_flag"] = f"""WITH c AS ({CHAIN})
SELECT count_if(action = 'retrain') AS alerts, max(CASE WHEN action = 'retrain' THEN i END) AS last_alert,
  count_if(action = 'retrain') > 0 AS retrain_recommended, 'before promotion' AS state FROM c
UNION ALL SELECT count_if(action = 'retrain'), max(CASE WHEN action = 'retrain' THEN i END), false, 'after promotion' FROM c"""
FLOWS_SQL["e03_tree_since_drift"] = f"""WITH ix AS ({_IX}), c AS ({CHAIN}),
m AS (SELECT is_weekend, avg(target) AS p FROM ix WHERE gidx > (SELECT coalesce(max(i), -1) FROM c WHERE validated) GROUP BY is_weekend)
SELECT seq, {R6('p')} AS prediction FROM ix JOIN m USING (is_weekend)"""

_N = f"count(target) OVER (PARTITION BY do_zone {W_ALL} {PRIOR})"


def _te(a: float) -> str:
    v = f"avg(target) OVER (PARTITION BY do_zone {W_ALL} {PRIOR})" if a == 0 else _ewma(a, "do_zone")
    return f"round(CASE WHEN {_N} > 0 THEN ({_N} * ({v}) + 20e0 * g) / ({_N} + 20e0) ELSE g END, 6)"


_ENC = f"""SELECT lidx, {_te(0.0)} AS te_do_zone_long, {_te(0.05)} AS te_do_zone_med, {_te(0.3)} AS te_do_zone_short FROM ({SCORED}) s"""
FLOWS_SQL["g10_psi_encoders"] = f"""WITH enc AS MATERIALIZED ({_ENC}), {_psi_numeric_sql('SELECT * FROM enc WHERE lidx < 5000', 'SELECT * FROM enc WHERE lidx >= 5000',
  ['te_do_zone_long', 'te_do_zone_med', 'te_do_zone_short'])}
SELECT feature, {R6('psi')} AS psi FROM psi_n"""

_SNAP = ("mae", "rmse", "r2", "rolling_mae", "rolling_rmse", "rolling_r2", "n")
_TOTALS = {"samples_total": "count(*)", "labeled_total": "count(target)", "predictions_total": "count(prediction)",
           "last_observed": "arg_max(target, gidx)", "last_predicted": "arg_max(prediction, gidx)"}
FLOWS_SQL["h05_metric_export"] = f"""WITH snap AS ({ORACLE_SQL['f03_snapshot']}), s AS ({SCORED}), c AS ({CHAIN}),
{_psi_cat_sql(_REF, _CUR, ['pu_borough', 'ratecode'])},
m AS ({" UNION ALL ".join(f"SELECT '{x}' AS metric, '' AS label, CAST({x} AS DOUBLE) AS value FROM snap" for x in _SNAP)}
{"".join(f" UNION ALL SELECT '{k}', '', CAST({v} AS DOUBLE) FROM s" for k, v in _TOTALS.items())}
UNION ALL SELECT 'concept_drift_total', '', CAST(count_if(validated) AS DOUBLE) FROM c
UNION ALL SELECT 'spurious_total', '', CAST(count_if(NOT validated) AS DOUBLE) FROM c
UNION ALL SELECT 'retrain_recommended', '', CASE WHEN count_if(action = 'retrain') > 0 THEN 1e0 ELSE 0e0 END FROM c
UNION ALL SELECT 'psi', 'feature=' || feature, psi FROM psi_c
UNION ALL SELECT 'segment_mae', 'pu_borough=' || segment, rolling_mae FROM ({ORACLE_SQL['f06_rolling_segment_mae']}) a
UNION ALL SELECT 'segment_mae', 'pickup_hour=' || segment, rolling_mae FROM ({ORACLE_SQL['f06_rolling_segment_hour']}) b)
SELECT (SELECT max(pickup_datetime) FROM s) AS ts, 'trips' AS source, metric, label, {R6('value')} AS value FROM m"""


def _joined(sql: str, text: str, order: str) -> str:
    return f"(SELECT string_agg({text}, ';' ORDER BY {order}) FROM ({sql}) x)"


_SEGMENT = "segment || '=' || rolling_mae"
_RECENT = "\"index\" || ':' || actual || ':' || predicted"
_HISTORY = "\"index\" || ':' || rolling_mae"
FLOWS_SQL["h08_status_full"] = f"""WITH c AS ({CHAIN}), snap AS ({ORACLE_SQL['f03_snapshot']}), {_psi_cat_sql(_REF, _CUR, ['pu_borough', 'ratecode'])},
flag AS (SELECT * FROM ({FLOWS_SQL['g12_retrain_flag']}) f WHERE state = 'before promotion')
SELECT 'trips' AS source, (SELECT count(*) FROM ({fx.TRIPS}) t) AS samples_processed, (SELECT count(target) FROM ({fx.TRIPS}) t) AS labeled_samples,
  'v1' AS model_version, alerts, last_alert, retrain_recommended,
  (SELECT count_if(validated) FROM c) AS concept_events, (SELECT count_if(NOT validated) FROM c) AS spurious_events, 0 AS feature_events,
  (SELECT round(mae, 4) FROM snap) AS mae, (SELECT round(rolling_mae, 4) FROM snap) AS rolling_mae,
  {_joined(ORACLE_SQL['f06_rolling_segment_mae'], _SEGMENT, 'segment')} AS segments,
  {_joined(ORACLE_SQL['f06_rolling_segment_hour'], _SEGMENT, 'segment')} AS hour_segments,
  (SELECT string_agg(feature || '=' || CAST(round(round(psi, 4) * 10000) AS BIGINT), ';' ORDER BY feature) FROM psi_c) AS feature_psi,
  {_joined(ORACLE_SQL['f16_recent_points'], _RECENT, '"index"')} AS recent,
  {_joined(ORACLE_SQL['f17_perf_history'], _HISTORY, '"index"')} AS history,
  (SELECT string_agg(concat_ws(':', type, i, validated, direction, action), ';' ORDER BY type, i) FROM c) AS drift_events
FROM flag"""

_SUMS = {"n": "count(target)", "sy": "sum(target)", "s1": "sum(gc_distance_km)", "s2": "sum(CAST(passenger_count AS DOUBLE))",
         "s1y": "sum(gc_distance_km * target)", "s2y": "sum(passenger_count * target)", "s11": "sum(gc_distance_km * gc_distance_km)",
         "s12": "sum(gc_distance_km * passenger_count)", "s22": "sum(CAST(passenger_count * passenger_count AS DOUBLE))"}
# batch ids of the continual rows; the holdout is the batch after the last
FLOWS_SQL["f09_regime_window"] = f"""WITH ix AS (SELECT *, CAST(floor(total * 0.4e0) AS BIGINT) AS w_end, CAST(floor(total * 0.8e0) AS BIGINT) AS h_start FROM ({_IX}) i),
warm AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _SUMS.items())} FROM ix WHERE gidx < w_end AND target IS NOT NULL),
b AS (SELECT *, CASE WHEN gidx < h_start THEN (gidx - w_end) // 500 ELSE -((w_end - h_start) // 500) END AS b FROM ix WHERE gidx >= w_end),
per AS (SELECT b, {', '.join(f'{v} AS {k}' for k, v in _SUMS.items())} FROM b GROUP BY b),
c AS (SELECT b, {', '.join(f'warm.{k} + coalesce(sum(per.{k}) OVER (ORDER BY b ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS {k}' for k in _SUMS)} FROM per, warm),
k AS (SELECT b, sy / n AS my, s1 / n AS m1, s2 / n AS m2, s11 - s1 * s1 / n + 2e0 AS a, s12 - s1 * s2 / n AS o, s22 - s2 * s2 / n + 2e0 AS d,
  s1y - s1 * sy / n AS e, s2y - s2 * sy / n AS f FROM c),
w AS (SELECT *, (e * d - o * f) / (a * d - o * o) AS w1, (a * f - o * e) / (a * d - o * o) AS w2 FROM k),
p AS (SELECT CASE WHEN gidx < h_start THEN 'continual' ELSE 'holdout' END AS part, target,
  my + w1 * (gc_distance_km - m1) + w2 * (passenger_count - m2) AS q FROM b JOIN w USING (b))
SELECT part, {R6('avg(abs(target - q))')} AS mae, {R6('sqrt(avg((target - q) * (target - q)))')} AS rmse,
  {R6('1 - sum((target - q) * (target - q)) / (var_pop(target) * count(*))')} AS r2, count(*) AS n FROM p WHERE target IS NOT NULL GROUP BY part"""


def _ridge_setup(name: str, features: tuple[str, ...]) -> str:
    """One row: the setup's ridge fit (closed form for at most two features) scored on the holdout."""
    a, b = [*features, "0e0", "0e0"][:2]
    return f"""SELECT '{name}' AS setup, {len(features)} AS n_features, avg(abs(e)) AS mae,
  1 - sum(e * e) / (CASE WHEN var_pop(target) * count(*) = 0 THEN 1e0 ELSE var_pop(target) * count(*) END) AS r2, count(*) AS n
FROM (SELECT h.target, h.target - (my + w1 * ({a} - m1) + w2 * ({b} - m2)) AS e FROM hold h CROSS JOIN (
  SELECT my, m1, m2, (e * d - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2 FROM (
    SELECT avg(target) AS my, avg({a}) AS m1, avg({b}) AS m2, covar_pop({a}, {a}) * count(*) + 2e0 AS a, covar_pop({a}, {b}) * count(*) AS b,
      covar_pop({b}, {b}) * count(*) + 2e0 AS d, covar_pop({a}, target) * count(*) AS e, covar_pop({b}, target) * count(*) AS f
    FROM train WHERE target IS NOT NULL AND gc_distance_km IS NOT NULL AND passenger_count IS NOT NULL AND same_borough IS NOT NULL) s) w
  WHERE h.target IS NOT NULL) x WHERE e IS NOT NULL"""


FLOWS_SQL["f10_ridge_setups"] = f"""{HOLD_MEM}, u AS ({" UNION ALL ".join(_ridge_setup(k, v) for k, v in RIDGE_SETUPS.items())})
SELECT setup, n_features, {R6('mae')} AS mae, {R6('r2')} AS r2, n FROM u"""
