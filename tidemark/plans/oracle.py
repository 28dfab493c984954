"""DuckDB SQL equivalents of the registered queries (tables are views)."""

from __future__ import annotations

from tidemark.sources import fixtures_sql as fx

ORACLE_SQL: dict[str, str] = {}

W_ALL = "ORDER BY pickup_datetime, seq"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def R6(x: str) -> str:
    """Round to 6 decimals as Spark does (no negative zero)."""
    return f"(round({x}, 6) + 0e0)"


def features_sql(trips_sql: str = fx.TRIPS) -> str:
    """Trips with zone-pair and calendar features (C4 + B4)."""
    return f"""
SELECT t.*,
  CASE WHEN zp.location_id IS NOT NULL AND zd.location_id IS NOT NULL
       THEN round(sqrt((zd.x_km - zp.x_km) * (zd.x_km - zp.x_km) + (zd.y_km - zp.y_km) * (zd.y_km - zp.y_km)), 4)
       ELSE 0e0 END AS gc_distance_km,
  CASE WHEN zp.location_id IS NOT NULL AND zd.location_id IS NOT NULL
       THEN round(sin(atan2(zd.y_km - zp.y_km, zd.x_km - zp.x_km)), 4) ELSE 0e0 END AS bearing_sin,
  CASE WHEN zp.location_id IS NOT NULL AND zd.location_id IS NOT NULL
       THEN round(cos(atan2(zd.y_km - zp.y_km, zd.x_km - zp.x_km)), 4) ELSE 0e0 END AS bearing_cos,
  CASE WHEN coalesce(zp.borough, 'Unknown') = coalesce(zd.borough, 'Unknown')
        AND coalesce(zp.borough, 'Unknown') <> 'Unknown' THEN 1e0 ELSE 0e0 END AS same_borough,
  CAST(coalesce(zp.is_airport, 0) AS DOUBLE) AS pu_airport,
  CAST(coalesce(zd.is_airport, 0) AS DOUBLE) AS do_airport,
  coalesce(zp.borough, 'Unknown') AS pu_borough,
  coalesce(zd.borough, 'Unknown') AS do_borough,
  CAST(hour(t.pickup_datetime) AS INTEGER) AS pickup_hour,
  CAST(isodow(t.pickup_datetime) - 1 AS INTEGER) AS pickup_dayofweek,
  CAST(month(t.pickup_datetime) AS INTEGER) AS pickup_month,
  CAST(CASE WHEN isodow(t.pickup_datetime) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CAST(CASE WHEN hour(t.pickup_datetime) IN (7, 8, 9, 16, 17, 18, 19) THEN 1 ELSE 0 END AS INTEGER) AS is_rush_hour
FROM ({trips_sql}) t
LEFT JOIN ({fx.ZONES}) zp ON t.pu_zone = zp.location_id
LEFT JOIN ({fx.ZONES}) zd ON t.do_zone = zd.location_id
"""


def scored_sql(trips_sql: str = fx.TRIPS, k: float = 20.0) -> str:
    """Features + engine index + labelled index + memory prediction + errors."""
    return f"""
SELECT *, abs(target - prediction) AS abs_err, (target - prediction) * (target - prediction) AS sq_err,
       prediction - target AS residual
FROM (
  SELECT *, CASE WHEN pn > 0 THEN (pn * plong + {k}e0 * g) / (pn + {k}e0) ELSE g END AS prediction
  FROM (
    SELECT f.*,
      row_number() OVER ({W_ALL}) - 1 AS gidx,
      CASE WHEN target IS NOT NULL THEN count(target) OVER ({W_ALL} {UPTO}) - 1 END AS lidx,
      coalesce(avg(target) OVER ({W_ALL} {PRIOR}), 0e0) AS g,
      count(target) OVER (PARTITION BY pu_zone, do_zone {W_ALL} {PRIOR}) AS pn,
      avg(target) OVER (PARTITION BY pu_zone, do_zone {W_ALL} {PRIOR}) AS plong
    FROM ({features_sql(trips_sql)}) f
  ) a
) b
"""


ORACLE_SQL["flagship_prequential"] = f"""
WITH s AS ({scored_sql()}),
m AS (
  SELECT *, count(target) OVER w AS n, sum(abs_err) OVER w AS sa, sum(sq_err) OVER w AS sq,
         var_pop(target) OVER w * count(target) OVER w AS sst,
         avg(abs_err) OVER ({W_ALL} ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS rolling_mae
  FROM s WINDOW w AS ({W_ALL} {UPTO})
)
SELECT record_id, gidx, round(prediction, 6) AS prediction, n,
       round(sa / n, 6) AS mae, round(sqrt(sq / n), 6) AS rmse,
       round(CASE WHEN n < 2 OR sst <= 1e-12 THEN 0e0 ELSE 1 - sq / sst END, 6) AS r2,
       round(rolling_mae, 6) AS rolling_mae
FROM m
"""


# ---------------------------------------------------------------- B: cleaning
K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
RAW_D = f"SELECT *, date_diff('microsecond', pickup, dropoff) / 1e6 AS duration_s FROM ({fx.RAW_TRIPS}) r"
CLEAN = f"""SELECT * FROM ({RAW_D}) d WHERE duration_s BETWEEN 86400 AND 86400000
  AND coalesce(passenger_count, 0) >= 1 AND trip_distance > 0
  AND pu_id IS NOT NULL AND do_id IS NOT NULL AND ratecode_id IS NOT NULL"""
PREPARED = f"""SELECT {K}, src_month, pickup AS pickup_datetime, duration_s AS target_duration_s,
  CAST(hour(pickup) AS INTEGER) AS pickup_hour, CAST(isodow(pickup) - 1 AS INTEGER) AS pickup_dayofweek,
  CAST(month(pickup) AS INTEGER) AS pickup_month,
  CAST(CASE WHEN isodow(pickup) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CAST(CASE WHEN hour(pickup) IN (7, 8, 9, 16, 17, 18, 19) THEN 1 ELSE 0 END AS INTEGER) AS is_rush_hour,
  CAST(passenger_count AS INTEGER) AS passenger_count,
  greatest(trip_distance * 1.60934, 0e0) AS route_distance_km,
  CAST(CAST(pu_id AS INTEGER) AS VARCHAR) AS pu_zone, CAST(CAST(do_id AS INTEGER) AS VARCHAR) AS do_zone,
  CAST(CAST(ratecode_id AS INTEGER) AS VARCHAR) AS ratecode
FROM ({CLEAN}) c"""

ORACLE_SQL["b01_duration"] = f"SELECT {K}, round(duration_s, 6) AS duration_s FROM ({RAW_D}) x"
ORACLE_SQL["b02_clean_trips"] = f"SELECT {K}, round(duration_s, 6) AS duration_s FROM ({CLEAN}) x"
ORACLE_SQL["b03_in_month"] = f"""SELECT {K}, pickup, src_month FROM ({fx.RAW_TRIPS}) r
WHERE pickup >= src_month AND pickup < src_month + INTERVAL 1 MONTH"""
ORACLE_SQL["b04_calendar"] = f"""SELECT seq, pickup_hour, pickup_dayofweek, pickup_month, is_weekend, is_rush_hour
FROM ({features_sql()}) f"""
ORACLE_SQL["b05_normalize_ids"] = f"""SELECT {K}, CAST(CAST(pu_id AS INTEGER) AS VARCHAR) AS pu_zone,
  CAST(CAST(do_id AS INTEGER) AS VARCHAR) AS do_zone, CAST(CAST(ratecode_id AS INTEGER) AS VARCHAR) AS ratecode,
  CAST(passenger_count AS INTEGER) AS passenger_count FROM ({fx.RAW_TRIPS}) r"""
ORACLE_SQL["b06_route_km"] = f"""SELECT {K}, round(greatest(trip_distance * 1.60934, 0e0), 6) AS route_distance_km
FROM ({fx.RAW_TRIPS}) r"""
ORACLE_SQL["b07_prepared_trips"] = f"""SELECT {K}, pickup_datetime, round(target_duration_s, 6) AS target_duration_s,
  pickup_hour, pickup_dayofweek, pickup_month, is_weekend, is_rush_hour, passenger_count,
  round(route_distance_km, 6) AS route_distance_km, pu_zone, do_zone, ratecode FROM ({PREPARED}) p"""
ORACLE_SQL["b08_cap_per_month"] = f"""SELECT {K}, src_month FROM (
  SELECT *, row_number() OVER (PARTITION BY src_month ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR),
    CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), '42')), {K}) AS rk
  FROM ({PREPARED}) p) x WHERE rk <= 100"""
ORACLE_SQL["b09_order_by_time"] = f"SELECT {K}, pickup_datetime FROM ({PREPARED}) p ORDER BY pickup_datetime, {K}"
ORACLE_SQL["b10_sequential_id"] = f"""SELECT {K}, concat('taxi-', CAST(row_number() OVER (ORDER BY pickup_datetime, {K}) - 1 AS VARCHAR)) AS record_id
FROM ({PREPARED}) p"""
ORACLE_SQL["b11_cleaning_report"] = f"""SELECT b.src_month, b.rows_before, coalesce(a.rows_after, 0) AS rows_after,
  round(coalesce(a.rows_after, 0) * 100.0e0 / greatest(b.rows_before, 1), 1) AS pct_kept
FROM (SELECT src_month, count(*) AS rows_before FROM ({RAW_D}) r GROUP BY src_month) b
LEFT JOIN (SELECT src_month, count(*) AS rows_after FROM ({CLEAN}) c GROUP BY src_month) a USING (src_month)"""
ORACLE_SQL["b11_prepared_summary"] = f"""SELECT count(*) AS n, min(pickup_datetime) AS first_ts, max(pickup_datetime) AS last_ts,
  round(avg(target_duration_s), 6) AS mean_target, round(quantile_cont(target_duration_s, 0.5), 6) AS median_target
FROM ({PREPARED}) p"""
ORACLE_SQL["b12_coerce"] = f"""SELECT seq, CAST(passenger_count AS DOUBLE) AS passenger_count,
  CAST(pickup_hour AS DOUBLE) AS pickup_hour, ratecode, pu_zone FROM ({features_sql()}) f"""
ORACLE_SQL["b13_drop_features"] = f"""SELECT seq, target, ratecode, passenger_count, gc_distance_km, bearing_sin,
  bearing_cos, same_borough, pu_airport, do_airport, pu_borough, do_borough, pickup_hour, pickup_dayofweek,
  pickup_month, is_weekend, is_rush_hour FROM ({features_sql()}) f"""
ORACLE_SQL["b14_feature_set"] = f"""SELECT {K}, round(coalesce(route_distance_km, 0e0), 6) AS route_distance_km
FROM ({PREPARED}) p"""

# ---------------------------------------------------------------- C: geography
RINGS = f"""
SELECT id, part, n_points,
  CASE WHEN abs(coalesce(a, 0)) < 1e-9 THEN mx ELSE sx / (6 * a) END AS cx,
  CASE WHEN abs(coalesce(a, 0)) < 1e-9 THEN my ELSE sy / (6 * a) END AS cy,
  CASE WHEN abs(coalesce(a, 0)) < 1e-9 THEN 0e0 ELSE abs(a) END AS area
FROM (
  SELECT id, part, count(*) AS n_points, sum(x * y1 - x1 * y) * 0.5e0 AS a,
         sum((x + x1) * (x * y1 - x1 * y)) AS sx, sum((y + y1) * (x * y1 - x1 * y)) AS sy,
         avg(x) AS mx, avg(y) AS my
  FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ({fx.VERTICES}) v
        WINDOW w AS (PARTITION BY id, part ORDER BY seq)) e
  GROUP BY id, part) s
"""
POLY = f"""
SELECT m.id, CASE WHEN coalesce(w.ta, 0) = 0 THEN m.mx ELSE w.sx / w.ta END AS x,
       CASE WHEN coalesce(w.ta, 0) = 0 THEN m.my ELSE w.sy / w.ta END AS y
FROM (SELECT id, avg(x) AS mx, avg(y) AS my FROM ({fx.VERTICES}) v GROUP BY id) m
LEFT JOIN (SELECT id, sum(cx * area) AS sx, sum(cy * area) AS sy, sum(area) AS ta
           FROM ({RINGS}) r WHERE n_points >= 3 GROUP BY id) w USING (id)
"""
ORACLE_SQL["c01_ring_centroids"] = f"""SELECT id, part, n_points, round(cx, 6) AS cx, round(cy, 6) AS cy,
  round(area, 6) AS area FROM ({RINGS}) r"""
ORACLE_SQL["c02_polygon_centroids"] = f"SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM ({POLY}) p"
ORACLE_SQL["c03_zone_table"] = f"""SELECT n_nationkey AS location_id, trim(r_name) AS borough,
  replace(trim(n_name), ',', ' ') AS zone, round(p.x * 0.0003048, 4) AS x_km, round(p.y * 0.0003048, 4) AS y_km,
  CAST(contains(lower(trim(n_name)), 'airport') AS INTEGER) AS is_airport
FROM nation JOIN region ON n_regionkey = r_regionkey JOIN ({POLY}) p ON p.id = n_nationkey ORDER BY location_id"""
ORACLE_SQL["c04_zone_pair"] = f"""SELECT seq, gc_distance_km, bearing_sin, bearing_cos, same_borough, pu_airport,
  do_airport, pu_borough, do_borough FROM ({features_sql()}) f"""
ORACLE_SQL["c05_zone_catalog"] = f"SELECT location_id AS id, zone, borough FROM ({fx.ZONES}) z ORDER BY borough, zone"
ORACLE_SQL["c06_zone_distance"] = f"""SELECT p.a, p.b,
  round(sqrt((zb.x_km - za.x_km) * (zb.x_km - za.x_km) + (zb.y_km - za.y_km) * (zb.y_km - za.y_km)), 6) AS distance_km
FROM (SELECT DISTINCT pu_zone AS a, do_zone AS b FROM ({fx.TRIPS}) t) p
JOIN ({fx.ZONES}) za ON p.a = za.location_id JOIN ({fx.ZONES}) zb ON p.b = zb.location_id"""

REQUESTS = f"""
SELECT seq, pu_zone, do_zone,
  CAST(coalesce(CASE WHEN ratecode <> 'view' THEN hour(pickup_datetime) END, 18) AS INTEGER) AS pickup_hour,
  CAST(coalesce(isodow(pickup_datetime) - 1, 2) AS INTEGER) AS pickup_dayofweek,
  CAST(coalesce(CASE WHEN ratecode <> 'signup' THEN month(pickup_datetime) END, 2) AS INTEGER) AS pickup_month,
  CAST(coalesce(CASE WHEN ratecode <> 'click' THEN passenger_count END, 1) AS INTEGER) AS passenger_count,
  coalesce(CASE WHEN ratecode <> 'error' THEN ratecode END, '1') AS ratecode
FROM ({fx.TRIPS}) t
"""
ORACLE_SQL["c07_trip_requests"] = f"""
SELECT r.seq, r.pickup_hour, r.pickup_dayofweek, r.pickup_month, r.passenger_count, r.ratecode,
  CAST(CASE WHEN r.pickup_dayofweek >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CAST(CASE WHEN r.pickup_hour IN (7, 8, 9, 16, 17, 18, 19) THEN 1 ELSE 0 END AS INTEGER) AS is_rush_hour,
  f.gc_distance_km, f.bearing_sin, f.bearing_cos, f.same_borough, f.pu_airport, f.do_airport, f.pu_borough, f.do_borough
FROM ({REQUESTS}) r JOIN ({features_sql()}) f USING (seq)
"""


# ---------------------------------------------------------------- D: features and encoders
FEAT = features_sql()


def _cyc(c, p):
    a = f"2 * pi() * fmod(CAST({c} AS DOUBLE), {p}e0) / {p}e0"
    return f"round(sin({a}), 6) + 0e0 AS {c}_sin, round(cos({a}), 6) + 0e0 AS {c}_cos"


ORACLE_SQL["d01_cyclical"] = f"""SELECT seq, {_cyc('pickup_hour', 24)}, {_cyc('pickup_dayofweek', 7)},
  {_cyc('pickup_month', 12)} FROM ({FEAT}) f"""
ORACLE_SQL["d02_running_stats"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
  round(CASE WHEN count({c}) >= 2 THEN stddev_pop(CAST({c} AS DOUBLE)) ELSE 0e0 END, 6) AS std,
  count({c}) AS n FROM ({FEAT}) f""" for c in ("passenger_count", "pickup_hour", "gc_distance_km", "target"))
ORACLE_SQL["d02_running_stats_prefix"] = f"""SELECT seq, round(avg(passenger_count) OVER w, 6) AS run_mean,
  round(CASE WHEN count(passenger_count) OVER w >= 2 THEN stddev_pop(passenger_count) OVER w ELSE 0e0 END, 6) AS run_std,
  count(passenger_count) OVER w AS run_n FROM ({FEAT}) f WINDOW w AS ({W_ALL} {UPTO})"""
ORACLE_SQL["d03_prior_global_mean"] = f"""SELECT seq, round(coalesce(avg(target) OVER ({W_ALL} {PRIOR}), 0e0), 6) AS g
FROM ({FEAT}) f"""
ORACLE_SQL["d04_encode_long"] = f"""SELECT seq, count(target) OVER w AS n, round(avg(target) OVER w, 6) AS long
FROM ({FEAT}) f WINDOW w AS (PARTITION BY pu_zone, do_zone {W_ALL} {PRIOR})"""


def _ewma(alpha, part, src="target"):
    lst = f"list({src}) OVER (PARTITION BY {part} {W_ALL} {PRIOR})"
    return (f"CASE WHEN count({src}) OVER (PARTITION BY {part} {W_ALL} {PRIOR}) > 0 THEN "
            f"list_reduce(list_filter({lst}, lambda x: x IS NOT NULL), lambda acc, y: acc + {alpha} * (y - acc)) END")


ORACLE_SQL["d05_encode_ewma"] = f"""SELECT seq, count(target) OVER (PARTITION BY do_zone {W_ALL} {PRIOR}) AS n,
  round({_ewma(0.05, 'do_zone')}, 6) AS med, round({_ewma(0.3, 'do_zone')}, 6) AS short FROM ({FEAT}) f"""
ORACLE_SQL["d06_shrink"] = f"""SELECT seq, round(g, 6) AS g, pn AS n, round(prediction, 6) AS te_pu_zone_do_zone_long
FROM ({scored_sql()}) s"""

ENCODERS = [("pu_zone", "do_zone"), ("do_zone",), ("pu_borough", "do_borough", "pickup_hour")]
HORIZONS = [("long", 0.0), ("med", 0.05), ("short", 0.3)]


_GAPPED = f"SELECT * REPLACE (CASE WHEN do_zone <> '7' THEN do_zone END AS do_zone) FROM ({features_sql(fx.TRIPS_GAPPED)}) f0"
ORACLE_SQL["d05_encode_ewma_gaps"] = f"""SELECT seq, count(target) OVER (PARTITION BY do_zone {W_ALL} {PRIOR}) AS n,
  round({_ewma(0.05, 'do_zone')}, 6) AS med, round({_ewma(0.3, 'do_zone')}, 6) AS short FROM ({_GAPPED}) f"""


def _te_cols(k=20.0):
    cols = []
    for e in ENCODERS:
        part = ", ".join(e)
        name = "te_" + "_".join(e)
        n = f"count(target) OVER (PARTITION BY {part} {W_ALL} {PRIOR})"
        for h, a in HORIZONS:
            v = f"avg(target) OVER (PARTITION BY {part} {W_ALL} {PRIOR})" if a == 0 else _ewma(a, part)
            cols.append(f"round(CASE WHEN {n} > 0 THEN ({n} * ({v}) + {k}e0 * g) / ({n} + {k}e0) ELSE g END, 6) AS {name}_{h}")
    return ",\n  ".join(cols)


ORACLE_SQL["d07_multi_encode"] = f"""SELECT seq, {_te_cols()}
FROM (SELECT *, coalesce(avg(target) OVER ({W_ALL} {PRIOR}), 0e0) AS g FROM ({FEAT}) f) x"""


ORACLE_SQL["d07_multi_encode_gaps"] = f"""SELECT seq, {_te_cols()}
FROM (SELECT *, coalesce(avg(target) OVER ({W_ALL} {PRIOR}), 0e0) AS g FROM ({_GAPPED}) f) x"""


def _frozen_sql(frac=0.8, k=20.0):
    indexed = f"SELECT *, row_number() OVER ({W_ALL}) - 1 AS gidx, count(*) OVER () AS total FROM ({FEAT}) f"
    states = []
    sel = []
    for i, e in enumerate(ENCODERS):
        keys = ", ".join(e)
        aggs = []
        for h, a in HORIZONS:
            if a == 0:
                aggs.append(f"avg(target) AS {h}")
            else:
                aggs.append(f"list_reduce(list(target ORDER BY pickup_datetime, seq), lambda acc, y: acc + {a} * (y - acc)) AS {h}")
        states.append(f"LEFT JOIN (SELECT {keys}, count(target) AS n, {', '.join(aggs)} FROM train WHERE target IS NOT NULL GROUP BY {keys}) s{i} USING ({keys})")
        for h, _ in HORIZONS:
            sel.append(f"round(CASE WHEN coalesce(s{i}.n, 0) > 0 THEN (s{i}.n * s{i}.{h} + {k}e0 * gf.g) / (s{i}.n + {k}e0) ELSE gf.g END, 6) AS te_{'_'.join(e)}_{h}")
    return f"""WITH ix AS ({indexed}),
train AS (SELECT * FROM ix WHERE gidx < floor(total * {frac}e0)),
hold AS (SELECT * FROM ix WHERE gidx >= floor(total * {frac}e0)),
gf AS (SELECT coalesce(avg(target), 0e0) AS g FROM train)
SELECT h.seq, round(gf.g, 6) AS g_frozen, {', '.join(sel)}
FROM hold h CROSS JOIN gf {' '.join(states)}"""


ORACLE_SQL["d08_frozen_encoder"] = _frozen_sql()
ORACLE_SQL["d10_target_scale"] = f"""SELECT seq,
  round(coalesce(avg(target) OVER wp, 0e0), 6) AS t_mean_prior,
  round(CASE WHEN count(target) OVER wp >= 2 AND stddev_pop(target) OVER wp > 1e-9 THEN stddev_pop(target) OVER wp ELSE 1e0 END, 6) AS t_std_prior,
  round(CASE WHEN target IS NOT NULL THEN (target - avg(target) OVER wi) /
    (CASE WHEN count(target) OVER wi >= 2 AND stddev_pop(target) OVER wi > 1e-9 THEN stddev_pop(target) OVER wi ELSE 1e0 END) END, 6) AS y_scaled
FROM ({FEAT}) f WINDOW wp AS ({W_ALL} {PRIOR}), wi AS ({W_ALL} {UPTO})"""
ORACLE_SQL["d11_warmup_mask"] = f"""SELECT seq, label_n, (target IS NOT NULL AND label_n > 100) AS learns,
  (label_n - CASE WHEN target IS NOT NULL THEN 1 ELSE 0 END) > 100 AS model_active
FROM (SELECT *, count(target) OVER ({W_ALL} {UPTO}) AS label_n FROM ({features_sql(fx.TRIPS_GAPPED)}) f) x"""
ORACLE_SQL["d12_lags"] = f"""SELECT seq, lag(target, 1) OVER w AS target_lag1, lag(target, 2) OVER w AS target_lag2,
  lag(target, 3) OVER w AS target_lag3 FROM ({FEAT}) f WINDOW w AS ({W_ALL})"""
ORACLE_SQL["d12_rolling_mean"] = f"""SELECT seq, round(avg(target) OVER ({W_ALL} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 6) AS target_roll50
FROM ({FEAT}) f"""


# ---------------------------------------------------------------- F: evaluation
SCORED = scored_sql()
PREQ = f"""SELECT *, count(target) OVER w AS n, sum(abs_err) OVER w AS sa, sum(sq_err) OVER w AS sq,
  var_pop(target) OVER w * count(target) OVER w AS sst FROM ({SCORED}) s WINDOW w AS ({W_ALL} {UPTO})"""
ROLL = f"""SELECT *, count(*) OVER r AS rc, sum(abs_err) OVER r AS rsa, sum(sq_err) OVER r AS rsq,
  var_pop(target) OVER r * count(*) OVER r AS rsst FROM ({SCORED}) s
  WINDOW r AS ({W_ALL} ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)"""
R2C = "CASE WHEN n < 2 OR sst <= 1e-12 THEN 0e0 ELSE 1 - sq / sst END"
RR2C = "CASE WHEN rc < 2 OR rsst <= 1e-12 THEN 0e0 ELSE 1 - rsq / rsst END"

ORACLE_SQL["f01_prequential"] = f"""SELECT seq, n, {R6('sa / n')} AS mae, {R6('sqrt(sq / n)')} AS rmse, {R6(R2C)} AS r2
FROM ({PREQ}) p"""
ORACLE_SQL["f02_rolling_metrics"] = f"""SELECT seq, lidx, {R6('rsa / rc')} AS rolling_mae, {R6('sqrt(rsq / rc)')} AS rolling_rmse,
  {R6(RR2C)} AS rolling_r2 FROM ({ROLL}) r"""
ORACLE_SQL["f03_snapshot"] = f"""SELECT {R6('sa / n')} AS mae, {R6('sqrt(sq / n)')} AS rmse, {R6(R2C)} AS r2,
  {R6('rsa / rc')} AS rolling_mae, {R6('sqrt(rsq / rc)')} AS rolling_rmse, {R6(RR2C)} AS rolling_r2, n
FROM ({PREQ}) p JOIN (SELECT seq, rc, rsa, rsq, rsst FROM ({ROLL}) r0) r USING (seq) ORDER BY lidx DESC LIMIT 1"""

HOLD_MEM = f"""WITH ix AS (SELECT *, row_number() OVER ({W_ALL}) - 1 AS gidx, count(*) OVER () AS total FROM ({FEAT}) f),
train AS (SELECT * FROM ix WHERE gidx < floor(total * 0.8e0)),
hold AS (SELECT * FROM ix WHERE gidx >= floor(total * 0.8e0)),
gf AS (SELECT coalesce(avg(target), 0e0) AS g FROM train),
st AS (SELECT pu_zone, do_zone, count(target) AS n, avg(target) AS v FROM train WHERE target IS NOT NULL GROUP BY pu_zone, do_zone),
scored AS (SELECT h.*, CASE WHEN coalesce(st.n, 0) > 0 THEN (st.n * st.v + 20e0 * gf.g) / (st.n + 20e0) ELSE gf.g END AS prediction
  FROM hold h CROSS JOIN gf LEFT JOIN st USING (pu_zone, do_zone))"""
HOLD_METRICS = """SELECT avg(abs(target - prediction)) AS mae, sqrt(avg((target - prediction) * (target - prediction))) AS rmse,
  1 - sum((target - prediction) * (target - prediction)) / (CASE WHEN var_pop(target) * count(*) = 0 THEN 1e0 ELSE var_pop(target) * count(*) END) AS r2,
  count(*) AS n FROM scored WHERE target IS NOT NULL"""
ORACLE_SQL["f04_holdout_metrics"] = f"""{HOLD_MEM}, m AS ({HOLD_METRICS})
SELECT {R6('mae')} AS mae, {R6('rmse')} AS rmse, {R6('r2')} AS r2, n FROM m"""
ORACLE_SQL["f05_segment_mae"] = f"""SELECT pu_borough AS segment, round(avg(abs_err), 1) AS mae, count(abs_err) AS n
FROM ({SCORED}) s GROUP BY pu_borough"""
ORACLE_SQL["f06_rolling_segment_mae"] = f"""SELECT pu_borough AS segment, round(avg(abs_err), 1) AS rolling_mae, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY pu_borough ORDER BY pickup_datetime DESC, seq DESC) AS rk FROM ({SCORED}) s) x
WHERE rk <= 2000 AND abs_err IS NOT NULL GROUP BY pu_borough"""
ORACLE_SQL["f06_rolling_segment_hour"] = f"""SELECT CAST(pickup_hour AS VARCHAR) AS segment, round(avg(abs_err), 1) AS rolling_mae, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY pickup_hour ORDER BY pickup_datetime DESC, seq DESC) AS rk FROM ({SCORED}) s) x
WHERE rk <= 2000 AND abs_err IS NOT NULL GROUP BY pickup_hour"""
ORACLE_SQL["f06_rolling_segment_rows"] = f"""SELECT seq, {R6('avg(abs_err) OVER (PARTITION BY pu_borough ' + W_ALL + ' ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW)')} AS segment_rolling_mae
FROM ({SCORED}) s WHERE abs_err IS NOT NULL"""
ORACLE_SQL["f07_time_split"] = f"""SELECT seq, CASE WHEN gidx < floor(total * 0.8e0) THEN 'train' ELSE 'holdout' END AS part
FROM (SELECT *, row_number() OVER ({W_ALL}) - 1 AS gidx, count(*) OVER () AS total FROM ({FEAT}) f) x"""
ORACLE_SQL["f08_rolling_window_split"] = f"""SELECT seq, CASE WHEN gidx >= vs THEN 'holdout' ELSE 'window' END AS part
FROM (SELECT *, CAST(floor(total * (1e0 - 0.1e0)) AS BIGINT) AS vs FROM
  (SELECT *, row_number() OVER ({W_ALL}) - 1 AS gidx, count(*) OVER () AS total FROM ({FEAT}) f) a) x
WHERE gidx >= floor(vs * (1e0 - 0.8e0))"""
GLOBAL_FLOOR = """SELECT 'global-mean' AS setup, avg(abs(h.target - t.m)) AS mae, 0e0 AS r2
  FROM hold h CROSS JOIN (SELECT avg(target) AS m FROM train) t WHERE h.target IS NOT NULL"""
MEMORY_FLOOR = """SELECT 'zone-pair memory' AS setup, avg(abs(target - prediction)) AS mae,
  1 - sum((target - prediction) * (target - prediction)) / (var_pop(target) * count(*)) AS r2 FROM scored WHERE target IS NOT NULL"""
ORACLE_SQL["f10_ablation_floors"] = f"""{HOLD_MEM}, u AS ({GLOBAL_FLOOR} UNION ALL {MEMORY_FLOOR})
SELECT setup, {R6('mae')} AS mae, {R6('r2')} AS r2 FROM u"""
ORACLE_SQL["f11_promotion_decision"] = f"""{HOLD_MEM}, cand AS ({HOLD_METRICS}),
champ AS (SELECT avg(abs(h.target - t.m)) AS mae FROM hold h CROSS JOIN (SELECT avg(target) AS m FROM train) t WHERE h.target IS NOT NULL)
SELECT {R6('cand.mae')} AS candidate_mae, {R6('champ.mae')} AS champion_mae, cand.mae < champ.mae AS promote,
  CASE WHEN cand.mae < champ.mae THEN 'PROMOTE' ELSE 'KEEP CHAMPION' END AS decision FROM cand CROSS JOIN champ"""
ORACLE_SQL["f12_residual_summary"] = f"""SELECT count(*) AS n, {R6('avg(abs(residual))')} AS mae,
  {R6('sqrt(avg(residual * residual))')} AS rmse, {R6('avg(residual)')} AS bias FROM ({SCORED}) s WHERE target IS NOT NULL"""
ORACLE_SQL["f13_residual_by"] = f"""SELECT 'pickup_hour' AS dim, CAST(pickup_hour AS BIGINT) AS value, {R6('avg(residual)')} AS bias,
  {R6('avg(abs(residual))')} AS mae, count(*) AS n FROM ({SCORED}) s WHERE target IS NOT NULL GROUP BY pickup_hour
UNION ALL
SELECT 'pickup_dayofweek', CAST(pickup_dayofweek AS BIGINT), {R6('avg(residual)')}, {R6('avg(abs(residual))')}, count(*)
FROM ({SCORED}) s WHERE target IS NOT NULL GROUP BY pickup_dayofweek"""
_LAGS = (1, 10, 50, 200, 1000)
ORACLE_SQL["f14_autocorr"] = f"""WITH r AS (SELECT lidx, residual - avg(residual) OVER () AS r0 FROM ({SCORED}) s WHERE target IS NOT NULL),
den AS (SELECT sum(r0 * r0) AS d FROM r)
""" + " UNION ALL ".join(
    f"SELECT {k} AS lag, {R6('sum(a.r0 * b.r0) / (SELECT d FROM den)')} AS autocorr FROM r a JOIN r b ON b.lidx = a.lidx - {k}"
    for k in _LAGS)
_QS = [(50.0, "p50"), (75.0, "p75"), (90.0, "p90"), (95.0, "p95"), (99.0, "p99"), (99.9, "p99_9")]
ORACLE_SQL["f15_error_percentiles"] = "SELECT " + ", ".join(
    f"{R6(f'quantile_cont(abs_err, {q / 100.0})')} AS {n}" for q, n in _QS) + f" FROM ({SCORED}) s WHERE abs_err IS NOT NULL"
ORACLE_SQL["f16_recent_points"] = f"""SELECT gidx AS "index", pickup_datetime AS ts, round(target, 2) AS actual,
  round(prediction, 2) AS predicted FROM ({SCORED}) s ORDER BY gidx DESC LIMIT 200"""
ORACLE_SQL["f17_perf_history"] = f"""SELECT gidx AS "index", round(rsa / rc, 3) AS rolling_mae, round(sqrt(rsq / rc), 3) AS rolling_rmse,
  round({RR2C}, 3) AS rolling_r2 FROM ({ROLL}) r WHERE gidx % 100 = 0 ORDER BY gidx DESC LIMIT 400"""

# ---------------------------------------------------------------- E: models
ORACLE_SQL["e01_ridge"] = f"""WITH s AS (SELECT count(*) AS n, avg(target) AS my, avg(gc_distance_km) AS m1, avg(passenger_count) AS m2,
  covar_pop(gc_distance_km, gc_distance_km) * count(*) + 2e0 AS a, covar_pop(gc_distance_km, passenger_count) * count(*) AS b,
  covar_pop(passenger_count, passenger_count) * count(*) + 2e0 AS d,
  covar_pop(gc_distance_km, target) * count(*) AS e, covar_pop(passenger_count, target) * count(*) AS f
  FROM ({FEAT}) x WHERE target IS NOT NULL),
w AS (SELECT *, (e * d - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2 FROM s)
SELECT 'intercept' AS term, {R6('my - w1 * m1 - w2 * m2')} AS coef FROM w
UNION ALL SELECT 'gc_distance_km', {R6('w1')} FROM w
UNION ALL SELECT 'passenger_count', {R6('w2')} FROM w"""
ORACLE_SQL["e05_global_mean_baseline"] = f"""{HOLD_MEM}, u AS ({GLOBAL_FLOOR}) SELECT setup, {R6('mae')} AS mae, r2 FROM u"""
ORACLE_SQL["e06_memory_baseline"] = f"""{HOLD_MEM}, u AS ({MEMORY_FLOOR}) SELECT setup, {R6('mae')} AS mae, {R6('r2')} AS r2 FROM u"""
ORACLE_SQL["e08_score_trips"] = f"""{HOLD_MEM}
SELECT seq, round(prediction, 1) AS eta_seconds, round(prediction / 60.0, 1) AS eta_minutes, gc_distance_km AS distance_km,
  pu_borough, do_borough, CAST(is_rush_hour AS BOOLEAN) AS rush_hour FROM scored"""
ORACLE_SQL["e12_metric_log"] = f"""SELECT gidx AS step, {R6('sa / n')} AS mae, {R6('sqrt(sq / n)')} AS rmse, {R6(R2C)} AS r2,
  {R6('rsa / rc')} AS rolling_mae FROM ({PREQ}) p JOIN (SELECT seq, rc, rsa FROM ({ROLL}) r0) r USING (seq) WHERE gidx % 500 = 0"""


# ---------------------------------------------------------------- G: drift
ERR = fx.ERRORS
GRID = f"SELECT i FROM ({ERR}) e WHERE (i + 1) % 1000 = 0"
ORACLE_SQL["g02_page_hinkley_first"] = f"""WITH a AS (SELECT i, err, avg(err) OVER (ORDER BY i {UPTO}) AS mu FROM ({ERR}) e),
b AS (SELECT i, sum(err - mu - 0.005e0) OVER (ORDER BY i {UPTO}) AS m FROM a),
c AS (SELECT i, m, min(m) OVER (ORDER BY i {UPTO}) AS mm FROM b)
SELECT min(i) AS first_alarm FROM c WHERE i + 1 >= 30 AND m - mm > 50e0"""
ORACLE_SQL["g03_ddm_first"] = f"""WITH a AS (SELECT i, sum(CASE WHEN err > 60 THEN 1 ELSE 0 END) OVER (ORDER BY i {UPTO}) AS e,
  count(*) OVER (ORDER BY i {UPTO}) AS n FROM ({ERR}) x),
b AS (SELECT i, n, e / n AS p, sqrt((e / n) * (1 - e / n) / n) AS s FROM a),
c AS (SELECT *, min(CASE WHEN n >= 30 THEN {{'ps': p + s, 'ni': -i, 'p': p, 's': s}} END) OVER (ORDER BY i {UPTO}) AS mn FROM b)
SELECT min(i) AS first_alarm FROM c WHERE n >= 30 AND p + s > mn.p + 3e0 * mn.s"""


def _win_stats(lo_off: int, hi_off: int) -> str:
    """mean and population variance of err over rows [i+lo_off, i+hi_off]."""
    frame = f"ROWS BETWEEN {-lo_off} PRECEDING AND {-hi_off} PRECEDING" if hi_off <= 0 else \
        f"ROWS BETWEEN {'CURRENT ROW' if lo_off == 0 else str(-lo_off) + ' PRECEDING'} AND {hi_off} FOLLOWING"
    if hi_off <= 0 and -hi_off == 0:
        frame = f"ROWS BETWEEN {-lo_off} PRECEDING AND CURRENT ROW"
    return frame


ORACLE_SQL["g04_validate_trailing"] = f"""WITH s AS (SELECT i, avg(err) OVER (ORDER BY i ROWS BETWEEN 2999 PRECEDING AND 1500 PRECEDING) AS mb,
  var_pop(err) OVER (ORDER BY i ROWS BETWEEN 2999 PRECEDING AND 1500 PRECEDING) AS vb,
  avg(err) OVER (ORDER BY i ROWS BETWEEN 1499 PRECEDING AND CURRENT ROW) AS ma,
  var_pop(err) OVER (ORDER BY i ROWS BETWEEN 1499 PRECEDING AND CURRENT ROW) AS va FROM ({ERR}) e),
v AS (SELECT s.*, i + 1 >= 3000 AS enough, CASE WHEN mb > 1e-9 THEN (ma - mb) / mb ELSE 0e0 END AS rel,
  abs(ma - mb) / (sqrt((vb + va) / 2) + 1e-9) AS eff FROM s WHERE i IN ({GRID}))
SELECT i, CASE WHEN enough THEN {R6('mb')} END AS mean_before, CASE WHEN enough THEN {R6('ma')} END AS mean_after,
  CASE WHEN enough THEN {R6('rel')} ELSE 0e0 END AS rel_shift, CASE WHEN enough THEN {R6('eff')} END AS effect,
  coalesce(enough AND abs(rel) >= 0.1e0 AND eff >= 0.2e0, false) AS validated,
  CASE WHEN NOT enough THEN 'insufficient' WHEN ma > mb THEN 'worse' ELSE 'better' END AS direction FROM v"""
ORACLE_SQL["g05_validate_centred"] = f"""WITH s AS (SELECT i, avg(err) OVER (ORDER BY i ROWS BETWEEN 2000 PRECEDING AND 1 PRECEDING) AS mb,
  var_pop(err) OVER (ORDER BY i ROWS BETWEEN 2000 PRECEDING AND 1 PRECEDING) AS vb,
  avg(err) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 1999 FOLLOWING) AS ma,
  var_pop(err) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 1999 FOLLOWING) AS va, count(*) OVER () AS total FROM ({ERR}) e),
v AS (SELECT i, (ma - mb) / (sqrt((vb + va) / 2) + 1e-9) AS d, CASE WHEN mb <> 0 THEN (ma - mb) / mb END AS rel, ma > mb AS worse
  FROM s WHERE i IN ({GRID}) AND i - 2000 >= 0 AND i + 2000 <= total),
f AS (SELECT *, coalesce(abs(d) > 0.2e0 AND abs(rel) > 0.1e0, false) AS ok FROM v)
SELECT count(*) AS checked, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS valid,
  CAST(count(*) - sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS spurious,
  {R6('sum(CASE WHEN ok THEN 1 ELSE 0 END) * 100.0e0 / greatest(count(*), 1)')} AS pct_valid,
  CAST(sum(CASE WHEN ok AND worse THEN 1 ELSE 0 END) AS BIGINT) AS degradations,
  CAST(sum(CASE WHEN ok AND NOT worse THEN 1 ELSE 0 END) AS BIGINT) AS improvements,
  {R6('quantile_cont(abs(rel), 0.5)')} AS median_abs_rel FROM f"""
ORACLE_SQL["g07_outlier_autocorr"] = f"""WITH t AS (SELECT quantile_cont(err, 0.99) AS thr FROM ({ERR}) e),
b AS (SELECT i, CASE WHEN err > thr THEN 1e0 ELSE 0e0 END AS big FROM ({ERR}) e CROSS JOIN t),
c AS (SELECT i, big - avg(big) OVER () AS b0 FROM b)
SELECT 1 AS lag, {R6('(SELECT sum(x.b0 * y.b0) FROM c x JOIN c y ON y.i = x.i - 1) / (SELECT sum(b0 * b0) FROM c)')} AS autocorr,
  {R6('(SELECT thr FROM t)')} AS threshold"""

PSI_FEAT = f"SELECT * FROM ({SCORED}) s WHERE lidx IS NOT NULL"


def _unpivot(src: str, cols, as_string=False, extra=""):
    cast = "VARCHAR" if as_string else "DOUBLE"
    return " UNION ALL ".join(f"SELECT {extra}'{c}' AS feature, CAST({c} AS {cast}) AS value FROM ({src}) u" for c in cols)


def _psi_numeric_sql(ref_src, cur_src, cols, group=""):
    g = f"{group}, " if group else ""
    gk = f"k.{group}, " if group else ""
    return f"""ref AS ({_unpivot(ref_src, cols)}),
cur AS ({_unpivot(cur_src, cols, extra=g)}),
rk AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS pos,
  count(*) OVER (PARTITION BY feature) AS n FROM ref),
qq AS (SELECT k, k / 10 AS q FROM range(1, 10) t(k)),
edges AS (SELECT feature, list(value ORDER BY k) AS edges FROM rk JOIN qq ON pos = least(floor(q * n), n - 1) GROUP BY feature),
rb AS (SELECT r.feature, len(list_filter(e.edges, lambda x: x < r.value)) AS bin FROM ref r JOIN edges e USING (feature)),
cb AS (SELECT {g}c.feature, len(list_filter(e.edges, lambda x: x < c.value)) AS bin FROM cur c JOIN edges e USING (feature)),
rd AS (SELECT feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM rb GROUP BY feature, bin),
cd AS (SELECT {g}feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY {g}feature) AS p FROM cb GROUP BY {g}feature, bin),
keys AS (SELECT DISTINCT {g}feature, b AS bin FROM {'cb' if group else 'rb'}, range(10) t(b)),
psi_n AS (SELECT {gk}k.feature, CASE WHEN max(c.p) IS NULL OR max(r.p) IS NULL THEN 0e0 ELSE
    sum((greatest(coalesce(c.p, 0), 1e-6) - greatest(coalesce(r.p, 0), 1e-6))
    * ln(greatest(coalesce(c.p, 0), 1e-6) / greatest(coalesce(r.p, 0), 1e-6))) END AS psi
  FROM keys k LEFT JOIN rd r ON r.feature = k.feature AND r.bin = k.bin
  LEFT JOIN cd c ON c.feature = k.feature AND c.bin = k.bin {('AND c.' + group + ' = k.' + group) if group else ''}
  GROUP BY {gk}k.feature)"""


def _psi_cat_sql(ref_src, cur_src, cols, group=""):
    g = f"{group}, " if group else ""
    gk = f"k.{group}, " if group else ""
    return f"""cref AS ({_unpivot(ref_src, cols, True)}),
ccur AS ({_unpivot(cur_src, cols, True, extra=g)}),
crd AS (SELECT feature, value, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM cref GROUP BY feature, value),
ccd AS (SELECT {g}feature, value, count(*) / sum(count(*)) OVER (PARTITION BY {g}feature) AS p FROM ccur GROUP BY {g}feature, value),
ckeys AS (SELECT {g}feature, value FROM ccd UNION SELECT {('k.' + group + ', ') if group else ''}r.feature, r.value FROM crd r
  JOIN (SELECT DISTINCT {g}feature FROM {'ccur' if group else 'cref'}) k ON k.feature = r.feature),
psi_c AS (SELECT {gk}k.feature, CASE WHEN max(c.p) IS NULL OR max(r.p) IS NULL THEN 0e0 ELSE
    sum((greatest(coalesce(c.p, 0), 1e-6) - greatest(coalesce(r.p, 0), 1e-6))
    * ln(greatest(coalesce(c.p, 0), 1e-6) / greatest(coalesce(r.p, 0), 1e-6))) END AS psi
  FROM ckeys k LEFT JOIN crd r ON r.feature = k.feature AND r.value = k.value
  LEFT JOIN ccd c ON c.feature = k.feature AND c.value = k.value {('AND c.' + group + ' = k.' + group) if group else ''}
  GROUP BY {gk}k.feature)"""


_REF = f"SELECT * FROM ({PSI_FEAT}) x WHERE lidx < 5000"
_CUR = f"SELECT * FROM ({PSI_FEAT}) x WHERE lidx >= 5000"
ORACLE_SQL["g08_psi_numeric"] = f"""WITH {_psi_numeric_sql(_REF, _CUR, ['passenger_count', 'pickup_hour', 'gc_distance_km', 'target'])}
SELECT feature, {R6('psi')} AS psi FROM psi_n"""
ORACLE_SQL["g09_psi_categorical"] = f"""WITH {_psi_cat_sql(_REF, _CUR, ['pu_borough', 'ratecode', 'do_zone'])}
SELECT feature, {R6('psi')} AS psi FROM psi_c"""
_GAPS = ("* REPLACE (CASE WHEN seq % 5 >= 2 THEN gc_distance_km END AS gc_distance_km, "
         "CASE WHEN seq % 3 <> 0 THEN ratecode END AS ratecode)")


def _present(cte: str, sql: str) -> str:
    """The SQL with absent values left out of ``cte`` and its current-side twin."""
    return sql.replace(f"{cte}ref AS (", f"{cte}ref AS (SELECT * FROM (", 1).replace(f"),\n{cte}cur AS (", f") p WHERE value IS NOT NULL),\n{cte}cur AS (SELECT * FROM (", 1)


def _gaps_sql(cte, sql, after):
    out = _present(cte, sql)
    return out.replace(f"),\n{after} AS (", f") p WHERE value IS NOT NULL),\n{after} AS (", 1)


_REF_GAPS, _CUR_GAPS = f"SELECT {_GAPS} FROM ({_REF}) gr", f"SELECT {_GAPS} FROM ({_CUR}) gc"
ORACLE_SQL["g08_psi_numeric_gaps"] = f"""WITH {_gaps_sql('', _psi_numeric_sql(_REF_GAPS, _CUR_GAPS, ['gc_distance_km', 'target']), 'rk')}
SELECT feature, {R6('psi')} AS psi FROM psi_n"""
ORACLE_SQL["g09_psi_categorical_gaps"] = f"""WITH {_gaps_sql('c', _psi_cat_sql(_REF_GAPS, _CUR_GAPS, ['ratecode', 'do_zone']), 'crd')}
SELECT feature, {R6('psi')} AS psi FROM psi_c"""
_CHECKS = f"""SELECT * FROM (SELECT *, unnest(range(CAST(ceil((lidx + 1) / 1000) * 1000 AS BIGINT), lidx + 1 + 2000, 1000)) AS "check"
  FROM (SELECT *, count(*) OVER () AS total FROM ({PSI_FEAT}) x0) x WHERE lidx >= 5000) y WHERE "check" <= total"""
PSI_TIME = f"""WITH {_psi_numeric_sql(_REF, _CHECKS, ['passenger_count', 'pickup_hour', 'gc_distance_km'], '"check"')},
{_psi_cat_sql(_REF, _CHECKS, ['pu_borough', 'ratecode'], '"check"')},
allp AS (SELECT * FROM psi_n UNION ALL SELECT * FROM psi_c)"""
ORACLE_SQL["g10_psi_over_time"] = f"""{PSI_TIME} SELECT "check", feature, {R6('psi')} AS psi FROM allp"""
ORACLE_SQL["g11_psi_flag"] = f"""{PSI_TIME} SELECT "check", {R6('max(psi)')} AS max_psi, arg_max(feature, psi) AS worst_feature,
  max(psi) > 0.2e0 AS feature_drift FROM allp GROUP BY "check" """

G04 = ORACLE_SQL["g04_validate_trailing"]
ORACLE_SQL["g12_retrain_alerts"] = f"""WITH RECURSIVE ev AS (SELECT i FROM ({G04}) v WHERE validated AND direction = 'worse'),
alerts(i) AS (SELECT min(i) FROM ev
  UNION ALL SELECT (SELECT min(e.i) FROM ev e WHERE e.i - a.i >= 3000) FROM alerts a WHERE a.i IS NOT NULL)
SELECT i FROM alerts WHERE i IS NOT NULL"""
EVENTS = f"""SELECT 'concept' AS type, i, validated FROM ({G04}) v
UNION ALL SELECT 'feature' AS type, "check" - 1 AS i, true AS validated FROM ({ORACLE_SQL["g11_psi_flag"]}) f WHERE feature_drift"""
ORACLE_SQL["g13_drift_log"] = f"SELECT type, i, validated FROM ({EVENTS}) e ORDER BY i DESC, type LIMIT 50"
ORACLE_SQL["g13_drift_counts"] = f"""SELECT CAST(sum(CASE WHEN type = 'concept' AND validated THEN 1 ELSE 0 END) AS BIGINT) AS concept_events,
  CAST(sum(CASE WHEN type = 'concept' AND NOT validated THEN 1 ELSE 0 END) AS BIGINT) AS spurious_events,
  CAST(sum(CASE WHEN type = 'feature' THEN 1 ELSE 0 END) AS BIGINT) AS feature_events FROM ({EVENTS}) e"""

ORACLE_SQL["e12_metric_log_drift"] = f"""WITH ev AS ({EVENTS}), m AS ({ORACLE_SQL["e12_metric_log"]})
SELECT step, rolling_mae, (SELECT count(*) FROM ev WHERE validated AND type = 'concept' AND i <= step) AS concept_drift_events,
  (SELECT count(*) FROM ev WHERE validated AND type = 'feature' AND i <= step) AS feature_drift_events FROM m"""


# ---------------------------------------------------------------- A: sources
ORACLE_SQL["a01_raw_trips"] = f"""SELECT {K}, pickup, dropoff, passenger_count, trip_distance, ratecode_id, pu_id, do_id
FROM ({fx.RAW_TRIPS}) r"""
ORACLE_SQL["a02_union_months"] = f"SELECT {K}, l_returnflag, l_shipdate FROM lineitem"
ORACLE_SQL["a03_prepared_trips"] = f"""SELECT seq, record_id, pickup_datetime, target, gc_distance_km, pu_borough, do_borough,
  0e0 AS route_distance_km FROM ({FEAT}) f"""
ORACLE_SQL["a05_build_source"] = f"""SELECT record_id, pickup_datetime, target, pu_zone, do_zone, ratecode, pu_borough, do_borough
FROM ({FEAT}) f"""


# ---------------------------------------------------------------- H: streaming and monitoring
ORACLE_SQL["h01_prequential_stream"] = ORACLE_SQL["flagship_prequential"]
ORACLE_SQL["h02_encoder_state_stream"] = f"""SELECT seq, count(target) OVER (PARTITION BY do_zone {W_ALL} {PRIOR}) AS n,
  {R6(f'avg(target) OVER (PARTITION BY do_zone {W_ALL} {PRIOR})')} AS long,
  round({_ewma(0.05, 'do_zone')}, 6) AS med, round({_ewma(0.3, 'do_zone')}, 6) AS short FROM ({fx.TRIPS}) t"""
_SG = scored_sql(fx.TRIPS_GAPPED)
ORACLE_SQL["h04_unlabelled"] = f"""WITH s AS ({_SG}),
p AS (SELECT *, count(target) OVER w AS n, sum(abs_err) OVER w AS sa, sum(sq_err) OVER w AS sq,
  var_pop(target) OVER w * count(target) OVER w AS sst FROM s WINDOW w AS ({W_ALL} {UPTO})),
r AS (SELECT seq, avg(abs_err) OVER ({W_ALL} ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS rolling_mae FROM s WHERE target IS NOT NULL)
SELECT record_id, gidx, lidx, {R6('prediction')} AS prediction, n, {R6('sa / n')} AS mae, {R6(R2C)} AS r2, {R6('rolling_mae')} AS rolling_mae
FROM p JOIN r USING (seq)"""
_BOUNDS = [0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0, 500.0]
HIST = " UNION ALL ".join(
    [f"SELECT {b}e0 AS le, CAST(count_if(target <= {b}e0) AS BIGINT) AS count FROM ({fx.TRIPS}) t WHERE target IS NOT NULL" for b in _BOUNDS]
    + [f"SELECT CAST(NULL AS DOUBLE) AS le, count(*) AS count FROM ({fx.TRIPS}) t WHERE target IS NOT NULL"])
ORACLE_SQL["h06_histogram"] = HIST


def _bq(q):
    expr = (f"CASE WHEN le IS NULL THEN prev_le WHEN count = coalesce(prev_c, 0) THEN le ELSE coalesce(prev_le, 0e0) + "
            f"(le - coalesce(prev_le, 0e0)) * ({q}e0 * total - coalesce(prev_c, 0)) / (count - coalesce(prev_c, 0)) END")
    return f"""SELECT {q}e0 AS q, {R6(expr)} AS value
FROM (SELECT *, lag(le) OVER w AS prev_le, lag(count) OVER w AS prev_c, max(count) OVER () AS total FROM ({HIST}) h
  WINDOW w AS (ORDER BY le ASC NULLS LAST)) x WHERE count >= {q}e0 * total ORDER BY le ASC NULLS LAST LIMIT 1"""


ORACLE_SQL["h06_bucket_quantile"] = f"SELECT * FROM ({_bq(0.5)}) a UNION ALL SELECT * FROM ({_bq(0.95)}) b"
ORACLE_SQL["h07_throughput"] = f"""SELECT date_trunc('minute', pickup_datetime) AS window_start, count(*) AS rows,
  {R6('count(*) / 60.0e0')} AS rate_per_sec FROM ({fx.TRIPS}) t GROUP BY 1"""
ORACLE_SQL["h09_join_labels"] = f"""SELECT record_id, pickup_datetime AS pred_ts,
  pickup_datetime + to_microseconds(CAST(round(target * 1000000) AS BIGINT)) AS label_ts, {R6('target')} AS label
FROM ({fx.TRIPS}) t"""
ORACLE_SQL["e11_registry_champion"] = f"""{HOLD_MEM}, cand AS ({HOLD_METRICS}),
champ AS (SELECT avg(abs(h.target - t.m)) AS mae FROM hold h CROSS JOIN (SELECT avg(target) AS m FROM train) t WHERE h.target IS NOT NULL),
ntrain AS (SELECT count(*) AS n FROM train)
SELECT CAST(CASE WHEN cand.mae < champ.mae THEN 2 ELSE 1 END AS BIGINT) AS version,
  CASE WHEN cand.mae < champ.mae THEN 'zone-pair memory' ELSE 'global-mean' END AS reason,
  ntrain.n AS step, {R6('CASE WHEN cand.mae < champ.mae THEN cand.mae ELSE champ.mae END')} AS mae
FROM cand, champ, ntrain"""
