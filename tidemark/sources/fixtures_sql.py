"""DuckDB SQL for the stand-in views (the oracle side of the correctness check)."""

TRIPS = """
SELECT event_id AS seq, concat('ev-', CAST(event_id AS VARCHAR)) AS record_id,
       ts AS pickup_datetime, value AS target,
       CAST(user_id % 27 AS VARCHAR) AS pu_zone, CAST(k % 27 AS VARCHAR) AS do_zone,
       event_type AS ratecode, k % 6 + 1 AS passenger_count
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
"""

TRIPS_GAPPED = """
SELECT seq, record_id, pickup_datetime,
       CASE WHEN seq % 10 = 0 THEN NULL ELSE target END AS target,
       pu_zone, do_zone, ratecode, passenger_count
FROM (""" + TRIPS + """) t
"""

ZONES = """
SELECT CAST(n_nationkey AS VARCHAR) AS location_id, r_name AS borough, n_name AS zone,
       (n_nationkey * 7 % 25) * 1.5e0 AS x_km, (n_nationkey * 11 % 25) * 1.2e0 AS y_km,
       CASE WHEN n_nationkey IN (3, 17) THEN 1 ELSE 0 END AS is_airport
FROM nation JOIN region ON n_regionkey = r_regionkey
"""

RAW_TRIPS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       o_orderdate AS pickup, l_shipdate AS dropoff,
       NULLIF(l_linenumber - 1, 3) AS passenger_count, l_quantity - 2 AS trip_distance,
       NULLIF(l_linenumber, 7) AS ratecode_id, c_nationkey AS pu_id, s_nationkey AS do_id,
       date_trunc('month', l_shipdate) AS src_month
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
"""

VERTICES = """
SELECT n_nationkey AS id, v.part, v.seq,
       n_nationkey * 10 + v.x AS x, n_nationkey * 5 + v.y AS y
FROM nation, (VALUES (0,0,0e0,0e0),(0,1,4e0,0e0),(0,2,4e0,3e0),(0,3,0e0,3e0),(0,4,0e0,0e0),
  (1,0,6e0,6e0),(1,1,7e0,6e0),(1,2,7e0,8e0),(1,3,6e0,6e0),
  (2,0,9e0,9e0),(2,1,9e0,9e0)) AS v(part, seq, x, y)
WHERE v.part <> 1 OR n_nationkey % 2 = 0
"""

ERRORS = """
SELECT event_id AS i, ts, abs(value - 50) + CASE WHEN event_id >= 6000 THEN 40e0 ELSE 0e0 END AS err
FROM events
"""
