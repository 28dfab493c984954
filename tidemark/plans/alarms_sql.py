"""DuckDB SQL of the queries in ``alarms``."""

from __future__ import annotations

from tidemark.operators.scales import BLOCK_ROWS, LEAST_ROWS, ROUNDS, round_constants
from tidemark.plans.alarms import CHAIN_BLOCK, SEEDS
from tidemark.plans.flows_sql import CHAIN, FLOWS_SQL
from tidemark.plans.oracle import (_CHECKS, _REF, ENCODERS, ERR, EVENTS, G04, GRID, HORIZONS, ORACLE_SQL, PSI_FEAT, R6, _psi_cat_sql,
                                   _psi_numeric_sql)

ALARM_SQL: dict[str, str] = {}
_D = "DECIMAL(38,12)"


def alarms_sql(src: str, block: int = BLOCK_ROWS) -> str:
    """The alarms of ``src(series, i, err)``: exact sums by block, tests on all scales, the
    first test behind each start, and the walk over them."""
    at = lambda t, k: ", ".join(f"{t}.{c} AS {c}{k}" for c in "nsq")
    return f"""WITH RECURSIVE blk AS MATERIALIZED (SELECT series, i // {block} AS b, count(err) AS n, coalesce(sum(CAST(err AS {_D})), 0) AS s,
  coalesce(sum(CAST(CAST(err AS {_D}) * CAST(err AS {_D}) AS {_D})), 0) AS q, max(i) AS last_i FROM ({src}) src GROUP BY ALL),
pre AS MATERIALIZED (SELECT series, b + 1 AS b, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q, last_i FROM blk
  WINDOW w AS (PARTITION BY series ORDER BY b ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT DISTINCT series, 0, 0, CAST(0 AS {_D}), CAST(0 AS {_D}), -1 FROM blk),
t AS (SELECT h.series, h.b AS hi, l.level, h.b - (1::BIGINT << l.level) AS cut, h.b - (2::BIGINT << l.level) AS lo, h.last_i,
    {at('h', 'h')}, {at('c', 'c')}, {at('a', 'a')}
  FROM pre h JOIN (SELECT CAST(unnest(range(40)) AS BIGINT) AS level) l ON (2::BIGINT << l.level) <= h.b
  JOIN pre c ON c.series IS NOT DISTINCT FROM h.series AND c.b = h.b - (1::BIGINT << l.level)
  JOIN pre a ON a.series IS NOT DISTINCT FROM h.series AND a.b = h.b - (2::BIGINT << l.level)),
u AS (SELECT series, hi, level, cut, lo, last_i, CAST(nc - na AS DOUBLE) AS n0, CAST(nh - nc AS DOUBLE) AS n1, CAST(sc - sa AS DOUBLE) AS s0,
    CAST(sh - sc AS DOUBLE) AS s1, CAST(qh - qa AS DOUBLE) AS q FROM t WHERE nc - na >= {LEAST_ROWS} AND nh - nc >= {LEAST_ROWS}),
v AS (SELECT *, s0 / n0 AS m0, s1 / n1 AS m1, 1e0 / n0 + 1e0 / n1 AS inv, ln(2e0 * ln(n0 + n1) / 0.002e0) AS d,
    greatest(q / (n0 + n1) - (s0 + s1) / (n0 + n1) * ((s0 + s1) / (n0 + n1)), 0e0) AS var FROM u),
fired AS MATERIALIZED (SELECT *, abs(m1 - m0) / bound AS score, hi * 64 + level AS k FROM (
  SELECT *, sqrt(2e0 * inv * var * d) + 2e0 / 3e0 * inv * d AS bound FROM v) b WHERE abs(m1 - m0) > bound),
nxt AS MATERIALIZED (SELECT s.series, s.p, min(f.k) AS k FROM (SELECT DISTINCT series, 0 AS p FROM fired UNION SELECT series, cut FROM fired) s
  JOIN fired f ON f.series IS NOT DISTINCT FROM s.series AND f.lo >= s.p GROUP BY ALL),
walk(series, p, k) AS (SELECT series, p, k FROM nxt WHERE p = 0
  UNION ALL SELECT n.series, n.p, n.k FROM walk w JOIN fired f ON f.series IS NOT DISTINCT FROM w.series AND f.k = w.k
  JOIN nxt n ON n.series IS NOT DISTINCT FROM f.series AND n.p = f.cut)
SELECT f.series, f.last_i AS i, max(f.cut) AS cut, CAST(arg_min(f.level, f.cut) AS INTEGER) AS level, arg_min(f.score, f.cut) AS score,
  arg_min(f.m0, f.cut) AS mean_before, arg_min(f.m1, f.cut) AS mean_after
FROM walk w JOIN fired f ON f.series IS NOT DISTINCT FROM w.series AND f.k = w.k GROUP BY f.series, f.last_i"""


_SHOWN = f"i, cut, level, {R6('score')} AS score, {R6('mean_before')} AS mean_before, {R6('mean_after')} AS mean_after"
SCALE_ALARMS = alarms_sql(f"SELECT 'all' AS series, i, err FROM ({ERR}) e")
ALARM_SQL["g01_scale_alarms"] = f"SELECT {_SHOWN} FROM ({SCALE_ALARMS}) a"
ALARM_SQL["h03_scale_alarms_stream"] = ALARM_SQL["g01_scale_alarms"]
CHAIN_ALARMS = alarms_sql(f"SELECT 'all' AS series, i, err FROM ({ERR}) e", CHAIN_BLOCK)
_BY_TYPE = f"""SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY i) - 1 AS i, err
FROM ({ERR}) e JOIN events v ON e.i = v.event_id"""
ALARM_SQL["g01_scale_alarms_by_type"] = f"SELECT series AS event_type, {_SHOWN} FROM ({alarms_sql(_BY_TYPE)}) a"


def page_hinkley_sql(src: str) -> str:
    """All alarms on ``src(series, i, err)``, row by row; an alarm starts the next row anew. Errors in millionths."""
    far = 1 << 62
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT series, i, row_number() OVER (PARTITION BY series ORDER BY i) AS r,
    CAST(floor(err * 1e6 + 0.5e0) AS BIGINT) AS x FROM ({src}) src WHERE err IS NOT NULL),
w(series, r, i, n, t, m, low, fired) AS (
  SELECT DISTINCT series, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, {far}::BIGINT, false FROM e
  UNION ALL SELECT series, r, i, n, t, m, least(low, m), n >= 30 AND m - least(low, m) > 50e6 FROM (
    SELECT series, r, i, n, t, m + CAST(floor(x - CAST(t AS DOUBLE) / n - 5e3 + 0.5e0) AS BIGINT) AS m, low FROM (
      SELECT e.series, e.r, e.i, e.x, if(w.fired, 0, w.n) + 1 AS n, if(w.fired, 0, w.t) + e.x AS t, if(w.fired, 0, w.m) AS m, if(w.fired, {far}, w.low) AS low
      FROM w JOIN e ON e.series IS NOT DISTINCT FROM w.series AND e.r = w.r + 1) a) b)
SELECT series, i FROM w WHERE fired"""


def ddm_sql(src: str) -> str:
    """All alarms on ``src(series, i, err)`` (errors over 60), row by row; ``k`` is the row count at the latest minimum, ``c`` its errors."""
    rate = lambda n, e, f: f"(CAST({e} AS DOUBLE) / {n} + {f} * sqrt(CAST({e} AS DOUBLE) / {n} * (1e0 - CAST({e} AS DOUBLE) / {n}) / {n}))"
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT series, i, row_number() OVER (PARTITION BY series ORDER BY i) AS r,
    CAST(err > 60 AS BIGINT) AS x FROM ({src}) src WHERE err IS NOT NULL),
w(series, r, i, n, t, k, c, fired) AS (
  SELECT DISTINCT series, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM e
  UNION ALL SELECT series, r, i, n, t, k, c, k > 0 AND {rate('n', 't', '1e0')} > {rate('greatest(k, 1)', 'c', '3e0')} FROM (
    SELECT series, r, i, n, t, if(low, n, k) AS k, if(low, t, c) AS c FROM (
      SELECT *, n >= 30 AND (k = 0 OR {rate('n', 't', '1e0')} <= {rate('greatest(k, 1)', 'c', '1e0')}) AS low FROM (
        SELECT e.series, e.r, e.i, if(w.fired, 0, w.n) + 1 AS n, if(w.fired, 0, w.t) + e.x AS t, if(w.fired, 0, w.k) AS k, if(w.fired, 0, w.c) AS c
        FROM w JOIN e ON e.series IS NOT DISTINCT FROM w.series AND e.r = w.r + 1) a) b) d)
SELECT series, i FROM w WHERE fired"""


for _name, _walk in (("g02_page_hinkley_alarms", page_hinkley_sql), ("g03_ddm_alarms", ddm_sql)):
    ALARM_SQL[_name] = f"SELECT i FROM ({_walk(f"SELECT 'all' AS series, i, err FROM ({ERR}) e")}) a"
    ALARM_SQL[f"{_name}_by_type"] = f"SELECT series AS event_type, i FROM ({_walk(_BY_TYPE)}) a"

_CHECKED = G04.replace(f"i IN ({GRID})", f"i IN (SELECT i FROM ({CHAIN_ALARMS}) g)")
SCALE_CHAIN = f"""WITH RECURSIVE chk AS ({_CHECKED}), ev AS (SELECT i FROM chk WHERE validated AND direction = 'worse'),
alerts(i) AS (SELECT min(i) FROM ev
  UNION ALL SELECT (SELECT min(e.i) FROM ev e WHERE e.i - a.i >= 3000) FROM alerts a WHERE a.i IS NOT NULL)
SELECT 'concept' AS type, c.i, 'scale-cut' AS detector, {R6('g.score')} AS score, c.validated, c.direction, c.rel_shift, c.effect,
  CASE WHEN c.i IN (SELECT i FROM alerts WHERE i IS NOT NULL) THEN 'retrain' WHEN c.validated THEN 'log' ELSE 'ignore' END AS action
FROM chk c JOIN ({CHAIN_ALARMS}) g ON c.i = g.i"""
ALARM_SQL["g13_scale_chain"] = SCALE_CHAIN
for new, old in (("g12_retrain_flag_scales", "g12_retrain_flag"), ("e12_metric_log_scales", "e12_metric_log_alarms"),
                 ("e03_tree_since_scale_alarm", "e03_tree_since_drift"), ("h05_metric_export_scales", "h05_metric_export")):
    ALARM_SQL[new] = FLOWS_SQL[old].replace(CHAIN, SCALE_CHAIN)
ALARM_SQL["h08_status_registry"] = FLOWS_SQL["h08_status_full"].replace(CHAIN, SCALE_CHAIN).replace(
    "'v1' AS model_version", f"(SELECT CAST(version AS VARCHAR) FROM ({ORACLE_SQL['e11_registry_champion']}) r) AS model_version")
ALARM_SQL["g05_centred_on_alarms"] = ORACLE_SQL["g05_validate_centred"].replace(f"i IN ({GRID})", f"i IN (SELECT i FROM ({CHAIN_ALARMS}) g)")
_EVENTS = EVENTS.replace(f"({G04}) v", f"({SCALE_CHAIN}) v")
for new, old in (("g13_drift_log_alarms", "g13_drift_log"), ("g13_drift_counts_alarms", "g13_drift_counts")):
    ALARM_SQL[new] = ORACLE_SQL[old].replace(EVENTS, _EVENTS)

# the schedule over all monitored features: the encoder columns join the others by row
_TE = [f"te_{'_'.join(e)}_{h}" for e in ENCODERS for h, _ in HORIZONS]
_OF = lambda src: src.replace(f"({PSI_FEAT})", "(SELECT * FROM enc)")
_SCHEDULE = f"""WITH enc AS MATERIALIZED (SELECT f.*, {', '.join('d.' + c for c in _TE)} FROM ({PSI_FEAT}) f JOIN ({ORACLE_SQL['d07_multi_encode']}) d USING (seq)),
{_psi_numeric_sql(_OF(_REF), _OF(_CHECKS), ['passenger_count', 'pickup_hour', 'gc_distance_km', *_TE], '"check"')},
{_psi_cat_sql(_REF, _CHECKS, ['pu_borough', 'ratecode'], '"check"')},
allp AS (SELECT * FROM psi_n UNION ALL SELECT * FROM psi_c)"""
ALARM_SQL["g10_psi_schedule"] = f"""{_SCHEDULE} SELECT "check", feature, {R6('psi')} AS psi FROM allp"""
ALARM_SQL["g11_psi_schedule_flag"] = f"""{_SCHEDULE} SELECT "check", {R6('max(psi)')} AS max_psi, max(psi) > 0.2e0 AS feature_drift
FROM allp GROUP BY "check" """


def _mixed(v: str, number: int) -> str:
    h = f"(({v} * m{number} + c{number}) % {(1 << 31) - 1})"
    return f"(({h} * {h} + d{number}) % {(1 << 31) - 1})"


def _pass(source: str) -> str:
    """One pass of the bijection over ``source(seed, i, x)``."""
    cols = "x // b AS l0, x % b AS r0"
    for r in range(0, ROUNDS, 2):
        left, right = f"l{r // 2}", f"r{r // 2}"
        cols += f", ({left} + {_mixed(right, r)}) % a AS l{r // 2 + 1}, ({right} + {_mixed(f'l{r // 2 + 1}', r + 1)}) % b AS r{r // 2 + 1}"
    return f"SELECT seed, i, l{ROUNDS // 2} * b + r{ROUNDS // 2} AS x FROM (SELECT seed, i, b, {cols} FROM ({source}) s JOIN con USING (seed), side)"


_CON = ", ".join(f"({s}, {', '.join(str(x) for r in range(ROUNDS) for x in round_constants(s, r))})" for s in SEEDS)
_COLS = ", ".join(f"{x}{r}" for r in range(ROUNDS) for x in "mcd")
_PERMUTED = f"""WITH RECURSIVE con AS (SELECT * FROM (VALUES {_CON}) v(seed, {_COLS})),
side AS (SELECT total, a, CAST(ceil(total / a) AS BIGINT) AS b FROM (SELECT count(*) AS total, CAST(floor(sqrt(count(*))) AS BIGINT) AS a FROM ({ERR}) e)),
p(seed, i, x) AS ({_pass(f"SELECT seed, i, i AS x FROM ({ERR}) e, con")}
  UNION ALL {_pass("SELECT p.* FROM p, side WHERE x >= total")})
SELECT p.seed AS series, p.x AS i, e.err FROM p JOIN ({ERR}) e USING (i), side WHERE p.x < total"""
ALARM_SQL["g06_permutation_control"] = f"""SELECT CAST(seed AS BIGINT) AS seed, coalesce(alarms, 0) AS alarms, first_alarm
FROM (SELECT unnest(range({len(SEEDS)})) AS seed) s
LEFT JOIN (SELECT series AS seed, count(*) AS alarms, min(i) AS first_alarm FROM ({alarms_sql(_PERMUTED)}) a GROUP BY series) c USING (seed)"""
