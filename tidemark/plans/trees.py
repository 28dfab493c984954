"""Queries on the learners that move with the stream (trees, forest, least squares with forgetting), and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import r6
from tidemark.operators import hoeffding as ht
from tidemark.operators import recursive as rc
from tidemark.operators.scales import _P, round_constants
from tidemark.plans.oracle import PSI_FEAT, R6
from tidemark.plans.ordering import materialize
from tidemark.plans.trips import sequenced_trips
from tidemark.session import remove_paths, scratch_path
from tidemark.sources import io as sio

TREE_FLOWS: dict = {}
TREE_SQL: dict[str, str] = {}

GRIDS = {"gc_distance_km": (0.0, 0.5), "passenger_count": (0.0, 1.0), "pickup_hour": (0.0, 1.0)}
GROWTH = ht.Growth(GRIDS)
STUMP = ht.Growth(GRIDS, max_depth=1)
FOREST = ht.Growth(GRIDS, members=8)
ARRIVAL = 2000  # rows of an arrival: scored, then learned
MOST_ARRIVALS = 512  # arrivals that a micro-batch takes up at most; the trees do not depend on it
FORGET, L2 = 0.999, 1.0


def flow(name: str):
    def deco(fn):
        TREE_FLOWS[name] = fn
        return fn
    return deco


def _rows(spark, sf_dir) -> DataFrame:
    return sequenced_trips(spark, sf_dir).df.where("lidx IS NOT NULL").select("lidx", "target", *GRIDS)


def _stats(spark, sf_dir, growth):
    s = ht.statistics(_rows(spark, sf_dir), ht.Trees(growth))
    return s.select("member", "feature", "bin", "n", r6(F.col("s").cast("double")).alias("s"), r6(F.col("q").cast("double")).alias("q"))


def replay(spark, sf_dir, growth: ht.Growth) -> tuple[DataFrame, DataFrame]:
    """The labelled rows arrive in order and are scored, then learned: the scores, and the last trees' nodes.
    A run of the query takes up what has arrived since the last one: 1, 4, 16, ... arrivals."""
    laid, src, state, out, ckpt = (scratch_path(spark, f"trees-{x}") for x in ("laid", "src", "state", "out", "ckpt"))
    rows, arrival = _rows(spark, sf_dir), F.floor(F.col("lidx") / ARRIVAL)
    rows.withColumn("_run", run_of(arrival)).write.partitionBy("_run").parquet(laid)  # a run reads its own rows, not all again
    stream = ht.TreeStream(state, out, growth, arrival=arrival)
    for k, (first, end) in enumerate(stretches(-(-spark.read.parquet(laid).count() // ARRIVAL))):
        new = spark.read.schema(rows.schema).parquet(f"{laid}/_run={k}")
        sio.append_records(new.repartition(min(end - first, 2 * spark.sparkContext.defaultParallelism), arrival), src)
        stream.start(spark.readStream.schema(rows.schema).parquet(src), ckpt).awaitTermination()
    nodes = spark.createDataFrame(stream.trees(spark).node_rows(), ht.NODE_DDL)
    scores = materialize(spark.read.parquet(out))
    remove_paths(spark, laid, src, state, out, ckpt)
    return scores, nodes


def stretches(total: int, most: int = MOST_ARRIVALS) -> list[tuple[int, int]]:
    """``[first, end)`` of the arrivals that each run of a streamed query takes up, growing up to ``most``."""
    out, at, size = [], 0, 1
    while at < total:
        out.append((at, min(total, at + size)))
        at, size = at + size, min(most, 4 * size)
    return out


def run_of(arrival: Column, most: int = MOST_ARRIVALS) -> Column:
    """The number of the stretch that holds an arrival."""
    growing = next(k for k in range(most) if 4 ** k >= most)  # stretches shorter than ``most``
    ends = [end for _, end in stretches(sum(4 ** k for k in range(growing)), most)]
    begun = ends[-1] if ends else 0
    out = F.lit(growing) + F.floor((arrival - begun) / most)
    for k in reversed(range(growing)):
        out = F.when(arrival < ends[k], k).otherwise(out)
    return out.cast("int")


def by_batch(scores: DataFrame) -> DataFrame:
    # errors are summed as exact decimals: the mean does not depend on the partitioning
    e = F.abs(F.col("target") - F.col("prediction")).cast("decimal(38,9)")
    return scores.groupBy(F.floor(F.col("lidx") / ARRIVAL).alias("batch")).agg(
        F.count("*").alias("rows"), r6(F.sum(e).cast("double") / F.count("*")).alias("mae"))


@flow("e02_hoeffding_statistics")
def e02_statistics(spark, sf_dir):
    return _stats(spark, sf_dir, GROWTH).drop("member")


@flow("e02_hoeffding_first_split")
def e02_first(spark, sf_dir):
    nodes = replay(spark, sf_dir, STUMP)[1]
    root, child = nodes.where("node = 0 AND feature IS NOT NULL"), nodes.where("parent = 0")
    born = child.agg(F.max("born").alias("batch"), F.sum("n").alias("n"), r6(F.sum("s").cast("double")).alias("s"))
    return root.select("feature", "bin").join(F.broadcast(born))  # one row each


@flow("e02_hoeffding_stump_scores")
def e02_stump(spark, sf_dir):
    return by_batch(replay(spark, sf_dir, STUMP)[0])


@flow("e02_hoeffding_tree")
def e02_tree(spark, sf_dir):
    return by_batch(replay(spark, sf_dir, GROWTH)[0])


@flow("e04_member_statistics")
def e04_statistics(spark, sf_dir):
    return _stats(spark, sf_dir, FOREST)


@flow("e04_online_forest")
def e04_forest(spark, sf_dir):
    return by_batch(replay(spark, sf_dir, FOREST)[0])


def _moving(spark, sf_dir, features):
    seq = sequenced_trips(spark, sf_dir)
    seq = seq.with_df(seq.df.where("lidx IS NOT NULL"))
    scores = rc.recursive_least_squares(seq, features, forget=FORGET, l2=L2).df
    return by_batch(scores)


@flow("e01_moving_line")
def e01_line(spark, sf_dir):
    """One feature, weights that move with every row: the mean error of each stretch of rows."""
    return _moving(spark, sf_dir, ["gc_distance_km"])


@flow("e01_moving_linear")
def e01_linear(spark, sf_dir):
    return _moving(spark, sf_dir, list(GRIDS))


# ---------------------------------------------------------------- SQL
_D = "DECIMAL(38,12)"


def _bin(f: str) -> str:
    o, w = GRIDS[f]
    x = f"CAST({f} AS DOUBLE)"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN -1 ELSE CAST(least(greatest(floor(({x} - {o}e0) / {w}e0), 0), {GROWTH.bins - 1}) AS INTEGER) END"


_ROWS = f"SELECT lidx, lidx // {ARRIVAL} AS batch, CAST(target AS DOUBLE) AS target, {', '.join(GRIDS)} FROM ({PSI_FEAT}) f"
_CELLS = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT lidx, batch, CAST(target AS {_D}) AS y, '{f}' AS feature, {_bin(f)} AS bin FROM r" for f in GRIDS) + ") c"
_SUMS = f"CAST(sum(y) AS {_D}) AS s, CAST(sum(CAST(y * y AS {_D})) AS {_D}) AS q"

TREE_SQL["e02_hoeffding_statistics"] = f"""WITH r AS MATERIALIZED ({_ROWS}), c AS ({_CELLS}), t AS (SELECT feature, bin, count(*) AS n, {_SUMS} FROM c GROUP BY ALL)
SELECT feature, bin, n, {R6('CAST(s AS DOUBLE)')} AS s, {R6('CAST(q AS DOUBLE)')} AS q FROM t"""


def _hash_sql(v: str, constants: tuple[int, int, int]) -> str:
    m, c, d = constants
    h = f"(({v} * {m} + {c}) % {_P})"
    return f"(({h} * {h} + {d}) % {_P})"


_WEIGHTS = " UNION ALL ".join(f"SELECT lidx, {m} AS member, {_hash_sql(_hash_sql(f'(lidx % {_P})', round_constants(42, 2 * m)), round_constants(42, 2 * m + 1))} AS h FROM r"
                              for m in range(FOREST.members))
_DRAWN = " + ".join(f"CAST(u >= {step!r}e0 AS BIGINT)" for step in ht.poisson_steps())
TREE_SQL["e04_member_statistics"] = f"""WITH r AS MATERIALIZED ({_ROWS}), c AS ({_CELLS}),
w AS (SELECT lidx, member, {_DRAWN} AS w FROM (SELECT lidx, member, CAST(h AS DOUBLE) / {_P}e0 AS u FROM ({_WEIGHTS}) h) u),
t AS (SELECT member, feature, bin, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * y) AS {_D}) AS s, CAST(sum(w * CAST(y * y AS {_D})) AS {_D}) AS q
  FROM c JOIN w USING (lidx) WHERE w > 0 GROUP BY ALL)
SELECT CAST(member AS INTEGER) AS member, feature, bin, n, {R6('CAST(s AS DOUBLE)')} AS s, {R6('CAST(q AS DOUBLE)')} AS q FROM t"""

_SPREAD = lambda n, s, q: f"(CAST({q} AS DOUBLE) - CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE) / {n})"
# every edge of the root after every micro-batch, the best edge a feature, and the first micro-batch that decides
_SPLIT = f"""r AS MATERIALIZED ({_ROWS}), c AS ({_CELLS}),
one AS MATERIALIZED (SELECT batch, feature, bin, count(*) AS n, {_SUMS} FROM c GROUP BY ALL),
cum AS (SELECT k.batch, o.feature, o.bin, CAST(sum(o.n) AS BIGINT) AS n, CAST(sum(o.s) AS {_D}) AS s, CAST(sum(o.q) AS {_D}) AS q
  FROM (SELECT DISTINCT batch FROM one) k JOIN one o ON o.batch <= k.batch GROUP BY ALL),
e AS (SELECT batch, feature, bin, sum(n) OVER lo AS ln, sum(s) OVER lo AS ls, sum(q) OVER lo AS lq, sum(n) OVER al AS n, sum(s) OVER al AS s, sum(q) OVER al AS q
  FROM cum WINDOW lo AS (PARTITION BY batch, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), al AS (PARTITION BY batch, feature)),
g AS (SELECT batch, feature, bin, n, s, ({_SPREAD('n', 's', 'q')} - {_SPREAD('ln', 'ls', 'lq')} - {_SPREAD('(n - ln)', '(s - ls)', '(q - lq)')}) / n AS gain
  FROM e WHERE ln < n),
b AS (SELECT *, row_number() OVER (PARTITION BY batch, feature ORDER BY gain DESC, bin) AS place FROM g WHERE gain > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY gain DESC, feature) AS rank, lead(gain, 1, 0) OVER (PARTITION BY batch ORDER BY gain DESC, feature) AS second,
  sqrt(ln(1e0 / {GROWTH.delta!r}) / (2e0 * n)) AS eps FROM b WHERE place = 1),
sp AS MATERIALIZED (SELECT * FROM f WHERE rank = 1 AND n >= {GROWTH.grace} AND (second / gain < 1e0 - eps OR eps < {GROWTH.tie}e0) ORDER BY batch LIMIT 1)"""
TREE_SQL["e02_hoeffding_first_split"] = f"WITH {_SPLIT} SELECT feature, bin, batch, CAST(n AS BIGINT) AS n, {R6('CAST(s AS DOUBLE)')} AS s FROM sp"
TREE_SQL["e02_hoeffding_stump_scores"] = f"""WITH {_SPLIT},
side AS (SELECT r.lidx, r.batch, r.target, CASE WHEN c.bin <= sp.bin THEN 0 ELSE 1 END AS side FROM r JOIN c USING (lidx) JOIN sp ON c.feature = sp.feature),
past AS (SELECT k.batch, s.side, count(*) AS n, sum(CAST(s.target AS {_D})) AS s FROM (SELECT DISTINCT batch FROM r) k JOIN side s ON s.batch < k.batch GROUP BY ALL),
p AS (SELECT s.batch, s.target, CASE WHEN s.batch <= (SELECT batch FROM sp)
    THEN (SELECT CAST(sum(a.s) AS DOUBLE) / sum(a.n) FROM past a WHERE a.batch = s.batch)
    ELSE (SELECT CAST(sum(a.s) AS DOUBLE) / sum(a.n) FROM past a WHERE a.batch = s.batch AND a.side = s.side) END AS prediction FROM side s)
SELECT batch, count(*) AS rows, {R6('sum(abs(target - coalesce(prediction, 0e0))) / count(*)')} AS mae FROM p GROUP BY batch"""

_FORGOT = lambda z: f"coalesce(sum(pow({FORGET}e0, -lidx) * ({z})) OVER before * pow({FORGET}e0, lidx - 1), 0e0)"
TREE_SQL["e01_moving_line"] = f"""WITH r AS (SELECT lidx, batch, target AS y, coalesce(CAST(gc_distance_km AS DOUBLE), 0e0) AS x FROM ({_ROWS}) r),
s AS (SELECT *, {_FORGOT('1e0')} + {L2}e0 AS a, {_FORGOT('x')} AS b, {_FORGOT('x * x')} + {L2}e0 AS d, {_FORGOT('y')} AS v, {_FORGOT('x * y')} AS w
  FROM r WINDOW before AS (ORDER BY lidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT batch, abs(y - ((d * v - b * w) + (a * w - b * v) * x) / (a * d - b * b)) AS e FROM s)
SELECT batch, count(*) AS rows, {R6('sum(e) / count(*)')} AS mae FROM p GROUP BY batch"""
