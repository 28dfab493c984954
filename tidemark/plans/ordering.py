"""Plans for computations that follow one total order.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one task.
Everything here avoids that:

* ``sequence`` range-partitions the rows on their total order (Spark samples
  the whole order key, so ties in time are split by the tie-break column and a
  burst of rows cannot land in one task), tags each row with its range bucket,
  clusters and sorts by ``(bucket, order)`` and checkpoints the result into
  the shared checkpoint folder. Bucket ids are then stable across retries and
  lost executors, and the checkpoint keeps its partitioning, so every window
  partitioned by the bucket (or by ``keys + bucket``) runs without another
  exchange.
* Running aggregates are two-level: a window inside each bucket plus an offset
  from all earlier buckets. Offsets come from a per-bucket summary whose size is
  bounded by the bucket count, not by the data.
* Keyed running aggregates use ``(keys, bucket)`` windows, so a hot key is split
  into as many pieces as there are buckets, plus per-key offsets.
* Bounded frames that cross bucket boundaries (rolling windows, lags) use halo
  blocks of a dense index: each block also receives the last ``w - 1`` rows of
  the block before it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import adaptive_disabled, checkpoint_dir

BUCKET = "_bucket"
_UNB = Window.unboundedPreceding


@dataclass(frozen=True)
class Sequenced:
    """Rows clustered by range bucket of a total order, sorted inside buckets."""

    df: DataFrame
    order: tuple[str, ...]
    n_buckets: int

    def window(self, *keys: str):
        """Window over ``keys`` inside one bucket, in stream order."""
        return Window.partitionBy(*keys, BUCKET).orderBy(*self.order)

    def with_df(self, df: DataFrame) -> "Sequenced":
        """Same ordering facts for a frame derived row by row from ``self.df``."""
        return Sequenced(df, self.order, self.n_buckets)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != BUCKET]


def default_buckets(df: DataFrame) -> int:
    """Buckets per ordered stream: the shuffle partition count, which a cluster
    sizes to its data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sequence(df: DataFrame, order: Sequence[str], n_buckets: int | None = None,
             materialize: bool = True) -> Sequenced:
    """Range-partition ``df`` on ``order`` (which must be a total order).

    The result is checkpointed (reliably, into the session's checkpoint folder)
    so the bucket of every row is fixed once and lineage is cut.
    """
    if isinstance(df, Sequenced):
        return df
    spark = df.sparkSession
    n = int(n_buckets or default_buckets(df))
    if materialize:
        checkpoint_dir(spark)
    with adaptive_disabled(spark):
        out = (
            df.repartitionByRange(n, *order)
            .withColumn(BUCKET, F.spark_partition_id())
            .repartitionById(n, F.col(BUCKET))  # bucket b is partition b, which Spark then knows
            .sortWithinPartitions(BUCKET, *order)
        )
        if materialize:
            out = out.checkpoint(eager=True)
    return Sequenced(out, tuple(order), n)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                    hint_broadcast: bool = False) -> DataFrame:
    """Join on ``keys`` treating null keys as equal; keeps the left key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    if hint_broadcast:
        renamed = F.broadcast(renamed)
    cond = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    out = left.join(renamed, cond, how)
    return out.drop(*[f"_r_{k}" for k in keys])


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the shared checkpoint folder (AQE off so the
    recorded output partitioning and ordering survive)."""
    checkpoint_dir(df.sparkSession)
    with adaptive_disabled(df.sparkSession):
        return df.checkpoint(eager=True)


def running(seq: Sequenced, sums: Mapping[str, Column] | None = None,
            moments: Mapping[str, Column] | None = None, inclusive: bool = True,
            keys: Sequence[str] = (), checkpoint: bool = True) -> Sequenced:
    """Two-level running aggregates over the global order (per key with ``keys``).

    ``sums``: running sum of each expression (nulls count as 0).
    ``moments``: running ``{name}_n``, ``{name}_mean`` and ``{name}_m2`` (sum of
    squared deviations) of each expression; nulls are skipped; bucket
    summaries are merged with Chan's formula after shifting by the key's mean.

    All windows of one call run in one pass inside the buckets; that pass is
    checkpointed, so the per-bucket summary and the final join read it instead
    of recomputing everything upstream (plans stay linear in the number of
    chained calls). Offsets are joined by ``(keys, bucket)``: broadcast without
    keys (one row per bucket); with keys Spark picks the join by size.
    """
    sums, moments, keys = dict(sums or {}), dict(moments or {}), list(keys)
    frame = (_UNB, Window.currentRow) if inclusive else (_UNB, -1)
    base = seq.df.select("*", *[e.alias(f"_e_{n}") for n, e in sums.items()],
                         *[e.cast("double").alias(f"_v_{n}") for n, e in moments.items()])
    w = seq.window(*keys).rowsBetween(*frame)
    loc = [F.coalesce(F.sum(f"_e_{n}").over(w), F.lit(0)).alias(f"_l_{n}") for n in sums]
    for n in moments:
        v = f"_v_{n}"
        nb = F.count(v).over(w)
        loc += [nb.alias(f"_nb_{n}"), F.coalesce(F.avg(v).over(w), F.lit(0.0)).alias(f"_mb_{n}"),
                F.coalesce(F.var_pop(v).over(w) * nb, F.lit(0.0)).alias(f"_qb_{n}")]
    local = base.select("*", *loc)
    if checkpoint:
        local = materialize(local)
    aggs = [F.sum(f"_e_{n}").alias(f"_s_{n}") for n in sums]
    for n in moments:
        v = f"_v_{n}"
        aggs += [F.count(v).alias(f"_sn_{n}"), F.coalesce(F.avg(v), F.lit(0.0)).alias(f"_sm_{n}"),
                 F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias(f"_sq_{n}")]
    summary = local.groupBy(*keys, BUCKET).agg(*aggs)
    prior = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(_UNB, -1)
    whole = Window.partitionBy(*keys)
    offs = [F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in sums]
    for n in moments:
        cnt, mean = F.col(f"_sn_{n}"), F.col(f"_sm_{n}")
        g = F.sum(cnt * mean).over(whole) / F.greatest(F.sum(cnt).over(whole), F.lit(1))
        dm = mean - g
        na = F.coalesce(F.sum(cnt).over(prior), F.lit(0))
        s1 = F.coalesce(F.sum(cnt * dm).over(prior), F.lit(0.0))
        s2 = F.coalesce(F.sum(cnt * dm * dm).over(prior), F.lit(0.0))
        sq = F.coalesce(F.sum(f"_sq_{n}").over(prior), F.lit(0.0))
        offs += [na.alias(f"_na_{n}"), (g + F.when(na > 0, s1 / na).otherwise(0.0)).alias(f"_ma_{n}"),
                 (sq + s2 - F.when(na > 0, s1 * s1 / na).otherwise(0.0)).alias(f"_qa_{n}")]
    offsets = summary.select(*keys, BUCKET, *offs)
    if keys:
        # one row per (key, bucket): a join balanced by the bucket, or a broadcast
        # when the measured size is small
        joined = _null_safe_join(local, offsets, [*keys, BUCKET])
    else:
        joined = _null_safe_join(local, offsets, [BUCKET], hint_broadcast=True)
    outs = [(F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums]
    for n in moments:
        cnt, mean, m2 = _chan_merge(F.coalesce(F.col(f"_na_{n}"), F.lit(0)), F.coalesce(F.col(f"_ma_{n}"), F.lit(0.0)),
                                    F.coalesce(F.col(f"_qa_{n}"), F.lit(0.0)),
                                    F.col(f"_nb_{n}"), F.col(f"_mb_{n}"), F.col(f"_qb_{n}"))
        outs += [cnt.alias(f"{n}_n"), mean.alias(f"{n}_mean"), F.greatest(m2, F.lit(0.0)).alias(f"{n}_m2")]
    return seq.with_df(joined.select(*seq.df.columns, *outs))


def running_sums(seq: Sequenced, exprs: Mapping[str, Column], inclusive: bool = True,
                 keys: Sequence[str] = ()) -> Sequenced:
    """Append, per row, the sum of each expression over earlier rows.

    ``inclusive`` includes the row itself. With ``keys`` only rows sharing the
    key values count. Null expression values count as zero.
    """
    return running(seq, sums=exprs, inclusive=inclusive, keys=keys)


def _chan_merge(na: Column, ma: Column, m2a: Column, nb: Column, mb: Column, m2b: Column):
    """Merge two (count, mean, M2) summaries (Chan et al.)."""
    n = na + nb
    d = mb - ma
    mean = F.when(n > 0, ma + d * nb / n)
    m2 = F.when(n > 0, m2a + m2b + d * d * na * nb / n).otherwise(F.lit(0.0))
    return n, mean, m2


def running_moments(seq: Sequenced, value: Column | str, prefix: str, inclusive: bool = True) -> Sequenced:
    """Append running ``{prefix}_n``, ``{prefix}_mean`` and ``{prefix}_m2``
    (sum of squared deviations) of ``value`` over the global order; nulls skip."""
    v = F.col(value) if isinstance(value, str) else value
    return running(seq, moments={prefix: v}, inclusive=inclusive)


def with_global_index(seq: Sequenced, name: str = "gidx", where: Column | None = None,
                      keys: Sequence[str] = ()) -> Sequenced:
    """Dense 0-based position in the global order (per key with ``keys``).

    With ``where`` only qualifying rows are counted; the others get null.
    """
    return with_indexes(seq, {name: where}, keys)


def with_indexes(seq: Sequenced, conds: Mapping[str, Column | None], keys: Sequence[str] = ()) -> Sequenced:
    """Several dense indexes (each over the rows meeting its condition) in one pass."""
    conds = {n: (F.lit(True) if c is None else c) for n, c in conds.items()}
    counted = running(seq, sums={f"_{n}_c": F.when(c, F.lit(1)).otherwise(F.lit(0)) for n, c in conds.items()},
                      inclusive=True, keys=keys)
    out = counted.df
    for n, c in conds.items():
        out = out.withColumn(n, F.when(c, F.col(f"_{n}_c") - 1)).drop(f"_{n}_c")
    return seq.with_df(out)


def halo_window_frame(df: DataFrame, idx: str, lookback: int, block_rows: int | None = None,
                      keys: Sequence[str] = ()):
    """Lay rows out in halo blocks of a dense index ``idx`` so that a frame of
    ``lookback`` earlier rows (per ``keys``) is complete inside every block.

    Returns ``(frame_df, window)``: rows carry ``_halo`` (True for copies that
    only serve as history); apply the window, then drop halo rows. Blocks have
    a fixed number of index values, so a hot key is cut into many blocks.
    """
    b = int(block_rows) if block_rows else int(max(4 * max(lookback, 1), 1 << 14))
    if b < lookback:
        raise ValueError("block must hold at least the lookback")
    blk = F.floor(F.col(idx) / F.lit(b)).cast("long")
    in_tail = (F.col(idx) % F.lit(b)) >= F.lit(b - lookback)
    copies = F.array(
        F.struct(blk.alias("_blk"), F.lit(False).alias("_halo")),
        F.when(in_tail & F.lit(lookback > 0), F.struct((blk + 1).alias("_blk"), F.lit(True).alias("_halo"))),
    )
    laid = (df.where(F.col(idx).isNotNull())
            .withColumn("_c", F.explode(copies)).where(F.col("_c").isNotNull())
            .select("*", "_c._blk", "_c._halo").drop("_c"))
    window = Window.partitionBy(*keys, "_blk").orderBy(idx)
    return laid, window


def rolling(df: DataFrame, idx: str, w: int, sums: Mapping[str, Column],
            keys: Sequence[str] = (), block_rows: int | None = None,
            variances: Mapping[str, Column] | None = None) -> DataFrame:
    """Rolling sums over the last ``w`` rows (inclusive) of a dense index.

    O(rows): inside each halo block, a running sum minus the same running sum
    ``w`` rows earlier. ``sums`` maps output names to expressions (nulls count
    as 0). ``variances`` adds ``{name}`` = population variance and
    ``{name}_n`` = non-null count over the frame, from sums shifted by the
    block mean. Rows with a null index are dropped. NaN and infinite values
    are counted apart, so they show in the frames that hold them (as a plain
    sum would) and nowhere else.
    """
    variances = dict(variances or {})
    laid, window = halo_window_frame(df, idx, w - 1, block_rows, keys)
    whole = Window.partitionBy(*keys, "_blk")
    terms, odd = {}, {}
    for i, (n, e) in enumerate(sums.items()):
        laid = laid.withColumn(f"_sx_{i}", e)
        terms[n] = F.col(f"_sx_{i}")
        if laid.schema[f"_sx_{i}"].dataType.simpleString() in ("double", "float"):
            odd[n] = terms[n]
    odd |= {n: e.cast("double") for n, e in variances.items()}
    for n in [n for n in terms if n in odd]:
        terms[n] = F.when(_finite(odd[n]), odd[n])
    for n, x in odd.items():  # how many NaN, infinite and minus infinite values: three counts of 20 bits
        kind = F.when(F.isnan(x), F.lit(1)).when(x == F.lit(float("inf")), F.lit(1 << 20)).when(x == F.lit(float("-inf")), F.lit(1 << 40))
        terms[f"_odd_{n}"] = F.when(x.isNotNull(), kind.otherwise(F.lit(0))).cast("long")
    for n, e in variances.items():
        laid = laid.withColumn(f"_vx_{n}", F.when(_finite(e.cast("double")), e.cast("double")))
        laid = laid.withColumn(f"_vc_{n}", F.avg(f"_vx_{n}").over(whole))
        d = F.col(f"_vx_{n}") - F.col(f"_vc_{n}")
        terms[f"_vn_{n}"] = F.col(f"_vx_{n}").isNotNull().cast("long")
        terms[f"_v1_{n}"] = d
        terms[f"_v2_{n}"] = d * d
    run = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step1 = laid.select("*", *[F.coalesce(F.sum(e).over(run), F.lit(0)).alias(f"_p_{n}") for n, e in terms.items()])
    step2 = step1.select("*", *[(F.col(f"_p_{n}") - F.coalesce(F.lag(f"_p_{n}", w).over(window), F.lit(0))).alias(n)
                                for n in terms])
    out = step2.where(~F.col("_halo"))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    for n in odd:
        o = F.col(f"_odd_{n}")
        nans, ups, downs = o.bitwiseAND(F.lit((1 << 20) - 1)) > 0, F.shiftright(o, 20).bitwiseAND(F.lit((1 << 20) - 1)) > 0, F.shiftright(o, 40) > 0
        if n in sums:
            out = out.withColumn(n, F.when(nans | (ups & downs), nan).when(ups, inf).when(downs, -inf).otherwise(F.col(n)))
    for n in variances:
        cnt = F.col(f"_vn_{n}")
        m1 = F.col(f"_v1_{n}") / cnt
        o = F.col(f"_odd_{n}")
        plain = F.when(cnt > 0, F.greatest(F.col(f"_v2_{n}") / cnt - m1 * m1, F.lit(0.0)))
        out = out.withColumn(n, F.when(o > 0, nan).otherwise(plain))
        odd_n = sum((F.shiftright(o, k).bitwiseAND(F.lit((1 << 20) - 1)) for k in (20, 40)), o.bitwiseAND(F.lit((1 << 20) - 1)))
        out = out.withColumn(f"{n}_n", cnt + odd_n)
    drop = ["_blk", "_halo", *[f"_p_{n}" for n in terms], *[f"_sx_{i}" for i in range(len(sums))], *[f"_odd_{n}" for n in odd]]
    for n in variances:
        drop += [f"_vx_{n}", f"_vc_{n}", f"_v1_{n}", f"_v2_{n}", f"_vn_{n}"]
    return out.drop(*drop)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, parts: int | None = None,
                      descending: bool = False) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` (a total order), with their
    rank ``_rk``. A hot group is limited in ``parts`` pieces first, so no task
    ranks more than a piece or ``parts * n`` rows of it."""
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).desc() if descending else F.col(c) for c in order]
    rank = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(*by))
    some = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(parts)))
    some = some.withColumn("_rk", rank(*keys, "_piece")).where(F.col("_rk") <= n).drop("_piece", "_rk")
    return some.withColumn("_rk", rank(*keys)).where(F.col("_rk") <= n)


def lags(df: DataFrame, idx: str, cols: Mapping[str, tuple[str, int]],
         keys: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """Lagged values ``name -> (column, lag)`` by a dense index, across blocks."""
    depth = max(lag for _, lag in cols.values())
    laid, window = halo_window_frame(df, idx, depth, block_rows, keys)
    out = laid.select("*", *[F.lag(c, lag).over(window).alias(n) for n, (c, lag) in cols.items()])
    return out.where(~F.col("_halo")).drop("_blk", "_halo")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (no job runs). For scans it comes
    from file sizes, for joins it is an upper bound."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def bounded_broadcast(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` only when its estimated size is at most ``max_bytes``;
    otherwise leave the join strategy to Spark (AQE can still switch at run
    time on the measured size)."""
    try:
        size = estimated_bytes(df)
    except AttributeError:  # a remote session has no handle on the plan: do not force
        return df
    return F.broadcast(df) if size <= max_bytes else df


#: Rows of a value range that is sorted; wider ranges are narrowed first.
RANGE_ROWS = 1 << 16
SKETCH_ACCURACY = 2000  # ranks of the quantile sketch err by at most 1 / this of the rows


def select_ranks(df: DataFrame, col: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the numbers in ``col`` (no nulls or NaN), without a sort of them.

    Each wanted rank has a value range that holds it for certain. A pass counts the
    rows below and inside every range and sketches its quantiles (mergeable
    summaries with a rank error bound), which narrow the range by the sketch's
    accuracy. Ranges of at most ``RANGE_ROWS`` rows, or of one value, are done: only
    their distinct values and counts are read.
    """
    x = F.col(col)
    lo, hi = (F.min(x), F.max(x))
    first = df.agg(lo.alias("lo"), hi.alias("hi"), F.count(x).alias("n")).first()
    bounds = {k: (first["lo"], first["hi"]) for k in set(ranks)}
    below, inside, out = {k: 0 for k in bounds}, {k: first["n"] for k in bounds}, {}
    while True:
        out |= {k: b[0] for k, b in bounds.items() if b[0] == b[1] and k not in out}
        wide = {b for k, b in bounds.items() if k not in out and inside[k] > RANGE_ROWS}
        if not wide:
            break
        wanted = {b: sorted(k for k, c in bounds.items() if c == b and k not in out) for b in wide}
        names = {b: f"r{i}" for i, b in enumerate(sorted(wide))}
        parts = []
        for b, name in names.items():
            some = F.when(x.between(F.lit(b[0]), F.lit(b[1])), x)
            edges = []
            for k in wanted[b]:
                at, margin = (k - below[k]) / inside[k], 2 / SKETCH_ACCURACY
                edges += [max(at - margin, 0.0), min(at + margin, 1.0)]
            parts.append(F.percentile_approx(some, edges, SKETCH_ACCURACY).alias(name))
        got = df.agg(*parts).first()
        tried = {k: tuple(got[names[b]][2 * j:2 * j + 2]) for b in wide for j, k in enumerate(wanted[b])}
        pairs = sorted(set(tried.values()))
        counts = df.agg(*[c for i, (p, q) in enumerate(pairs) for c in (F.count_if(x < F.lit(p)).alias(f"b{i}"),
                                                                      F.count_if(x.between(F.lit(p), F.lit(q))).alias(f"n{i}"))]).first()
        for k, pair in tried.items():
            i = pairs.index(pair)
            if not counts[f"b{i}"] <= k < counts[f"b{i}"] + counts[f"n{i}"]:
                raise RuntimeError("a quantile sketch missed its error bound")
            stuck = pair == bounds[k]  # the range's ends are values of so many rows that the sketch cannot part them
            bounds[k], below[k], inside[k] = pair, counts[f"b{i}"], counts[f"n{i}"]
            if stuck and pair[0] != pair[1]:
                _split_at_end(df, x, k, bounds, below, inside)
    for pair in sorted({bounds[k] for k in bounds if k not in out}):
        rows = df.where(x.between(F.lit(pair[0]), F.lit(pair[1]))).groupBy(x.alias("v")).count().collect()
        values = sorted((r["v"], r["count"]) for r in rows)
        for k in (k for k, b in bounds.items() if b == pair and k not in out):
            left = k - below[k]
            for v, n in values:
                if left < n:
                    out[k] = v
                    break
                left -= n
    return out


def _split_at_end(df: DataFrame, x: Column, k: int, bounds: dict, below: dict, inside: dict) -> None:
    """Narrow the range of rank ``k`` by its own ends: to the lowest value, the highest one, or what is between."""
    p, q = bounds[k]
    between = (x > F.lit(p)) & (x < F.lit(q))
    r = df.agg(F.count_if(x == F.lit(p)).alias("low"), F.count_if(between).alias("mid"),
               F.min(F.when(between, x)).alias("a"), F.max(F.when(between, x)).alias("b")).first()
    if k < below[k] + r["low"]:
        bounds[k], inside[k] = (p, p), r["low"]
    elif k < below[k] + r["low"] + r["mid"]:
        bounds[k], below[k], inside[k] = (r["a"], r["b"]), below[k] + r["low"], r["mid"]
    else:
        bounds[k], below[k], inside[k] = (q, q), below[k] + r["low"] + r["mid"], inside[k] - r["low"] - r["mid"]


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], n_buckets: int | None = None) -> list[float | None]:
    """Exact quantiles with linear interpolation (numpy / ``percentile`` /
    ``quantile_cont`` semantics), fully distributed.

    The order statistics around each quantile are selected by mergeable sketches
    (``select_ranks``): a few aggregations, no sort of the values. Unlike the
    ``percentile`` aggregate, no task holds a map of all distinct values. NaN
    ranks above everything; nulls are left out.
    """
    vals = materialize(df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_q_v")))  # read by every pass
    n, odd = vals.agg(F.count("*"), F.count_if(F.isnan("_q_v"))).first()
    if n == 0:
        return [None] * len(qs)
    wanted = {}
    for q in qs:
        pos = (n - 1) * float(q)
        lo, hi = int(math.floor(pos)), int(math.ceil(pos))
        wanted[q] = (pos, lo, hi)
    idx = sorted({i for _, lo, hi in wanted.values() for i in (lo, hi)})
    got = {i: math.nan for i in idx if i >= n - odd}
    if len(got) < len(idx):
        got |= select_ranks(vals.where(~F.isnan("_q_v")), "_q_v", [i for i in idx if i < n - odd])
    out = []
    for q in qs:
        pos, lo, hi = wanted[q]
        out.append(got[lo] if lo == hi else (hi - pos) * got[lo] + (pos - lo) * got[hi])
    return out
