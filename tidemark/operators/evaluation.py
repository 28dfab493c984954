"""Test-then-train evaluation and residual diagnostics.

Cumulative metrics are two-level running aggregates; rolling metrics are
bounded frames on halo blocks of the labelled-row index; per-segment "last n"
values limit a segment piece by piece before its rows meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordering import Sequenced, lags, first_n_per_group, rolling, running, with_global_index

# Fixed values of the reference configuration.
R2_EPS = 1e-12
AUTOCORR_LAGS = (1, 10, 50, 200, 1000)
ERROR_QUANTILES = (50.0, 75.0, 90.0, 95.0, 99.0, 99.9)


def _r2(sse, sst, n):
    return F.when((n < 2) | (sst <= R2_EPS), F.lit(0.0)).otherwise(1.0 - sse / sst)


def with_errors(df: DataFrame, y: str = "target", yhat: str = "prediction") -> DataFrame:
    """Absolute error, squared error and residual (prediction - actual)."""
    e = F.col(y) - F.col(yhat)
    return df.select("*", F.abs(e).alias("abs_err"), (e * e).alias("sq_err"), (-e).alias("residual"))


def prequential(seq: Sequenced, y: str = "target", yhat: str = "prediction") -> Sequenced:
    """cumulative MAE, RMSE, R2 after each row (labelled rows update)."""
    lab = F.col(y).isNotNull()
    err = F.col(y) - F.col(yhat)
    m = running(seq, sums={"_pn": lab.cast("long"), "_pa": F.when(lab, F.abs(err)),
                           "_pq": F.when(lab, err * err)}, moments={"_pt": F.col(y)}, inclusive=True)
    n = F.col("_pn")
    out = m.df.select(
        *seq.df.columns,
        n.alias("n"),
        F.when(n > 0, F.col("_pa") / n).otherwise(F.lit(0.0)).alias("mae"),
        F.when(n > 0, F.sqrt(F.col("_pq") / n)).otherwise(F.lit(0.0)).alias("rmse"),
        _r2(F.col("_pq"), F.col("_pt_m2"), n).alias("r2"))
    return seq.with_df(out)


def rolling_metrics(seq: Sequenced, y: str = "target", yhat: str = "prediction", w: int = 1000,
                    idx: str = "lidx") -> DataFrame:
    """MAE, RMSE, R2 over the last ``w`` labelled rows (partial at start).

    Returns labelled rows only, with their labelled index ``lidx``.
    """
    s = seq if idx in seq.df.columns else with_global_index(seq, idx, where=F.col(y).isNotNull())
    err = F.col(y) - F.col(yhat)
    base = s.df.where(F.col(idx).isNotNull()).withColumn("_ae", F.abs(err)).withColumn("_se", err * err)
    out = rolling(base, idx, w, {"_c": F.lit(1).cast("long"), "_sa": F.col("_ae"), "_sq": F.col("_se")},
                  variances={"_vy": F.col(y)})
    c = F.col("_c")
    return out.select(
        *[x for x in s.df.columns],
        (F.col("_sa") / c).alias("rolling_mae"),
        F.sqrt(F.col("_sq") / c).alias("rolling_rmse"),
        _r2(F.col("_sq"), F.col("_vy") * c, c).alias("rolling_r2"))


def snapshot(metrics: DataFrame, idx: str = "lidx") -> DataFrame:
    """the metric state after the last labelled row (7 values incl. n)."""
    cols = ["mae", "rmse", "r2", "rolling_mae", "rolling_rmse", "rolling_r2", "n"]
    return metrics.agg(*[F.max_by(c, idx).alias(c) for c in cols])


def holdout_metrics(df: DataFrame, y: str = "target", yhat: str = "prediction") -> DataFrame:
    """frozen MAE, RMSE, R2 (SST = 0 counts as 1) and n, in one aggregation."""
    e = F.col(y) - F.col(yhat)
    lab = df.where(F.col(y).isNotNull())
    n = F.count(F.lit(1))
    sst = F.var_pop(y) * n
    sse = F.sum(e * e)
    return lab.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                   (1.0 - sse / F.when(sst == 0, F.lit(1.0)).otherwise(sst)).alias("r2"), n.alias("n"))


def segment_mae(df: DataFrame, seg: str = "pu_borough", err: str = "abs_err") -> DataFrame:
    """MAE per segment rounded to 1 over its ``n`` scored rows; segment ``all``
    if the column is absent."""
    s = F.col(seg).cast("string") if seg in df.columns else F.lit("all")
    return df.groupBy(s.alias("segment")).agg(F.round(F.avg(err), 1).alias("mae"), F.count(err).alias("n"))


def rolling_segment_mae(df: DataFrame, seg: str, order: Sequence[str], err: str = "abs_err",
                        n: int = 2000) -> DataFrame:
    """F6 (snapshot): MAE over the last ``n`` errors of each segment, rounded to 1."""
    last = first_n_per_group(df.where(F.col(err).isNotNull()), [seg], order, n, descending=True)
    return last.groupBy(F.col(seg).cast("string").alias("segment")).agg(
        F.round(F.avg(err), 1).alias("rolling_mae"), F.count(F.lit(1)).alias("n"))


def rolling_segment_mae_rows(seq: Sequenced, seg: str, err: str = "abs_err", n: int = 2000) -> DataFrame:
    """F6 (per row): rolling MAE of the row's segment over its last ``n`` errors."""
    s = with_global_index(seq, "_sidx", where=F.col(err).isNotNull(), keys=[seg])
    out = rolling(s.df, "_sidx", n, {"_sa": F.col(err), "_c": F.col(err).isNotNull().cast("long")}, keys=[seg])
    return out.withColumn("segment_rolling_mae", F.col("_sa") / F.col("_c")).drop("_sa", "_c", "_sidx")


def total_rows(seq: Sequenced, where=None) -> int:
    df = seq.df if where is None else seq.df.where(where)
    return int(df.count())


def time_split(seq: Sequenced, frac: float, idx: str = "gidx") -> tuple[DataFrame, DataFrame]:
    """first ``int(n * frac)`` rows in stream order, and the rest."""
    s = seq if idx in seq.df.columns else with_global_index(seq, idx)
    cut = int(total_rows(seq) * frac)
    return s.df.where(F.col(idx) < cut), s.df.where(F.col(idx) >= cut)


def rolling_window_split(seq: Sequenced, window_frac: float = 0.8, val_frac: float = 0.1,
                         idx: str = "gidx") -> tuple[DataFrame, DataFrame]:
    """F8: holdout = last ``val_frac``; window = last ``window_frac`` of the rest."""
    s = seq if idx in seq.df.columns else with_global_index(seq, idx)
    n = total_rows(seq)
    val_start = int(n * (1 - val_frac))
    window_start = int(val_start * (1 - window_frac))
    i = F.col(idx)
    return s.df.where((i >= window_start) & (i < val_start)), s.df.where(i >= val_start)


def promotion_decision(cand: DataFrame, champ: DataFrame | None, margin: float = 0.0) -> DataFrame:
    """promote iff there is no champion or ``cand_mae < champ_mae (1 - margin)``."""
    c = cand.select(F.col("mae").alias("candidate_mae"), F.col("r2").alias("candidate_r2"))
    if champ is None:
        return c.select("*", F.lit(None).cast("double").alias("champion_mae"),
                        F.lit(None).cast("double").alias("champion_r2"), F.lit(True).alias("promote"),
                        F.lit("PROMOTE").alias("decision"))
    h = champ.select(F.col("mae").alias("champion_mae"), F.col("r2").alias("champion_r2"))
    j = c.withColumn("_one", F.lit(1)).join(h.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    promote = F.col("champion_mae").isNull() | (F.col("candidate_mae") < F.col("champion_mae") * (1 - margin))
    return j.select("*", promote.alias("promote"),
                    F.when(promote, F.lit("PROMOTE")).otherwise(F.lit("KEEP CHAMPION")).alias("decision"))


def residual_summary(df: DataFrame, y: str = "target", yhat: str = "prediction") -> DataFrame:
    """n, MAE, RMSE and bias = mean(prediction - actual)."""
    r = F.col(yhat) - F.col(y)
    return df.where(F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mae"),
        F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(r).alias("bias"))


def residual_by(df: DataFrame, cols: Sequence[str] = ("pickup_hour", "pickup_dayofweek"),
                y: str = "target", yhat: str = "prediction") -> DataFrame:
    """bias, MAE and n per value of each column, all in one grouping-sets pass."""
    r = F.col(yhat) - F.col(y)
    lab = df.where(F.col(y).isNotNull()).withColumn("_r", r)
    sets = [[F.col(c)] for c in cols]
    g = lab.groupingSets(sets, *cols).agg(
        F.avg("_r").alias("bias"), F.avg(F.abs(F.col("_r"))).alias("mae"), F.count(F.lit(1)).alias("n"),
        *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    dim = F.lit(None).cast("string")
    val = F.lit(None).cast("long")
    for c in reversed(list(cols)):
        dim = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(dim)
        val = F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("long")).otherwise(val)
    return g.select(dim.alias("dim"), val.alias("value"), "bias", "mae", "n")


def autocorr(seq: Sequenced, value: str = "residual", lag_list: Sequence[int] = AUTOCORR_LAGS,
             idx: str = "gidx") -> DataFrame:
    """``sum(r0[t] r0[t-lag]) / sum(r0^2)`` with ``r0`` centred by the mean.

    Lagged values come from halo blocks of the dense index (one shuffle for
    all lags), not from a self-join per lag.
    """
    s = seq if idx in seq.df.columns else with_global_index(seq, idx, where=F.col(value).isNotNull())
    base = s.df.where(F.col(idx).isNotNull()).select(idx, value)
    mean = base.agg(F.avg(value)).first()[0] or 0.0
    c = base.withColumn("_r0", F.col(value) - F.lit(mean))
    lagged = lags(c, idx, {f"_l{k}": ("_r0", k) for k in lag_list})
    sums = lagged.agg(F.sum(F.col("_r0") * F.col("_r0")).alias("_den"),
                      *[F.sum(F.col("_r0") * F.col(f"_l{k}")).alias(f"_n{k}") for k in lag_list])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_n{k}") / F.col("_den")).alias("autocorr"))
                     for k in lag_list])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def error_percentiles(df: DataFrame, err: str = "abs_err", qs: Sequence[float] = ERROR_QUANTILES,
                      exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """error tail percentiles with linear interpolation.

    Exact by default through a distributed sort (no task holds all values);
    ``exact=False`` uses ``percentile_approx`` (one pass, bounded sketch).
    """
    from tidemark.plans.ordering import exact_quantiles

    names = [("p" + (str(q).rstrip("0").rstrip(".")).replace(".", "_")) for q in qs]
    if not exact:
        return df.where(F.col(err).isNotNull()).agg(
            *[F.percentile_approx(err, q / 100.0, accuracy).alias(n) for q, n in zip(qs, names)])
    vals = exact_quantiles(df, err, [q / 100.0 for q in qs])
    schema = ", ".join(f"{n} double" for n in names)
    return df.sparkSession.createDataFrame([tuple(vals)], schema)


def recent_points(df: DataFrame, idx: str = "gidx", ts: str = "pickup_datetime", y: str = "target",
                  yhat: str = "prediction", n: int = 200) -> DataFrame:
    """F16: the last ``n`` points (index, ts, actual, predicted rounded to 2)."""
    return (df.orderBy(F.col(idx).desc()).limit(n)
            .select(F.col(idx).alias("index"), F.col(ts).alias("ts"),
                    F.round(y, 2).alias("actual"), F.round(yhat, 2).alias("predicted")))


def perf_history(rolling_df: DataFrame, idx: str = "gidx", every: int = 100, keep: int = 400) -> DataFrame:
    """rolling metrics at every ``every``-th engine index, the last ``keep``."""
    sel = rolling_df.where(F.col(idx) % every == 0)
    return (sel.orderBy(F.col(idx).desc()).limit(keep)
            .select(F.col(idx).alias("index"), F.round("rolling_mae", 3).alias("rolling_mae"),
                    F.round("rolling_rmse", 3).alias("rolling_rmse"), F.round("rolling_r2", 3).alias("rolling_r2")))


def metric_log(metrics: DataFrame, idx: str = "gidx", every: int = 500,
               cols: Sequence[str] = ("mae", "rmse", "r2", "rolling_mae"), events: DataFrame | None = None,
               event_idx: str = "i") -> DataFrame:
    """Metrics at every ``every``-th engine index, with the running
    counts of validated concept and feature drift events up to that index.

    Event counts come from a two-level running sum over the union of log
    steps and (sparse) events, so no step is matched against events one by one.
    """
    from tidemark.plans.ordering import running, sequence

    steps = metrics.where(F.col(idx) % every == 0).select(F.col(idx).alias("step"), *cols)
    if events is None:
        return steps
    ev = events.where(F.col("validated")).select(
        F.col(event_idx).cast("long").alias("step"),
        (F.col("type") == "concept").cast("long").alias("_c"), (F.col("type") == "feature").cast("long").alias("_f"),
        F.lit(0).alias("_is_step"))
    st = steps.select("step", F.lit(0).cast("long").alias("_c"), F.lit(0).cast("long").alias("_f"),
                      F.lit(1).alias("_is_step"))
    both = ev.unionByName(st).withColumn("_tie", F.monotonically_increasing_id())
    seq = running(sequence(both, ["step", "_is_step", "_tie"], materialize=False),
                  sums={"concept_drift_events": F.col("_c"), "feature_drift_events": F.col("_f")})
    counts = seq.df.where(F.col("_is_step") == 1).select("step", "concept_drift_events", "feature_drift_events")
    return steps.join(counts, "step", "left")
