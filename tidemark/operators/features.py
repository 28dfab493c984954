"""Row features that depend on the stream order: cyclical encodings, running
statistics, target scaling, the learner warm-up gate, lags and rolling means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import CYCLICAL_PERIODS, cyclical
from tidemark.plans.ordering import Sequenced, lags, rolling, running_moments, running_sums, with_global_index


def with_cyclical(df: DataFrame, periods: Mapping[str, float] = CYCLICAL_PERIODS) -> DataFrame:
    """``{c}_sin, {c}_cos`` for every present numeric periodic column."""
    numeric = {f.name for f in df.schema.fields
               if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")}
    out = df
    for c, p in periods.items():
        if c in numeric:
            s, co = cyclical(c, p)
            out = out.withColumn(f"{c}_sin", s).withColumn(f"{c}_cos", co)
    return out


def running_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D2 (final): mean, population std (0 when n < 2) and n per numeric feature.

    All features are unpivoted once, so the result is one aggregation whatever
    the number of columns.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("s")
    ).select("s.*")
    n = F.count("value")
    return stacked.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.when(n >= 2, F.stddev_pop("value")).otherwise(F.lit(0.0)).alias("std"),
        n.alias("n"))


def running_stats_prefix(seq: Sequenced, col: str, prefix: str | None = None) -> Sequenced:
    """D2 (per row): running mean, population std and n of ``col`` including the row."""
    p = prefix or col
    s = running_moments(seq, col, f"_{p}", inclusive=True)
    n = F.col(f"_{p}_n")
    out = s.df.select(
        *seq.df.columns,
        F.col(f"_{p}_mean").alias(f"{p}_run_mean"),
        F.when(n >= 2, F.sqrt(F.col(f"_{p}_m2") / n)).otherwise(F.lit(0.0)).alias(f"{p}_run_std"),
        n.alias(f"{p}_run_n"))
    return seq.with_df(out)


def target_scale(seq: Sequenced, y: str = "target") -> Sequenced:
    """Online target standardization.

    ``t_mean_prior``/``t_std_prior`` are the statistics a prediction is
    unscaled with (labels before the row); ``y_scaled`` uses the statistics
    after the row's own label entered (as the learner sees it). The std is the
    population std, 1 when n < 2 or below 1e-9.
    """
    pri = running_moments(seq, y, "_tp", inclusive=False)
    # statistics including the row: the prior ones plus the row's own label
    yv = F.col(y).cast("double")
    has = yv.isNotNull()
    n_i = F.col("_tp_n") + has.cast("long")
    mp = F.coalesce(F.col("_tp_mean"), F.lit(0.0))
    mean_i = F.when(has, mp + (yv - mp) / n_i).otherwise(F.col("_tp_mean"))
    m2_i = F.when(has, F.col("_tp_m2") + (yv - mp) * (yv - mean_i)).otherwise(F.col("_tp_m2"))
    inc = pri.with_df(pri.df.withColumn("_ti_n", n_i).withColumn("_ti_mean", mean_i).withColumn("_ti_m2", m2_i))

    def std(pfx):
        n = F.col(f"{pfx}_n")
        s = F.sqrt(F.col(f"{pfx}_m2") / F.greatest(n, F.lit(1)))
        return F.when((n >= 2) & (s > 1e-9), s).otherwise(F.lit(1.0))

    out = inc.df.select(
        *seq.df.columns,
        F.coalesce(F.col("_tp_mean"), F.lit(0.0)).alias("t_mean_prior"),
        std("_tp").alias("t_std_prior"),
        F.when(F.col(y).isNotNull(), (F.col(y) - F.col("_ti_mean")) / std("_ti")).alias("y_scaled"))
    return seq.with_df(out)


def warmup_mask(seq: Sequenced, y: str = "target", warmup: int = 100) -> Sequenced:
    """The learner skips the first ``max(warmup, 2)`` labels.

    ``label_n`` counts labels up to and including the row, ``learns`` marks
    labelled rows the learner trains on, ``model_active`` marks rows predicted
    by a learner that has trained at least once (else the prior target mean).
    """
    w = max(int(warmup), 2)
    counted = running_sums(seq, {"label_n": F.col(y).isNotNull().cast("long")}, inclusive=True)
    out = counted.df.select(
        *seq.df.columns, "label_n",
        (F.col(y).isNotNull() & (F.col("label_n") > w)).alias("learns"),
        ((F.col("label_n") - F.col(y).isNotNull().cast("int")) > w).alias("model_active"))
    return seq.with_df(out)


def with_lags(seq: Sequenced, y: str = "target", lag_list: Sequence[int] = (1, 2, 3), idx: str = "gidx") -> DataFrame:
    """``{y}_lag{k}`` = label k rows earlier in stream order (null at the start)."""
    s = seq if idx in seq.df.columns else with_global_index(seq, idx)
    return lags(s.df, idx, {f"{y}_lag{k}": (y, k) for k in lag_list})


def with_rolling_mean(seq: Sequenced, y: str = "target", w: int = 50, idx: str = "gidx") -> DataFrame:
    """Mean of the ``w`` labels before the row (exclusive), null at the start."""
    s = seq if idx in seq.df.columns else with_global_index(seq, idx)
    out = rolling(s.df, idx, w + 1, {"_s": F.col(y), "_c": F.col(y).isNotNull().cast("long")})
    prior_sum = F.col("_s") - F.coalesce(F.col(y), F.lit(0.0))
    prior_n = F.col("_c") - F.col(y).isNotNull().cast("int")
    return out.withColumn(f"{y}_roll{w}", F.when(prior_n > 0, prior_sum / prior_n)).drop("_s", "_c")


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str], ignore: Sequence[str] = (),
                     output: str = "features") -> Pipeline:
    """One-hot categoricals and standardized numerics chosen by role.

    Unseen categories at scoring time go to an extra slot
    (``handleInvalid='keep'``).
    """
    drop = set(ignore)
    cats = [c for c in categorical if c not in drop]
    nums = [c for c in numeric if c not in drop]
    stages = []
    parts = []
    if nums:
        stages.append(VectorAssembler(inputCols=nums, outputCol="_num_vec", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="_num_vec", outputCol="_num_scaled", withMean=True, withStd=True))
        parts.append("_num_scaled")
    if cats:
        idx = [f"_{c}_idx" for c in cats]
        ohe = [f"_{c}_ohe" for c in cats]
        stages.append(StringIndexer(inputCols=cats, outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, handleInvalid="keep"))
        parts.extend(ohe)
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return Pipeline(stages=stages)
