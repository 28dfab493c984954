"""Cleaning raw trip records into the prepared trips table (projections,
filters, calendar columns, seeded per-group caps, ordering and ids)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import KM_PER_MILE, RUSH_HOURS, col, duration_seconds
from tidemark.plans.ordering import Sequenced, first_n_per_group, with_global_index

# Column names of the raw files and of the prepared table.
RAW_COLUMNS = ("tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count", "trip_distance",
               "RatecodeID", "PULocationID", "DOLocationID")

PREPARED_COLUMNS = ("pickup_datetime", "target_duration_s", "pickup_hour", "pickup_dayofweek",
                    "pickup_month", "is_weekend", "is_rush_hour", "passenger_count",
                    "route_distance_km", "pu_zone", "do_zone", "ratecode")


def with_duration(df: DataFrame, start: str = "pickup", end: str = "dropoff",
                  name: str = "duration_s") -> DataFrame:
    """B1: duration in seconds (dropoff - pickup), fractions kept."""
    return df.withColumn(name, duration_seconds(start, end))


def clean_trips(df: DataFrame, min_s: float = 60, max_s: float = 10_800, duration: str = "duration_s",
                passengers: str = "passenger_count", distance: str = "trip_distance",
                required: Sequence[str] = ("pu_id", "do_id", "ratecode_id")) -> DataFrame:
    """B2: keep rows with duration in ``[min_s, max_s]``, at least one passenger
    (null counts as 0), positive distance and all ``required`` columns present."""
    return df.where(is_clean(min_s, max_s, duration, passengers, distance, required))


def is_clean(min_s: float = 60, max_s: float = 10_800, duration: str = "duration_s", passengers: str = "passenger_count",
             distance: str = "trip_distance", required: Sequence[str] = ("pu_id", "do_id", "ratecode_id")) -> Column:
    """The condition of ``clean_trips``."""
    cond = (F.col(duration).between(float(min_s), float(max_s))
            & (F.coalesce(F.col(passengers), F.lit(0)) >= 1)
            & (F.col(distance) > 0))
    for c in required:
        cond = cond & F.col(c).isNotNull()
    return cond


def in_month(df: DataFrame, ts: str, month: str | Column) -> DataFrame:
    """Keep rows whose ``ts`` lies in ``[month start, next month start)``.

    ``month`` is a ``'YYYY-MM'`` literal (a static predicate that reaches the
    scan) or a column holding the first instant of the row's month.
    """
    if isinstance(month, str) and len(month) == 7:
        start = F.to_timestamp(F.lit(month + "-01"))
    else:
        start = col(month).cast("timestamp_ntz") if isinstance(month, str) else month
    end = F.add_months(start, 1).cast("timestamp_ntz")
    t = F.col(ts)
    return df.where((t >= start) & (t < end))


def with_calendar(df: DataFrame, ts: str = "pickup_datetime", rush_hours: Iterable[int] = RUSH_HOURS,
                  prefix: str = "pickup") -> DataFrame:
    """Hour, day of week (0 = Monday), month, weekend and rush-hour flags."""
    t = F.col(ts)
    hour = F.hour(t)
    dow = F.weekday(t)
    return df.select(
        "*",
        hour.alias(f"{prefix}_hour"),
        dow.alias(f"{prefix}_dayofweek"),
        F.month(t).alias(f"{prefix}_month"),
        (dow >= 5).cast("int").alias("is_weekend"),
        hour.isin(*list(rush_hours)).cast("int").alias("is_rush_hour"),
    )


def normalize_ids(df: DataFrame, pu: str = "pu_id", do: str = "do_id", rate: str = "ratecode_id",
                  passengers: str = "passenger_count") -> DataFrame:
    """Integer ids to strings, passenger count to int."""
    return (df.withColumn("pu_zone", F.col(pu).cast("int").cast("string"))
              .withColumn("do_zone", F.col(do).cast("int").cast("string"))
              .withColumn("ratecode", F.col(rate).cast("int").cast("string"))
              .withColumn(passengers, F.col(passengers).cast("int")))


def with_route_km(df: DataFrame, miles: str = "trip_distance", name: str = "route_distance_km") -> DataFrame:
    """Miles to km, clipped at 0."""
    return df.withColumn(name, F.greatest(F.col(miles) * F.lit(KM_PER_MILE), F.lit(0.0)))


def select_prepared(df: DataFrame, ts: str = "pickup", duration: str = "duration_s",
                    keep: Sequence[str] = ()) -> DataFrame:
    """Final projection to the prepared columns (plus ``keep``)."""
    renamed = df.withColumnRenamed(ts, "pickup_datetime").withColumnRenamed(duration, "target_duration_s")
    return renamed.select(*keep, *PREPARED_COLUMNS)


def prepare_trips(raw: DataFrame, min_s: float = 60, max_s: float = 10_800,
                  rush_hours: Iterable[int] = RUSH_HOURS, month: str | Column | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """B1-B7 in one pass: one filter, one projection (no per-month loop)."""
    df = with_duration(raw, "pickup", "dropoff")
    df = clean_trips(df, min_s, max_s)
    if month is not None:
        df = in_month(df, "pickup", month)
    df = with_calendar(df, "pickup", rush_hours)
    df = normalize_ids(df)
    df = with_route_km(df)
    return select_prepared(df, "pickup", "duration_s", keep)


def cap_per_group(df: DataFrame, group: str | Sequence[str], n: int, seed: int, id_cols: Sequence[str]) -> DataFrame:
    """Seeded sample of at most ``n`` rows per group; ``n = 0`` keeps all.

    Rows are ranked by ``md5(ids || seed)`` (a deterministic pseudo-random
    order) with the ids as tie-break; groups with fewer rows keep everything.
    A large group is limited piece by piece before its rows meet.
    """
    if n <= 0:
        return df
    groups = [group] if isinstance(group, str) else list(group)
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))
    return first_n_per_group(df.withColumn("_key", key), groups, ["_key", *id_cols], n).drop("_key", "_rk")


def order_by_time(df: DataFrame, ts: str = "pickup_datetime", tie_break: Sequence[str] = ()) -> DataFrame:
    """Total sort by time (range-partitioned by Spark)."""
    return df.orderBy(ts, *tie_break)


def with_sequential_id(seq: Sequenced, prefix: str = "taxi-", name: str = "record_id") -> Sequenced:
    """Dense id ``{prefix}{i}`` in stream order (distributed index)."""
    s = with_global_index(seq, "_i")
    return s.with_df(s.df.withColumn(name, F.concat(F.lit(prefix), F.col("_i").cast("string"))).drop("_i"))


def cleaning_report(raw: DataFrame, kept: Column, month: str = "src_month") -> DataFrame:
    """B11 (per month): rows before, rows that meet ``kept`` and percent kept, in
    one pass; months without rows to start with are absent."""
    j = raw.where(F.col(month).isNotNull()).groupBy(month).agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after"))
    return j.select(month, "rows_before", "rows_after",
                    F.round(F.col("rows_after") * 100.0 / F.greatest(F.col("rows_before"), F.lit(1)), 1).alias("pct_kept"))


def prepared_summary(prepared: DataFrame, ts: str = "pickup_datetime", target: str = "target_duration_s") -> DataFrame:
    """B11 (overall): row count, time span, mean and median target (exact
    median by a distributed sort)."""
    from tidemark.plans.ordering import exact_quantiles

    median = exact_quantiles(prepared, target, [0.5])[0]
    return prepared.agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.avg(target).alias("mean_target")).withColumn("median_target", F.lit(median).cast("double"))


def coerce(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Categorical features to string, numeric features to double."""
    cats, nums = set(categorical), set(numeric)
    return df.select(*[
        F.col(c).cast("string").alias(c) if c in cats else
        F.col(c).cast("double").alias(c) if c in nums else F.col(c)
        for c in df.columns])


def drop_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Remove ignored features (missing names are fine)."""
    return df.drop(*names)


def feature_set(df: DataFrame, use_route: bool, name: str = "route_distance_km") -> DataFrame:
    """Expose the route distance (0.0 when absent) or hide it."""
    if not use_route:
        return df.drop(name)
    if name in df.columns:
        return df.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
    return df.withColumn(name, F.lit(0.0))
