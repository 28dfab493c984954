"""H4-H9: monitoring outputs and late labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed upper bounds of the prediction-latency histogram, in seconds.
LATENCY_BOUNDS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5)


def metrics_long(snapshot: DataFrame, ts: str | None = None, labels: Mapping[str, str] | None = None) -> DataFrame:
    """H5: one row per metric ``(ts, metric, labels, value)`` from a wide snapshot."""
    num = [f.name for f in snapshot.schema.fields
           if f.dataType.typeName() in ("double", "long", "integer", "float", "boolean")]
    lab = F.create_map(*[x for k, v in (labels or {}).items() for x in (F.lit(k), F.lit(v))]) if labels else \
        F.create_map().cast("map<string,string>")
    arr = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in num])
    t = F.col(ts) if ts else F.current_timestamp()
    return snapshot.select(t.alias("ts"), F.explode(arr).alias("m")).select(
        "ts", "m.metric", lab.alias("labels"), "m.value")


def metric_rows(frame: DataFrame, names: Sequence[str], prefix: str = "", label: str | None = None) -> DataFrame:
    """``(metric, label, value)`` of the numeric columns ``names``; with ``label`` one
    series per value of that column."""
    lab = F.concat(F.lit(f"{label}="), F.col(label).cast("string")) if label else F.lit("")
    arr = F.array(*[F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return frame.select(lab.alias("label"), F.explode(arr).alias("m")).select("m.metric", "label", "m.value")


def metric_export(parts: Sequence[DataFrame], ts, source: str) -> DataFrame:
    """H5: all series of one scrape, ``(ts, source, metric, label, value)``; ``ts`` is
    the scrape's time (a literal or a column expression)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(ts.alias("ts"), F.lit(source).alias("source"), "metric", "label", "value")


def histogram(df: DataFrame, col: str, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """H6: cumulative bucket counts ``(le, count)`` including ``+Inf`` (as null le)."""
    aggs = [F.count_if(F.col(col) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.where(F.col(col).isNotNull()).agg(*aggs, F.count(F.lit(1)).alias("binf"))
    arr = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)],
                  F.struct(F.lit(None).cast("double").alias("le"), F.col("binf").alias("count")))
    return wide.select(F.explode(arr).alias("h")).select("h.le", "h.count")


def bucket_quantile(hist: DataFrame, q: float) -> DataFrame:
    """H6: quantile from cumulative buckets: the first bucket whose count
    reaches ``q * total``, linear inside it (lower bound 0 for the first);
    in the ``+Inf`` bucket, the largest finite bound."""
    w = Window.orderBy(F.col("le").asc_nulls_last())
    h = (hist.withColumn("_prev_le", F.lag("le").over(w)).withColumn("_prev_c", F.lag("count").over(w))
             .withColumn("_total", F.max("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    rank = F.lit(q) * F.col("_total")
    hit = h.where(F.col("count") >= rank).orderBy(F.col("le").asc_nulls_last()).limit(1)
    lo = F.coalesce(F.col("_prev_le"), F.lit(0.0))
    pc = F.coalesce(F.col("_prev_c"), F.lit(0))
    inside = lo + (F.col("le") - lo) * (rank - pc) / (F.col("count") - pc)
    val = F.when(F.col("le").isNull(), F.col("_prev_le")).when(F.col("count") == pc, F.col("le")).otherwise(inside)
    return hit.select(F.lit(q).alias("q"), val.alias("value"))


def throughput(df: DataFrame, ts: str, every: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """H7: rows per second over tumbling windows (watermarked when streaming)."""
    src = df.withWatermark(ts, watermark) if watermark else df
    secs = {"1 minute": 60.0}.get(every)
    if secs is None:
        num, unit = every.split()
        secs = float(num) * {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}[unit]
    return src.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows",
        (F.col("rows") / F.lit(secs)).alias("rate_per_sec"))


def status_snapshot(snapshot: DataFrame, segments: DataFrame, recent: DataFrame, history: DataFrame,
                    psi_last: DataFrame | None, events: DataFrame, counts: DataFrame, source: str,
                    totals: DataFrame | None = None, hours: DataFrame | None = None) -> DataFrame:
    """H8: one row of structs and arrays (all inputs are already bounded:
    one-row aggregates, per-segment rows, top-k lists). ``totals`` adds the columns
    of a one-row frame (samples, labels, version, retrain flag), ``hours`` the
    segments by hour."""
    perf = snapshot.select(F.struct(*[F.round(c, 4).alias(c) for c in snapshot.columns]).alias("performance"))
    seg = segments.agg(F.map_from_entries(F.collect_list(F.struct("segment", "rolling_mae"))).alias("segments"))
    rec = recent.agg(F.sort_array(F.collect_list(F.struct(*recent.columns))).alias("recent"))
    his = history.agg(F.sort_array(F.collect_list(F.struct(*history.columns))).alias("history"))
    ev = events.agg(F.collect_list(F.struct(*events.columns)).alias("drift_events"))
    parts = [perf, seg, rec, his, ev, counts]
    if totals is not None:
        parts.append(totals)
    if hours is not None:
        parts.append(hours.agg(F.map_from_entries(F.collect_list(F.struct("segment", "rolling_mae"))).alias("hour_segments")))
    if psi_last is not None:
        parts.append(psi_last.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.round("psi", 4)))).alias("feature_psi")))
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:  # every part is a one-row aggregate: equi-join on a constant key
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one").select(F.lit(source).alias("source"), "*")


def join_labels(preds: DataFrame, labels: DataFrame, key: str = "record_id", pred_ts: str = "pred_ts",
                label_ts: str = "label_ts", watermark: str = "1 hour", bound: str = "1 day") -> DataFrame:
    """H9: attach late labels to predictions (stream-stream left outer join,
    watermarks on both sides, labels accepted within ``bound`` of the prediction)."""
    p = preds.withWatermark(pred_ts, watermark).alias("p")
    lab = labels.withWatermark(label_ts, watermark).alias("l")
    cond = (F.col(f"p.{key}") == F.col(f"l.{key}")) & (F.col(f"l.{label_ts}") >= F.col(f"p.{pred_ts}")) & \
        (F.col(f"l.{label_ts}") <= F.col(f"p.{pred_ts}") + F.expr(f"INTERVAL {bound}"))
    return p.join(lab, cond, "leftOuter").select("p.*", *[F.col(f"l.{c}") for c in labels.columns if c != key])
