"""Models re-aimed as Spark jobs.

* Ridge regression from mergeable sufficient statistics (one aggregation per
  batch; a p x p solve on the driver, p = number of features).
* Regression trees / forests from Spark ML, refit per batch or window.
* Baselines (global mean, frozen zone-pair memory), scoring without learning,
  trip ETA output, bundle save/load and warm start.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.operators.features import feature_pipeline

ship_by_value(__name__)

# Roles of the trip features.
NUMERIC_FEATURES = ("pickup_hour", "pickup_dayofweek", "pickup_month", "is_weekend", "is_rush_hour",
                    "passenger_count", "gc_distance_km", "bearing_sin", "bearing_cos", "same_borough",
                    "pu_airport", "do_airport")
CATEGORICAL_FEATURES = ("pu_zone", "do_zone", "ratecode", "pu_borough", "do_borough")
IGNORED_FEATURES = ("pu_zone", "do_zone")
#: Coefficients of all micro-batches that are broadcast at most.
COEFS_BYTES = 64 << 20


# ---------------------------------------------------------------- E1: ridge
@dataclass
class LinearStats:
    """Sufficient statistics of ``(X, y)``: count, means and co-moments."""

    features: tuple[str, ...]
    n: float
    mean_x: np.ndarray
    mean_y: float
    cxx: np.ndarray  # sum of (x - mean)(x - mean)^T
    cxy: np.ndarray  # sum of (x - mean)(y - mean)

    def merge(self, other: "LinearStats") -> "LinearStats":
        """Combine statistics of two disjoint batches (Chan et al.)."""
        if other.n == 0:
            return self
        if self.n == 0:
            return other
        n = self.n + other.n
        dx = other.mean_x - self.mean_x
        dy = other.mean_y - self.mean_y
        f = self.n * other.n / n
        return LinearStats(self.features, n, self.mean_x + dx * other.n / n, self.mean_y + dy * other.n / n,
                           self.cxx + other.cxx + np.outer(dx, dx) * f, self.cxy + other.cxy + dx * dy * f)


def linear_stats(df: DataFrame, features: Sequence[str], y: str = "target") -> LinearStats:
    """One aggregation: counts, means and population co-moments (Spark's
    numerically stable ``covar_pop``)."""
    feats = list(features)
    lab = df.where(F.col(y).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my")]
    aggs += [F.avg(c).alias(f"m{i}") for i, c in enumerate(feats)]
    for i, a in enumerate(feats):
        aggs.append(F.covar_pop(a, y).alias(f"cy{i}"))
        for j in range(i, len(feats)):
            aggs.append(F.covar_pop(a, feats[j]).alias(f"c{i}_{j}"))
    r = lab.agg(*aggs).first()
    n = float(r["n"] or 0)
    p = len(feats)
    cxx = np.zeros((p, p))
    cxy = np.zeros(p)
    for i in range(p):
        cxy[i] = (r[f"cy{i}"] or 0.0) * n
        for j in range(i, p):
            cxx[i, j] = cxx[j, i] = (r[f"c{i}_{j}"] or 0.0) * n
    mx = np.array([r[f"m{i}"] or 0.0 for i in range(p)])
    return LinearStats(tuple(feats), n, mx, float(r["my"] or 0.0), cxx, cxy)


def solve_ridge(stats: LinearStats, l2: float = 2.0) -> tuple[np.ndarray, float]:
    """``(Cxx + l2 I) w = Cxy`` on centred columns; intercept from the means."""
    p = len(stats.features)
    w = np.linalg.solve(stats.cxx + l2 * np.eye(p), stats.cxy) if p else np.zeros(0)
    b = stats.mean_y - float(w @ stats.mean_x)
    return w, b


def fit_linear(df: DataFrame, features: Sequence[str], y: str = "target", l2: float = 2.0) -> DataFrame:
    """Ridge coefficients as a small table ``(term, coef)``."""
    stats = linear_stats(df, features, y)
    w, b = solve_ridge(stats, l2)
    rows = [("intercept", float(b))] + [(f, float(c)) for f, c in zip(stats.features, w)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double")


def predict_linear(df: DataFrame, coefs: dict[str, float], name: str = "prediction") -> DataFrame:
    expr = F.lit(coefs.get("intercept", 0.0))
    for f, c in coefs.items():
        if f != "intercept":
            expr = expr + F.col(f).cast("double") * F.lit(c)
    return df.withColumn(name, expr)


# ---------------------------------------------------------------- E2-E4: trees
def _model_pipeline(regressor, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES,
                    ignore=IGNORED_FEATURES) -> Pipeline:
    feats = feature_pipeline(list(numeric), list(categorical), list(ignore))
    return Pipeline(stages=[*feats.getStages(), regressor])


def fit_tree(df: DataFrame, y: str = "target", numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES,
             ignore=IGNORED_FEATURES, max_depth: int = 8, min_instances: int = 200) -> PipelineModel:
    """Bounded regression tree (depth and leaf size cap the model)."""
    reg = DecisionTreeRegressor(featuresCol="features", labelCol=y, predictionCol="prediction",
                                maxDepth=max_depth, minInstancesPerNode=min_instances, seed=42)
    return _model_pipeline(reg, numeric, categorical, ignore).fit(df.where(F.col(y).isNotNull()))


def fit_tree_since(df: DataFrame, idx: str, start: int, **kw) -> PipelineModel:
    """Tree refit on the rows after the last validated drift (``idx >= start``)."""
    return fit_tree(df.where(F.col(idx) >= start), **kw)


def fit_forest(df: DataFrame, y: str = "target", numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES,
               ignore=IGNORED_FEATURES, trees: int = 20, max_depth: int = 8, bootstrap: bool = True) -> PipelineModel:
    """Random forest, seed 42."""
    reg = RandomForestRegressor(featuresCol="features", labelCol=y, predictionCol="prediction",
                                numTrees=trees, maxDepth=max_depth, seed=42, bootstrap=bootstrap)
    return _model_pipeline(reg, numeric, categorical, ignore).fit(df.where(F.col(y).isNotNull()))


def update_leaves(model: PipelineModel, batch: DataFrame, y: str = "target") -> DataFrame:
    """E2 between refits: per-leaf label sums of a new batch (mergeable with
    earlier batches by addition); leaves come from the tree's leaf ids."""
    tree = model.stages[-1]
    tree.setLeafCol("leaf")
    scored = model.transform(batch.where(F.col(y).isNotNull()))
    return scored.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum_y"))


# ---------------------------------------------------------------- E5-E8
def global_mean_baseline(train: DataFrame, test: DataFrame, y: str = "target") -> DataFrame:
    """E5: predict the training mean; MAE on the test rows, R2 reported as 0."""
    mean = train.agg(F.avg(y)).first()[0] or 0.0
    lab = test.where(F.col(y).isNotNull())
    return lab.agg(F.avg(F.abs(F.col(y) - F.lit(mean))).alias("mae")).select(
        F.lit("global-mean").alias("setup"), "mae", F.lit(0.0).alias("r2"))


def memory_baseline(train: DataFrame, test: DataFrame, order: Sequence[str], y: str = "target",
                    k: float = 20.0) -> DataFrame:
    """Frozen long encoder of (pu, do) as the prediction; MAE and R2."""
    from tidemark.operators.encoders import apply_encoder, fit_encoder

    state = fit_encoder(train, order, y, encoders=[("pu_zone", "do_zone")], horizons={"long": 0.0})
    scored = apply_encoder(test, state, k, horizons={"long": 0.0})
    e = F.col(y) - F.col("te_pu_zone_do_zone_long")
    lab = scored.where(F.col(y).isNotNull())
    n = F.count(F.lit(1))
    return lab.agg(F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * n)).alias("r2")).select(
        F.lit("zone-pair memory").alias("setup"), "mae", "r2")


def score(model: PipelineModel, df: DataFrame, encoder_state: dict | None = None, k: float = 20.0) -> DataFrame:
    """Inference without learning (frozen encoders, then the model)."""
    from tidemark.operators.encoders import apply_encoder

    x = apply_encoder(df, encoder_state, k) if encoder_state else df
    return model.transform(x)


def score_trips(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Trip ETA output."""
    p = F.col(prediction)
    return scored.select(
        *[c for c in ("seq", "record_id") if c in scored.columns],
        F.round(p, 1).alias("eta_seconds"), F.round(p / 60.0, 1).alias("eta_minutes"),
        F.col("gc_distance_km").alias("distance_km"), "pu_borough", "do_borough",
        F.col("is_rush_hour").cast("boolean").alias("rush_hour"))


# ---------------------------------------------------------------- E9-E10: bundles
@dataclass
class Bundle:
    model: PipelineModel | None
    encoder_state: dict
    roles: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


def save_bundle(bundle: Bundle, path: str) -> None:
    """Spark ML model + encoder state tables (parquet) + roles/meta JSON."""
    spark = SparkSession.getActiveSession()
    if bundle.model is not None:
        bundle.model.write().overwrite().save(f"{path}/model")
    names = []
    for enc, tbl in bundle.encoder_state.items():
        name = "global" if enc == "global" else "te_" + "_".join(enc)
        tbl.write.mode("overwrite").parquet(f"{path}/state/{name}")
        names.append({"name": name, "keys": [] if enc == "global" else list(enc)})
    doc = {"roles": bundle.roles, "meta": bundle.meta, "state": names, "has_model": bundle.model is not None}
    spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    doc = json.loads(spark.read.text(f"{path}/bundle").first()[0])
    state = {}
    for s in doc["state"]:
        key = "global" if s["name"] == "global" else tuple(s["keys"])
        state[key] = spark.read.parquet(f"{path}/state/{s['name']}")
    model = PipelineModel.load(f"{path}/model") if doc["has_model"] else None  # a broken model raises
    return Bundle(model, state, doc.get("roles", {}), doc.get("meta", {}))


def maybe_warm_start(spark: SparkSession, path: str | None, source_name: str) -> Bundle | None:
    """The saved bundle if it exists and belongs to the same source; else
    None (cold start). A bundle that is there but broken raises."""
    if not path:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bundle")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    b = load_bundle(spark, path)
    return b if b.roles.get("name") == source_name else None


# ---------------------------------------------------------------- E1 continual
def continual_linear(df: DataFrame, features: Sequence[str], y: str, idx: str, batch_rows: int,
                     l2: float = 2.0, name: str = "prediction", start: LinearStats | None = None,
                     window_batches: int | None = None) -> DataFrame:
    """E1 kept current: rows of micro-batch ``b = idx div batch_rows`` are
    predicted by the ridge fit on ``start`` (statistics of a warm-up) and the
    labelled rows of the batches before ``b``: all of them, or the last
    ``window_batches``. Before any history the prediction is 0.

    Per-batch sufficient statistics (one matrix a batch, folded from arrays in
    the tasks that hold its rows) are summed along the batches inside range
    buckets, from what a matrix a bucket says came before; the small solves run
    in vectorized steps there, and the coefficients join back by batch id. With
    ``window_batches`` they are rolling sums. Values are shifted by the warm-up's means, or the
    first batch's, so nothing later than a row enters its prediction.
    """
    from tidemark.plans.ordering import materialize, rolling, sequence, with_global_index

    feats = list(features)
    p = len(feats)
    lab = F.col(y).isNotNull()
    b = F.floor(F.col(idx) / F.lit(batch_rows)).cast("long")
    if start is not None and start.n:
        mu = dict(zip([*feats, y], [*map(float, start.mean_x), start.mean_y]))
    else:
        begin = df.where(lab).agg(F.min(b)).first()[0]
        means = df.where(lab & (b == F.lit(begin))).agg(*[F.avg(c).alias(c) for c in feats], F.avg(y).alias(y)).first()
        mu = {c: float(means[c] or 0.0) for c in [*feats, y]}
        start = None
    shift = np.array([mu[c] for c in [*feats, y]])
    n0, cxx0, cxy0 = (float(start.n), start.cxx, start.cxy) if start is not None else (0.0, np.zeros((p, p)), np.zeros(p))
    width = p + 2

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of (1, x, y), a matrix a micro-batch; rows of a task are in few of them, which add up before they leave it."""
        held: dict[int, np.ndarray] = {}

        def leave() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([m.tobytes() for m in held.values()], pa.binary())], ["_b", "_m"])
            held.clear()
            return out

        for rows in batches:
            ids = rows.column(0).to_numpy()
            z = np.ones((rows.num_rows, width))
            for i in range(p + 1):
                c = rows.column(i + 1)
                v = c.to_numpy(zero_copy_only=False).astype(np.float64) - shift[i]
                z[:, i + 1] = np.where(c.is_null().to_numpy(zero_copy_only=False), 0.0, v) if c.null_count else v  # absent: adds nothing
            z[rows.column(p + 1).is_null().to_numpy(zero_copy_only=False)] = 0.0  # no label: only its micro-batch counts
            order = np.argsort(ids, kind="stable")
            ids, z = ids[order], z[order]
            at = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)])) if len(ids) else [0]
            for s, e in zip(at[:-1], at[1:], strict=True):
                k = int(ids[s])
                held[k] = held.get(k, 0.0) + z[s:e].T @ z[s:e]
                if len(held) > 512:
                    yield leave()
        if held:
            yield leave()

    numbers = df.where(b.isNotNull()).select(b.alias("_b"), *[F.when(lab, F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(feats)], F.col(y).cast("double").alias("y"))
    products = numbers.mapInArrow(fold, "_b long, _m binary")
    out_schema = "_b long, " + ", ".join(f"w{i} double" for i in range(p)) + ", w_b double"

    def solved(ids: list[int], m: np.ndarray) -> pa.RecordBatch:
        n = m[:, 0, 0] + n0
        safe = np.maximum(n, 1.0)
        mx, my = m[:, 0, 1:-1] / safe[:, None], m[:, 0, -1] / safe
        a = m[:, 1:-1, 1:-1] + cxx0 - safe[:, None, None] * mx[:, :, None] * mx[:, None, :] + l2 * np.eye(p)
        w = np.linalg.solve(a, (m[:, 1:-1, -1] + cxy0 - safe[:, None] * mx * my[:, None])[:, :, None])[:, :, 0]
        last = np.where(n > 0, my - (w * mx).sum(1), np.nan)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(w[:, i]) for i in range(p)], pa.array(last)], ["_b", *[f"w{i}" for i in range(p)], "w_b"])

    parts = sequence(materialize(products), ["_b"])  # the parts of a micro-batch are in one bucket

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(bucket, micro-batch, its matrix)`` in order."""
        now = None
        for rows in batches:
            for bucket, k, m in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                m = np.frombuffer(m).reshape(width, width)
                if now is not None and now[1] == k:
                    now = (bucket, k, now[2] + m)
                else:
                    if now is not None:
                        yield now
                    now = (bucket, k, m)
        if now is not None:
            yield now

    inside = parts.df.select(F.col("_bucket").cast("int").alias("_bucket"), "_b", "_m")
    if window_batches is None:
        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, size, m = None, 0, np.zeros((width, width))
            for bucket, _, own in whole(batches):
                size, m = size + 1, m + own
            if bucket is not None:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([size], pa.int64()), pa.array([m.tobytes()], pa.binary())], ["_bucket", "size", "_m"])

        before, at, size = {}, np.zeros((width, width)), 0
        for r in sorted(inside.mapInArrow(total, "_bucket int, size long, _m binary").collect(), key=lambda r: r["_bucket"]):  # a matrix a bucket
            before[r["_bucket"]], at, size = at, at + np.frombuffer(bytes(r["_m"])).reshape(width, width), size + r["size"]

        def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What came before each micro-batch, solved 256 at a time."""
            sofar, ids, known = None, [], []
            for bucket, k, own in whole(batches):
                sofar = before[bucket] if sofar is None else sofar
                ids.append(k)
                known.append(sofar)
                sofar = sofar + own
                if len(ids) == 256:
                    yield solved(ids, np.stack(known))
                    ids, known = [], []
            if ids:
                yield solved(ids, np.stack(known))

        coefs = materialize(inside.mapInArrow(along, out_schema))
        if size * (p + 2) * 8 <= COEFS_BYTES:
            coefs = F.broadcast(coefs)
    else:
        cells = [(i, j) for i in range(width) for j in range(i, width)]

        def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, k, m in whole(batches):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *[pa.array([m[c]]) for c in cells]], ["_b", *[f"m{i}_{j}" for i, j in cells]])

        names = [f"m{i}_{j}" for i, j in cells]
        seq = sequence(inside.mapInArrow(wide, "_b long, " + ", ".join(f"{c} double" for c in names)), ["_b"])
        dense = with_global_index(seq, "_i").df
        cum = rolling(dense, "_i", window_batches + 1, {f"_c_{c}": F.col(c) for c in names})
        cum = cum.select("_b", *[(F.col(f"_c_{c}") - F.col(c)).alias(c) for c in names])

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                m = np.zeros((rows.num_rows, width, width))
                for (i, j), c in zip(cells, rows.columns[1:], strict=True):
                    m[:, i, j] = m[:, j, i] = c.to_numpy(zero_copy_only=False)
                if rows.num_rows:
                    yield solved(rows.column(0).to_pylist(), m)

        coefs = cum.mapInArrow(solve, out_schema)
    pred = F.col("w_b")
    for i, c in enumerate(feats):
        pred = pred + F.col(f"w{i}") * (F.col(c).cast("double") - F.lit(mu[c]))
    res = df.withColumn("_b", b).join(coefs, "_b", "left")
    res = res.withColumn(name, F.when(F.col("w_b").isNull() | F.isnan("w_b"), F.lit(0.0)).otherwise(pred + F.lit(mu[y])))
    return res.drop("_b", "w_b", *[f"w{i}" for i in range(p)])


# ---------------------------------------------------------------- F9 / F10
def train_regime(df: DataFrame, features: Sequence[str], y: str, idx: str, total: int,
                 warm_frac: float = 0.4, holdout_frac: float = 0.2, batch_rows: int = 1000,
                 l2: float = 2.0, window_batches: int = 20) -> tuple[DataFrame, DataFrame]:
    """batch warm-up on the first ``warm_frac`` of rows, then continual
    micro-batch updates in stream order up to the holdout, then a frozen
    holdout. Returns ``(continual_predictions, holdout_predictions)``.

    The warm slice is one batch fit. The continual learner keeps it and the
    last ``window_batches`` micro-batches, so it follows the stream; the holdout
    is predicted by what it knows at its start. What was learned in the warm-up
    stays, what the window left behind is forgotten, so the split matters.
    """
    warm_end = int(total * warm_frac)
    hold_start = int(total * (1 - holdout_frac))
    i = F.col(idx)
    warm = linear_stats(df.where(i < warm_end), features, y)
    rows = df.where((i >= warm_end) & (i < hold_start)).withColumn("_ri", i - warm_end)
    cont = continual_linear(rows, features, y, "_ri", batch_rows, l2, start=warm, window_batches=window_batches).drop("_ri")
    batches = -(-max(hold_start - warm_end, 0) // batch_rows)
    kept_from = warm_end + max(batches - window_batches, 0) * batch_rows
    stats = warm.merge(linear_stats(df.where((i >= kept_from) & (i < hold_start)), features, y))
    w, b = solve_ridge(stats, l2)
    coefs = {"intercept": b, **{f: float(c) for f, c in zip(stats.features, w)}}
    hold = predict_linear(df.where(i >= hold_start), coefs)
    return cont, hold


def ablation(df: DataFrame, idx: str, total: int, order: Sequence[str], y: str = "target",
             base_features: Sequence[str] = ("pickup_hour", "passenger_count", "bearing_sin", "bearing_cos",
                                             "same_borough", "pu_airport", "do_airport"),
             route_feature: str = "gc_distance_km", split: float = 0.8) -> DataFrame:
    """setups scored on the same chronological holdout. ``vs_batch`` is each
    linear setup's R2 below the batch fit with the route feature: the continual
    cost of the continual rows, the route lift of the row without route."""
    from tidemark.operators.evaluation import holdout_metrics

    cut = int(total * split)
    i = F.col(idx)
    train, hold = df.where(i < cut), df.where(i >= cut)
    rows = [global_mean_baseline(train, hold, y), memory_baseline(train, hold, order, y)]

    def scored(name, pred_df):
        m = holdout_metrics(pred_df, y, "prediction")
        return m.select(F.lit(name).alias("setup"), "mae", "r2")

    feats = list(base_features)
    for name, fs in (("ridge, no route", feats), ("ridge +route", feats + [route_feature])):
        st = linear_stats(train, fs, y)
        w, b = solve_ridge(st, 2.0)
        rows.append(scored(name, predict_linear(hold, {"intercept": b, **dict(zip(fs, map(float, w)))})))
    tree = fit_tree(train, y, numeric=feats + [route_feature], categorical=("ratecode", "pu_borough", "do_borough"),
                    ignore=(), min_instances=50)
    rows.append(scored("tree batch (ceiling)", tree.transform(hold)))
    for name, warm in (("warm-up + continual", 0.4), ("continual only", 0.0)):
        _, hold_pred = train_regime(df, feats + [route_feature], y, idx, total, warm_frac=warm, holdout_frac=1 - split,
                                    batch_rows=200, window_batches=10)
        rows.append(scored(name, hold_pred))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    found = out.collect()  # one row per setup
    batch = next(r["r2"] for r in found if r["setup"] == "ridge +route")
    linear = ("ridge, no route", "warm-up + continual", "continual only")
    return df.sparkSession.createDataFrame(
        [(r["setup"], r["mae"], r["r2"], batch - r["r2"] if r["setup"] in linear else None) for r in found],
        "setup string, mae double, r2 double, vs_batch double")
