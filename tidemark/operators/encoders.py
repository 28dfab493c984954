"""Leakage-free target encoders.

For a row, every encoder value uses only labels of earlier rows: the global
prior mean ``g`` (D3), the per-key cumulative mean (D4, horizon ``long``) and
per-key exponentially weighted means (D5, horizons ``med`` and ``short``),
shrunk toward ``g`` (D6).

The EWMA ``v_j = q v_{j-1} + a y_j`` (first label sets ``v``) is a fold of
affine maps; ``plans/folds.py`` runs it exactly over a key's whole history,
for all encoders and horizons in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import shrink
from tidemark.plans.folds import final_folds, prior_folds
from tidemark.plans.ordering import Sequenced, _null_safe_join, materialize, running_sums, sequence

# Fixed defaults of the reference configuration.
DEFAULT_ENCODERS = (("pu_zone", "do_zone"), ("do_zone",), ("pu_borough", "do_borough", "pickup_hour"))
DEFAULT_HORIZONS = {"long": 0.0, "med": 0.05, "short": 0.3}
DEFAULT_SMOOTHING = 20.0


def encoder_name(cols: Sequence[str], horizon: str) -> str:
    return "te_" + "_".join(cols) + "_" + horizon


def prior_global_mean(seq: Sequenced, y: str = "target", name: str = "g") -> Sequenced:
    """D3: mean of all earlier labels in stream order; 0.0 before the first."""
    s = running_sums(seq, {"_gs": F.col(y), "_gn": F.col(y).isNotNull().cast("long")}, inclusive=False)
    out = s.df.withColumn(name, F.when(F.col("_gn") > 0, F.col("_gs") / F.col("_gn")).otherwise(F.lit(0.0)))
    return seq.with_df(out.drop("_gs", "_gn"))


def keyed_prior(seq: Sequenced, keys: Sequence[str], y: str = "target", prefix: str = "k") -> Sequenced:
    """Per-key count and sum of earlier labels: ``{prefix}_n``, ``{prefix}_sum``."""
    s = running_sums(seq, {f"{prefix}_n": F.col(y).isNotNull().cast("long"), f"{prefix}_sum": F.col(y)},
                     inclusive=False, keys=keys)
    return s


def encode_long(seq: Sequenced, keys: Sequence[str], y: str = "target", prefix: str | None = None) -> Sequenced:
    """Cumulative mean of earlier labels of the same key (``{p}_long``,
    null when the key has none) and their count ``{p}_n``."""
    p = prefix or "te_" + "_".join(keys)
    s = keyed_prior(seq, keys, y, f"_{p}")
    n = F.col(f"_{p}_n")
    out = s.df.withColumn(f"{p}_n", n).withColumn(
        f"{p}_long", F.when(n > 0, F.col(f"_{p}_sum") / n)).drop(f"_{p}_n", f"_{p}_sum")
    return seq.with_df(out)


def encode_ewma(seq: Sequenced, keys: Sequence[str], y: str = "target",
                alphas: Mapping[str, float] | None = None, prefix: str | None = None) -> DataFrame:
    """``{p}_{horizon}`` prior EWMA per key for each horizon (null before
    the key's first label), plus ``{p}_n``."""
    alphas = dict(alphas or {h: a for h, a in DEFAULT_HORIZONS.items() if a > 0})
    p = prefix or "te_" + "_".join(keys)
    return prior_folds(seq, {p: list(keys)}, y, alphas).df.drop(f"{p}_sum")


def multi_encode(seq: Sequenced, y: str = "target",
                 encoders: Sequence[Sequence[str]] = DEFAULT_ENCODERS,
                 horizons: Mapping[str, float] | None = None,
                 k: float = DEFAULT_SMOOTHING, keep_raw: bool = False) -> DataFrame:
    """D6 + D7: every present encoder x horizon as ``te_<cols>_<horizon>``,
    shrunk toward the prior global mean ``g``. Encoders with a missing column
    are skipped. Horizon alpha 0 is the cumulative mean. Counts, sums and all
    EWMAs of all encoders come from one pass."""
    horizons = dict(DEFAULT_HORIZONS if horizons is None else horizons)
    present = [tuple(e) for e in encoders if all(c in seq.df.columns for c in e)]
    s = seq if "g" in seq.df.columns else prior_global_mean(seq, y, "g")
    raw = {"_rawte_" + "_".join(e): list(e) for e in present}
    df = prior_folds(s, raw, y, {h: a for h, a in horizons.items() if a > 0}).df if present else s.df
    outs, raw_cols = [], []
    for p, enc in raw.items():
        n = F.col(f"{p}_n")
        raw_cols += [f"{p}_n", f"{p}_sum"]
        for h, a in horizons.items():
            value = F.when(n > 0, F.col(f"{p}_sum") / n) if a <= 0 else F.col(f"{p}_{h}")
            raw_cols += [f"{p}_{h}"] if a > 0 else []
            outs.append(shrink(n, value, "g", k).alias(encoder_name(enc, h)))
    res = df.select("*", *outs)
    return res if keep_raw else res.drop(*raw_cols)


def fit_encoder(train: DataFrame, order: Sequence[str], y: str = "target",
                encoders: Sequence[Sequence[str]] = DEFAULT_ENCODERS,
                horizons: Mapping[str, float] | None = None) -> dict:
    """D8 (fit): encoder state after all training labels.

    Returns ``{"global": DataFrame(n, mean), encoder_tuple: DataFrame(keys...,
    n, <horizon>...)}``. Every key's whole history counts; a hot key is folded
    per range bucket first.
    """
    horizons = dict(DEFAULT_HORIZONS if horizons is None else horizons)
    lab = train.where(F.col(y).isNotNull())
    state: dict = {"global": lab.agg(F.count(y).alias("n"), F.coalesce(F.avg(y), F.lit(0.0)).alias("mean"))}
    present = [tuple(e) for e in encoders if all(c in train.columns for c in e)]
    ewmas = {h: a for h, a in horizons.items() if a > 0}
    if not ewmas:
        for enc in present:
            base = lab.groupBy(*enc).agg(F.count(y).alias("n"), F.avg(y).alias("_long"))
            state[enc] = materialize(base.select(*enc, "n", *[F.col("_long").alias(h) for h in horizons]))
        return state
    columns = list(dict.fromkeys([c for e in present for c in e] + [y, *order]))
    seq = sequence(lab.select(*columns), order, materialize=False)
    for p, tbl in final_folds(seq, {"_".join(e): list(e) for e in present}, y, ewmas).items():
        enc = next(e for e in present if "_".join(e) == p)
        values = [(F.col(h) if a > 0 else F.col("sum") / F.col("n")).alias(h) for h, a in horizons.items()]
        state[enc] = materialize(tbl.select(*enc, "n", *values))  # a fitted artifact: one row per key
    return state


def apply_encoder(df: DataFrame, state: dict, k: float = DEFAULT_SMOOTHING,
                  horizons: Mapping[str, float] | None = None) -> DataFrame:
    """D8 (apply): frozen encoder values, no update; unseen keys get ``g``.

    The state joins by key, null keys included; Spark picks the join by size.
    """
    horizons = dict(DEFAULT_HORIZONS if horizons is None else horizons)
    g = state["global"].first()["mean"]  # one aggregate value
    out = df.withColumn("_g_frozen", F.lit(float(g)))
    for enc, tbl in state.items():
        if enc == "global" or not all(c in df.columns for c in enc):
            continue
        p = "te_" + "_".join(enc)
        ren = tbl
        for h in list(horizons) + ["n"]:
            ren = ren.withColumnRenamed(h, f"_{p}_{h}")
        out = _null_safe_join(out, ren, list(enc))
        for h in horizons:
            out = out.withColumn(encoder_name(enc, h),
                                 shrink(F.coalesce(F.col(f"_{p}_n"), F.lit(0)), f"_{p}_{h}", "_g_frozen", k))
        out = out.drop(*[f"_{p}_{h}" for h in list(horizons) + ["n"]])
    return out.withColumnRenamed("_g_frozen", "g_frozen")
