"""One packed Gram matrix for many linear fits.

Counts, means and co-moments of all columns are accumulated in one pass: every
task folds its rows, batch by batch, to one matrix, the tasks' matrices are
merged in ``FAN_IN`` tasks and those on the driver, so neither the number of
aggregate columns nor the driver's share grows with columns or data. The fit
on any subset of the features is then a sub-matrix of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.operators.models import LinearStats, solve_ridge

ship_by_value(__name__)

#: Tasks that merge the matrices of all tasks; the driver reads at most as many.
FAN_IN = 32
SCHEMA = "n double, mean binary, moments binary"


@dataclass
class Gram:
    """``n``, means and co-moments ``sum (x - mean)(x - mean)^T`` of ``columns``."""

    columns: tuple[str, ...]
    n: float
    mean: np.ndarray
    moments: np.ndarray

    def stats(self, features: Sequence[str], y: str) -> LinearStats:
        """The statistics of ``y`` on some of the columns."""
        at, t = [self.columns.index(c) for c in features], self.columns.index(y)
        return LinearStats(tuple(features), self.n, self.mean[at], float(self.mean[t]),
                           self.moments[np.ix_(at, at)], self.moments[at, t])


def _merge(parts: Iterable[tuple[float, np.ndarray, np.ndarray]], p: int) -> tuple[float, np.ndarray, np.ndarray]:
    n, mean, moments = 0.0, np.zeros(p), np.zeros((p, p))
    for m, mu, s in parts:
        if m:
            d = mu - mean
            moments += s + np.outer(d, d) * (n * m / (n + m))
            mean = mean + d * (m / (n + m))
            n += m
    return n, mean, moments


def _packed(n: float, mean: np.ndarray, moments: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([mean.tobytes()]), pa.array([moments.tobytes()])],
                                      ["n", "mean", "moments"])


def _unpacked(rows: Iterable[tuple], p: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    for n, mean, moments in rows:
        yield n, np.frombuffer(mean), np.frombuffer(moments).reshape(p, p)


def packed_gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    """The Gram matrix of ``columns`` over the rows where all of them are numbers.

    Rows with a null, NaN or infinite value in one of the columns are left out.
    No rows give ``n = 0`` and zeros. Other columns are not read.
    """
    columns = tuple(columns)
    p = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], axis=1)
                x = x[np.isfinite(x).all(axis=1)]
                if len(x):
                    mu = x.mean(axis=0)
                    yield float(len(x)), mu, (x - mu).T @ (x - mu)
        yield _packed(*_merge(parts(), p))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield _packed(*_merge(_unpacked(rows, p), p))

    numbers = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    merged = numbers.mapInArrow(fold, SCHEMA).where("n > 0").repartition(FAN_IN).mapInArrow(merge, SCHEMA)
    found = [(r["n"], bytes(r["mean"]), bytes(r["moments"])) for r in merged.where("n > 0").collect()]
    return Gram(columns, *_merge(_unpacked(found, p), p))


def ridge_subsets(train: DataFrame, hold: DataFrame, setups: Mapping[str, Sequence[str]], y: str = "target",
                  l2: float = 2.0) -> DataFrame:
    """ridge fits of all ``setups`` (name -> features) from one pass over
    ``train``, scored on ``hold`` in one pass: ``setup, n_features, mae, r2, n``.

    Training rows with an absent value in any feature of any setup are left out
    of all fits; rows of ``hold`` without a label count in none, and a row
    without a feature counts only in the setups that do not use it. A setup
    without features predicts the mean. No setups give no rows.
    """
    spark = train.sparkSession
    out = "setup string, n_features int, mae double, r2 double, n bigint"
    if not setups:
        return spark.createDataFrame([], out)
    features = list(dict.fromkeys(f for fs in setups.values() for f in fs))
    gram = packed_gram(train, [*features, y])
    scored = []
    for name, fs in setups.items():
        w, b = solve_ridge(gram.stats(fs, y), l2)
        prediction = F.lit(float(b))
        for f, c in zip(fs, w, strict=True):
            prediction = prediction + F.col(f).cast("double") * F.lit(float(c))
        scored.append(F.struct(F.lit(name).alias("setup"), F.lit(len(fs)).alias("n_features"), prediction.alias("prediction")))
    rows = (hold.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("y"), F.explode(F.array(*scored)).alias("s"))
            .select("y", "s.*").where("prediction IS NOT NULL"))
    e = F.col("y") - F.col("prediction")
    sst = F.var_pop("y") * F.count("*")
    return rows.groupBy("setup", "n_features").agg(
        F.avg(F.abs(e)).alias("mae"), (1.0 - F.sum(e * e) / F.when(sst == 0, F.lit(1.0)).otherwise(sst)).alias("r2"),
        F.count("*").alias("n"))
