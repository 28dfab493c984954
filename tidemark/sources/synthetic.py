"""Drift-injected synthetic regression table.

``y = b + w.x + noise`` with ``x ~ N(0, 1)``; from row ``at_sample`` on the
weights become ``w * magnitude + U(-1, 1)`` and the bias grows by
``magnitude``. Random numbers are functions of ``(seed, row, column)``
(hash-derived uniforms, Box-Muller normals), so the table does not depend on
partitioning and the same seed gives the same table.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCH = "2020-01-01 00:00:00"


def _uniform(seed: int, stream: int, i: F.Column) -> F.Column:
    """A uniform in (0, 1) from a 64-bit hash of (seed, stream, i)."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), i)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _normal(seed: int, stream: int, i: F.Column) -> F.Column:
    u1 = _uniform(seed, 2 * stream, i)
    u2 = _uniform(seed, 2 * stream + 1, i)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def drift_table(spark: SparkSession, n: int, n_features: int = 6, seed: int = 42, noise_std: float = 0.5,
                at_sample: int = 5000, magnitude: float = 2.0, enabled: bool = True) -> DataFrame:
    rng = random.Random(seed)
    w = [rng.uniform(-2.0, 2.0) for _ in range(n_features)]
    b = rng.uniform(-1.0, 1.0)
    w2 = [x * magnitude + rng.uniform(-1, 1) for x in w]
    b2 = b + magnitude
    i = F.col("id")
    xs = [_normal(seed, k, i).alias(f"x{k}") for k in range(n_features)]
    base = spark.range(n).select(i.alias("i"), *xs, _normal(seed, 10_000, i).alias("_eps"))
    drifted = F.lit(bool(enabled)) & (F.col("i") >= at_sample)

    def lin(ws, bias):
        e = F.lit(bias)
        for k, wk in enumerate(ws):
            e = e + F.lit(wk) * F.col(f"x{k}")
        return e

    y = F.when(drifted, lin(w2, b2)).otherwise(lin(w, b)) + F.lit(noise_std) * F.col("_eps")
    return base.select(
        F.concat(F.lit("syn-"), F.col("i").cast("string")).alias("record_id"),
        (F.to_timestamp(F.lit(_EPOCH)) + F.make_interval(secs=F.col("i").cast("int"))).alias("ts"),
        "i", *[f"x{k}" for k in range(n_features)], y.alias("y"), drifted.alias("drifted"))
