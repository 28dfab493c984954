"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
RUSH_HOURS = (7, 8, 9, 16, 17, 18, 19)
CYCLICAL_PERIODS = {"pickup_hour": 24.0, "pickup_dayofweek": 7.0, "pickup_month": 12.0}
KM_PER_MILE = 1.60934
KM_PER_FOOT = 0.0003048
UNKNOWN_BOROUGH = "Unknown"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Round a computed double to 6 decimals (the precision results are compared at)."""
    return F.round(col(c).cast("double"), 6)


def cyclical(c: Column | str, period: float) -> tuple[Column, Column]:
    """``sin, cos(2 pi (x mod p) / p)``."""
    angle = F.lit(2.0 * math.pi) * F.pmod(col(c).cast("double"), F.lit(float(period))) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def shrink(n: Column | str, v: Column | str, g: Column | str, k: float) -> Column:
    """Shrink a per-key value toward the global mean: ``(n v + k g) / (n + k)``.

    A key without labels (``n = 0``) gets ``g``.
    """
    n, v, g = col(n).cast("double"), col(v), col(g)
    kk = F.lit(float(k))
    return F.when((n > 0) & (n + kk > 0), (n * v + kk * g) / (n + kk)).otherwise(g)


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in seconds with microsecond fractions kept."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)).cast("double") / F.lit(1e6)
