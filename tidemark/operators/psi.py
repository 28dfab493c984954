"""Population stability index (feature drift).

All features are unpivoted into ``(feature, value)`` once, so one aggregation
covers every column; absent (null) values are not part of a feature's
distribution. Numeric bin edges are exact order statistics of the reference,
found on a distributed sort whatever its size; values are binned against a
broadcast edge table (one row per feature).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.plans.ordering import materialize, sequence, with_global_index

ship_by_value(__name__)

# Fixed values of the reference configuration.
PSI_EPS = 1e-6
PSI_THRESHOLD = 0.2


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), as_string: bool = False) -> DataFrame:
    """``(keep..., feature, value)`` with one row per input row and present value."""
    cast = "string" if as_string else "double"
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("value")) for c in cols])
    return (df.select(*keep, F.explode(arr).alias("_fv")).select(*keep, "_fv.feature", "_fv.value")
            .where(F.col("value").isNotNull()))


def numeric_edges(ref_long: DataFrame, bins: int = 10) -> DataFrame:
    """``(feature, edges)``: value at sorted position ``min(int(q n), n - 1)``
    for ``q = 1/bins .. (bins-1)/bins``.

    The values are range-partitioned by ``(feature, value)``, a per-feature
    dense index comes from the two-level keyed running count (a frequent value
    or a dominant feature is split across buckets), and only the picked rows
    meet.
    """
    qs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    vals = ref_long.where(F.col("value").isNotNull())
    tagged = vals.select("feature", "value", F.monotonically_increasing_id().alias("_t"))
    seq = with_global_index(sequence(tagged, ["feature", "value", "_t"], materialize=False), "_pos", keys=["feature"])
    counts = seq.df.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
    want = counts.select("feature", "_n", F.posexplode(qs).alias("_qi", "_q")).select(
        "feature", "_qi", F.least(F.floor(F.col("_q") * F.col("_n")), F.col("_n") - 1).cast("long").alias("_pos"))
    picks = seq.df.join(F.broadcast(want), ["feature", "_pos"]).select("feature", "_qi", "value")  # bins - 1 rows a feature
    return picks.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_qi", "value"))), lambda s: s["value"]).alias("edges"))


def bin_numeric(long_df: DataFrame, edges: DataFrame) -> DataFrame:
    """Bin = number of edges strictly below the value (first edge >= value)."""
    j = long_df.join(F.broadcast(edges), "feature")
    return j.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")


def edge_values(edges: DataFrame) -> dict[str, list[float]]:
    """The edges of each feature, ``bins - 1`` numbers a feature."""
    return {r["feature"]: list(r["edges"]) for r in edges.collect()}


def bin_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], cols: Sequence[str], slot: str | None = None) -> DataFrame:
    """``([slot], feature, bin, _c)``: counts of ``bin_numeric`` of ``unpivot``, without a row for every value.

    Tasks bin a column of a batch at a time and count it by slot and bin; the counts are then added up.
    ``slot`` is a column of whole numbers. Features without edges give no rows."""
    cols = [c for c in cols if c in edges]
    of = {c: np.array(edges[c], np.float64) for c in cols}
    rows = df.select(F.col(slot).cast("long").alias("_slot") if slot else F.lit(0).cast("long").alias("_slot"),
                     *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, number = np.unique(b.column(0).to_numpy(), return_inverse=True)
            for i, c in enumerate(cols):
                there = b.column(i + 1).is_valid().to_numpy(zero_copy_only=False)
                # NaN is above every number, here as in Spark
                at = np.searchsorted(of[c], b.column(i + 1).to_numpy(zero_copy_only=False)[there], side="left")
                width = len(of[c]) + 1
                n = np.bincount(number[there] * width + at, minlength=0)
                cell = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(slots[cell // width], pa.int64()), pa.array([c] * len(cell), pa.string()),
                                                  pa.array(cell % width, pa.int32()), pa.array(n[cell], pa.int64())], ["_slot", "feature", "bin", "_c"])

    some = rows.mapInArrow(count, "_slot long, feature string, bin int, _c long")
    group = [F.col("_slot").alias(slot)] if slot else []
    return some.groupBy(*group, "feature", "bin").agg(F.sum("_c").alias("_c"))


def _psi_terms(r: F.Column, c: F.Column) -> F.Column:
    rr = F.greatest(r, F.lit(PSI_EPS))
    cc = F.greatest(c, F.lit(PSI_EPS))
    return (cc - rr) * F.log(cc / rr)


def _counts(binned: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    return binned.groupBy(*group, "feature", key).agg(F.count(F.lit(1)).alias("_c"))


def psi_from_counts(ref: DataFrame, cur: DataFrame, group: Sequence[str] = (), key: str = "bin") -> DataFrame:
    """PSI per ``(group..., feature)`` from counts ``_c`` per bin or category.

    The bins of either side count. A bin that the current side lacks adds a
    term of the reference alone, so all of them together are one number per
    feature, and no group has to list them: a group's sum starts from that
    number and corrects it for the bins it has. Features without current or
    reference rows get 0.
    """
    group = list(group)
    rd = ref.select("feature", key, (F.col("_c") / F.sum("_c").over(Window.partitionBy("feature"))).alias("_r"))
    alone = rd.groupBy("feature").agg(F.sum(_psi_terms(F.col("_r"), F.lit(0.0))).alias("_alone"))
    total = cur.groupBy(*group, "feature").agg(F.sum("_c").alias("_n"))
    share = cur.join(total, [*group, "feature"]).withColumn("_cur", F.col("_c") / F.col("_n"))
    j = share.join(rd, ["feature", key], "left")
    r = F.coalesce(F.col("_r"), F.lit(0.0))
    own = _psi_terms(r, F.col("_cur")) - F.when(F.col("_r").isNotNull(), _psi_terms(r, F.lit(0.0))).otherwise(F.lit(0.0))
    sums = j.groupBy(*group, "feature").agg(F.sum(own).alias("_own")).join(alone, "feature", "left")
    psi = F.when(F.col("_alone").isNotNull(), F.greatest(F.col("_own") + F.col("_alone"), F.lit(0.0))).otherwise(F.lit(0.0))
    out = sums.select(*group, "feature", psi.alias("psi"))
    if not group:  # features that only the reference has
        only = alone.join(out.select("feature"), "feature", "left_anti").select("feature", F.lit(0.0).alias("psi"))
        out = out.unionByName(only)
    return out


def psi_numeric(ref: DataFrame, cur: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """PSI of numeric features between a reference and a current sample."""
    rl = unpivot(ref, cols)
    edges = numeric_edges(rl, bins)
    return psi_from_counts(_counts(bin_numeric(rl, edges), [], "bin"), _counts(bin_numeric(unpivot(cur, cols), edges), [], "bin"))


def psi_categorical(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PSI of categorical features over the union of their categories."""
    rl = unpivot(ref, cols, as_string=True)
    cl = unpivot(cur, cols, as_string=True)
    return psi_from_counts(_counts(rl, [], "value"), _counts(cl, [], "value"), key="value")


def psi_over_time(df: DataFrame, idx: str, numeric: Sequence[str], categorical: Sequence[str],
                  reference_size: int = 5000, window: int = 2000, every: int = 1000,
                  total: int | None = None, bins: int = 10) -> DataFrame:
    """PSI at every check of the schedule.

    ``idx`` is the 0-based index of the rows the detector sees. Rows with
    ``idx < reference_size`` are the reference; a check happens at count
    ``c`` (1-based) when ``c % every == 0`` and ``c > reference_size``, over
    the rows with count in ``(max(reference_size, c - window), c]``. Rows are
    counted once per slot of ``gcd(window, every)`` rows; a check adds its slots.
    """
    cnt = F.col(idx) + 1
    ref = df.where(cnt <= reference_size)
    width = math.gcd(window, every)
    # slot s holds the counts s * width + 1 .. (s + 1) * width
    cur = df.where(cnt > reference_size).withColumn("_slot", F.floor((cnt - 1) / F.lit(width)).cast("long"))

    def checks(counts: DataFrame, key: str) -> DataFrame:
        end = (F.col("_slot") + 1) * F.lit(width)
        first = (F.ceil(end / F.lit(every)) * F.lit(every)).cast("long")
        at = F.sequence(first, (F.col("_slot") * F.lit(width) + F.lit(window)).cast("long"), F.lit(every).cast("long"))
        some = counts.where(first <= F.col("_slot") * F.lit(width) + F.lit(window)).withColumn("check", F.explode(at))
        if total is not None:
            some = some.where(F.col("check") <= total)
        return some.groupBy("check", "feature", key).agg(F.sum("_c").alias("_c"))

    parts = []
    if numeric:
        rl = unpivot(ref, numeric)
        edges = edge_values(numeric_edges(rl, bins))
        slots = materialize(bin_counts(cur, edges, numeric, "_slot"))  # rows are read once, counts twice
        parts.append(psi_from_counts(bin_counts(ref, edges, numeric), checks(slots, "bin"), ["check"]))
    if categorical:
        slots = materialize(_counts(unpivot(cur, categorical, ["_slot"], as_string=True), ["_slot"], "value"))
        parts.append(psi_from_counts(_counts(unpivot(ref, categorical, as_string=True), [], "value"), checks(slots, "value"),
                                     ["check"], key="value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def psi_flag(psi: DataFrame, threshold: float = PSI_THRESHOLD, group: Sequence[str] = ("check",)) -> DataFrame:
    """Per check, the worst feature, its PSI and the drift flag (any > threshold)."""
    return psi.groupBy(*group).agg(
        F.max("psi").alias("max_psi"), F.max_by("feature", "psi").alias("worst_feature"),
        (F.max("psi") > threshold).alias("feature_drift"))
