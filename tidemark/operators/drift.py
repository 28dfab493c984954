"""Concept drift on an error stream: detectors and alarm validation.

* Validation of an alarm compares mean errors in windows before and after it.
  Window sums are differences of exact (decimal) prefix sums looked up by an
  equi-join on the dense index, so no range join and no precision loss however
  long the stream.
* Page-Hinkley and DDM first alarms are nested two-level running aggregates.
* Full detectors (ADWIN, Page-Hinkley with reset, DDM) are sequential by
  definition: a sorted per-series scan in ``mapInPandas`` with the detector
  state carried across Arrow batches; series run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ordering import BUCKET, Sequenced, _null_safe_join, bounded_broadcast, materialize, running_moments, running_sums, sequence

# Fixed defaults of the reference configuration.
ADWIN_DELTA = 0.002
VALIDATION_WINDOW = 1500
CENTRED_WINDOW = 2000
MIN_REL_SHIFT = 0.10
MIN_EFFECT = 0.20
RETRAIN_COOLDOWN = 20000
PH_DELTA, PH_THRESHOLD, PH_MIN_INSTANCES = 0.005, 50.0, 30
DDM_MIN_INSTANCES, DDM_WARNING, DDM_DRIFT = 30, 2.0, 3.0

_EXACT = T.DecimalType(38, 12)

from tidemark.functions.shipping import ship_by_value  # noqa: E402

ship_by_value(__name__)


def error_prefix(seq: Sequenced, err: str = "err", idx: str = "i") -> DataFrame:
    """``(idx, P, Q)``: exact running sums of ``err`` and ``err^2`` up to ``idx``."""
    e = F.col(err).cast(_EXACT)
    s = running_sums(seq, {"_P": e, "_Q": (e * e).cast(_EXACT)}, inclusive=True)
    return s.df.select(F.col(idx).alias("_pos"), "_P", "_Q")


def _lookup(events: DataFrame, prefix: DataFrame, offsets: dict[str, int], at: str) -> DataFrame:
    """Attach ``{name}_P, {name}_Q`` = prefix sums at ``at + offset``
    (0 before the start).

    The lookups (a few per event) are broadcast after a size check and
    inner-joined against the prefix table, so the big side only streams;
    positions before the start need no lookup.
    """
    pos = F.array(*[F.struct(F.lit(k).alias("_role"), (F.col(at) + F.lit(o)).alias("_pos")) for k, o in offsets.items()])
    ex = events.select(at, F.explode(pos).alias("_l")).select(at, "_l._role", "_l._pos")
    found = prefix.join(bounded_broadcast(ex.where(F.col("_pos") >= 0)), "_pos").select(at, "_role", "_P", "_Q")
    zero = F.lit(0).cast(_EXACT)
    before = ex.where(F.col("_pos") < 0).select(at, "_role", zero.alias("_P"), zero.alias("_Q"))
    j = found.unionByName(before)
    piv = j.groupBy(at).pivot("_role", list(offsets)).agg(F.first("_P").alias("P"), F.first("_Q").alias("Q"))
    return events.join(piv, at, "left")


def _window_stats(p_hi, p_lo, q_hi, q_lo, w: int):
    s = (F.col(p_hi) - F.col(p_lo)).cast("double")
    q = (F.col(q_hi) - F.col(q_lo)).cast("double")
    mean = s / F.lit(float(w))
    var = F.greatest(q / F.lit(float(w)) - mean * mean, F.lit(0.0))
    return mean, var


def block_alarms(seq: Sequenced, err: str = "err", idx: str = "i", block: int = 500, delta: float = ADWIN_DELTA) -> DataFrame:
    """G1 (distributed form): at the end of each block of ``block`` rows, the
    adaptive-window cut test of the block against the one before it.

    ``(idx, score, mean_before, mean_after)`` of the blocks whose means differ by
    more than ``sqrt(2 v ln(2 ln(n) / delta) / m) + 2 ln(2 ln(n) / delta) / (3 m)``
    with ``n`` rows, harmonic size ``m`` and variance ``v`` of both; ``score`` is the
    difference over that bound. Blocks are sums of rows, so a stream of any
    length is one aggregation and an equi-join of neighbouring blocks.
    """
    per = seq.df.where(F.col(err).isNotNull()).groupBy(F.floor(F.col(idx) / F.lit(block)).cast("long").alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err).alias("m"), F.var_pop(err).alias("v")).where(F.col("n") == block)
    before = per.select((F.col("_b") + 1).alias("_b"), F.col("m").alias("m0"), F.col("v").alias("v0"))
    j = per.join(before, "_b")
    gap = F.abs(F.col("m") - F.col("m0"))
    var = (F.col("v") + F.col("v0")) / 2 + gap * gap / 4  # of both blocks together
    dd, m = math.log(2.0 * math.log(2.0 * block) / delta), block / 2.0
    bound = F.sqrt(F.lit(2.0 / m * dd) * var) + F.lit(2.0 / (3.0 * m) * dd)
    return j.where(gap > bound).select(((F.col("_b") + 1) * F.lit(block) - 1).alias(idx), (gap / bound).alias("score"),
                                       F.col("m0").alias("mean_before"), F.col("m").alias("mean_after"))


def alarm_chain(seq: Sequenced, alarms: DataFrame, err: str = "err", idx: str = "i", w: int = VALIDATION_WINDOW,
                cooldown: int = RETRAIN_COOLDOWN, detector: str = "block-cut") -> DataFrame:
    """G4 -> G12 -> G13: alarms with their validation and what came of them.

    Columns of the drift log: ``type, i, detector, score, validated, direction,
    rel_shift, effect, action``; ``action`` is ``retrain`` for alerts past the
    cooldown, ``log`` for other validated ones and ``ignore`` for spurious ones.
    """
    checked = validate_trailing(seq, alarms, err, idx, w)
    alerts = retrain_alerts(checked, idx, cooldown).select(F.col(idx).alias("_alert"))
    j = checked.join(alarms.select(F.col(idx).alias("_at"), "score"), F.col(idx) == F.col("_at")).join(
        alerts, F.col(idx) == F.col("_alert"), "left")
    action = F.when(F.col("_alert").isNotNull(), "retrain").when(F.col("validated"), "log").otherwise("ignore")
    return j.select(F.lit("concept").alias("type"), idx, F.lit(detector).alias("detector"), "score", "validated", "direction",
                    "rel_shift", "effect", action.alias("action"))


def retrain_flag(chain: DataFrame, promoted_at: int | None = None, idx: str = "i") -> DataFrame:
    """One row: ``alerts``, ``last_alert`` and ``retrain_recommended``, which a
    promotion at ``promoted_at`` clears until the next alert."""
    fired = F.col("action") == "retrain"
    since = F.lit(-1 if promoted_at is None else promoted_at)
    return chain.agg(F.count_if(fired).alias("alerts"), F.max(F.when(fired, F.col(idx))).alias("last_alert")).select(
        "*", F.coalesce(F.col("last_alert") > since, F.lit(False)).alias("retrain_recommended"))


def validate_trailing(seq: Sequenced, events: DataFrame, err: str = "err", idx: str = "i",
                      w: int = VALIDATION_WINDOW, min_rel: float = MIN_REL_SHIFT,
                      min_effect: float = MIN_EFFECT) -> DataFrame:
    """An alarm at ``i`` compares errors ``[i-2w+1, i-w]`` with ``[i-w+1, i]``.

    Fewer than ``2w`` errors: not valid, ``rel`` 0, direction ``insufficient``.
    """
    prefix = error_prefix(seq, err, idx)
    ev = events.select(F.col(idx).alias("_at")).distinct()
    j = _lookup(ev, prefix, {"hi": 0, "mid": -w, "lo": -2 * w}, "_at")
    mb, vb = _window_stats("mid_P", "lo_P", "mid_Q", "lo_Q", w)
    ma, va = _window_stats("hi_P", "mid_P", "hi_Q", "mid_Q", w)
    enough = (F.col("_at") + 1) >= 2 * w
    pooled = F.sqrt((vb + va) / 2) + F.lit(1e-9)
    rel = F.when(mb > 1e-9, (ma - mb) / mb).otherwise(F.lit(0.0))
    effect = F.abs(ma - mb) / pooled
    valid = enough & (F.abs(rel) >= min_rel) & (effect >= min_effect)
    return j.select(
        F.col("_at").alias(idx),
        F.when(enough, mb).alias("mean_before"), F.when(enough, ma).alias("mean_after"),
        F.when(enough, rel).otherwise(F.lit(0.0)).alias("rel_shift"),
        F.when(enough, effect).alias("effect"),
        F.coalesce(valid, F.lit(False)).alias("validated"),
        F.when(~enough, F.lit("insufficient")).when(ma > mb, F.lit("worse")).otherwise(F.lit("better")).alias("direction"))


def validate_centred(seq: Sequenced, events: DataFrame, total: int, err: str = "err", idx: str = "i",
                     w: int = CENTRED_WINDOW, min_rel: float = MIN_REL_SHIFT, min_effect: float = MIN_EFFECT) -> DataFrame:
    """G5 (per event): before ``[i-W, i)``, after ``[i, i+W)``; strict thresholds;
    events without both full windows are left out."""
    prefix = error_prefix(seq, err, idx)
    ev = events.select(F.col(idx).alias("_at")).distinct().where(
        (F.col("_at") - w >= 0) & (F.col("_at") + w <= total))
    j = _lookup(ev, prefix, {"hi": w - 1, "mid": -1, "lo": -w - 1}, "_at")
    mb, vb = _window_stats("mid_P", "lo_P", "mid_Q", "lo_Q", w)
    ma, va = _window_stats("hi_P", "mid_P", "hi_Q", "mid_Q", w)
    pooled = F.sqrt((vb + va) / 2) + F.lit(1e-9)
    d = (ma - mb) / pooled
    rel = F.when(mb != 0, (ma - mb) / mb)
    valid = (F.abs(d) > min_effect) & (F.abs(rel) > min_rel)
    return j.select(F.col("_at").alias(idx), mb.alias("mean_before"), ma.alias("mean_after"),
                    rel.alias("rel_shift"), d.alias("cohens_d"), F.coalesce(valid, F.lit(False)).alias("validated"),
                    (ma > mb).alias("worse"))


def centred_summary(per_event: DataFrame) -> DataFrame:
    """G5 (summary): checked, valid, spurious, percentages, degradations,
    improvements and the median absolute relative shift."""
    n = F.count(F.lit(1))
    valid = F.sum(F.col("validated").cast("long"))
    return per_event.agg(
        n.alias("checked"), valid.alias("valid"), (n - valid).alias("spurious"),
        (valid * 100.0 / F.greatest(n, F.lit(1))).alias("pct_valid"),
        F.sum((F.col("validated") & F.col("worse")).cast("long")).alias("degradations"),
        F.sum((F.col("validated") & ~F.col("worse")).cast("long")).alias("improvements"),
        F.percentile(F.abs(F.col("rel_shift")), 0.5).alias("median_abs_rel"))


def outlier_autocorr(seq: Sequenced, err: str = "err", idx: str = "i", q: float = 0.99, lag: int = 1) -> DataFrame:
    """Lag autocorrelation of the indicator ``err > p99`` (exact percentile)."""
    from tidemark.operators.evaluation import autocorr

    from tidemark.plans.ordering import exact_quantiles

    thr = exact_quantiles(seq.df, err, [q])[0]
    ind = seq.with_df(seq.df.withColumn("_big", (F.col(err) > F.lit(thr)).cast("double")))
    out = autocorr(ind, "_big", [lag], idx=idx)
    return out.withColumn("threshold", F.lit(float(thr)))


def retrain_alerts(events: DataFrame, idx: str = "i", cooldown: int = RETRAIN_COOLDOWN,
                   series: Sequence[str] = ()) -> DataFrame:
    """Validated degradations raise an alert when at least ``cooldown``
    rows passed since the previous alert (greedy, in index order).

    Every degradation knows the one that would follow it as an alert, the
    first at least ``cooldown`` rows later (a running maximum over events and
    probes in falling order). The alerts are the ones that a series' first
    degradation reaches over such steps: steps are doubled round by round, so
    the rounds grow with the logarithm of the alerts and no list of events
    comes together.
    """
    keys = list(series)
    pos = F.col(idx).cast("long")
    worse = materialize(events.where(F.col("validated") & (F.col("direction") == "worse")).select(*keys, pos.alias("_p")).distinct())
    probes = worse.select(*keys, (-(F.col("_p") + cooldown)).alias("_neg"), F.lit(1).alias("_kind"), "_p")
    both = worse.select(*keys, (-F.col("_p")).alias("_neg"), F.lit(0).alias("_kind"), "_p").unionByName(probes)
    seq = sequence(both, [*keys, "_neg", "_kind", "_p"], materialize=False)
    seen = running_extreme(seq, F.when(F.col("_kind") == 0, F.struct(*keys, "_neg")), "_ev", largest=True).df.where("_kind = 1")
    same = F.col("_ev").isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_ev.{k}"))
    step = materialize(seen.where(same).select(*keys, F.col("_p").alias("_from"), (-F.col("_ev._neg")).alias("_to")))
    first = materialize(worse.groupBy(*keys).agg(F.min("_p").alias("_p")).where("_p IS NOT NULL"))
    return reach(first, step, keys).select(*keys, F.col("_p").alias(idx))


def reach(reached: DataFrame, step: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All positions ``_p`` that those of ``reached`` lead to over ``step(keys..., _from, _to)``
    (one step a position), themselves included. Steps double round by round."""
    known, before = reached.count(), -1
    while known != before:
        reached = materialize(reached.unionByName(_follow(reached, step, keys).select(*keys, F.col("_to").alias("_p"))).distinct())
        further = step.select(*keys, F.col("_from").alias("_start"), F.col("_to").alias("_p"))
        step = materialize(_follow(further, step, keys, ["_start"]).select(*keys, F.col("_start").alias("_from"), "_to"))
        known, before = reached.count(), known
    return reached


def _follow(at: DataFrame, step: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Where ``step`` leads from the positions ``_p`` of ``at``."""
    to = step.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_from", "_to")
    cond = at["_p"] == to["_from"]
    for k in keys:
        cond = cond & at[k].eqNullSafe(to[f"_s_{k}"])
    return at.join(to, cond).select(*keys, *keep, "_to")


def drift_log(events: DataFrame, at: str = "i", keep: int = 50) -> tuple[DataFrame, DataFrame]:
    """The newest ``keep`` events and the counts by kind.

    ``events`` has ``type`` ('concept'/'feature'), ``validated`` and ``at``.
    """
    recent = events.orderBy(F.col(at).desc(), F.col("type")).limit(keep)
    counts = events.agg(
        F.sum(((F.col("type") == "concept") & F.col("validated")).cast("long")).alias("concept_events"),
        F.sum(((F.col("type") == "concept") & ~F.col("validated")).cast("long")).alias("spurious_events"),
        F.sum((F.col("type") == "feature").cast("long")).alias("feature_events"))
    return recent, counts


# ---------------------------------------------------------------- first alarms by windows
def running_extreme(seq: Sequenced, expr: F.Column, name: str, largest: bool = False, keys: Sequence[str] = ()) -> Sequenced:
    """Two-level running minimum, or maximum, (inclusive) over the global order, per key with ``keys``; nulls skip."""
    pick, of_two = (F.max, F.greatest) if largest else (F.min, F.least)
    w = seq.window(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = materialize(seq.df.withColumn("_x", expr).withColumn("_lm", pick("_x").over(w)))
    summ = local.groupBy(*keys, BUCKET).agg(pick("_x").alias("_bm"))
    prior = Window.partitionBy(*keys).orderBy(BUCKET) if keys else Window.orderBy(BUCKET)
    offs = summ.select(*keys, BUCKET, pick("_bm").over(prior.rowsBetween(Window.unboundedPreceding, -1)).alias("_om"))
    j = _null_safe_join(local, offs, [*keys, BUCKET], hint_broadcast=not keys)  # without keys one row a bucket
    return seq.with_df(j.withColumn(name, of_two("_lm", "_om")).drop("_x", "_lm", "_om"))


def running_min(seq: Sequenced, expr: F.Column, name: str) -> Sequenced:
    return running_extreme(seq, expr, name)


def page_hinkley_first(seq: Sequenced, err: str = "err", idx: str = "i", delta: float = PH_DELTA,
                       threshold: float = PH_THRESHOLD, min_instances: int = PH_MIN_INSTANCES) -> DataFrame:
    """G2 (first alarm): ``m_t = sum_{i<=t} (x_i - mean_i - delta)``; alarm at
    the first ``t`` (1-based count >= min_instances) with ``m_t - min m > threshold``."""
    m = running_moments(seq, err, "_ph", inclusive=True)
    d = m.with_df(m.df.withColumn("_d", F.col(err) - F.col("_ph_mean") - F.lit(delta)))
    s = running_sums(d, {"_m": F.col("_d")}, inclusive=True)
    mn = running_min(s, F.col("_m"), "_mmin")
    hit = mn.df.where((F.col(idx) + 1 >= min_instances) & (F.col("_m") - F.col("_mmin") > threshold))
    return hit.agg(F.min(idx).alias("first_alarm"))


def ddm_first(seq: Sequenced, is_error: F.Column, idx: str = "i", min_instances: int = DDM_MIN_INSTANCES,
              drift_level: float = DDM_DRIFT) -> DataFrame:
    """G3 (first alarm) on an explicit 0/1 error: ``p_i`` running error rate,
    ``s_i = sqrt(p (1 - p) / i)``; ``(p_min, s_min)`` at the latest minimum of
    ``p + s`` from ``min_instances`` on; drift when ``p + s > p_min + 3 s_min``."""
    s = running_sums(seq, {"_e": is_error.cast("long"), "_i": F.lit(1).cast("long")}, inclusive=True)
    p = F.col("_e") / F.col("_i")
    df = s.df.withColumn("_p", p).withColumn("_s", F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("_i")))
    elig = F.col("_i") >= min_instances
    key = F.when(elig, F.struct((F.col("_p") + F.col("_s")).alias("ps"), (-F.col(idx)).alias("ni"),
                                F.col("_p").alias("p"), F.col("_s").alias("s")))
    mn = running_min(s.with_df(df), key, "_min")
    hit = mn.df.where(elig & (F.col("_p") + F.col("_s") > F.col("_min.p") + drift_level * F.col("_min.s")))
    return hit.agg(F.min(idx).alias("first_alarm"))


# ---------------------------------------------------------------- sequential detectors
class Adwin:
    """ADWIN2 (Bifet & Gavalda 2007) on an exponential histogram of buckets
    ``(count, total, M2)``; at most ``max_buckets`` per level; cut checks every
    ``clock`` inserts."""

    def __init__(self, delta: float = ADWIN_DELTA, max_buckets: int = 5, clock: int = 32, min_len: int = 5):
        self.delta, self.max_buckets, self.clock, self.min_len = delta, max_buckets, clock, min_len
        self.rows: list[list[tuple[float, float]]] = []  # level -> [(total, m2)], newest last
        self.width = 0
        self.total = 0.0
        self.m2 = 0.0
        self.t = 0

    def _insert(self, x: float) -> None:
        if self.width > 0:
            mean = self.total / self.width
            self.m2 += self.width * (x - mean) ** 2 / (self.width + 1)
        self.width += 1
        self.total += x
        if not self.rows:
            self.rows.append([])
        self.rows[0].append((x, 0.0))
        level = 0
        while level < len(self.rows) and len(self.rows[level]) > self.max_buckets:
            (t1, v1), (t2, v2) = self.rows[level][0], self.rows[level][1]
            n = 2 ** level
            merged = (t1 + t2, v1 + v2 + n * n / (2 * n) * (t1 / n - t2 / n) ** 2)
            del self.rows[level][:2]
            if level + 1 == len(self.rows):
                self.rows.append([])
            self.rows[level + 1].append(merged)
            level += 1

    def _drop_oldest(self) -> None:
        for level in range(len(self.rows) - 1, -1, -1):
            if self.rows[level]:
                t, v = self.rows[level].pop(0)
                n = 2 ** level
                if self.width > n:
                    mean_rest = (self.total - t) / (self.width - n)
                    self.m2 -= v + n * (self.width - n) / self.width * (t / n - mean_rest) ** 2
                else:
                    self.m2 = 0.0
                self.width -= n
                self.total -= t
                self.m2 = max(self.m2, 0.0)
                while self.rows and not self.rows[-1]:
                    self.rows.pop()
                return

    def update(self, x: float) -> bool:
        self._insert(float(x))
        self.t += 1
        if self.t % self.clock != 0 or self.width < 2 * self.min_len:
            return False
        changed = False
        cut = True
        while cut and self.width >= 2 * self.min_len:
            cut = False
            var = self.m2 / self.width
            dd = math.log(2.0 * math.log(self.width) / self.delta)
            n0, s0 = 0, 0.0
            buckets = [(2 ** lv, t) for lv in range(len(self.rows) - 1, -1, -1) for (t, _) in self.rows[lv]]
            for n, t in buckets[:-1]:
                n0 += n
                s0 += t
                n1 = self.width - n0
                if n0 < self.min_len or n1 < self.min_len:
                    continue
                m = 1.0 / (1.0 / n0 + 1.0 / n1)
                eps = math.sqrt(2.0 / m * var * dd) + 2.0 / (3.0 * m) * dd
                if abs(s0 / n0 - (self.total - s0) / n1) > eps:
                    self._drop_oldest()
                    changed = cut = True
                    break
        return changed


class PageHinkley:
    """Page-Hinkley test for an increase of the mean, reset after an alarm."""

    def __init__(self, delta=PH_DELTA, threshold=PH_THRESHOLD, min_instances=PH_MIN_INSTANCES):
        self.delta, self.threshold, self.min_instances = delta, threshold, min_instances
        self.reset()

    def reset(self):
        self.n, self.mean, self.sum, self.min = 0, 0.0, 0.0, float("inf")

    def update(self, x: float) -> bool:
        self.n += 1
        self.mean += (x - self.mean) / self.n
        self.sum += x - self.mean - self.delta
        self.min = min(self.min, self.sum)
        if self.n >= self.min_instances and self.sum - self.min > self.threshold:
            self.reset()
            return True
        return False


class Ddm:
    """Drift detection method on a 0/1 error, reset after a drift."""

    def __init__(self, min_instances=DDM_MIN_INSTANCES, drift_level=DDM_DRIFT):
        self.min_instances, self.drift_level = min_instances, drift_level
        self.reset()

    def reset(self):
        self.n, self.p, self.ps_min, self.p_min, self.s_min = 0, 0.0, float("inf"), float("inf"), float("inf")

    def update(self, e: float) -> bool:
        self.n += 1
        self.p += (float(e) - self.p) / self.n
        s = math.sqrt(self.p * (1 - self.p) / self.n)
        if self.n < self.min_instances:
            return False
        if self.p + s <= self.ps_min:
            self.p_min, self.s_min, self.ps_min = self.p, s, self.p + s
        if self.p + s > self.p_min + self.drift_level * self.s_min:
            self.reset()
            return True
        return False


DETECTORS = {"adwin": Adwin, "page_hinkley": PageHinkley, "ddm": Ddm}


def detect(df: DataFrame, value: str, order: Sequence[str], series: Sequence[str] = (),
           detector: str = "adwin", **params) -> DataFrame:
    """Run a sequential detector per series; returns alarm rows
    ``(series..., order..., value)``.

    Rows are hash-partitioned by series and sorted inside partitions; the scan
    keeps one detector per series and carries it across Arrow batches, so
    memory is bounded by the batch and the detector, not by the series length.
    Without series, the one scan reads packed values only (``_detect_one``).
    """
    series = list(series)
    if not series:
        return _detect_one(df, value, order, detector, **params)
    cols = [*series, *order, value]
    src = df.select(*cols).where(F.col(value).isNotNull())
    src = src.repartition(*series).sortWithinPartitions(*series, *order)
    schema = src.schema
    make = DETECTORS[detector]

    def scan(batches):
        state = {}
        for pdf in batches:
            keys = list(zip(*[pdf[c] for c in series]))
            vals = pdf[value].to_numpy()
            hits = []
            for pos, (k, v) in enumerate(zip(keys, vals)):
                d = state.get(k)
                if d is None:
                    d = state[k] = make(**params)
                if d.update(v):
                    hits.append(pos)
            if hits:
                yield pdf.iloc[hits]

    return src.mapInPandas(scan, schema)


def _detect_one(df: DataFrame, value: str, order: Sequence[str], detector: str, **params) -> DataFrame:
    """One series is one ordered scan. The rows are sorted in many tasks, which pack
    the values alone, eight bytes a row; the one task of the scan reads these and
    gives the places of alarms, whose rows are looked up in the sorted ones."""
    src = df.select(*order, value).where(F.col(value).isNotNull())
    seq = sequence(src, order)
    numbered = seq.df.withColumn("_at", F.row_number().over(seq.window()).cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = np.asarray(b.column(2).to_numpy(zero_copy_only=False), np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), b.column(1).slice(0, 1), pa.array([values.tobytes()], pa.binary())],
                                                 [BUCKET, "_at", "_values"])

    make = DETECTORS[detector]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = make(**params)
        for b in batches:
            for bucket, at, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hits = [at + k for k, v in enumerate(np.frombuffer(values).tolist()) if d.update(v)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(hits), pa.int32()), pa.array(hits, pa.int64())], ["_in", "_hit"])

    packed = numbered.select(BUCKET, "_at", value).mapInArrow(pack, f"{BUCKET} int, _at long, _values binary")
    hits = packed.repartition(1).sortWithinPartitions(BUCKET, "_at").mapInArrow(scan, "_in int, _hit long")
    found = materialize(hits)  # the scan runs once
    return numbered.join(found, (F.col(BUCKET) == F.col("_in")) & (F.col("_at") == F.col("_hit")), "left_semi").select(*order, value)


def shuffle_control(df: DataFrame, value: str, id_col: str, seed: int = 0, detector: str = "adwin",
                    **params) -> DataFrame:
    """The same values in a seeded pseudo-random order; alarms are false positives."""
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    shuffled = df.select(id_col, value).withColumn("_shuffle_key", key)
    return detect(shuffled, value, ["_shuffle_key", id_col], detector=detector, **params)
