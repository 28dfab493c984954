"""Every alarm of detectors that start anew after an alarm, without a scan of the stream.

Page-Hinkley and DDM forget everything at an alarm, so where the next one comes
depends on where the last one was. The stream is cut into blocks of a dense
index, packed into one row each. Every block is first scanned as if the detector
started at its first row; this gives its alarms and the state it leaves. Then,
round by round, blocks whose entry differs from what the block before now
leaves are scanned again. As soon as a scan alarms at a row where the scan before
it did too, both go on alike and the rest is taken over. When no entry differs,
all alarms are those of one scan from the first row.

In each series the first block with a wrong entry, the front, is scanned in
every round, the other ones in rounds 1, 2, 4, 8, ... only, so all scans together
read the stream at most about ``log2(rounds) + 2`` times. Where the block before the front had no
alarm, the detector's start is known and only its sums are not: the next
``ahead`` blocks are summed up at once for that start, and the summaries, a few
numbers a block, say up to which of them no alarm can come. So a long quiet stretch takes
``1 / ahead`` of its blocks in rounds. Scans from different states come to a shared
alarm after some five to ten; with that many a block, one to three rounds
are enough. The slow case is a few alarms a block: then there are up to as many
rounds as blocks, and the work is still bounded as above. Take longer blocks for it.

All states are whole numbers (errors in millionths), so that sums do not
depend on the cut into blocks, nor on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.operators.drift import DDM_DRIFT, DDM_MIN_INSTANCES, PH_DELTA, PH_MIN_INSTANCES, PH_THRESHOLD
from tidemark.plans.ordering import bounded_broadcast, materialize
from tidemark.session import remove_paths, scratch_path

ship_by_value(__name__)

UNIT = 1_000_000  # errors are taken in millionths
FAR = 1 << 62
LARGEST = 9e12  # of an error, and of their sum since the start
BLOCK_ROWS = 16_384
AHEAD_BLOCKS = 256
FIRST_CHUNK, LAST_CHUNK = 256, 65_536  # rows looked at together; doubles while no alarm comes


@dataclass(frozen=True)
class PageHinkleyUnits:
    """State ``(rows, total, sum, least sum)`` since the start.

    ``sum`` adds up each error less the mean so far and ``delta``; an alarm comes when
    it is more than ``threshold`` above its least value, from row ``min_instances`` on.
    """

    delta: float = PH_DELTA
    threshold: float = PH_THRESHOLD
    min_instances: int = PH_MIN_INSTANCES
    fresh = (0, 0, 0, FAR)

    def _steps(self, n0: int, t0: int, x: np.ndarray):
        n = n0 + np.arange(1, len(x) + 1, dtype=np.int64)
        total = t0 + np.cumsum(x)
        step = np.floor(x - total / n - self.delta * UNIT + 0.5).astype(np.int64)
        return n, total, np.cumsum(step)

    def advance(self, state, x):
        """The states after each row, were there no alarm, and where alarms come."""
        n, total, added = self._steps(state[0], state[1], x)
        m = state[2] + added
        low = np.minimum(np.minimum.accumulate(m), state[3])
        return (n, total, m, low), (n >= self.min_instances) & (m - low > self.threshold * UNIT)

    def summary(self, n0, t0, x):
        """What a block does to any state of ``n0`` rows and total ``t0``: change, least and largest of
        the sum, and its largest rise within the block."""
        if len(x) == 0:
            return (0, 0, 0, FAR, -FAR, 0)
        n, total, added = self._steps(n0, t0, x)
        rise = added - np.minimum.accumulate(added)
        return (len(x), int(total[-1]) - t0, int(added[-1]), int(added.min()), int(added.max()), int(rise.max()))

    def compose(self, state, s):
        """The state after a block, and whether an alarm may come inside."""
        n, total, m, low = state
        rows, sum_x, change, least, largest, rise = s
        may = max(m + largest - low, rise) > self.threshold * UNIT
        return (n + rows, total + sum_x, m + change, min(low, m + least)), may


@dataclass(frozen=True)
class DdmUnits:
    """State ``(rows, errors, rows at the minimum, errors at the minimum)`` since the start.

    With error rate ``p`` and ``s = sqrt(p (1 - p) / rows)``, the minimum is the latest least ``p + s``
    from row ``min_instances`` on; an alarm comes when ``p + s`` is above its ``p + level s``.
    """

    min_instances: int = DDM_MIN_INSTANCES
    level: float = DDM_DRIFT
    fresh = (0, 0, 0, 0)

    @staticmethod
    def _rate(n, e):
        p = np.asarray(e, np.float64) / n
        return p, np.sqrt(p * (1 - p) / n)

    def _edge(self, kn, ke):
        """``p + s`` of a minimum and the level above which alarms come."""
        if kn == 0:
            return np.inf, np.inf
        p, s = self._rate(kn, ke)
        return float(p + s), float(p + self.level * s)

    def _rates(self, n0, e0, x):
        n = n0 + np.arange(1, len(x) + 1, dtype=np.int64)
        e = e0 + np.cumsum(x)
        p, s = self._rate(n, e)
        return n, e, p, s, np.where(n >= self.min_instances, p + s, np.inf)

    def advance(self, state, x):
        n, e, p, s, ps = self._rates(state[0], state[1], x)
        before, edge = self._edge(state[2], state[3])
        least = np.minimum(np.minimum.accumulate(ps), before)
        at = np.maximum.accumulate(np.where((ps == least) & np.isfinite(ps), np.arange(len(x)), -1))
        inside, k = at >= 0, np.maximum(at, 0)
        edges = np.where(inside, p[k] + self.level * s[k], edge)
        after = (n, e, np.where(inside, n[k], state[2]), np.where(inside, e[k], state[3]))
        return after, np.isfinite(ps) & (ps > edges)

    def summary(self, n0, t0, x):
        """Rows, errors, the block's own minimum, its largest ``p + s`` (as rows and errors) and whether it alarms by itself."""
        if len(x) == 0:
            return (0, 0, 0, 0, 0, 0, 0)
        n, e, _, _, ps = self._rates(n0, t0, x)
        (*_, kn, ke), fired = self.advance((n0, t0, 0, 0), x)
        top = int(np.argmax(np.where(np.isfinite(ps), ps, -1.0)))
        seen = bool(np.isfinite(ps[top]))
        return (len(x), int(e[-1]) - t0, int(kn[-1]), int(ke[-1]), int(n[top]) * seen, int(e[top]) * seen, int(fired.any()))

    def compose(self, state, s):
        n, e, kn, ke = state
        rows, errors, bn, be, hn, he, own = s
        before, edge = self._edge(kn, ke)
        may = bool(own) or (hn > 0 and self._edge(hn, he)[0] > edge)
        if bn and self._edge(bn, be)[0] <= before:
            kn, ke = bn, be
        return (n + rows, e + errors, kn, ke), may


def scan(detector, state, x: np.ndarray, known: Sequence[int] = (), known_exit=None) -> tuple[list[int], tuple]:
    """Alarms (places in ``x``) and the state after ``x``. ``known`` are the alarms of a scan from another
    state, which left ``known_exit``: from a shared alarm on, both are alike."""
    state, shared, hits, at, size = tuple(state), set(known), [], 0, FIRST_CHUNK
    while at < len(x):
        after, fired = detector.advance(state, x[at:at + size])
        k = int(fired.argmax())
        if not fired[k]:
            state, at, size = tuple(int(a[-1]) for a in after), at + size, min(2 * size, LAST_CHUNK)
            continue
        at, state, size = at + k + 1, detector.fresh, FIRST_CHUNK
        hits.append(at - 1)
        if at - 1 in shared:
            return hits + [h for h in known if h >= at], tuple(known_exit)
    return hits, state


def pack(df: DataFrame, units, idx: str, block: int, series: Sequence[str]) -> DataFrame:
    """``(series..., b, at, x)``: a row a block, its index values and errors in order; null errors are left out."""
    cell = F.when(units.isNotNull(), F.struct(F.col(idx).cast("long").alias("i"), units.cast("long").alias("x")))
    cells = df.groupBy(*series, F.floor(F.col(idx) / F.lit(block)).cast("long").alias("b")).agg(F.sort_array(F.collect_list(cell)).alias("_c"))
    return cells.select(*series, "b", F.col("_c.i").alias("at"), F.col("_c.x").alias("x"))


_RESULT = "entry array<bigint>, left array<bigint>, alarms array<bigint>"


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equal keys, null ones too; the left key columns stay."""
    named = right
    for k in keys:
        named = named.withColumnRenamed(k, f"_r_{k}")
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


class _Rounds:
    """The packed stream and the steps of a round. Every step is a written table, whose size Spark knows."""

    def __init__(self, packed: DataFrame, detector, series: Sequence[str], ahead: int, path: str):
        self.path, self.tables = path, 0
        self.packed = self.written(packed)
        self.detector, self.series, self.ahead = detector, list(series), ahead
        self.keys = [*self.series, "b"]
        self.key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*self.keys).schema)
        self.fresh = F.array(*[F.lit(v).cast("long") for v in detector.fresh])

    def written(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        to = f"{self.path}/{self.tables}"
        df.write.parquet(to)
        return df.sparkSession.read.schema(df.schema).parquet(to)

    def _blocks(self, wanted: DataFrame) -> DataFrame:
        """The packed rows of ``wanted(keys..., more)``; only files between its first and last block are read."""
        lo, hi = wanted.agg(F.min("b"), F.max("b")).first()
        return _same(self.packed.where(F.col("b").between(lo, hi)), bounded_broadcast(wanted), self.keys, "inner")

    def scanned(self, todo: DataFrame) -> DataFrame:
        """Scans of ``todo(keys..., entry, known, known_left)``."""
        detector, keys = self.detector, self.keys

        def run(batches):
            for pdf in batches:
                rows = []
                for x, at, entry, known, known_left in zip(pdf["x"], pdf["at"], pdf["entry"], pdf["known"], pdf["known_left"], strict=True):
                    places = [] if known is None else np.searchsorted(at, np.asarray(known, np.int64)).tolist()
                    hits, left = scan(detector, [int(v) for v in entry], np.asarray(x, np.int64), places, None if known_left is None else [int(v) for v in known_left])
                    rows.append((list(left), [int(at[h]) for h in hits]))
                out = pdf[[*keys, "entry"]].copy()
                out["left"] = [r[0] for r in rows]
                out["alarms"] = [r[1] for r in rows]
                yield out

        return todo.mapInPandas(run, f"{self.key_ddl}, {_RESULT}")

    def first(self) -> DataFrame:
        none = F.lit(None).cast("array<bigint>")
        return self.written(self.scanned(self.packed.select("*", self.fresh.alias("entry"), none.alias("known"), none.alias("known_left"))))

    def wrong(self, result: DataFrame) -> DataFrame:
        """Blocks whose entry is not what the block before leaves: ``(keys..., entry, known, known_left, quiet, front)``."""
        before = result.select(*self.series, (F.col("b") + 1).alias("b"), F.col("left").alias("_want"), (F.size("alarms") == 0).alias("quiet"))
        j = _same(result, before, self.keys, "inner").where(F.col("_want") != F.col("entry"))
        w = self.written(j.select(*self.keys, F.col("_want").alias("entry"), F.col("alarms").alias("known"), F.col("left").alias("known_left"), "quiet"))
        fronts = w.groupBy(*self.series).agg(F.min("b").alias("_front"))
        return self.written(_same(w, fronts, self.series, "inner").withColumn("front", F.col("b") == F.col("_front")).drop("_front"))

    def passed(self, wrong: DataFrame, sizes: DataFrame) -> DataFrame | None:
        """For fronts behind a quiet block: the next blocks that surely have no alarm, with their states, and the one
        after them (``left`` null). ``sizes(keys..., rows, total)`` are those of the blocks."""
        fronts = wrong.where("front AND quiet").select(*self.series, F.col("b").alias("_f"), F.col("entry").alias("_e"))
        if fronts.isEmpty():
            return None
        near = _same(sizes, bounded_broadcast(fronts), self.series, "inner").where((F.col("b") >= F.col("_f")) & (F.col("b") < F.col("_f") + self.ahead))
        w = Window.partitionBy(*self.series, "_f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ahead`` rows
        so_far = lambda c, k: (F.col("_e")[k] + F.coalesce(F.sum(c).over(w), F.lit(0))).cast("long")
        starts = self.written(near.select(*self.keys, "_f", "_e", so_far("rows", 0).alias("_n"), so_far("total", 1).alias("_t")))
        detector, keys, series = self.detector, self.keys, self.series

        def summed(batches):
            for pdf in batches:
                out = pdf[[*keys, "_e"]].copy()
                out["s"] = [[int(v) for v in detector.summary(int(n), int(t), np.asarray(x, np.int64))] for n, t, x in zip(pdf["_n"], pdf["_t"], pdf["x"], strict=True)]
                yield out

        def composed(pdf):
            pdf = pdf.sort_values("b")
            state, rows = tuple(int(v) for v in pdf["_e"].iloc[0]), []
            for s in pdf["s"]:
                after, may = detector.compose(state, [int(v) for v in s])
                rows.append((list(state), None if may else list(after), None if may else []))
                if may:
                    break
                state = after
            out = pdf[keys].iloc[:len(rows)].copy()
            for c, name in enumerate(("entry", "left", "alarms")):
                out[name] = pd.Series([r[c] for r in rows], index=out.index, dtype=object)
            return out

        sums = self._blocks(starts).mapInPandas(summed, f"{self.key_ddl}, _e array<bigint>, s array<bigint>")
        return self.written(sums.groupBy(*series).applyInPandas(composed, f"{self.key_ddl}, {_RESULT}"))


def restart_alarms(df: DataFrame, detector, units, idx: str = "i", series: Sequence[str] = (), block: int = BLOCK_ROWS,
                   ahead: int = AHEAD_BLOCKS) -> DataFrame:
    """``(series..., idx)`` of all alarms; the detector starts at each series' first row and anew after each alarm.

    ``idx`` is dense within a series; ``units`` is the whole-number error that ``detector`` takes. Rows with a
    null error keep their place and do not count. Empty streams give no alarm; null series values are a series.
    """
    spark, series = df.sparkSession, list(series)
    path = scratch_path(spark, "restarts")
    packed = pack(df, units, idx, block, series).repartitionByRange("b", *series).sortWithinPartitions("b", *series)
    rounds = _Rounds(packed, detector, series, ahead, path)
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v)
    sizes = rounds.written(rounds.packed.select(*rounds.keys, F.size("x").cast("long").alias("rows"), total.alias("total")))
    result, number = rounds.first(), 0
    while True:
        wrong = rounds.wrong(result)
        if wrong.isEmpty():
            break
        number += 1
        scattered = number & (number - 1) == 0
        todo, new = wrong.where("front" if not scattered else "front OR NOT quiet").drop("quiet", "front"), None
        passed = rounds.passed(wrong, sizes)
        if passed is not None:  # the front moves behind the blocks passed
            new = passed.where("left IS NOT NULL")
            known = result.select(*rounds.keys, F.col("alarms").alias("known"), F.col("left").alias("known_left"))
            stopped = _same(passed.where("left IS NULL").select(*rounds.keys, "entry"), known, rounds.keys, "inner")
            todo = _same(todo, passed.select(*rounds.keys), rounds.keys, "left_anti").unionByName(stopped)
        todo = rounds.written(todo)
        if not todo.isEmpty():
            again = rounds.scanned(rounds._blocks(todo))
            new = again if new is None else new.unionByName(again)
        new = rounds.written(new)
        result = rounds.written(_same(result, new.select(*rounds.keys), rounds.keys, "left_anti").unionByName(new))
    alarms = materialize(result.select(*series, F.explode("alarms").alias(idx)))
    remove_paths(spark, path)
    return alarms


def page_hinkley_alarms(df: DataFrame, err: str = "err", idx: str = "i", series: Sequence[str] = (), block: int = BLOCK_ROWS,
                        ahead: int = AHEAD_BLOCKS, **params) -> DataFrame:
    """All Page-Hinkley alarms on ``err``, taken in millionths.

    NaN and infinite errors are absent, like nulls. The errors between two alarms may add up to 9e12.
    """
    e = F.col(err).cast("double")
    units = F.when(F.abs(e) < LARGEST, F.floor(e * UNIT + 0.5))  # NaN is above all numbers
    return restart_alarms(df, PageHinkleyUnits(**params), units, idx, series, block, ahead)


def ddm_alarms(df: DataFrame, is_error, idx: str = "i", series: Sequence[str] = (), block: int = BLOCK_ROWS,
               ahead: int = AHEAD_BLOCKS, **params) -> DataFrame:
    """All DDM alarms on a boolean error."""
    return restart_alarms(df, DdmUnits(**params), is_error.cast("long"), idx, series, block, ahead)
