"""Adaptive-window alarms on an error stream over all scales, without a scan.

The stream is cut into short blocks, whose sums are exact decimals. At the end
of every block, windows of 1, 2, 4, ... blocks on both sides of a cut are
compared with the adaptive-window bound; their sums are differences of running
sums, which travel by chunks of blocks. So a stream of ``n`` blocks costs ``n log n``
array steps, whatever its length, and neither a slow drift nor a
small lasting shift hides behind one fixed scale.

After an alarm the window starts anew at the cut. Which alarm follows which is
a pointer from every possible start to the first test that fires on rows behind
it; the alarms are what the start of the stream reaches over these pointers,
found by doubling steps.

``permuted`` is a keyed bijection of the dense index: one column, no sort. The
permutation control groups the same blocks by it and counts alarms again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shipping import ship_by_value
from tidemark.operators.drift import ADWIN_DELTA, reach, running_extreme
from tidemark.plans.ordering import materialize, running, sequence

ship_by_value(__name__)

# Fixed defaults of the reference configuration: checks every 32 rows, at least 5 rows a side.
BLOCK_ROWS = 32
LEAST_ROWS = 5

_EXACT = T.DecimalType(38, 12)
SUMS = ("_n", "_s", "_q")
#: Boundaries that travel together to the tests; a power of two.
CHUNK = 8192


def block_sums(df: DataFrame, err: str = "err", idx: str = "i", block: int = BLOCK_ROWS, series: Sequence[str] = (),
               scattered: bool = False) -> DataFrame:
    """``(series..., b, _n, _s, _q, _last)`` a block of ``block`` index values: present
    errors, their exact sum and sum of squares, and the last index. Null errors
    are left out of the counts, their block stays. Blocks merge by adding up.
    ``scattered``: a task holds few rows of any one block, so rows meet first, light as they
    are, and are added up there."""
    rows = df.select(*series, F.floor(F.col(idx) / F.lit(block)).cast("long").alias("b"), F.col(err).alias("_err"), F.col(idx).alias("_idx"))
    if scattered:
        rows = rows.repartition(*series, "b")
    e = F.col("_err").cast(_EXACT)
    return rows.groupBy(*series, "b").agg(
        F.count("_err").alias("_n"), F.coalesce(F.sum(e), F.lit(0).cast(_EXACT)).alias("_s"),
        F.coalesce(F.sum((e * e).cast(_EXACT)), F.lit(0).cast(_EXACT)).alias("_q"), F.max("_idx").alias("_last"))


def block_prefix(blocks: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """``(series..., b, _n, _s, _q, _last)``: sums over the blocks before boundary ``b``, and the
    last index before it. Boundary 0 of each series has sums of zero. Blocks are
    numbered without gaps, as they are on a dense index."""
    seq = sequence(blocks, [*series, "b"], materialize=False)
    sums = running(seq, sums={c + "p": F.col(c) for c in SUMS}, keys=list(series)).df
    zero = lambda c: F.lit(0).cast("long" if c == "_n" else _EXACT).alias(c)
    after = sums.select(*series, (F.col("b") + 1).alias("b"), *[F.col(c + "p").cast("long" if c == "_n" else _EXACT).alias(c) for c in SUMS], "_last")
    first = blocks.select(*series).distinct() if series else blocks.limit(1).select()
    return after.unionByName(first.select(*series, F.lit(0).cast("long").alias("b"), *[zero(c) for c in SUMS], F.lit(-1).cast("long").alias("_last")))


def _chunks(boundaries: DataFrame, series: Sequence[str]) -> DataFrame:
    """``(series..., _k, b, _n, _s, _q, _last)``: the boundaries of each ``CHUNK`` numbers as bytes, a row a chunk.
    Sums are the 16 bytes of their decimals, so they stay exact."""
    keys = [*series, "_k"]
    rows = boundaries.where(F.col("_s").isNotNull() & F.col("_q").isNotNull()).select(
        *series, F.floor(F.col("b") / F.lit(CHUNK)).cast("long").alias("_k"), "b", "_n", *[F.col(c).cast(_EXACT).alias(c) for c in SUMS[1:]],
        F.col("_last").cast("long").alias("_last"))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(c, T.BinaryType()) for c in ("b", *SUMS, "_last")])

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("b").to_numpy(), kind="stable")
        cells = [_numbers(group.column(c))[order].tobytes() for c in ("b", *SUMS, "_last")]
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([c], pa.binary()) for c in cells], [*keys, "b", *SUMS, "_last"])

    return rows.groupBy(*keys).applyInArrow(pack, schema)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of a column; of decimals the two halves (low, high), a row each."""
    if not pa.types.is_decimal(column.type):
        return column.to_numpy()
    parts = [np.frombuffer(c.buffers()[1], np.int64)[2 * c.offset:2 * (c.offset + len(c))] for c in column.chunks if len(c)]
    return np.concatenate(parts).reshape(-1, 2)


def _difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x - y`` of exact sums as doubles; the difference is exact, only it is rounded."""
    low = x[:, 0].view(np.uint64) - y[:, 0].view(np.uint64)
    high = x[:, 1] - y[:, 1] - (x[:, 0].view(np.uint64) < y[:, 0].view(np.uint64))
    small = (high == 0) & (low < (1 << 53))
    out = low.astype(np.float64) / 1e12
    if not small.all():
        rest = ~small
        out[rest] = ((high[rest].astype(np.longdouble) * np.longdouble(2.0 ** 64) + low[rest].astype(np.longdouble)) / np.longdouble(1e12)).astype(np.float64)
    return out


def _fired(ends: dict, known: dict, delta: float) -> dict[str, np.ndarray]:
    """The tests that fire at ``ends``, level by level, all ends of a level at once."""
    found, level = [], 0
    while len(ends["b"]) and 2 << level <= ends["b"][-1]:
        hi = ends["b"]
        cut, lo = hi - (1 << level), hi - (2 << level)
        c, a = np.searchsorted(known["b"], cut), np.searchsorted(known["b"], lo)
        here = (lo >= 0) & (known["b"][np.minimum(c, len(known["b"]) - 1)] == cut) & (known["b"][np.minimum(a, len(known["b"]) - 1)] == lo)
        h = np.flatnonzero(here)
        c, a = c[h], a[h]
        n1, n0 = ends["_n"][h] - known["_n"][c], known["_n"][c] - known["_n"][a]
        enough = (n0 >= LEAST_ROWS) & (n1 >= LEAST_ROWS)
        h, c, a, n1, n0 = h[enough], c[enough], a[enough], n1[enough].astype(np.float64), n0[enough].astype(np.float64)
        s1, s0, q = _difference(ends["_s"][h], known["_s"][c]), _difference(known["_s"][c], known["_s"][a]), _difference(ends["_q"][h], known["_q"][a])
        n = n0 + n1
        before, after, mean = s0 / n0, s1 / n1, (s0 + s1) / n
        d = np.log(2.0 * np.log(n) / delta)
        inv = 1.0 / n0 + 1.0 / n1
        bound = np.sqrt(2.0 * inv * np.maximum(q / n - mean * mean, 0.0) * d) + 2.0 / 3.0 * inv * d
        gap = np.abs(after - before)
        f = gap > bound
        h = h[f]
        found.append({"hi": hi[h], "level": np.full(len(h), level, np.int32), "cut": cut[h], "lo": lo[h], "_last": ends["_last"][h],
                      "score": gap[f] / bound[f], "mean_before": before[f], "mean_after": after[f]})
        level += 1
    return {c: np.concatenate([x[c] for x in found]) for c in found[0]} if found else {}


def scale_tests(prefix: DataFrame, ends: DataFrame | None = None, series: Sequence[str] = (), delta: float = ADWIN_DELTA) -> DataFrame:
    """The tests that fire: ``(series..., hi, level, cut, lo, _last, score, mean_before, mean_after)``.

    At boundary ``hi``, the ``2**level`` blocks before it are compared with as many
    before these. With ``n`` present errors in both, harmonic size ``m`` and joint
    variance ``v``, means may differ by ``sqrt(2 v d / m) + 2 d / (3 m)``,
    ``d = ln(2 ln(n) / delta)``; ``score`` is the difference over that. ``ends`` restricts the
    boundaries (those of a micro-batch).

    Boundaries travel by chunks of ``CHUNK`` numbers: the ones that those of chunk ``k`` are
    compared with lie in it, in the one before, or exactly 2, 4, 8, ... chunks before. So a chunk
    meets a few others, about ``log2`` of their number, and no row travels for every single test.
    """
    keys = [*series, "_k"]
    known = materialize(_chunks(prefix, series))
    own = known if ends is None else materialize(_chunks(ends, series))
    top = own.agg(F.max("_k")).first()[0] or 0
    back = [0] + [1 << j for j in range(int(top).bit_length()) if 1 << j <= top]
    copies = known.withColumn("_d", F.explode(F.array(*[F.lit(d).cast("long") for d in back]))).withColumn("_k", F.col("_k") + F.col("_d"))
    copies = copies.where(F.col("_k") <= top).withColumn("_last", F.lit(None).cast("binary")).drop("_d")
    shown = ["hi long", "level int", "cut long", "lo long", "_last long", "score double", "mean_before double", "mean_after double"]
    types = T.StructType([own.schema[k] for k in series] + T._parse_datatype_string(", ".join(shown)).fields)

    def unpacked(rows: list[dict]) -> dict:
        rows = sorted(rows, key=lambda r: np.frombuffer(r["b"], np.int64, 1)[0])
        flat = {c: np.concatenate([np.frombuffer(r[c] or b"", np.int64) for r in rows]) for c in ("b", *SUMS, "_last")}
        return flat | {c: flat[c].reshape(-1, 2) for c in SUMS[1:]}

    def test(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = group.select(["b", *SUMS, "_last"]).to_pylist()
        at, others = [r for r in rows if r["_last"] is not None], [r for r in rows if r["_last"] is None]
        hits = _fired(unpacked(at), unpacked(others), delta) if at and others else {}
        size = len(hits.get("hi", ()))
        cells = [hits.get(c.split()[0], np.zeros(0)) for c in shown]
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        return pa.table([pa.array([k.as_py()] * size, k.type) for k in key[:-1]] + [pa.array(x, kinds[c.split()[1]]) for x, c in zip(cells, shown, strict=True)],
                        [*series, *[c.split()[0] for c in shown]])

    return copies.unionByName(own).groupBy(*keys).applyInArrow(test, types)


def restarted(fired: DataFrame, series: Sequence[str] = (), idx: str = "i", start: DataFrame | None = None) -> DataFrame:
    """The alarms among the tests that fire, the window starting anew at each alarm's cut.

    From a start, the next alarm is the first test (by its end, then its level) whose rows
    all lie behind it. ``(series..., idx, cut, level, score, mean_before, mean_after)`` with
    ``idx`` the last row seen. Cuts that follow each other at one row are one alarm: the first
    one's figures and the last one's ``cut``, where the window starts. ``start(series..., _p)``
    are the starts, boundary 0 unless given.
    """
    keys = list(series)
    fired = materialize(fired)
    zero = fired.select(*keys, F.lit(0).cast("long").alias("_p")).distinct() if start is None else start
    starts = zero.unionByName(fired.select(*keys, F.col("cut").alias("_p"))).distinct()
    test = F.struct("hi", "level", "cut")
    both = starts.select(*keys, (-F.col("_p")).alias("_neg"), F.lit(1).alias("_kind"), F.lit(None).cast(fired.select(test.alias("t")).schema["t"].dataType).alias("_t"))
    both = both.unionByName(fired.select(*keys, (-F.col("lo")).alias("_neg"), F.lit(0).alias("_kind"), test.alias("_t")))
    seq = sequence(both, [*keys, "_neg", "_kind", "_t"], materialize=False)
    seen = running_extreme(seq, F.col("_t"), "_first", keys=keys).df.where("_kind = 1 AND _first IS NOT NULL")
    pointer = materialize(seen.select(*keys, (-F.col("_neg")).alias("_from"), F.col("_first.cut").alias("_to"), "_first"))
    reached = reach(materialize(zero), pointer.select(*keys, "_from", "_to"), keys)
    cond = reached["_p"] == pointer["_from"]
    for k in keys:
        cond = cond & reached[k].eqNullSafe(pointer[k])
    of = pointer.join(reached.select(*keys, "_p"), cond, "left_semi").select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_first")
    on = (F.col("hi") == F.col("_first.hi")) & (F.col("level") == F.col("_first.level"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    first = F.min_by(F.struct("level", "score", "mean_before", "mean_after"), "cut").alias("_a")
    out = fired.join(of, on).groupBy(*keys, "_last").agg(F.max("cut").alias("cut"), first)
    return out.select(*keys, F.col("_last").alias(idx), "cut", "_a.level", "_a.score", "_a.mean_before", "_a.mean_after")


def scale_alarms(df: DataFrame, err: str = "err", idx: str = "i", block: int = BLOCK_ROWS, series: Sequence[str] = (),
                 delta: float = ADWIN_DELTA, scattered: bool = False) -> DataFrame:
    """G1: the alarms of ``df`` by its dense index ``idx``, a window of its own a series.

    Null errors count for nothing but keep their place. An empty stream, or one of
    fewer than two blocks, gives no alarm.
    """
    prefix = materialize(block_prefix(materialize(block_sums(df, err, idx, block, series, scattered)), series))
    return restarted(scale_tests(prefix, series=series, delta=delta), series, idx)


# ---------------------------------------------------------------- permutation control
_P = (1 << 31) - 1  # squares of remainders stay below 2**62
ROUNDS = 4


def round_constants(seed: int, number: int) -> tuple[int, int, int]:
    """Multiplier and offsets of a round of the bijection, spread over the remainders of a prime."""
    x = (seed * 1_000_003 + number * 7_919 + 1) % _P
    out = []
    for _ in range(3):
        x = (x * 48_271 + 11) % _P
        x = (x * x + 3) % _P
        out.append(1 + x % (_P - 1))
    return tuple(out)


def sides(total: int) -> tuple[int, int]:
    """``(a, b)`` with ``a * b`` at least ``total`` and less than ``a`` more."""
    a = max(1, math.isqrt(total))
    return a, -(-total // a)


def seed_constants(seed: int) -> list[tuple[int, int, int]]:
    return [round_constants(seed, r) for r in range(ROUNDS)]


def _mixed(v, constants):
    m, c, d = constants
    h = (v * m + c) % _P
    return (h * h + d) % _P


def _step(x, rounds, a: int, b: int):
    """One pass of the bijection of ``[0, a * b)``, on numbers, numpy arrays or columns."""
    left = F.floor(x / F.lit(b)).cast("long") if isinstance(x, Column) else x // b
    right = x % b
    for r in range(0, ROUNDS, 2):
        left = (left + _mixed(right, rounds[r])) % a
        right = (right + _mixed(left, rounds[r + 1])) % b
    return left * b + right


def longest_walk(total: int, seed: int) -> int:
    """Passes after which every index is back inside ``[0, total)``, from the fewer than ``sqrt(total)`` numbers outside."""
    a, b = sides(total)
    x, passes = np.arange(total, a * b, dtype=np.int64), 1
    while len(x):
        x = _step(x, seed_constants(seed), a, b)
        x = x[x >= total]
        passes += 1
    return passes


def permuted(idx: Column, total: int, seed: int, rounds=None, walk: int | None = None) -> Column:
    """A pseudo-random bijection of ``[0, total)``: Feistel rounds on ``a * b >= total``
    numbers; what falls outside goes through them again until it is inside.

    ``rounds`` may give the seed's constants as columns, with the longest ``walk`` of the seeds."""
    if total >= 1 << 52:
        raise ValueError("index too large")
    a, b = sides(total)
    rounds, walk = rounds or seed_constants(seed), walk or longest_walk(total, seed)
    out = _step(idx.cast("long"), rounds, a, b)
    if walk == 1:
        return out
    again = lambda x, _: F.when(x >= total, _step(x, rounds, a, b)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(2), F.lit(walk)), out, again)


def permutation_control(df: DataFrame, total: int, seeds: Sequence[int], err: str = "err", idx: str = "i", block: int = BLOCK_ROWS,
                        delta: float = ADWIN_DELTA) -> DataFrame:
    """Alarms on the same errors in pseudo-random orders, one a seed; all of them are false.

    ``(seed, alarms, first_alarm)`` for every seed. A shuffled stream is never
    sorted: its rows are grouped by the block that their new index falls into.
    """
    if total >= 1 << 52:
        raise ValueError("index too large")
    seeds = [int(s) for s in seeds]
    a, b = sides(total)
    constants = [(s, seed_constants(s)) for s in seeds]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(1).to_numpy()
            for seed, rounds in constants:
                j = _step(i, rounds, a, b)
                out = np.flatnonzero(j >= total)
                while len(out):
                    j[out] = _step(j[out], rounds, a, b)
                    out = out[j[out] >= total]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(i), seed, np.int64)), pa.array(j)], ["_e", "seed", "_j"])

    rows = df.where(F.col(idx).isNotNull()).select(F.col(err).alias("_e"), F.col(idx).cast("long").alias("_i"))
    laid = rows.mapInArrow(lay, T.StructType([rows.schema["_e"]] + [T.StructField(c, T.LongType()) for c in ("seed", "_j")]))
    alarms = scale_alarms(laid, "_e", "_j", block, ["seed"], delta, scattered=True)
    counts = alarms.groupBy("seed").agg(F.count("*").alias("alarms"), F.min("_j").alias("first_alarm"))
    all_seeds = df.sparkSession.createDataFrame([(int(s),) for s in seeds], "seed long")
    return all_seeds.join(counts, "seed", "left").select("seed", F.coalesce("alarms", F.lit(0)).alias("alarms"), "first_alarm")
