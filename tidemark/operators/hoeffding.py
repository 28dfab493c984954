"""Regression trees and forests that grow with the stream, a few aggregations a micro-batch.

Every numeric feature has a fixed grid of bins. A micro-batch is routed to the
leaves by its bins, and counts, sums and sums of squares of the target
by (member, leaf, feature, bin) are one aggregation with partial sums in every
task: members are drawn, routed and summed in arrays there, no row a member.
Sums are exact (whole numbers in the tasks, decimals between them), so merging them does not depend on order or
partitioning. Their number is bounded by members x leaves x features x bins,
whatever the stream, and so is what the driver merges; rows and target sums by arrival,
members x leaves an arrival, come to the driver for the scores.

Rows arrive in numbered arrivals, and a micro-batch holds one or many of them; the
trees are those of one arrival after the other. When a leaf splits depends on its
own rows only, so all leaves of a depth find their first deciding arrival at once,
each in a task of its own from its sums by arrival, and their children follow in
the next round: rounds are bounded by the depth, not by the number of arrivals.

After an arrival each leaf of at least ``grace`` rows is tested: the bin edge
that lowers the variance most splits it if the best other feature does so by
less than the Hoeffding bound allows, or if the bound is below ``tie``. Leaves
predict the mean of their rows, among them those that their parent saw on
their side of the split. A forest is several trees whose rows carry
Poisson(1) weights from a hash of (row, member); it predicts the mean of its trees.

Rows are scored by the trees as of the arrivals before. A null or NaN target is scored
and not learned; a null or NaN feature falls into bin -1, below all others.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shipping import ship_by_value
from tidemark.operators.scales import _P, _mixed, round_constants
from tidemark.session import remove_paths
from tidemark.streaming.prequential import _mark_committed, state_versions

ship_by_value(__name__)

_EXACT = T.DecimalType(38, 12)
NODE_DDL = "member int, node int, parent int, depth int, feature string, bin int, n long, s decimal(38,12), born long"
STAT_DDL = "member int, node int, feature string, bin int, n long, s decimal(38,12), q decimal(38,12)"
CELL_DDL = "member int, node int, arrival long, feature string, bin int, n long, s decimal(38,12), q decimal(38,12)"
SPLIT_DDL = "member int, node int, feature string, bin int, arrival long, n0 long, s0 decimal(38,12), n1 long, s1 decimal(38,12)"
_BEFORE = -(1 << 62)  # arrival number of the statistics that a leaf has from earlier micro-batches
_UNIT = 1_000_000  # a sum's last digit counts as many of the decimals' last digits
_LIMB = (1 << 32) - 1
_WIDE = Context(prec=60)


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``grids``: feature -> (origin, width) of its bins."""

    grids: Mapping[str, tuple[float, float]]
    bins: int = 32
    grace: int = 200
    delta: float = 1e-7
    tie: float = 0.05
    max_depth: int = 6
    members: int = 1


@dataclass
class Node:
    member: int
    node: int
    parent: int  # -1: root
    depth: int
    feature: str | None = None  # of a split node: rows of its ``bin`` and below go to the first child
    bin: int | None = None
    n: int = 0  # rows and target sum that a leaf took over from its parent
    s: Decimal = Decimal(0)
    born: int = -1


@dataclass
class Trees:
    """The node tables and the leaves' statistics; both bounded by the growth parameters."""

    growth: Growth
    nodes: list[list[Node]] = field(default_factory=list)
    stats: dict[tuple[int, int], dict[str, dict[int, tuple[int, Decimal, Decimal]]]] = field(default_factory=dict)

    def __post_init__(self):
        if not self.nodes:
            self.nodes = [[Node(m, 0, -1, 0)] for m in range(self.growth.members)]

    def children(self, member: int, node: int) -> list[int]:
        return [x.node for x in self.nodes[member] if x.parent == node]

    def leaves(self, member: int) -> list[Node]:
        return [x for x in self.nodes[member] if x.feature is None]

    def totals(self, member: int, node: int) -> tuple[int, Decimal]:
        """Rows and target sum of a leaf, those taken over included."""
        x = self.nodes[member][node]
        seen = next(iter(self.stats.get((member, node), {}).values()), {})
        return x.n + sum(v[0] for v in seen.values()), x.s + sum((v[1] for v in seen.values()), Decimal(0))

    # ------------------------------------------------------------ routing
    def paths(self, since: int | None = None) -> np.ndarray:
        """A row a node of every member: the number of its split feature (-1: leaf), its bin, both children, and the arrival
        from which on the split holds: with ``since``, splits of the arrivals from it on hold for those behind them."""
        names, most = list(self.growth.grids), max(map(len, self.nodes))
        out = np.full((self.growth.members, most, 5), -1, np.int64)
        for tree in self.nodes:
            for x in tree:
                if x.feature is not None:
                    low, high = self.children(x.member, x.node)
                    born = tree[low].born
                    out[x.member, x.node] = names.index(x.feature), x.bin, low, high, born if since is not None and born >= since else _BEFORE - 1
        return out

    # ------------------------------------------------------------ learning
    def learn(self, statistics: Sequence, batch: int) -> None:
        """Merge the statistics of an arrival and split the leaves that they decide."""
        self.merge(statistics)
        for m in range(self.growth.members):
            for x in self.leaves(m):
                if x.depth < self.growth.max_depth:
                    found = decided(self.growth, self.stats.get((m, x.node), {}))
                    if found:
                        self.split(x, *found, batch)

    def merge(self, statistics: Sequence) -> None:
        for r in statistics:
            bins = self.stats.setdefault((r["member"], r["node"]), {}).setdefault(r["feature"], {})
            n, s, q = bins.get(r["bin"], (0, Decimal(0), Decimal(0)))
            bins[r["bin"]] = (n + r["n"], s + r["s"], q + r["q"])

    def split(self, x: Node, feature: str, bin_: int, sides: Sequence[tuple[int, Decimal]], batch: int) -> list[Node]:
        x.feature, x.bin = feature, bin_
        for k, s in sides:
            self.nodes[x.member].append(Node(x.member, len(self.nodes[x.member]), x.node, x.depth + 1, n=k, s=s, born=batch))
        self.stats.pop((x.member, x.node), None)
        return self.nodes[x.member][-2:]

    def renumber(self) -> None:
        """Number nodes in the order in which one arrival after the other makes them: by arrival, then by the parent's number."""
        for m, tree in enumerate(self.nodes):
            number, order, open_ = {-1: -1}, [], [(tree[0].born, -1, 0)]
            while open_:
                at = min(open_)  # an arrival's splits are made in the order of the leaves' numbers, children low, high
                open_.remove(at)
                number[at[2]] = len(order)
                order.append(tree[at[2]])
                open_ += [(tree[c].born, len(order) - 1, c) for c in self.children(m, at[2])]
            stats = {number[k]: self.stats.pop((m, k)) for k in list(number) if (m, k) in self.stats}
            for x in order:
                x.node, x.parent = number[x.node], number[x.parent]
            self.nodes[m] = order
            self.stats |= {(m, k): v for k, v in stats.items()}

    # ------------------------------------------------------------ tables
    def node_rows(self) -> list[tuple]:
        return [tuple(asdict(x).values()) for tree in self.nodes for x in tree]

    def stat_rows(self) -> list[tuple]:
        return [(m, k, f, b, *v) for (m, k), fs in self.stats.items() for f, bins in fs.items() for b, v in bins.items()]

    @classmethod
    def of(cls, growth: Growth, node_rows: Sequence, stat_rows: Sequence) -> "Trees":
        nodes: list[list[Node]] = [[] for _ in range(growth.members)]
        for r in sorted(node_rows, key=lambda r: (r["member"], r["node"])):
            nodes[r["member"]].append(Node(**r.asDict()))
        out = cls(growth, nodes)
        for r in stat_rows:
            out.stats.setdefault((r["member"], r["node"]), {}).setdefault(r["feature"], {})[r["bin"]] = (r["n"], r["s"], r["q"])
        return out


def best_edge(bins: Mapping[int, tuple[int, Decimal, Decimal]]) -> tuple[float, int | None]:
    """The fall of the variance at the best edge (the lowest of equal ones) and its bin; ``(0, None)`` without one."""
    n, s, q = sum(v[0] for v in bins.values()), sum(v[1] for v in bins.values()), sum(v[2] for v in bins.values())
    whole = spread(n, s, q)
    best, at, ln, ls, lq = 0.0, None, 0, Decimal(0), Decimal(0)
    for b in sorted(bins)[:-1]:
        ln, ls, lq = ln + bins[b][0], ls + bins[b][1], lq + bins[b][2]
        gain = (whole - spread(ln, ls, lq) - spread(n - ln, s - ls, q - lq)) / n
        if gain > best:
            best, at = gain, b
    return best, at


def decided(growth: Growth, found: Mapping) -> tuple[str, int, list[tuple[int, Decimal]]] | None:
    """The split that a leaf's statistics decide: feature, bin, and rows and target sum of both sides."""
    best = sorted(((-gain, f, b) for f, bins in found.items() for gain, b in [best_edge(bins)]), key=lambda t: t[:2])  # equal gains: by name
    n = sum(v[0] for v in next(iter(found.values()), {}).values())
    if n < growth.grace or not best or best[0][0] >= 0:
        return None
    second = max(0.0, -best[1][0]) if len(best) > 1 else 0.0
    eps = math.sqrt(math.log(1.0 / growth.delta) / (2.0 * n))
    if second / -best[0][0] >= 1.0 - eps and eps >= growth.tie:
        return None
    _, feature, bin_ = best[0]
    sides = [(0, Decimal(0)), (0, Decimal(0))]
    for b, (k, s, _) in found[feature].items():
        i = int(b > bin_)
        sides[i] = (sides[i][0] + k, sides[i][1] + s)
    return feature, bin_, sides


def _route(paths: np.ndarray, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The leaf of each row in one member, whose ``paths`` these are."""
    node, row = np.zeros(len(at), np.int64), np.arange(len(at))
    for _ in range(len(paths)):
        feature, cut, low, high, born = paths[node].T
        go = (feature >= 0) & (at > born)
        if not go.any():
            break
        below = bins[row, np.maximum(feature, 0)] <= cut
        node = np.where(go, np.where(below, low, high), node)
    return node


def _bins(b: pa.RecordBatch, growth: Growth) -> np.ndarray:
    return np.stack([b.column("_bin_" + f).to_numpy(zero_copy_only=False) for f in growth.grids], axis=1).astype(np.int64)


def _drawn(ids: pa.Array, members: int, seed: int = 42) -> list[np.ndarray]:
    """The weights of ``with_weights``, an array a member."""
    if members == 1:
        return [np.ones(len(ids), np.int64)]
    known = np.ones(len(ids), bool) if not ids.null_count else ids.is_valid().to_numpy(zero_copy_only=False)
    v = np.fmod(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), _P)  # signs as Spark's
    steps, out = np.array(poisson_steps()), []
    for m in range(members):
        h = v
        for c1, c2, c3 in (round_constants(seed, 2 * m), round_constants(seed, 2 * m + 1)):
            h = np.fmod(h * c1 + c2, _P)
            h = np.fmod(h * h + c3, _P)
        out.append(np.searchsorted(steps, h / float(_P), side="right") * known)
    return out


def _units(column: pa.Array) -> np.ndarray:
    """The whole numbers of last digits in a decimal column; Python's where a weight's multiple may not fit a long."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(Decimal(0), column.type))
    words = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset:2 * (column.offset + len(column))].reshape(-1, 2)
    low, high = words[:, 0], words[:, 1]
    most = 1 << 58
    if (high == low >> 63).all() and low.max(initial=0) < most and low.min(initial=0) > -most:
        return low
    return high.astype(object) * (1 << 64) + low.copy().view(np.uint64).astype(object)


def _weighted(w: np.ndarray, units: np.ndarray) -> np.ndarray:
    """``w * units`` in units of a sum, rounded half up as Spark's product of a long and such a decimal."""
    v = w * units
    whole = (np.abs(v) + _UNIT // 2) // _UNIT
    return np.where(v < 0, -whole, whole)


def _decimals(units: np.ndarray) -> pa.Array:
    if units.dtype != object and np.abs(units).max(initial=0) < 1 << 42:
        low = units * _UNIT
        words = np.stack([low, low >> 63], axis=1).tobytes()
    else:
        words = b"".join((int(v) * _UNIT).to_bytes(16, "little", signed=True) for v in units.tolist())
    return pa.Array.from_buffers(pa.decimal128(38, 12), len(units), [None, pa.py_buffer(words)])


class _Sums:
    """Counts and exact sums by key, as limbs of 32 bits whose sums fit a long."""

    def __init__(self, size: int):
        self.size, self.n, self.limbs = size, np.zeros(size, np.int64), {}

    def add(self, key: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.n, key, n)
        for name, v in (("s", s), ("q", q)):
            top = 3 if v.dtype == object else int(max(v.max(initial=0), -v.min(initial=0)) > _LIMB >> 1)
            for i in range(top + 1):
                part = v >> 32 * i
                part = part if i == top else part & _LIMB
                if (name, i) not in self.limbs:
                    self.limbs[name, i] = np.zeros(self.size, np.int64)
                np.add.at(self.limbs[name, i], key, part.astype(np.int64))

    def total(self, name: str, at: np.ndarray) -> np.ndarray:
        parts = {i: limbs[at] for (k, i), limbs in self.limbs.items() if k == name}
        if max(parts, default=0) < 2 and all(np.abs(p).max(initial=0) < 1 << (60 - 32 * i) for i, p in parts.items()):
            return sum((p << 32 * i for i, p in parts.items()), np.zeros(len(at), np.int64))
        return sum((p.astype(object) * (1 << 32 * i) for i, p in parts.items()), np.zeros(len(at), object))


def _cells(rows: DataFrame, trees: Trees, since: int | None, each: Sequence[Node] = (), whole: Sequence[Node] | None = (), taken: bool = False) -> DataFrame:
    """Partial sums of the rows of ``laid_out``, ``CELL_DDL``: those of the leaves ``each`` by arrival, feature and bin, those of
    the leaves ``whole`` (None: all) by feature and bin at the arrival ``_BEFORE``, and with ``taken`` those of every leaf by
    arrival under the feature ``''``."""
    growth, paths, names = trees.growth, trees.paths(since), list(trees.growth.grids)
    members, most = paths.shape[:2]
    slots, width, wide = members * most, growth.bins + 1, (growth.bins + 1) * len(names)

    def mask(nodes: Sequence[Node] | None) -> np.ndarray:
        out = np.full(slots, nodes is None)
        out[[x.member * most + x.node for x in nodes or ()]] = True
        return out

    by_arrival, at_once = mask(each), mask(whole)
    schema = pa.schema([("member", pa.int32()), ("node", pa.int32()), ("arrival", pa.int64()), ("feature", pa.string()), ("bin", pa.int32()),
                        ("n", pa.int64()), ("s", pa.decimal128(38, 12)), ("q", pa.decimal128(38, 12))])

    def listed(sums: _Sums, at: np.ndarray, slot: np.ndarray, arrival: np.ndarray, cell: np.ndarray | None) -> pa.RecordBatch:
        feature = pa.array([""] * len(at)) if cell is None else pa.array(names).take(pa.array(cell // width))
        bin_ = np.zeros(len(at)) if cell is None else cell % width - 1
        return pa.RecordBatch.from_arrays([
            pa.array((slot // most).astype(np.int32)), pa.array((slot % most).astype(np.int32)), pa.array(arrival), feature, pa.array(bin_.astype(np.int32)),
            pa.array(sums.n[at]), _decimals(sums.total("s", at)), _decimals(sums.total("q", at))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums(slots * wide) if at_once.any() else None
        for b in batches:
            if not b.num_rows:
                continue
            at, bins, y, yy = b.column("_at").to_numpy(zero_copy_only=False), _bins(b, growth), _units(b.column("_y")), _units(b.column("_yy"))
            arrivals, which = np.unique(at, return_inverse=True)
            places = []
            for m, w in enumerate(_drawn(b.column("_id"), members)):
                row = np.flatnonzero(w)
                places.append((row, m * most + _route(paths[m], at[row], bins[row]), w[row]))
            row, slot, w = (np.concatenate(c) for c in zip(*places, strict=True))
            s, q = _weighted(w, y[row]), _weighted(w, yy[row])
            cell = np.arange(len(names)) * width + bins + 1
            if taken:
                key, at_key = np.unique(which[row] * slots + slot, return_inverse=True)
                sums = _Sums(len(key))
                sums.add(at_key, w, s, q)
                yield listed(sums, np.arange(len(key)), key % slots, arrivals[key // slots], None)
            some = np.flatnonzero(by_arrival[slot])
            if len(some):
                key = (((which[row[some]] * slots + slot[some]) * wide)[:, None] + cell[row[some]]).ravel()
                key, at_key = np.unique(key, return_inverse=True)
                sums = _Sums(len(key))
                sums.add(at_key, *(np.repeat(v[some], len(names)) for v in (w, s, q)))
                yield listed(sums, np.arange(len(key)), key // wide % slots, arrivals[key // (wide * slots)], key % wide)
            some = np.flatnonzero(at_once[slot]) if held else some[:0]
            if len(some):
                held.add((slot[some][:, None] * wide + cell[row[some]]).ravel(), *(np.repeat(v[some], len(names)) for v in (w, s, q)))
        key = np.flatnonzero(held.n) if held else np.zeros(0, np.int64)
        if len(key):
            yield listed(held, key, key // wide, np.full(len(key), _BEFORE), key % wide)

    return rows.select("_id", "_at", "_y", "_yy", *["_bin_" + f for f in names]).where("_y IS NOT NULL").mapInArrow(run, CELL_DDL)


def _gathered(cells: DataFrame) -> DataFrame:
    return cells.groupBy("member", "node", "arrival", "feature", "bin").agg(
        *[(F.sum(c) if c == "n" else F.sum(c).cast(_EXACT)).alias(c) for c in ("n", "s", "q")])


def _first_decision(growth: Growth):
    """Of one leaf's statistics by arrival: its first arrival that decides a split."""
    schema = pa.schema([("member", pa.int32()), ("node", pa.int32()), ("feature", pa.string()), ("bin", pa.int32()), ("arrival", pa.int64()),
                        ("n0", pa.int64()), ("s0", pa.decimal128(38, 12)), ("n1", pa.int64()), ("s1", pa.decimal128(38, 12))])

    def run(cells: pa.Table) -> pa.Table:
        cells = cells.sort_by("arrival")
        leaf = {k: cells.column(k)[0].as_py() for k in ("member", "node")}
        found: dict[str, dict] = {}

        def decides(arrival: int) -> list[dict]:
            split = decided(growth, found) if arrival > _BEFORE else None
            if split is None:
                return []
            feature, bin_, ((n0, s0), (n1, s1)) = split
            return [{**leaf, "feature": feature, "bin": bin_, "arrival": arrival, "n0": n0, "s0": s0, "n1": n1, "s1": s1}]

        last = _BEFORE
        for i in range(0, len(cells), 1024):  # a leaf decides early as a rule: what lies behind is not unpacked
            part = cells.slice(i, 1024)
            for a, f, b, *v in zip(*(part.column(k).to_pylist() for k in ("arrival", "feature", "bin", "n", "s", "q")), strict=True):
                if a > last:
                    if out := decides(last):
                        return pa.Table.from_pylist(out, schema)
                    last = a
                own = found.setdefault(f, {})
                n, s, q = own.get(b, (0, Decimal(0), Decimal(0)))
                own[b] = (n + v[0], s + v[1], q + v[2])
        return pa.Table.from_pylist(decides(last), schema)

    return run


def spread(n: int, s, q) -> float:
    """Sum of squared deviations, from exact sums."""
    return float(q) - float(s) * float(s) / n


def bin_of(growth: Growth, feature: str) -> Column:
    origin, width = growth.grids[feature]
    x = F.col(feature).cast("double")
    at = F.least(F.greatest(F.floor((x - origin) / width), F.lit(0)), F.lit(growth.bins - 1)).cast("int")
    return F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise(at)


def with_bins(rows: DataFrame, growth: Growth) -> DataFrame:
    return rows.withColumns({"_bin_" + f: bin_of(growth, f) for f in growth.grids})


def poisson_steps(most: int = 12) -> list[float]:
    """Cumulative chances of 0, 1, 2, ... for a mean of 1."""
    out, term, total = [], math.exp(-1.0), 0.0
    for k in range(1, most + 1):
        total += term
        out.append(total)
        term /= k
    return out


def with_weights(rows: DataFrame, row_id: str, members: int, seed: int = 42) -> DataFrame:
    """Each row once a member, with ``_m`` and its Poisson(1) weight ``_w`` from a hash of both: the same wherever the
    row is. A single member has weight 1. The hash is a column of its own, so its text does not multiply."""
    if members == 1:
        return rows.withColumns({"_m": F.lit(0), "_w": F.lit(1).cast("long")})
    names = ("_m1", "_c1", "_d1", "_m2", "_c2", "_d2")
    table = F.array(*[F.struct(F.lit(m).alias("_m"), *[F.lit(v).cast("long").alias(k) for k, v in zip(
        names, (*round_constants(seed, 2 * m), *round_constants(seed, 2 * m + 1)), strict=True)]) for m in range(members)])
    laid = rows.withColumn("_x", F.explode(table)).select(*rows.columns, "_x.*")
    for a, b, c in (names[:3], names[3:]):
        before = F.col(row_id).cast("long") % _P if a == "_m1" else F.col("_h")
        laid = laid.withColumn("_h", _mixed(before, (F.col(a), F.col(b), F.col(c))))
    laid = laid.withColumn("_u", F.col("_h").cast("double") / F.lit(float(_P)))
    weight = sum((F.when(F.col("_u") >= step, 1).otherwise(0) for step in poisson_steps()), F.lit(0))
    return laid.withColumn("_w", weight.cast("long")).drop(*names, "_h", "_u")


def laid_out(batch: DataFrame, growth: Growth, y: str, row_id: str, arrival: Column | None, keep: Sequence[str] = ()) -> DataFrame:
    """What learning and scoring read: ``_id``, ``_at``, the bins, and target and square as exact decimals (null where there is
    no target), behind ``keep``."""
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    at = F.lit(_BEFORE) if arrival is None else arrival
    rows = with_bins(batch.select(*dict.fromkeys([*keep, y, *growth.grids]), F.col(row_id).cast("long").alias("_id"), at.cast("long").alias("_at"),
                                  F.when(known, F.col(y).cast(_EXACT)).alias("_y")), growth)
    return rows.withColumn("_yy", (F.col("_y") * F.col("_y")).cast(_EXACT)).drop(*[f for f in growth.grids if f not in keep and f != y])


def statistics(batch: DataFrame, trees: Trees, y: str = "target", row_id: str = "lidx") -> DataFrame:
    """``(member, node, feature, bin, n, s, q)`` of a micro-batch at the leaves of all members, in one aggregation."""
    return _gathered(_cells(laid_out(batch, trees.growth, y, row_id, None), trees, None, whole=None)).drop("arrival")


def _frame(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """``rows`` as a DataFrame, without a look at each value."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "decimal(38,12)": pa.decimal128(38, 12)}
    named = [c.split() for c in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(named)
    return spark.createDataFrame(pa.table({c: pa.array(v, kinds[k]) for (c, k), v in zip(named, columns, strict=True)}))


def grow(rows: DataFrame, trees: Trees, since: int) -> None:
    """Make the splits that the arrivals of ``rows`` (``laid_out``) decide, the leaves of a round at once, their children in the next."""
    g, spark = trees.growth, rows.sparkSession
    fresh = [x for m in range(g.members) for x in trees.leaves(m) if x.depth < g.max_depth]
    while fresh:
        cells = _cells(rows, trees, since, each=fresh)
        old = [(x.member, x.node, _BEFORE, f, b, *v) for x in fresh for f, bins in trees.stats.get((x.member, x.node), {}).items() for b, v in bins.items()]
        if old:
            cells = cells.unionByName(_frame(spark, old, CELL_DDL))
        splits = cells.groupBy("member", "node").applyInArrow(_first_decision(g), SPLIT_DDL).collect()  # one a leaf at most
        born = [trees.split(trees.nodes[r["member"]][r["node"]], r["feature"], r["bin"], [(r["n0"], r["s0"]), (r["n1"], r["s1"])], r["arrival"])
                for r in sorted(splits, key=lambda r: (r["member"], r["node"]))]
        fresh = [x for pair in born for x in pair if x.depth < g.max_depth]


def leaf_means(trees: Trees, totals: Mapping, arrivals: Sequence[int], taken: pa.Table) -> np.ndarray:
    """``(arrivals, members, nodes)``: every node's mean of the arrivals before, 0 before its first row. ``totals``: rows and target
    sum of a leaf before them all, ``taken``: those of an arrival."""
    members, most = trees.growth.members, max(map(len, trees.nodes))
    n, s, mean = np.zeros((members, most), np.int64), np.zeros((members, most), object), np.zeros((members, most))

    def add(at: tuple, k: np.ndarray, units: np.ndarray) -> None:
        n[at] += k
        s[at] += units
        mean[at] = [a / 10 ** 12 / b if b else 0.0 for a, b in zip(s[at].tolist(), n[at].tolist(), strict=True)]

    first = [(x.member, x.node, *totals.get((x.member, x.node), (x.n, x.s))) for tree in trees.nodes for x in tree]
    m, k, rows, sums = zip(*first, strict=True)
    add((np.array(m), np.array(k)), np.array(rows), np.array([int(v.scaleb(12, _WIDE)) for v in sums], object))
    taken = taken.sort_by("arrival")
    at = (taken.column("member").to_numpy(), taken.column("node").to_numpy())
    k, units = taken.column("n").to_numpy(), _units(taken.column("s").combine_chunks()).astype(object)
    ends = np.searchsorted(taken.column("arrival").to_numpy(), arrivals, side="right")
    out, begun = np.empty((len(arrivals), members, most)), 0
    for i, end in enumerate(ends.tolist()):
        out[i] = mean
        some = slice(begun, end)  # a node once an arrival
        add((at[0][some], at[1][some]), k[some], units[some])
        begun = end
    return out


def _give_back() -> None:
    """Freed memory goes to the system: a run's micro-batches have a thread of their own, and allocators keep what a thread frees."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _predicted(growth: Growth, paths: np.ndarray, arrivals: Sequence[int], means: Broadcast, keep: Sequence[str]):
    """Task code: ``keep`` and the mean over the members, each leaf's mean of the arrivals before the row's."""
    order = np.array(arrivals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bins = b.column("_at").to_numpy(zero_copy_only=False), _bins(b, growth)
            which, total = np.searchsorted(order, at), 0.0
            for m in range(growth.members):
                total = total + means.value[which, m, _route(paths[m], at, bins)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(total / float(growth.members))], [*keep, "prediction"])
    return run


class TreeStream:
    """Trees kept current on a stream, test-then-train.

    ``arrival`` numbers the arrivals of the stream, in its order; a micro-batch holds whole ones, by default it is
    one. Each is scored by the trees of the arrivals before it, then learned; the trees after batch ``k`` are two
    light tables in ``state_dir/v<k>``, its scores are in ``out_dir/batch_id=<k>``. A batch that runs again starts
    from the same trees and writes the same tables.
    """

    def __init__(self, state_dir: str, out_dir: str, growth: Growth, y: str = "target", row_id: str = "lidx", keep: Sequence[str] = (),
                 arrival: Column | None = None):
        self.state_dir, self.out_dir, self.growth, self.y, self.row_id = state_dir.rstrip("/"), out_dir.rstrip("/"), growth, y, row_id
        self.keep, self.arrival = list(keep) or [row_id], arrival

    def trees(self, spark: SparkSession, before: int | None = None) -> Trees:
        known = [v for v in state_versions(spark, self.state_dir) if before is None or v < before]
        if not known:
            return Trees(self.growth)
        at = f"{self.state_dir}/v{known[-1]}"  # at most members x leaves x features x bins rows
        return Trees.of(self.growth, spark.read.schema(NODE_DDL).parquet(f"{at}/nodes").collect(), spark.read.schema(STAT_DDL).parquet(f"{at}/stats").toArrow().to_pylist())

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark, trees, g = batch.sparkSession, self.trees(batch.sparkSession, batch_id), self.growth
        kept = [*self.keep, self.y]
        rows = laid_out(batch, g, self.y, self.row_id, F.lit(batch_id) if self.arrival is None else self.arrival, kept).persist()
        arrivals = sorted(r["_at"] for r in rows.select("_at").distinct().collect()) or [batch_id]  # a number an arrival
        totals = {(x.member, x.node): trees.totals(x.member, x.node) for m in range(g.members) for x in trees.leaves(m)}
        grow(rows, trees, arrivals[0])
        leaves = [x for m in range(g.members) for x in trees.leaves(m)]
        sums = _gathered(_cells(rows, trees, arrivals[0], whole=leaves, taken=True)).toArrow()
        by_arrival = pc.equal(sums.column("feature"), "")
        means = spark.sparkContext.broadcast(leaf_means(trees, totals, arrivals, sums.filter(by_arrival)))  # members x nodes numbers an arrival
        scores = rows.select(*kept, "_at", *["_bin_" + f for f in g.grids])
        schema = T.StructType([*scores.select(*kept).schema.fields, T.StructField("prediction", T.DoubleType())])
        scores.mapInArrow(_predicted(g, trees.paths(arrivals[0]), arrivals, means, kept), schema).write.mode("overwrite").parquet(
            f"{self.out_dir}/batch_id={batch_id}")
        means.destroy()
        rows.unpersist()
        trees.merge(sums.filter(pc.invert(by_arrival)).to_pylist())
        del sums, by_arrival
        trees.renumber()
        at = f"{self.state_dir}/v{batch_id}"
        for name, table in (("nodes", _frame(spark, trees.node_rows(), NODE_DDL)), ("stats", _frame(spark, trees.stat_rows(), STAT_DDL))):
            table.coalesce(1).write.mode("overwrite").parquet(f"{at}/{name}")
        _mark_committed(spark, at)
        remove_paths(spark, *[f"{self.state_dir}/v{v}" for v in state_versions(spark, self.state_dir) if v < batch_id - 2])
        del trees, table
        _give_back()

    def start(self, stream: DataFrame, checkpoint: str, trigger_available_now: bool = True):
        w = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if trigger_available_now else w
        return w.start()
