"""Embedding near-duplicates by sorted projection passes.

A pass orders the distinct vectors lexicographically by the concatenated signs
of random projections and compares each with its next ``window`` neighbours;
near vectors share long prefixes and end up close in some pass. Verified pairs
of all passes are joined to components. Equal vectors are one node, so copies
never fill a window.

The first bits of an order make a cell. A pair at the threshold shares the cell
of some pass with the stated chance, whatever lies around it, and a cell of no
more rows than a window is compared completely by it. Crowded cells (dense
topics) are dealt to blocks, and every pair of blocks that may hold a link
between different components is compared in a task of its own.

A component can be denser than a window, so its links are then counted
exactly: its members are dealt to blocks, every pair of blocks is compared in
a task of its own, and only counts leave the task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.components import connected_components, forest
from tidemark.llm.support import operator_conf, scratch, shuffle_width

ship_by_value(__name__)

#: Members of a block when the links of a component are counted.
BLOCK = 512
#: Members of a block when a crowded cell is compared, and rows compared at once.
CELL_BLOCK, STRIP = 2048, 256


def _normal_form(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vecs = [], []
            for x in b.column("vec").to_pylist():
                ok = x is not None and len(x) > 0 and None not in x
                v = np.array(x, dtype) + 0.0 if ok else None  # -0.0 becomes 0.0
                ok = ok and bool(np.isfinite(v).all()) and bool(v.any())
                keys.append(hashlib.sha256(v.tobytes()).hexdigest()[:32] if ok else None)
                vecs.append(v.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.string()), pa.array(vecs, pa.binary())],
                                             ["vec_id", "node", "vec"])
    return run


def _order_plan(n: int, threshold: float, recall: float, passes: int, bits: int) -> tuple[int, int]:
    """(passes, bits of a cell) with which a pair at ``threshold`` shares a cell
    of some pass with chance ``recall``; the more vectors, the more of both."""
    agree = min(max(1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi, 0.01), 1 - 1e-6)
    shared = math.floor(math.log(1 - (1 - recall) ** (1 / passes)) / math.log(agree))
    cell = min(max(shared, math.ceil(math.log2(max(n, 1) / CELL_BLOCK)), 1), bits)
    return max(passes, math.ceil(math.log(1 - recall) / math.log(1 - agree ** cell))) if cell > shared else passes, cell


def _codes(dtype: str, numbers: list[int], bits: int, cell: int, seed: int, light: bool = False):
    """Rows of every pass: ``cell, code, node, vec``, or ``cell, node`` if ``light``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raw = b.column("vec").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():
                m = np.frombuffer(b"".join(raw[i] for i in rows), dtype).reshape(len(rows), -1).astype(np.float64)
                m /= np.abs(m).max(axis=1, keepdims=True)
                if size not in planes:
                    planes[size] = np.stack([np.random.default_rng([seed, n, m.shape[1]]).standard_normal((m.shape[1], bits)) for n in numbers])
                head = m.shape[1].to_bytes(4, "big")
                nodes, vecs = b.column("node").take(pa.array(rows)), b.column("vec").take(pa.array(rows))
                for n, p in zip(numbers, planes[size], strict=True):
                    above, name = m @ p > 0, head + n.to_bytes(2, "big")
                    cells = pa.array([name + s.tobytes() for s in np.packbits(above[:, :cell], axis=1)], pa.binary())
                    if light:
                        yield pa.RecordBatch.from_arrays([cells, nodes], ["cell", "node"])
                        continue
                    codes = pa.array([s.tobytes() for s in np.packbits(above, axis=1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([cells, codes, nodes, vecs], ["cell", "code", "node", "vec"])
    return run


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))[None, :]


def _scaled(m: np.ndarray) -> np.ndarray:
    """Double precision, largest component 1: squares neither overflow nor vanish."""
    m = m.astype(np.float64)
    return m / np.abs(m).max(axis=1, keepdims=True)


def _window_links(x: np.ndarray, start: int, window: int, least: float) -> list[tuple[int, int]]:
    """Links of rows of ``x`` with their next ``window`` rows, as a forest of row
    numbers; rows before ``start`` were already compared among themselves."""
    out = []
    for a in range(max(0, start - window), len(x), window):
        block = x[a:a + 2 * window]
        near = _cosines(block[:window], block) >= least
        i = np.arange(len(near))[:, None]
        j = np.arange(len(block))[None, :]
        near &= (j > i) & (j <= i + window)
        if near.any():
            out += [(a + int(p), a + int(q)) for p, q in forest(_reduced(near))]
    return out


def _reduced(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join the same rows as the upper-triangular ``near``, at most one a row and round."""
    n = near.shape[1]
    full = np.zeros((n, n), bool)
    full[: len(near)] = near
    full |= full.T | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(full, label[None, :], n).min(axis=1)
        if (new == label).all():
            return [(i, int(x)) for i, x in enumerate(label) if i != x]
        label = new


def _compare_windows(dtype: str, window: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[str, str]] = []
        nodes: list[str] = []
        held: np.ndarray | None = None
        for b in batches:
            raw, names = b.column("vec").to_pylist(), b.column("node").to_pylist()
            i = 0
            while i < len(raw):  # runs of one dimension
                j = i
                while j < len(raw) and len(raw[j]) == len(raw[i]):
                    j += 1
                m = _scaled(np.frombuffer(b"".join(raw[i:j]), dtype).reshape(j - i, -1))
                if held is None or held.shape[1] != m.shape[1]:
                    held, nodes = m[:0], []
                start = len(held)
                held, nodes = np.concatenate([held, m]), nodes + names[i:j]
                links += [(nodes[p], nodes[q]) for p, q in _window_links(held, start, window, least) if nodes[p] != nodes[q]]
                held, nodes = held[-window:], nodes[-window:]
                i = j
            if len(links) > 500_000:
                links = forest(links)
        links = forest(links)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.string()), pa.array([b for _, b in links], pa.string())],
                                         ["a", "b"])
    return run


def _compare_blocks(dtype: str, least: float):
    """Links between different components of two blocks (of one, if all rows are on the left)."""
    def run(table: pa.Table) -> pa.Table:
        raw = table.column("vec").to_pylist()
        m = _scaled(np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1))
        names, comp = np.unique(np.array(table.column("component").to_pylist()), return_inverse=True)
        left = table.column("on_left").to_numpy()
        at = np.flatnonzero(left)
        to = at if left.all() else np.flatnonzero(~left)
        found = []
        for i in range(0, len(at), STRIP):
            rows = at[i:i + STRIP]
            near = _cosines(m[rows], m[to]) >= least
            near &= comp[rows][:, None] != comp[to][None, :]
            p, q = np.nonzero(near)
            found.append(np.unique(comp[rows][p] * len(names) + comp[to][q]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        links = forest(zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist(), strict=True))
        return pa.table({"a": pa.array([str(names[x]) for x, _ in links], pa.string()),
                         "b": pa.array([str(names[y]) for _, y in links], pa.string())})
    return run


def _crowded_links(s, nodes: DataFrame, cells: DataFrame, comps: DataFrame, dtype: str, least: float, label: str) -> DataFrame:
    """All links between components inside crowded cells.

    ``cells`` has ``cell, node, rows`` (the rows of the cell). A component with
    a block's worth of rows in a cell gets blocks of its own, which are not
    compared with each other; vectors travel only for pairs of blocks.
    """
    crowd = cells.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = crowd.groupBy("cell", "component").agg(F.count("*").alias("size"))
    large = F.col("size") >= CELL_BLOCK
    number = F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CELL_BLOCK))).otherwise(
        F.pmod(F.xxhash64("component"), F.ceil(F.col("rows") / CELL_BLOCK)))
    block = F.struct(F.when(large, F.col("component")).otherwise(F.lit("")).alias("owner"), number.alias("number"))
    dealt = s.table(crowd.join(sizes, ["cell", "component"]).select("cell", "node", "component", block.alias("block")), f"dealt{label}", few=True)
    blocks = dealt.select("cell", "block").distinct()
    pairs = (blocks.withColumnRenamed("block", "p").join(blocks.withColumnRenamed("block", "q"), "cell")
             .where("p <= q AND (p.owner <> q.owner OR p.owner = '')"))
    sides = pairs.select("cell", "p", "q", F.col("p").alias("block")).union(
        pairs.where("p <> q").select("cell", "p", "q", F.col("q").alias("block")))
    met = (dealt.join(sides, ["cell", "block"])
           .select("cell", "p", "q", "node", "component", (F.col("block") == F.col("p")).alias("on_left"))
           .join(nodes.select("node", "vec"), "node"))
    found = met.groupBy("cell", "p", "q").applyInArrow(_compare_blocks(dtype, least), "a string, b string")
    out = s.table(found, f"crowded{label}", few=True)
    s.drop(dealt)
    return out


def _count_blocks(dtype: str, least: float):
    def run(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        block = np.array(table.column("block").to_pylist())
        raw = table.column("vec").to_pylist()
        m = _scaled(np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1))
        copies = table.column("copies").to_numpy()
        at, to = np.flatnonzero(block == p), np.flatnonzero(block == q)
        near = _cosines(m[at], m[to]) >= least if len(at) and len(to) else np.zeros((len(at), len(to)), bool)
        counts = np.zeros(len(raw), np.int64)
        if p == q:
            np.fill_diagonal(near, False)
            counts[at] = near @ copies[to]
        else:
            counts[at] = near @ copies[to]
            counts[to] = near.T @ copies[at]
        return pa.table({"node": table.column("node"), "n": pa.array(counts)})
    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                    passes: int = 24, window: int = 48, bits: int = 64, seed: int = 7, passes_per_job: int = 6,
                    recall: float = 0.995) -> DataFrame:
    """Near-duplicate classes of vectors by cosine in double precision.

    Returns ``vec_id, n_links, component_id, kept`` per row: the number of
    other rows linked directly, the smallest id reachable and whether it is the
    row's own. Null, empty or all-zero vectors and those with null or
    non-finite components link with nothing, and vectors of different lengths
    never link. Null ids never name a component unless it has no other. Repeated rows count as
    rows of their own. No rows give no rows; other columns are not read.

    The search is approximate: a pair at ``threshold`` is compared with a chance
    of at least ``recall``, a nearer one with a greater, in dense topics too.
    ``passes`` is the least number of orders; above about 2 ** 26 different vectors
    there are more. What is linked is verified, and links inside a found component
    are counted completely.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    light = vectors.select(F.col(id_col).alias("vec_id"),
                           F.col(vector_col).cast(f"array<{'float' if dtype == '<f4' else 'double'}>").alias("vec"))
    kind = light.schema["vec_id"].dataType.simpleString()
    with scratch(spark, "embeddings") as s, operator_conf(spark):
        rows = s.table(light.mapInArrow(_normal_form(dtype), f"vec_id {kind}, node string, vec binary"), "rows")
        nodes = s.table(rows.where("node is not null").groupBy("node").agg(
            F.min("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")), "nodes", few=True)
        width = 2 * shuffle_width(spark)
        passes, cell = _order_plan(nodes.count(), threshold, recall, passes, bits)
        parts = [list(range(i, min(i + passes_per_job, passes))) for i in range(0, passes, passes_per_job)]
        light = nodes.select("node", "vec")
        cells = light.mapInArrow(_codes(dtype, list(range(passes)), bits, cell, seed, light=True), "cell binary, node string")
        crowded = s.table(cells.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > window), "crowded-cells", few=True)
        links = None
        for i, numbers in enumerate(parts):
            coded = light.mapInArrow(_codes(dtype, numbers, bits, cell, seed), "cell binary, code binary, node string, vec binary")
            # a crowded cell is cut, so that no task takes all of a dense topic
            salt = F.coalesce(F.pmod(F.xxhash64("node", "cell"), F.ceil(F.col("rows") / CELL_BLOCK)), F.lit(0))
            near = (coded.join(crowded, "cell", "left").withColumn("salt", salt).drop("rows")
                    .repartitionByRange(width, "cell", "salt").sortWithinPartitions("cell", "salt", "code")
                    .select("node", "vec").mapInArrow(_compare_windows(dtype, window, threshold), "a string, b string"))
            part = s.table(near, f"links{i}", few=True)
            links = part if links is None else links.union(part)
        comps = connected_components(s, links)
        if not crowded.isEmpty():
            for i, numbers in enumerate(parts):
                cells = light.mapInArrow(_codes(dtype, numbers, bits, cell, seed, light=True), "cell binary, node string")
                links = links.union(_crowded_links(s, nodes, cells.join(crowded, "cell"), comps, dtype, threshold, str(i)))
            comps = connected_components(s, links)
        members = s.table(nodes.join(comps, "node"), "members", few=True)
        sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        pairs = (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("component", "node", "vec", "copies", "block",
                         F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")))
        counts = s.table(pairs.groupBy("component", "p", "q").applyInArrow(_count_blocks(dtype, threshold), "node string, n bigint")
                         .groupBy("node").agg(F.sum("n").alias("n")), "counts", few=True)
        ids = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
        known = members.join(ids, "component").join(counts, "node").select("node", "component_id", "n")
        named = nodes.join(known, "node", "left").select(
            F.col("node").alias("of"), F.coalesce("component_id", "first_id").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("bigint").alias("links"))
        out = rows.select("vec_id", "node").join(named, F.col("node") == F.col("of"), "left").select(
            "vec_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"),
            F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("class_id")).alias("component_id"))
        out = out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
        return s.table(out, "result", keep=True, few=True)
