"""Connected components of a distributed link table.

Links are first reduced inside each task to a spanning forest (a pre-
aggregation), then alternating large-star and small-star steps contract what
is left until every node points at the smallest node of its component. A step
is a ``min`` aggregate with map-side combining and an equi-join that Spark can
split on a skewed node; no neighbour list is gathered. Every step is written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.support import Scratch

ship_by_value(__name__)


def forest(pairs: Iterable[tuple]) -> list[tuple]:
    """Spanning forest of ``pairs`` as (node, smallest node of its tree)."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, kind, seen = [], None, 0
    for b in batches:
        kind = b.schema.field(0).type
        kept += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        seen += b.num_rows
        if len(kept) > 1_000_000:  # reduce what was read so far; a forest has fewer rows than nodes
            kept = forest(kept)
    if seen:
        kept = forest(kept)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], kind), pa.array([x for _, x in kept], kind)],
                                         ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)`` for every node that has a link.

    ``component`` is the smallest node reachable. Self links and repeated
    links are allowed; an empty table gives an empty table. Nulls must be
    filtered by the caller.
    """
    kind = links.schema["a"].dataType.simpleString()
    pairs = links.select(F.col("a"), F.col("b")).where("a <> b")
    edges = scratch.table(pairs.mapInArrow(_local_forest, f"u {kind}, v {kind}").distinct(), "forest", few=True)
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.table(both.join(low, "u").where("v > u")
                              .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", few=True)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = scratch.table(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                              .union(low.select("u", F.col("m").alias("v"))).distinct(), "small", few=True)
        scratch.drop(edges)
        scratch.drop(large)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return scratch.table(nodes.union(edges.select("v", "v")).distinct(), "components", few=True)
