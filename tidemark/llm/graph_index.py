"""Nearest neighbours by robust-pruned directed graphs, one a shard.

Distinct vectors are dealt to shards by their hash. A shard's graph is grown in
batches: a greedy search of the graph so far proposes neighbours for each new
vector, and pruning keeps the nearest of them, without those that a kept one is
closer to by the factor ``alpha`` (so that far, diverse edges stay). Edges are
added both ways, full lists are pruned again. Queries travel in blocks and are
answered by a beam search in every shard; distances of what the beams hold are
then computed in double precision on the original vectors.

A shard is one row of a written table (its vectors, graph and ids as packed
bytes), a query block another. A task meets its shards with the query blocks,
slice by slice, and merges the answers of a block, so what leaves a task grows
with the queries only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.blocks import Best, batch_of, batches_of, cell_files, matrix, met, pack, vector_columns
from tidemark.llm.support import operator_conf, scratch, shuffle_width
from tidemark.plans.ordering import first_n_per_group

ship_by_value(__name__)

SHARD_VECTORS = 4096   # vectors of a shard, on average
DEGREE = 48            # edges that leave a vector
ALPHA = 1.2            # relaxation of the pruning
BUILD_BEAM = 64        # vectors that a search holds while the graph grows
QUERY_BEAM = 128       # and when it is queried
EXPAND = 4             # vectors whose edges a search follows at once
BATCH = 512            # searches that run together
QUERY_BLOCK = 256


class Graph:
    """Vectors ``x`` and their edges (``-1``: none); ``entry`` is where searches start."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int):
        self.x, self.edges, self.entry = np.ascontiguousarray(x, np.float32), edges, entry
        self.square = np.einsum("ij,ij->i", self.x, self.x)

    def search(self, q: np.ndarray, beam: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and distances (short of the query's own square) of the ``beam``
        nearest found of each query, nearest first; ``-1`` where there are fewer."""
        n, count = len(self.x), len(q)
        ids, dist = np.full((count, beam), -1, np.int64), np.full((count, beam), np.inf, np.float32)
        open_, seen = np.zeros((count, beam), bool), np.zeros((count, n), bool)
        ids[:, 0], open_[:, 0], seen[:, self.entry] = self.entry, True, True
        dist[:, 0] = self.square[self.entry] - 2 * (q @ self.x[self.entry])
        live = np.arange(count)
        while len(live):
            nth = np.cumsum(open_[live], axis=1)
            take = open_[live] & (nth <= expand)
            live = live[nth[:, -1] > 0]
            row, col = np.nonzero(take[nth[:, -1] > 0])
            at = live[row]
            open_[at, col] = False
            to = self.edges[ids[at, col]]
            key = (at[:, None] * n + to)[to >= 0]
            key = np.unique(key[~seen.ravel()[key]])
            if not len(key):
                continue
            seen.ravel()[key] = True
            who, what = np.divmod(key, n)
            d = self.square[what] - 2 * np.einsum("ij,ij->i", self.x[what], q[who])
            better = d < dist[who, -1]
            who, what, d = who[better], what[better], d[better]
            if not len(who):
                continue
            rows, first, many = np.unique(who, return_index=True, return_counts=True)
            place = np.arange(len(who)) - np.repeat(first, many)
            line = np.repeat(np.arange(len(rows)), many)
            new_d = np.full((len(rows), int(many.max())), np.inf, np.float32)
            new_i = np.full(new_d.shape, -1, np.int64)
            new_d[line, place], new_i[line, place] = d, what
            all_d = np.concatenate([dist[rows], new_d], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[rows] = np.take_along_axis(all_d, order, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new_i], axis=1), order, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], new_i >= 0], axis=1), order, 1)
        return ids, dist


def pruned(x: np.ndarray, of: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of the candidates ``near`` (``-1``: none) of each vector ``of``.

    The nearest is kept, and every candidate goes that lies closer to it, by the
    factor ``alpha``, than to the vector itself; then the nearest of the rest, and so on.
    """
    out = np.full((len(of), degree), -1, np.int64)
    c = x[np.maximum(near, 0)]
    d = ((c - x[of][:, None, :]) ** 2).sum(axis=2)
    d[(near < 0) | (near == of[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, near = np.take_along_axis(d, order, 1), np.take_along_axis(near, order, 1)
    twin = np.zeros(near.shape, bool)
    by_id = np.argsort(near, axis=1, kind="stable")
    ranked = np.take_along_axis(near, by_id, 1)
    np.put_along_axis(twin, by_id[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    c = np.take_along_axis(c, order[:, :, None], 1)
    square = np.einsum("ijk,ijk->ij", c, c)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))
    alive = np.isfinite(d) & ~twin
    line = np.arange(len(of))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = near[line[some], first[some]]
        alive &= ~((alpha * alpha * between[line, first] <= d) & some[:, None])
        alive[line, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = 11,
                batch: int = BATCH) -> Graph:
    """The graph of distinct vectors ``x``; the same for the same vectors in the same order."""
    n = len(x)
    g = Graph(x, np.full((n, degree), -1, np.int64), 0)
    x = g.x
    g.entry = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([g.entry], order[order != g.entry]))
    done = min(n, 2 * degree)
    start = order[:done]
    g.edges[start] = pruned(x, start, np.tile(start, (done, 1)), degree, alpha)
    while done < n:
        new = order[done:done + min(batch, done)]
        near, _ = g.search(x[new], beam)
        g.edges[new] = pruned(x, new, near, degree, alpha)
        _add_back(g, new, degree, alpha)
        done += len(new)
    _reach_all(g, beam, batch)
    return g


def _reach_all(g: Graph, beam: int, batch: int) -> None:
    """Edges, beyond the degree, to the vectors that no path from the entry leads to
    any more (pruning took the last edge to them), each from the nearest one found."""
    while True:
        reached = np.zeros(len(g.x), bool)
        front = np.array([g.entry])
        while len(front):
            reached[front] = True
            to = np.unique(g.edges[front])
            front = to[(to >= 0) & ~reached[np.maximum(to, 0)]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return
        host = np.concatenate([g.search(g.x[lost[i:i + batch]], beam)[0][:, 0] for i in range(0, len(lost), batch)])
        order = np.argsort(host, kind="stable")
        lost, host = lost[order], host[order]
        _, first, many = np.unique(host, return_index=True, return_counts=True)
        place = np.arange(len(host)) - np.repeat(first, many)
        near = place < 2  # the others once these lead on to them
        extra = np.full((len(g.x), 2), -1, np.int64)
        extra[host[near], place[near]] = lost[near]
        g.edges = np.concatenate([g.edges, extra], axis=1)


def _add_back(g: Graph, new: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back to ``new`` from the vectors that its edges lead to."""
    to = g.edges[new]
    source, target = np.repeat(new, to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, many = np.unique(target, return_index=True, return_counts=True)
    free = (g.edges[nodes] < 0).sum(axis=1)
    room = many <= free
    place = np.arange(len(target)) - np.repeat(first, many)
    fits = np.repeat(room, many)
    g.edges[target[fits], (degree - np.repeat(free, many) + place)[fits]] = source[fits]
    full = np.flatnonzero(~room)
    for i in range(0, len(full), 512):  # lists that overflow are pruned, those of like length together
        some = full[i:i + 512]
        extra = np.full((len(some), int(many[some].max())), -1, np.int64)
        for j, s in enumerate(some.tolist()):
            extra[j, :many[s]] = source[first[s]:first[s] + many[s]]
        g.edges[nodes[some]] = pruned(g.x, nodes[some], np.concatenate([g.edges[nodes[some]], extra], axis=1), degree, alpha)


def centred(x: np.ndarray, mean: np.ndarray, scale: float) -> np.ndarray:
    """What graphs are searched on: distances in proportion, without the digits that all vectors share."""
    return ((x - mean) / scale).astype(np.float32)


GRAPH = "dim int, shard int, entry int, vecs binary, edges binary, ids binary, ends binary"
BLOCK = "dim int, number bigint, q_ids binary, q_vecs binary"
FOUND = "number bigint, q_ids binary, worth binary, ids binary, filled binary"


def _build(dtype: str, degree: int, alpha: float, beam: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = matrix(table.column("vec").combine_chunks(), dtype).astype(np.float64)
        mean = (x / len(x)).sum(axis=0)
        scale = float(np.abs(x - mean).max()) or 1.0
        g = build_graph(centred(x, mean, scale), degree, alpha, beam)
        ids = table.column("ids").combine_chunks()
        return pa.Table.from_batches([batch_of([{
            "dim": x.shape[1], "shard": table.column("shard")[0].as_py(), "entry": g.entry, "vecs": x.tobytes(),
            "edges": g.edges.astype(np.int32).tobytes(), "ids": ids.flatten().to_numpy().tobytes(),
            "ends": ids.offsets.to_numpy().astype(np.int64).tobytes()}], GRAPH)])
    return run


def _query_block(dtype: str):
    def row(table: pa.Table) -> dict:
        return {"q_ids": table.column("id").to_numpy().tobytes(),
                "q_vecs": matrix(table.column("vec").combine_chunks(), dtype).astype(np.float64).tobytes()}
    return row


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision; scaled only where the squares would overflow or vanish."""
    with np.errstate(over="ignore"):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
    odd = ~np.isfinite(d) | (d < 1e-150)
    if odd.any():
        gap = np.abs(x[odd] / 4 - q[odd] / 4)
        top = np.maximum(gap.max(axis=1), np.finfo(np.float64).tiny)
        d[odd] = 4 * (top * np.sqrt(((gap / top[:, None]) ** 2).sum(axis=1)))
    return d


def _search(k: int, beam: int):
    def run(shards: Iterator[dict], blocks: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Best, bytes]] = {}
        for r in shards:
            x = np.frombuffer(r["vecs"], np.float64).reshape(-1, r["dim"])
            mean = (x / len(x)).sum(axis=0)
            scale = float(np.abs(x - mean).max()) or 1.0
            g = Graph(centred(x, mean, scale), np.frombuffer(r["edges"], np.int32).reshape(len(x), -1).astype(np.int64), r["entry"])
            ids, ends = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ends"], np.int64)
            for block in blocks.get(r["dim"], []):
                own, q = np.frombuffer(block["q_ids"], np.int64), np.frombuffer(block["q_vecs"], np.float64).reshape(-1, r["dim"])
                best = held.setdefault(block["number"], (Best(len(q), k), block["q_ids"]))[0]
                found, _ = g.search(centred(q, mean, scale), beam)
                who, col = np.nonzero(found >= 0)
                what = found[who, col]
                score = distances(x[what], q[who])
                many = ends[what + 1] - ends[what]
                line = np.repeat(np.arange(len(what)), many)
                copy = ids[np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many) + ends[what][line]]
                other = copy != own[who][line]
                best.add(who[line][other], -score[line][other], copy[other])
        yield from batches_of(({"number": n, "q_ids": q_ids} | best.packed() for n, (best, q_ids) in held.items()), FOUND)
    return run


def _answers(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        q_ids = np.frombuffer(rows[0]["q_ids"], np.int64)
        best = Best(len(q_ids), k)
        for r in rows:
            best.merge(r)
        who, rank = np.nonzero(best.filled)
        return pa.table({"query_id": q_ids[who], "rank": (rank + 1).astype(np.int32), "id": best.ids[who, rank],
                         "score": np.abs(best.worth[who, rank])})
    return run


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
                       shard_vectors: int = SHARD_VECTORS, degree: int = DEGREE, alpha: float = ALPHA,
                       build_beam: int = BUILD_BEAM, query_beam: int = QUERY_BEAM) -> DataFrame:
    """The ``k`` nearest other rows (Euclidean) found for the rows that meet ``queries``.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller
    id; all candidates where there are fewer than ``k``. Every row is indexed and
    every shard searched; ``score`` is exact, the search approximate.

    Null ids and null, empty, all-zero vectors, or such with null or non-finite
    components, take no part. Vectors are compared with those of their own length
    only. Rows with a query's id are its own row and never its answer; repeated
    rows count once, equal vectors under other ids are answers of their own. No
    rows give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    usable, dtype = vector_columns(vectors, id_col, vector_col, _query=F.coalesce(queries, F.lit(False)))
    zero = F.forall("vec", lambda x: x == 0)
    with scratch(spark, "neighbours") as s, operator_conf(spark):
        plain = F.transform("vec", lambda x: x + F.lit(0.0).cast(usable.schema["vec"].dataType.elementType))  # -0.0 becomes 0.0
        rows = s.table(usable.where(~zero).withColumn("vec", plain)
                       .withColumn("node", F.sha2(F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))), 256))
                       .withColumn("dim", F.size("vec")), "rows")
        some = first_n_per_group(rows.select("node", "id", "dim", "vec").dropDuplicates(["node", "id"]), ["node"], ["id"], k + 1)
        nodes = s.table(some.groupBy("node", "dim").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids")), "nodes")
        shards = -(-nodes.count() // shard_vectors)
        if not shards:
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).repartition(cell_files(shards, shuffle_width(spark)), "dim", "shard")
        graphs = s.table(dealt.groupBy("dim", "shard").applyInArrow(
            _build(dtype, degree, alpha, build_beam), GRAPH), "graphs")
        asked = s.table(rows.where("_query").dropDuplicates(["node", "id"]).select("id", "dim", "vec"), "asked")
        packed = asked.repartition(-(-asked.count() // (8 * QUERY_BLOCK)) or 1, "id")
        blocks = s.table(packed.mapInArrow(pack(QUERY_BLOCK, BLOCK, _query_block(dtype)), BLOCK), "blocks")
        found = met(s, graphs, blocks, "number", _search(k, query_beam), FOUND, "found")
        out = found.groupBy("number").applyInArrow(_answers(k), "query_id bigint, rank int, id bigint, score double")
        return s.table(out.withColumnRenamed("id", "vec_id"), "result", keep=True)
