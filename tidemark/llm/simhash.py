"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``r`` bits apart share a point at most ``ceil(r/2)``
bits from both. So every distinct fingerprint emits all its variants within
that half radius, variants are shuffled, and fingerprints that meet on one are
verified by their bit distance. Fingerprints on one variant are pairwise
within ``2 * ceil(r/2)`` bits, so a star of verified links stands for all
their pairs when ``r`` is even; for odd ``r`` further pivots are tried.

Volume: a radius of 4 means 2,081 variants a distinct fingerprint, at 10 bytes
each. They travel as packed blocks, one row a block and bucket, in ``passes``
jobs over disjoint parts of the variant space, so only ``1 / passes`` of them
are on disk at a time. The part of a variant is a linear map over GF(2) of its
bits, so each pass generates its own variants only.

A group of near copies meets in every bucket of every pass. So what the passes
have joined so far is contracted after the first, second and fourth of them:
from then on the fingerprints of a component carry its number, a bucket takes
them for one, and only links that join something new leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.components import connected_components, forest
from tidemark.llm.support import Scratch, operator_conf, row_key, scratch, shuffle_width

ship_by_value(__name__)

CHUNK = 4096          # fingerprints whose variants are built together
BUCKET_VARIANTS = 2_000_000  # variants of a bucket, on average: 20 MB in a task
CONTRACT_AFTER = (1, 2, 4)   # passes after which found components are contracted
#: Bit masks whose parities name the part of a variant (fixed values, any well-mixed ones do).
PARITY_MASKS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def fingerprint(text: bytes, shingle_words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of lower-cased (A-Z) words; repeats of a shingle count."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle_words, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i:i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(shingle_words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t or b"", shingle_words, seed) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("row_key"), b.column("doc_id"), pa.array(np.array(got, np.uint64).view(np.int64))],
                ["row_key", "doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """``(row_key, doc_id, fp)`` per row of ``docs``; null text counts as empty (fingerprint 0)."""
    light = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"),
                        F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    return light.mapInArrow(_fingerprint_batches(shingle_words, seed), f"row_key string, doc_id {kind}, fp bigint")


def ball_masks(half: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)], np.uint64)


def _part(x: np.ndarray, passes: int) -> np.ndarray:
    out = np.zeros(len(x), np.uint8)
    for t in range(passes.bit_length() - 1):
        out |= ((np.bitwise_count(x & np.uint64(PARITY_MASKS[t])) & 1) << t).astype(np.uint8)
    return out


def _bucket(variants: np.ndarray, buckets: int) -> np.ndarray:
    return (((variants * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _emit(half: int, passes: int, number: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball_masks(half)
        part = _part(masks, passes)
        own = [np.flatnonzero(part == p).astype(np.uint16) for p in range(passes)]

        def blocks(fps: np.ndarray, comps: np.ndarray) -> pa.RecordBatch:
            """A row a bucket; the variants of fingerprints with a component come last, only these carry its number."""
            known = np.argsort(comps >= 0, kind="stable")
            fps, comps = fps[known], comps[known]
            of = _part(fps, passes)
            variants, index, joined = [], [], []
            for some in (comps < 0, comps >= 0):
                for p in range(passes):
                    mine, use = fps[(of == p) & some], own[p ^ number]
                    variants.append((mine[:, None] ^ masks[use][None, :]).ravel())
                    index.append(np.tile(use, len(mine)))
                    joined.append(np.repeat(comps[(of == p) & some], len(use)))
            v, m, c = np.concatenate(variants), np.concatenate(index), np.concatenate(joined)
            at = _bucket(v, buckets).astype(np.uint32)
            order = np.argsort(at.astype(np.uint16) if buckets <= 65536 else at, kind="stable")
            v, m, c, at = v[order], m[order], c[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            edges = [*first.tolist(), len(at)]
            tail = (np.add.reduceat(c < 0, first) + first).tolist()
            c = c.astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array(at[first].astype(np.int32)), pa.array([v[a:b].tobytes() for a, b in pairwise(edges)], pa.binary()),
                 pa.array([m[a:b].tobytes() for a, b in pairwise(edges)], pa.binary()),
                 pa.array([c[a:b].tobytes() for a, b in zip(tail, edges[1:], strict=True)], pa.binary())],
                ["bucket", "variants", "masks", "comps"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)))
            while sum(len(f) for f, _ in held) >= CHUNK:
                fps, comps = (np.concatenate(x) for x in zip(*held, strict=True))
                yield blocks(fps[:CHUNK], comps[:CHUNK])
                held = [(fps[CHUNK:], comps[CHUNK:])]
        if sum(len(f) for f, _ in held):
            yield blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return run


def meeting_links(variants: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links among fingerprints that meet on a variant, verified by bit distance.

    Stars on a pivot per group; a member out of the pivot's reach becomes a
    pivot for the whole group, so every component inside the group is joined.
    """
    order = np.lexsort((fps, variants))
    variants, fps = variants[order], fps[order]
    first = np.concatenate(([True], variants[1:] != variants[:-1]))
    group = np.cumsum(first) - 1
    pivot = fps[np.flatnonzero(first)][group]
    near = np.bitwise_count(pivot ^ fps) <= distance
    far = np.unique(group[~near])
    pairs = np.unique(np.stack([pivot[near & ~first], fps[near & ~first]], axis=1), axis=0)
    out = [(a, b) for a, b in pairs.tolist() if a != b]
    for g in far.tolist():
        members = fps[group == g]
        for p in members[1:][np.bitwise_count(members[1:] ^ members[0]) > distance]:
            out += [(int(p), int(x)) for x in members[np.bitwise_count(members ^ p) <= distance] if x != p]
    return out


def _meet(half: int, distance: int):
    def run(table: pa.Table) -> pa.Table:
        masks = ball_masks(half)
        v = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("variants")])
        m = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("masks")])
        c = np.concatenate([np.concatenate((np.full(len(x.as_py()) // 8 - len(y.as_py()) // 4, -1), np.frombuffer(y.as_py(), np.uint32).astype(np.int64)))
                            for x, y in zip(table.column("variants"), table.column("comps"), strict=True)])
        s = np.sort(v)
        twice = s[1:][s[1:] == s[:-1]]
        marked = np.zeros(1 << 20, bool)  # cheap sieve before the exact test
        marked[(twice >> np.uint64(7)) & np.uint64(0xFFFFF)] = True
        some = np.flatnonzero(marked[(v >> np.uint64(7)) & np.uint64(0xFFFFF)])
        some = some[np.isin(v[some], twice)] if len(twice) else some[:0]
        fps = v[some] ^ masks[m[some]]
        links = meeting_links(v[some], fps, distance) if len(some) else []
        if links:  # fingerprints of one component count as the first of them here
            joined = c[some] >= 0
            of = dict(zip(fps[joined].tolist(), c[some][joined].tolist(), strict=True))
            first: dict = {}
            links = forest([tuple(first.setdefault(of[x], x) if x in of else x for x in pair) for pair in links])
        return pa.table({"a": pa.array(np.array([x for x, _ in links], np.uint64).view(np.int64), pa.int64()),
                         "b": pa.array(np.array([x for _, x in links], np.uint64).view(np.int64), pa.int64())})
    return run


def numbered(scratch: Scratch, comps: DataFrame) -> DataFrame:
    """``(node, number)``: components numbered without gaps, by their place in a written table."""
    at = F.monotonically_increasing_id()
    names = scratch.table(comps.select("component").distinct(), "names", few=True)
    names = scratch.table(names.select("component", F.shiftright(at, 33).alias("part"),
                                       at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "places")
    counts = {r["part"]: r["n"] for r in names.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    if total >= 1 << 32:
        raise ValueError("more components than 4-byte numbers can name")
    offsets = scratch.spark.createDataFrame(offsets, "part bigint, before bigint")
    of = names.join(F.broadcast(offsets), "part").select(F.col("component").alias("of"), (F.col("place") + F.col("before")).alias("number"))
    return scratch.table(comps.join(of, comps.component == F.col("of")).select("node", "number"), "numbers", few=True)


def linked_components(scratch: Scratch, nodes: DataFrame, max_distance: int, passes: int) -> DataFrame:
    """``(node, component)`` of the distinct fingerprints ``nodes(fp, ...)`` that have a link."""
    half = (max_distance + 1) // 2
    per_pass = nodes.count() * len(ball_masks(half)) // passes
    buckets = max(per_pass // BUCKET_VARIANTS, 2 * shuffle_width(scratch.spark))
    links, known = None, nodes.select("fp", F.lit(-1).cast("bigint").alias("number"))
    for number in range(passes):
        blocks = known.mapInArrow(_emit(half, passes, number, buckets), "bucket int, variants binary, masks binary, comps binary")
        part = scratch.table(blocks.groupBy("bucket").applyInArrow(_meet(half, max_distance), "a bigint, b bigint"),
                             f"links{number}", few=True)
        links = part if links is None else links.union(part)
        if number + 1 in CONTRACT_AFTER and number + 1 < passes:
            numbers = numbered(scratch, connected_components(scratch, links))
            known = nodes.join(numbers, nodes.fp == numbers.node, "left").select("fp", F.coalesce("number", F.lit(-1)).alias("number"))
    return connected_components(scratch, links)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4,
                  max_distance: int = 4, seed: int = 42, passes: int = 8) -> DataFrame:
    """Near-duplicate classes of ``docs`` by SimHash distance.

    Returns ``row_key, doc_id, fp, fingerprint (16 hex digits), component_id,
    kept`` per row. ``component_id`` is the smallest id reachable over links of
    at most ``max_distance`` bits. Equal fingerprints are one node, so copies
    cost one set of variants. Null, empty and blank texts have fingerprint 0
    and link like any other; null ids never name a component unless all its
    ids are null (then ``component_id`` is null). ``kept`` marks rows whose id is
    the component's; other columns of ``docs`` are not read. ``passes`` must be a
    power of two up to 32.
    """
    spark = docs.sparkSession
    if passes & (passes - 1) or not 1 <= passes <= 32:
        raise ValueError("passes must be a power of two up to 32")
    with scratch(spark, "simhash") as s, operator_conf(spark):
        rows = s.table(fingerprints(docs, id_col, text_col, shingle_words, seed), "rows")
        nodes = s.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes", few=True)
        comps = linked_components(s, nodes, max_distance, passes)
        named = nodes.join(comps, nodes.fp == comps.node, "left").select(
            "fp", "first_id", F.coalesce("component", "fp").alias("root"))
        ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        named = s.table(named.join(ids, "root").select(F.col("fp").alias("node_fp"), "component_id", "root"), "named", few=True)
        out = rows.join(named, rows.fp == named.node_fp).select(
            "row_key", "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
            "root", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
        return s.table(out, "result", keep=True, few=True)


def keep_one_per_class(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``simhash_dedup`` keeps, one a class; repeated rows stay once.

    ``classes`` may hold several rows with the kept id (repeated ids): the one
    with the smallest ``row_key`` stays.
    """
    keys = classes.where("kept").groupBy("root").agg(F.min("row_key").alias("__row_key")).select("__row_key")
    return (docs.withColumn("__row_key", row_key(id_col, text_col)).join(keys, "__row_key", "left_semi")
            .dropDuplicates(["__row_key"]).drop("__row_key"))
