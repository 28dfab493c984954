"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of shard sums. Differencing takes the two
partial partitions with the largest spread and adds them oppositely ordered,
largest sum to smallest, until one is left. Groups (equal texts) are dealt to
buckets by their digest; each bucket is differenced in its own task and hands
on one partial partition, and those few tuples are differenced again. So the
driver sees ``buckets`` tuples, not groups.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_by_value
from tidemark.llm.support import operator_conf, scratch, shuffle_width

ship_by_value(__name__)


def difference(items: list[tuple[int, ...]]) -> tuple[list[tuple[int, ...]], tuple[int, ...]]:
    """Combine the partial partitions ``items`` (sums per part, equally many each).

    Returns for each item the shard of each of its parts, and the final sums.
    """
    k = len(items[0])
    # a node: (-spread, tie, sums, parts); parts[j] lists (item, part) pairs through the merge tree below
    heap, trees = [], []
    for i, sums in enumerate(items):
        order = sorted(range(k), key=sums.__getitem__)
        trees.append((i, order))
        heap.append((sums[order[0]] - sums[order[-1]], i, [sums[j] for j in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        merged = [x[j] + y[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=merged.__getitem__)
        sums = [merged[j] for j in order]
        trees.append((a, b, order))
        heapq.heappush(heap, (sums[0] - sums[-1], len(trees) - 1, sums))
    _, top, final = heap[0]
    # walk down: where[node][slot] is the shard of the node's slot
    where: dict[int, list[int]] = {top: list(range(k))}
    shards: list[tuple[int, ...]] = [()] * len(items)
    for node in range(len(trees) - 1, -1, -1):
        at = where.pop(node)
        order = trees[node][-1]
        by_source = [0] * k
        for slot, source in enumerate(order):
            by_source[source] = at[slot]
        if len(trees[node]) == 2:
            shards[trees[node][0]] = tuple(by_source)
        else:
            a, b, _ = trees[node]
            where[a] = by_source
            where[b] = by_source[::-1]
    return shards, tuple(final)


def _deal(shards: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: the local part of every group, and the bucket's sums on every row of its first part."""
        sizes = table.column("size").to_pylist()
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], table.column("digest")[i].as_py()))
        parts, sums = difference([(sizes[i],) + (0,) * (shards - 1) for i in order])
        part = [0] * len(sizes)
        for i, p in zip(order, parts, strict=True):
            part[i] = p[0]
        return pa.table({"bucket": table.column("bucket"), "digest": table.column("digest"), "size": table.column("size"),
                         "part": pa.array(part, pa.int32())})
    return run


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = [zlib.crc32(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), pa.array(np.array(crc, np.int64)), b.column("digest")],
                                         ["doc_id", "size", "text_crc32", "digest"])


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8,
                    buckets: int | None = None) -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` shards of near equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` (law
    ``bytes``; ``grown_shard`` is null). Size is the text's UTF-8 bytes plus 1;
    a null text counts as empty. Rows with equal texts stay together. Slots are
    gapless from 0 in each shard, in no particular order. Null or repeated ids
    keep their own rows; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * shuffle_width(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                        text.cast("binary").alias("text"), F.sha2(text, 256).alias("digest"))
    kind = light.schema["doc_id"].dataType.simpleString()
    with scratch(spark, "sharding") as s, operator_conf(spark):
        rows = s.table(light.mapInArrow(_crc_batches, f"doc_id {kind}, size bigint, text_crc32 bigint, digest string"), "rows")
        groups = rows.groupBy("digest").agg(F.sum("size").alias("size")).withColumn(
            "bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
        parts = s.table(groups.groupBy("bucket").applyInArrow(_deal(shards), "bucket int, digest string, size bigint, part int"), "parts", few=True)
        sums: dict[int, list[int]] = {}
        for r in parts.groupBy("bucket", "part").agg(F.sum("size").alias("n")).collect():  # buckets x shards rows
            sums.setdefault(r["bucket"], [0] * shards)[r["part"]] = r["n"]
        names = sorted(sums)
        dealt = difference([tuple(sums[b]) for b in names])[0] if names else []
        shard_of = spark.createDataFrame([(b, p, x) for b, d in zip(names, dealt, strict=True) for p, x in enumerate(d)],
                                         "bucket int, part int, shard int")
        placed = parts.join(F.broadcast(shard_of), ["bucket", "part"]).select(F.col("digest").alias("of"), "shard")
        located = s.table(rows.join(placed, rows.digest == F.col("of")).select(
            "doc_id", "size", "text_crc32", "shard",
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("slice")), "located", few=True)
        counts = located.groupBy("slice", "shard").agg(F.count("*").alias("n"))
        before = counts.select("slice", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("skip"))
        own = Window.partitionBy("slice", "shard").orderBy("doc_id", "text_crc32", "size")
        out = located.withColumn("rank", F.row_number().over(own).cast("bigint") - 1).join(F.broadcast(before), ["slice", "shard"])
        return s.table(out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                                  (F.col("rank") + F.col("skip")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")),
                       "result", keep=True, few=True)
