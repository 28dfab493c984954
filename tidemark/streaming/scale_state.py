"""H3: the all-scales detector on a stream.

State are light tables in the shared folder: the exact running sums at every block
boundary (an append-only log, cut into chunks of boundaries) and a row a series
with its open block and where its window starts. A micro-batch adds its rows up
by block first, so a hot series is split; then it looks up the few earlier
boundaries that its own ones are compared with, and reads only their chunks.
Sums are exact decimals, so the alarms do not depend on how the stream was cut
into micro-batches, and a batch that runs again writes the same tables again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.drift import ADWIN_DELTA
from tidemark.operators.scales import _EXACT, BLOCK_ROWS, SUMS, block_sums, restarted, scale_tests
from tidemark.plans.ordering import materialize, running, sequence
from tidemark.streaming.prequential import _mark_committed, state_versions

CHUNK = 4096  # boundaries of a chunk of the log


class ScaleStream:
    """Alarms of ``scale_alarms`` per series of a stream, batch by batch.

    ``idx`` counts a series' rows from 0 without gaps, and the rows of a batch come
    after those of the batches before it. Null errors keep their place; null series
    are a series. Alarms go to ``out_dir/batch_id=<id>``. Tests end at full blocks;
    ``finish`` gives the alarms at the open ones.
    """

    def __init__(self, state_dir: str, out_dir: str, series: Sequence[str], err: str = "err", idx: str = "i",
                 block: int = BLOCK_ROWS, delta: float = ADWIN_DELTA):
        self.state_dir, self.out_dir = state_dir.rstrip("/"), out_dir.rstrip("/")
        self.series, self.err, self.idx, self.block, self.delta = list(series), err, idx, block, delta

    def _tail(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        versions = [v for v in state_versions(spark, self.state_dir) if before is None or v < before]
        return spark.read.parquet(f"{self.state_dir}/v{versions[-1]}/tail") if versions else None

    def _log(self, spark: SparkSession, ends: DataFrame, until: int) -> DataFrame:
        """The logged boundaries in the chunks that tests at ``ends`` reach back to."""
        level = F.explode(F.sequence(F.lit(1), F.floor(F.log2(F.col("b").cast("double"))).cast("int")))
        back = ends.where("b >= 2").select("b", level.alias("_l")).select(F.floor((F.col("b") - F.expr("shiftleft(1L, _l)")) / CHUNK).alias("c"))
        own = ends.where("b >= 2").select(F.floor((F.col("b") - 1) / CHUNK).alias("c"))
        chunks = [r["c"] for r in back.union(own).distinct().collect()]  # a few a level for each chunk of the batch
        log = spark.read.option("basePath", f"{self.state_dir}/log").parquet(f"{self.state_dir}/log")
        return log.where(F.col("chunk").isin(chunks) & (F.col("batch") <= until)).select(*self.series, "b", *SUMS, "_last")

    def _same(self, a: DataFrame, b: DataFrame):
        cond = F.lit(True)
        for k in self.series:
            cond = cond & a[k].eqNullSafe(b[f"_of_{k}"])
        return cond

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark, keys = batch.sparkSession, self.series
        blocks = block_sums(batch, self.err, self.idx, self.block, keys)
        known = self._tail(spark, batch_id)
        if known is not None:
            blocks = blocks.unionByName(known.where("_last >= b * %d" % self.block).select(*keys, "b", *SUMS, "_last"))
        blocks = materialize(blocks.groupBy(*keys, "b").agg(
            F.sum("_n").alias("_n"), *[F.sum(c).cast(_EXACT).alias(c) for c in SUMS[1:]], F.max("_last").alias("_last")))
        full = blocks.where(F.col("_last") == (F.col("b") + 1) * self.block - 1)
        sums = running(sequence(full, [*keys, "b"], materialize=False), sums={c + "p": F.col(c) for c in SUMS}, keys=keys).df
        base = "_n long, _s decimal(38,12), _q decimal(38,12)"
        if known is None:
            old = blocks.select(*keys).distinct()
            old = old.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[F.lit(0).cast(t.split()[1]).alias("_o" + t.split()[0]) for t in base.split(", ")],
                             F.lit(0).cast("long").alias("_p"))
        else:
            old = known.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[F.col("_base" + c).alias("_o" + c) for c in SUMS], "_p")
        j = sums.join(old, self._same(sums, old), "left")
        grown = lambda c: (F.col(c + "p") + F.coalesce(F.col("_o" + c), F.lit(0))).cast("long" if c == "_n" else _EXACT)
        ends = materialize(j.select(*keys, (F.col("b") + 1).alias("b"), *[grown(c).alias(c) for c in SUMS], "_last"))
        seen = blocks.select(*keys).distinct()
        fresh = seen if known is None else seen.join(old, self._same(seen, old), "left_anti")
        zero = fresh.select(*keys, F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("_n"), *[F.lit(0).cast(_EXACT).alias(c) for c in SUMS[1:]],
                            F.lit(-1).cast("long").alias("_last"))
        log = zero.unionByName(ends).withColumn("chunk", F.floor(F.col("b") / CHUNK))
        log.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(f"{self.state_dir}/log/batch={batch_id}")
        fired = scale_tests(self._log(spark, ends, batch_id), ends, keys, self.delta)
        starts = fresh.select(*keys, F.lit(0).cast("long").alias("_p"))
        if known is not None:
            starts = starts.unionByName(known.select(*keys, "_p"))
        alarms = restarted(fired, keys, self.idx, starts)
        alarms.write.mode("overwrite").parquet(f"{self.out_dir}/batch_id={batch_id}")
        alarms = spark.read.schema(alarms.schema).parquet(f"{self.out_dir}/batch_id={batch_id}")
        self._write_tail(spark, blocks, ends, known, starts, alarms, batch_id)

    def _write_tail(self, spark, blocks, ends, known, starts, alarms, batch_id: int) -> None:
        """A row a series: sums before its open block, the block's own, and the window's start."""
        keys = self.series
        top = ends.groupBy(*keys).agg(F.max_by(F.struct(*SUMS, F.col("b")), "b").alias("e"))
        part = top.select(*keys, *[F.col(f"e.{c}").alias("_base" + c) for c in SUMS], F.col("e.b").alias("_bb"))
        if known is not None:
            part = part.unionByName(known.select(*keys, *["_base" + c for c in SUMS], "_bb"))
        zero = starts.select(*keys, F.lit(0).cast("long").alias("_base_n"), *[F.lit(0).cast(_EXACT).alias("_base" + c) for c in SUMS[1:]],
                             F.lit(0).cast("long").alias("_bb"))
        part = part.unionByName(zero).groupBy(*keys).agg(F.max_by(F.struct(*["_base" + c for c in SUMS], "_bb"), "_bb").alias("e")).select(*keys, "e.*")
        left = blocks.where(F.col("_last") < (F.col("b") + 1) * self.block - 1).select(
            *[F.col(k).alias(f"_of_{k}") for k in keys], "b", *SUMS, "_last")
        part = part.join(left, self._same(part, left), "left").drop(*[f"_of_{k}" for k in keys])
        part = part.withColumn("b", F.coalesce("b", "_bb")).withColumn("_last", F.coalesce(F.col("_last"), F.col("_bb") * self.block - 1))
        for c in SUMS:
            part = part.withColumn(c, F.coalesce(c, F.lit(0)).cast("long" if c == "_n" else _EXACT))
        start = starts.unionByName(alarms.select(*keys, F.col("cut").alias("_p"))).groupBy(*keys).agg(F.max("_p").alias("_p"))
        start = start.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_p")
        out = part.join(start, self._same(part, start)).drop(*[f"_of_{k}" for k in keys])
        out.write.mode("overwrite").parquet(f"{self.state_dir}/v{batch_id}/tail")
        _mark_committed(spark, f"{self.state_dir}/v{batch_id}")

    def finish(self, spark: SparkSession) -> DataFrame:
        """Alarms at the ends of the open blocks, as if the stream ended here."""
        tail = self._tail(spark).where(F.col("_last") >= F.col("b") * self.block)
        ends = tail.select(*self.series, (F.col("b") + 1).alias("b"), *[(F.col("_base" + c) + F.col(c)).cast("long" if c == "_n" else _EXACT).alias(c) for c in SUMS], "_last")
        ends = materialize(ends)
        log = self._log(spark, ends, 1 << 62)
        return restarted(scale_tests(log, ends, self.series, self.delta), self.series, self.idx, self._tail(spark).select(*self.series, "_p"))

    def start(self, stream: DataFrame, checkpoint: str, trigger_available_now: bool = True):
        w = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if trigger_available_now else w
        return w.start()
