"""H2 / H3: keyed state of streams.

H2 folds each micro-batch like the batch encoders do (range buckets, so a hot
key is split) and keeps the keys' states as versioned tables: a batch writes
the keys it changed, and every ``compact_every`` batches all of them. H3 runs a
sequential detector per series with ``applyInPandasWithState``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.functions.shipping import ship_by_value
from tidemark.plans.folds import prior_folds, raw_folds
from tidemark.plans.ordering import sequence
from tidemark.streaming.prequential import _fs, _mark_committed, state_versions

ship_by_value(__name__)


class EncoderStream:
    """H2: per row, the key's encoder state *before* its own label: ``n`` labels,
    cumulative mean ``long`` and one EWMA per horizon (first label sets the
    value). Shrinkage toward the global mean happens after.

    Outputs go to ``out_dir/batch_id=<id>``, states to ``state_dir/v<id>``; both are
    overwritten when a batch runs again, and a batch reads only states below
    its own id. Null keys are keys like any other.
    """

    def __init__(self, state_dir: str, out_dir: str, keys: Sequence[str], order: Sequence[str], y: str = "target",
                 alphas: Mapping[str, float] | None = None, keep: Sequence[str] = (), compact_every: int = 10):
        self.state_dir, self.out_dir = state_dir.rstrip("/"), out_dir.rstrip("/")
        self.keys, self.order, self.y, self.keep = list(keys), list(order), y, list(keep)
        self.alphas, self.compact_every = dict(alphas or {"med": 0.05, "short": 0.3}), compact_every

    def _fields(self) -> list[str]:
        return ["n", "s", "f", *(f"a_{h}" for h in self.alphas)]

    def _state(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """Each key's newest state: the last full version and the changes after it."""
        versions = [v for v in state_versions(spark, self.state_dir) if v < batch_id]
        full = [v for v in versions if _fs(spark, f"{self.state_dir}/v{v}/_FULL")[0].exists(_fs(spark, f"{self.state_dir}/v{v}/_FULL")[1])]
        versions = [v for v in versions if not full or v >= full[-1]]
        if not versions:
            return None
        parts = [spark.read.parquet(f"{self.state_dir}/v{v}/keys").withColumn("_v", F.lit(v)) for v in versions]
        if len(parts) == 1:
            return parts[0].drop("_v")
        every = reduce(DataFrame.unionByName, parts)
        newest = every.groupBy(*self.keys).agg(F.max_by(F.struct(*self._fields()), "_v").alias("e"))
        return newest.select(*self.keys, "e.*")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seq = sequence(batch, self.order)
        known = self._state(spark, batch_id)
        start = None
        if known is not None:  # only the keys of this batch
            own = seq.df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).distinct()
            start = {"e": known.join(own, [known[k].eqNullSafe(own[f"_k{i}"]) for i, k in enumerate(self.keys)], "left_semi")}
        out = prior_folds(seq, {"e": self.keys}, self.y, self.alphas, start).df
        out.select(*dict.fromkeys([*self.keys, *self.order, *self.keep]), F.col("e_n").alias("n"),
                   F.when(F.col("e_n") > 0, F.col("e_sum") / F.col("e_n")).alias("long"),
                   *[F.col(f"e_{h}").alias(h) for h in self.alphas]).write.mode("overwrite").parquet(f"{self.out_dir}/batch_id={batch_id}")
        changed = raw_folds(seq, {"e": self.keys}, self.y, self.alphas, start)["e"].select(*self.keys, *self._fields())
        base, whole = f"{self.state_dir}/v{batch_id}", known is None or batch_id % self.compact_every == 0
        if whole and known is not None:
            both = known.select(*self.keys, *self._fields(), F.lit(0).alias("_v")).unionByName(changed.withColumn("_v", F.lit(1)))
            changed = both.groupBy(*self.keys).agg(F.max_by(F.struct(*self._fields()), "_v").alias("e")).select(*self.keys, "e.*")
        changed.write.mode("overwrite").parquet(f"{base}/keys")
        if whole:
            fs, p = _fs(spark, f"{base}/_FULL")
            fs.create(p, True).close()
        _mark_committed(spark, base)

    def start(self, stream: DataFrame, checkpoint: str, trigger_available_now: bool = True):
        w = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if trigger_available_now else w
        return w.start()


def detector_state_stream(stream: DataFrame, series: Sequence[str], order: Sequence[str], value: str,
                          detector: str = "adwin", **params) -> DataFrame:
    """H3: an online drift detector per series; emits alarm rows
    ``(series..., order..., value)``. The detector lives pickled in the state."""
    from tidemark.operators.drift import DETECTORS

    series, order = list(series), list(order)
    cols = [*series, *[c for c in order if c not in series], value]
    out_schema = T.StructType([stream.schema[c] for c in cols])
    state_schema = T.StructType([T.StructField("blob", T.BinaryType())])
    make = DETECTORS[detector]

    def fn(key, pdfs, state):
        det = cloudpickle.loads(state.get[0]) if state.exists else make(**params)
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="mergesort")
        hits = [i for i, v in enumerate(pdf[value].to_numpy()) if not pd.isna(v) and det.update(float(v))]
        state.update((cloudpickle.dumps(det),))
        yield pdf.iloc[hits][cols]

    return stream.groupBy(*series).applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                          GroupStateTimeout.NoTimeout)
