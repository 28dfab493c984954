"""H1: the test-then-train loop as a Structured Streaming job.

Each micro-batch is scored with the state left by earlier batches and then
folded into it:

* the batch is sequenced (range buckets, as in batch mode), so rows inside a
  batch see each other in stream order;
* prior sums come from the state tables plus two-level running sums inside
  the batch; the rolling window gets the last ``w - 1`` labelled rows of the
  state as halo rows;
* outputs go to ``out_dir/batch_id=<id>`` and the new state to
  ``state_dir/v<id>`` (both overwritten on replay), so a batch that runs again
  after a failure produces the same files; the state of batch ``b`` is read
  from the latest version below ``b``.

The result over all batches equals the batch flagship query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import shrink
from tidemark.plans.ordering import _null_safe_join, rolling, running, running_sums, sequence

PAIR = ("pu_zone", "do_zone")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def state_versions(spark: SparkSession, state_dir: str) -> list[int]:
    fs, p = _fs(spark, state_dir)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(st.getPath().suffix("/_COMMITTED")):
            out.append(int(name[1:]))
    return sorted(out)


def _mark_committed(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path + "/_COMMITTED")
    fs.create(p, True).close()


class PrequentialStream:
    """Stateful scoring of the zone-pair memory predictor with cumulative and
    rolling metrics (the flagship), one micro-batch at a time."""

    def __init__(self, state_dir: str, out_dir: str, order: Sequence[str] = ("pickup_datetime", "seq"),
                 y: str = "target", k: float = 20.0, window: int = 1000, n_buckets: int | None = None):
        self.state_dir, self.out_dir = state_dir.rstrip("/"), out_dir.rstrip("/")
        self.order, self.y, self.k, self.w, self.n_buckets = list(order), y, k, window, n_buckets

    # ---------------------------------------------------------------- state
    def _load(self, spark: SparkSession, batch_id: int):
        prior = [v for v in state_versions(spark, self.state_dir) if v < batch_id]
        if not prior:
            return None
        base = f"{self.state_dir}/v{prior[-1]}"
        return {name: spark.read.parquet(f"{base}/{name}") for name in ("scalars", "pairs", "tail")}

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        y = F.col(self.y)
        st = self._load(spark, batch_id)
        if st is None:
            sc = dict(gidx=0, lidx=0, gs=0.0, gn=0, mn=0, sa=0.0, sq=0.0, tn=0, tmean=0.0, tm2=0.0)
        else:
            sc = st["scalars"].first().asDict()

        lab = y.isNotNull()
        seq = sequence(batch, self.order, self.n_buckets)
        # one pass for both indexes and the global label sums (exclusive = inclusive - own row)
        seq = running(seq, sums={"_gc": F.lit(1).cast("long"), "_lc": lab.cast("long"), "_gsi": y,
                                 "_gni": lab.cast("long")}, inclusive=True)
        seq = seq.with_df(seq.df.withColumn("_g", F.col("_gc") - 1)
                          .withColumn("_l", F.when(lab, F.col("_lc") - 1))
                          .withColumn("_gs", F.col("_gsi") - F.coalesce(y, F.lit(0.0)))
                          .withColumn("_gn", F.col("_gni") - lab.cast("long")))
        seq = running_sums(seq, {"_ps": y, "_pn": lab.cast("long")}, inclusive=False, keys=list(PAIR))
        df = seq.df
        if st is not None:
            df = _null_safe_join(df, st["pairs"].select(*PAIR, F.col("n").alias("_pn0"), F.col("s").alias("_ps0")), list(PAIR))
        else:
            df = df.withColumn("_pn0", F.lit(0).cast("long")).withColumn("_ps0", F.lit(0.0))
        pn = F.col("_pn") + F.coalesce(F.col("_pn0"), F.lit(0))
        psum = F.col("_ps") + F.coalesce(F.col("_ps0"), F.lit(0.0))
        gn = F.col("_gn") + F.lit(sc["gn"])
        g = F.when(gn > 0, (F.col("_gs") + F.lit(sc["gs"])) / gn).otherwise(F.lit(0.0))
        df = (df.withColumn("gidx", F.col("_g") + F.lit(sc["gidx"]))
                .withColumn("lidx", F.col("_l") + F.lit(sc["lidx"]))
                .withColumn("g", g).withColumn("te_pair_n", pn)
                .withColumn("te_pair_long", F.when(pn > 0, psum / pn))
                .withColumn("prediction", shrink("te_pair_n", "te_pair_long", "g", self.k)))
        err = y - F.col("prediction")
        df = df.withColumn("abs_err", F.abs(err)).withColumn("sq_err", err * err)
        scored = seq.with_df(df)

        # cumulative metrics: batch running sums + state (target moments merged by Chan)
        m = running(scored, sums={"_mn": lab.cast("long"), "_sa": F.when(lab, F.col("abs_err")),
                                  "_sq": F.when(lab, F.col("sq_err"))}, moments={"_t": y}, inclusive=True)
        n_all = F.col("_mn") + F.lit(sc["mn"])
        na, ma, m2a = F.lit(float(sc["tn"])), F.lit(float(sc["tmean"])), F.lit(float(sc["tm2"]))
        nb, mb, m2b = F.col("_t_n").cast("double"), F.coalesce(F.col("_t_mean"), F.lit(0.0)), F.col("_t_m2")
        nt = na + nb
        d = mb - ma
        m2 = F.when(nt > 0, m2a + m2b + d * d * na * nb / nt).otherwise(F.lit(0.0))
        sq_all = F.col("_sq") + F.lit(sc["sq"])
        out = m.df.select(
            "*", n_all.alias("n"),
            F.when(n_all > 0, (F.col("_sa") + F.lit(sc["sa"])) / n_all).otherwise(F.lit(0.0)).alias("mae"),
            F.when(n_all > 0, F.sqrt(sq_all / n_all)).otherwise(F.lit(0.0)).alias("rmse"),
            F.when((n_all < 2) | (m2 <= 1e-12), F.lit(0.0)).otherwise(1 - sq_all / m2).alias("r2"))
        out = out.cache()

        # rolling window: state tail rows are halo rows in front of the batch
        cols = ["record_id", "gidx", "prediction", "n", "mae", "rmse", "r2"]
        cur = out.where(lab).select(*cols, "lidx", "abs_err", F.lit(False).alias("_tail"))
        if st is not None:
            tail = st["tail"].select("lidx", "abs_err", F.lit(True).alias("_tail"))
            cur = cur.unionByName(tail, allowMissingColumns=True)
        roll = rolling(cur, "lidx", self.w, {"_sa": F.col("abs_err"), "_c": F.lit(1).cast("long")}).where(~F.col("_tail"))
        scored = roll.select(*cols, (F.col("_sa") / F.col("_c")).alias("rolling_mae"))
        unlabelled = out.where(~lab).select(*cols, F.lit(None).cast("double").alias("rolling_mae"))
        scored.unionByName(unlabelled).write.mode("overwrite").parquet(f"{self.out_dir}/batch_id={batch_id}")

        # new state
        tot = out.agg(F.count(F.lit(1)).alias("rows"), F.count(self.y).alias("labels"),
                      F.sum(self.y).alias("s"), F.sum(F.when(lab, F.col("abs_err"))).alias("sa"),
                      F.sum(F.when(lab, F.col("sq_err"))).alias("sq"),
                      F.avg(self.y).alias("mean"), (F.var_pop(self.y) * F.count(self.y)).alias("m2")).first()
        nbt = float(tot["labels"] or 0)
        mbt = float(tot["mean"] or 0.0)
        nn = sc["tn"] + nbt
        dd = mbt - sc["tmean"]
        new = dict(
            gidx=sc["gidx"] + int(tot["rows"]), lidx=sc["lidx"] + int(nbt), gs=sc["gs"] + float(tot["s"] or 0.0),
            gn=sc["gn"] + int(nbt), mn=sc["mn"] + int(nbt), sa=sc["sa"] + float(tot["sa"] or 0.0),
            sq=sc["sq"] + float(tot["sq"] or 0.0), tn=int(nn),
            tmean=(sc["tmean"] + dd * nbt / nn) if nn else 0.0,
            tm2=(sc["tm2"] + float(tot["m2"] or 0.0) + dd * dd * sc["tn"] * nbt / nn) if nn else 0.0)
        base = f"{self.state_dir}/v{batch_id}"
        spark.createDataFrame([new]).write.mode("overwrite").parquet(f"{base}/scalars")
        pairs_b = out.where(lab).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.sum(self.y).alias("s"))
        if st is not None:
            pairs_b = st["pairs"].unionByName(pairs_b).groupBy(*PAIR).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        pairs_b.write.mode("overwrite").parquet(f"{base}/pairs")
        keep = new["lidx"] - (self.w - 1)
        tail = cur.where(F.col("lidx") >= keep).select("lidx", "abs_err")
        tail.write.mode("overwrite").parquet(f"{base}/tail")
        _mark_committed(spark, base)
        out.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, trigger_available_now: bool = True):
        w = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if trigger_available_now else w
        return w.start()
