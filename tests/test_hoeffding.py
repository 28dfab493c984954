"""Trees that grow with the stream: statistics, splits, weights and what they must learn."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import hoeffding as ht

GROWTH = ht.Growth({"a": (0.0, 1.0), "b": (0.0, 0.5)}, bins=16, grace=100, max_depth=3)


def rows(n, seed=0, shift=0.0):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 10, n), rng.uniform(0, 5, n)
    y = np.where(a < 4, 10.0, 20.0) + np.where((a >= 4) & (b > 2), 8.0, 0.0) + rng.normal(0, 1, n) + shift
    return pd.DataFrame({"lidx": np.arange(n), "a": a, "b": b, "target": np.round(y, 3)})


def plain(pdf, growth, cuts):
    """Plain loop: the same bound and edges on raw rows, a list of rows a leaf."""
    where = lambda v, f: -1 if math.isnan(v) else int(min(max(math.floor((v - growth.grids[f][0]) / growth.grids[f][1]), 0), growth.bins - 1))
    tree = {"rows": [], "old": [], "depth": 0}
    out = []

    def find(node, r):
        while "split" in node:
            f, b = node["split"]
            node = node["low"] if where(r[f], f) <= b else node["high"]
        return node

    def leaves(node):
        return leaves(node["low"]) + leaves(node["high"]) if "split" in node else [node]

    for part in cuts:
        batch = [pdf.iloc[i].to_dict() for i in part]
        for r in batch:
            leaf = find(tree, r)
            seen = [x["target"] for x in leaf["rows"] + leaf["old"]]
            out.append((int(r["lidx"]), float(np.mean(seen)) if seen else 0.0))
        for r in batch:
            if not math.isnan(r["target"]):
                find(tree, r)["rows"].append(r)
        for leaf in leaves(tree):
            n, best = len(leaf["rows"]), []
            if n < growth.grace or leaf["depth"] >= growth.max_depth:
                continue
            y = np.array([r["target"] for r in leaf["rows"]])
            for f in growth.grids:
                at = np.array([where(r[f], f) for r in leaf["rows"]])
                gains = [((((y - y.mean()) ** 2).sum() - sum(((s - s.mean()) ** 2).sum() for s in (y[at <= b], y[at > b]))) / n, -b)
                         for b in sorted(set(at))[:-1]]
                best.append((max(gains)[0], f, -max(gains)[1]) if gains else (0.0, f, None))
            best.sort(reverse=True)
            eps = math.sqrt(math.log(1 / growth.delta) / (2 * n))
            if best[0][0] > 0 and (best[1][0] / best[0][0] < 1 - eps or eps < growth.tie):
                _, f, b = best[0]
                leaf["split"] = (f, b)
                for side, keep in (("low", lambda r: where(r[f], f) <= b), ("high", lambda r: where(r[f], f) > b)):
                    leaf[side] = {"rows": [], "old": [r for r in leaf["rows"] if keep(r)], "depth": leaf["depth"] + 1}
    return out


def streamed(spark, pdf, growth, cuts, tmp):
    s = ht.TreeStream(f"{tmp}/state", f"{tmp}/out", growth)
    df = spark.createDataFrame(pdf).withColumn("target", F.when(~F.isnan("target"), F.col("target"))).repartition(5)
    for k, part in enumerate(cuts):
        s.process(df.where(F.col("lidx").between(int(part[0]), int(part[-1]))), k)
    return s, spark.read.parquet(f"{tmp}/out")


def test_scores_equal_a_plain_tree(spark, tmp_dir):
    pdf = rows(1500)
    pdf.loc[pdf.lidx % 17 == 0, "target"] = np.nan
    pdf.loc[pdf.lidx % 13 == 0, "b"] = np.nan
    cuts = np.array_split(np.arange(1500), 6)
    s, out = streamed(spark, pdf, GROWTH, cuts, tmp_dir)
    got = {r.lidx: r.prediction for r in out.collect()}
    wanted = plain(pdf, GROWTH, cuts)
    assert len(got) == len(wanted)
    assert all(abs(got[i] - p) < 1e-6 for i, p in wanted)
    tree = s.trees(spark).nodes[0]
    assert tree[0].feature == "a" and tree[0].bin == 3 and len(tree) > 3


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_dir):
    pdf = rows(600, 1)
    s, out = streamed(spark, pdf, GROWTH, np.array_split(np.arange(600), 3), tmp_dir)
    before = (s.trees(spark).node_rows(), sorted(s.trees(spark).stat_rows()), sorted(out.collect()))
    s.process(spark.createDataFrame(pdf[400:]), 2)
    assert (s.trees(spark).node_rows(), sorted(s.trees(spark).stat_rows()), sorted(spark.read.parquet(f"{tmp_dir}/out").collect())) == before


def test_late_error_is_below_early(spark, tmp_dir):
    _, out = streamed(spark, rows(3000, 2), GROWTH, np.array_split(np.arange(3000), 5), tmp_dir)
    mae = {r.batch_id: r.e for r in out.groupBy("batch_id").agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("e")).collect()}
    assert mae[4] < 0.4 * mae[1] + 0.6 and mae[4] < 1.2


def test_member_weights_and_forest(spark, tmp_dir):
    def weights(ids, members):
        laid = ht.with_weights(ids, "id", members).toPandas()
        return laid.pivot(index="id", columns="_m", values="_w")

    w = weights(spark.range(20_000), 3)
    assert abs(w.mean() - 1).max() < 0.05 and abs(w.var() - 1).max() < 0.08
    assert abs(np.corrcoef(w.to_numpy().T) - np.eye(3)).max() < 0.05
    assert (weights(spark.range(20_000).repartition(7), 3) == w).all(axis=None)
    pdf = rows(2000, 3)
    growth = ht.Growth(GROWTH.grids, bins=16, grace=100, max_depth=3, members=4)
    trees = ht.Trees(growth)
    trees.learn(ht.statistics(spark.createDataFrame(pdf).where("lidx < 50"), trees).collect(), 0)  # too few to split
    own = weights(spark.range(50), 4).to_numpy()
    for m in range(4):
        n, s = trees.totals(m, 0)
        assert n == own[:, m].sum() and abs(float(s) - own[:, m] @ pdf["target"][:50]) < 1e-6
    _, out = streamed(spark, pdf, growth, np.array_split(np.arange(2000), 4), tmp_dir)
    late = out.where("batch_id = 3").agg(F.avg(F.abs(F.col("target") - F.col("prediction")))).first()[0]
    assert late < 1.3 and out.agg(F.max("prediction")).first()[0] <= pdf["target"].max()


def test_empty_batch_and_constant_target(spark, tmp_dir):
    pdf = rows(400, 4).assign(target=5.0)
    s, out = streamed(spark, pdf, GROWTH, [np.arange(200), np.arange(200, 400)], tmp_dir)
    s.process(spark.createDataFrame(pdf).limit(0), 2)
    assert len(s.trees(spark).nodes[0]) == 1
    assert {r.prediction for r in out.where("batch_id = 1").collect()} == {5.0}


def test_many_arrivals_in_a_batch_make_the_same_trees(spark, tmp_dir):
    pdf = rows(900, 5)
    pdf.loc[pdf.lidx % 17 == 0, "target"] = np.nan
    growth = ht.Growth(GROWTH.grids, bins=16, grace=100, max_depth=2)
    df = spark.createDataFrame(pdf).withColumn("target", F.when(~F.isnan("target"), F.col("target"))).repartition(5)
    got = []
    for k, cuts in enumerate(([0, 300, 600, 900], [0, 900])):
        s = ht.TreeStream(f"{tmp_dir}/state{k}", f"{tmp_dir}/out{k}", growth, arrival=F.floor(F.col("lidx") / 300))
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            s.process(df.where((F.col("lidx") >= lo) & (F.col("lidx") < hi)), b)
        trees = s.trees(spark)
        scores = spark.read.parquet(f"{tmp_dir}/out{k}").select("lidx", "prediction")
        got.append((trees.node_rows(), sorted(trees.stat_rows()), sorted(tuple(r) for r in scores.collect())))
    assert got[0] == got[1] and len(got[0][0]) > 2


def test_sums_in_arrays_equal_exact_decimals(spark):
    """Members are drawn and summed in the tasks, no row a member, to the last digit of sums over rows as Spark draws them."""
    pdf = rows(3000, 6)
    pdf["lidx"] = pdf["lidx"] - 700  # also ids below 0
    pdf["target"] = pdf["target"] * np.where(pdf.lidx % 5 == 0, -1.0, 1 / 3) * np.where(pdf.lidx % 97 == 0, 1e7, 1.0)
    pdf.loc[pdf.lidx % 17 == 0, "target"] = np.nan
    pdf.loc[pdf.lidx % 13 == 0, "b"] = np.nan
    df = spark.createDataFrame(pdf).repartition(4)
    df = df.withColumn("lidx", F.when(F.col("lidx") % 101 != 0, F.col("lidx")))
    growth, exact = ht.Growth(GROWTH.grids, bins=16, members=3), "decimal(38,12)"
    got = ht.statistics(df, ht.Trees(growth))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    y = F.col("target").cast(exact)
    laid = ht.with_weights(ht.with_bins(df.where("NOT isnan(target)"), growth).withColumns({"y": y, "yy": (y * y).cast(exact)}), "lidx", 3)
    want = []
    for f in growth.grids:
        want += laid.where("_w > 0").groupBy("_m", F.lit(f).alias("f"), "_bin_" + f).agg(
            F.sum("_w"), *[F.sum((F.col("_w") * F.col(c)).cast(exact)).cast(exact) for c in ("y", "yy")]).collect()
    got = [(r.member, r.feature, r.bin, r.n, r.s, r.q) for r in got.collect()]
    assert sorted(got) == sorted(tuple(r) for r in want) and max(abs(g[5]) for g in got) > 2 ** 63 // 10 ** 6


def test_whole_numbers_beyond_a_long():
    import decimal

    import pyarrow as pa

    with decimal.localcontext(prec=60):
        values = [decimal.Decimal(v) for v in ("12345678901234567890.123456789012", "-98765432109876543210.5", "0.000000500000", "-0.0000005", "7")]
        units = ht._units(pa.array([*values, None], pa.decimal128(38, 12)).slice(0))
        assert units.tolist() == [int(v * 10 ** 12) for v in values] + [0]
        w = np.array([1, 12, 1, 3, 2, 1])
        sums = ht._Sums(2)
        for _ in range(3):
            sums.add(np.array([0, 0, 1, 1, 1, 1]), w, ht._weighted(w, units), ht._weighted(w, units))
        rounded = [(k * v).quantize(decimal.Decimal("1e-6"), decimal.ROUND_HALF_UP) for k, v in zip(w.tolist(), values)]
        got = ht._decimals(sums.total("s", np.arange(2))).to_pylist()
        assert got == [3 * sum(rounded[:2]), 3 * sum(rounded[2:])] and sums.n.tolist() == [39, 21]


def test_a_run_reads_its_own_rows_in_many_tasks(spark, monkeypatch):
    from pyspark.sql.types import LongType, StructField, StructType

    from tidemark.plans import trees

    for most in (1, 3, 4, 16, 512):
        total = 5 * most + 90
        laid = spark.range(total).select("id", trees.run_of(F.col("id"), most).alias("k")).collect()
        assert [r.k for r in sorted(laid)] == [k for k, (first, end) in enumerate(trees.stretches(total, most)) for _ in range(first, end)]
    schema = StructType([StructField(c, LongType() if c == "lidx" else spark.range(0).selectExpr("0D").schema[0].dataType)
                         for c in ("lidx", "target", *trees.GRIDS)])
    rng = np.random.default_rng(7)
    few = spark.createDataFrame([(i, *map(float, rng.uniform(0, 6, 4))) for i in range(7 * 50)], schema)
    seen, append = [], trees.sio.append_records

    def noted(df, folder):
        seen.append((df.rdd.getNumPartitions(), {f.split("/")[-2] for f in df.inputFiles()}))
        append(df, folder)

    monkeypatch.setattr(trees, "_rows", lambda *a: few)
    monkeypatch.setattr(trees, "ARRIVAL", 50)
    monkeypatch.setattr(trees.sio, "append_records", noted)
    scores, _ = trees.replay(spark, "", ht.Growth(trees.GRIDS, members=2))
    assert scores.count() == 350 and scores.select("lidx").distinct().count() == 350
    assert seen == [(1, {"_run=0"}), (4, {"_run=1"}), (2, {"_run=2"})]
