"""Learning, inference, bundles and the registry (modelled on the reference's engine tests)."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import encoders as en
from tidemark.operators import models as mo
from tidemark.operators import registry as rg
from tidemark.sources.synthetic import drift_table


def test_stream_learns(spark):
    df = drift_table(spark, 4000, 5, seed=42, at_sample=10_000)
    pred = mo.continual_linear(df, [f"x{i}" for i in range(5)], "y", "i", batch_rows=100)
    from tidemark.plans.ordering import rolling

    err = pred.withColumn("ae", F.abs(F.col("y") - F.col("prediction")))
    roll = rolling(err, "i", 1000, {"_s": F.col("ae"), "_c": F.lit(1)}).withColumn("rolling_mae", F.col("_s") / F.col("_c"))
    early = roll.where((F.col("i") >= 200) & (F.col("i") < 400)).agg(F.avg("rolling_mae")).first()[0]
    late = roll.where(F.col("i") >= 3800).agg(F.avg("rolling_mae")).first()[0]
    assert late < early


def test_recovers_after_drift(spark):
    df = drift_table(spark, 4000, 3, seed=1, at_sample=2000, magnitude=2.0)
    pred = mo.continual_linear(df, ["x0", "x1", "x2"], "y", "i", batch_rows=100)
    err = pred.withColumn("ae", F.abs(F.col("y") - F.col("prediction")))
    just_after = err.where((F.col("i") >= 2000) & (F.col("i") < 2100)).agg(F.avg("ae")).first()[0]
    before = err.where((F.col("i") >= 1900) & (F.col("i") < 2000)).agg(F.avg("ae")).first()[0]
    assert just_after > before


def test_ridge_matches_numpy(spark):
    import numpy as np

    df = drift_table(spark, 500, 3, seed=3, at_sample=10_000)
    pdf = df.toPandas()
    x = pdf[["x0", "x1", "x2"]].to_numpy()
    y = pdf["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(3), xc.T @ yc)
    got = {r["term"]: r["coef"] for r in mo.fit_linear(df, ["x0", "x1", "x2"], "y", 2.0).collect()}
    assert all(abs(got[f"x{i}"] - w[i]) < 1e-8 for i in range(3))
    a = mo.linear_stats(df.where("i < 200"), ["x0", "x1", "x2"], "y")
    b = mo.linear_stats(df.where("i >= 200"), ["x0", "x1", "x2"], "y")
    wm, _ = mo.solve_ridge(a.merge(b), 2.0)
    assert np.allclose(wm, w, atol=1e-8)


def test_inference_does_not_change_state(spark):
    t = spark.createDataFrame([(0, "a", 10.0), (1, "a", 20.0), (2, "b", 5.0)], "seq long, k string, target double")
    state = en.fit_encoder(t, ["seq"], encoders=[("k",)])
    before = sorted(state[("k",)].collect())
    req = spark.createDataFrame([(9, "a", None), (10, "zz", None)], "seq long, k string, target double")
    one = en.apply_encoder(req, state).orderBy("seq").collect()
    two = en.apply_encoder(req, state).orderBy("seq").collect()
    assert one == two and sorted(state[("k",)].collect()) == before
    assert one[1]["te_k_long"] == one[1]["g_frozen"]  # unseen key -> global mean


def test_tree_predictions_within_seen_range(spark):
    from tidemark.plans.trips import trip_features

    f = trip_features(spark, "/root/testdata/sf0.001")
    train, test = f.where("seq < 800"), f.where("seq >= 800")
    m = mo.fit_tree(train, min_instances=20)
    lo, hi = train.agg(F.min("target"), F.max("target")).first()
    preds = m.transform(test).agg(F.min("prediction"), F.max("prediction")).first()
    assert lo <= preds[0] and preds[1] <= hi


def test_bundle_round_trip_and_warm_start(spark, tmp_dir):
    from tidemark.plans.trips import trip_features

    f = trip_features(spark, "/root/testdata/sf0.001")
    m = mo.fit_tree(f, min_instances=20)
    state = en.fit_encoder(f, ["pickup_datetime", "seq"], encoders=[("pu_zone", "do_zone")])
    mo.save_bundle(mo.Bundle(m, state, {"name": "trips"}, {"trained": 1}), f"{tmp_dir}/b")
    b = mo.load_bundle(spark, f"{tmp_dir}/b")
    p1 = [r["prediction"] for r in m.transform(f).orderBy("seq").collect()]
    p2 = [r["prediction"] for r in b.model.transform(f).orderBy("seq").collect()]
    assert p1 == p2
    assert mo.maybe_warm_start(spark, f"{tmp_dir}/b", "trips") is not None
    assert mo.maybe_warm_start(spark, f"{tmp_dir}/b", "synthetic") is None
    assert mo.maybe_warm_start(spark, f"{tmp_dir}/missing", "trips") is None


def test_registry_champion(spark, tmp_dir):
    root = f"{tmp_dir}/reg"
    v1 = rg.register(spark, root, "initial", 100, {"mae": 3.0}, "trips")
    rg.set_alias(spark, root, v1)
    v2 = rg.register(spark, root, "retrain", 200, {"mae": 2.5}, "trips")
    assert rg.champion(spark, root).first()["version"] == v1
    rg.set_alias(spark, root, v2)
    assert rg.champion(spark, root).first()["version"] == v2
    assert rg.versions(spark, root).count() == 2


def test_promotion_rule(spark):
    from tidemark.operators.evaluation import promotion_decision

    c = spark.createDataFrame([(1.0, 0.5)], "mae double, r2 double")
    h = spark.createDataFrame([(1.05, 0.4)], "mae double, r2 double")
    assert promotion_decision(c, h, 0.0).first()["promote"]
    assert not promotion_decision(c, h, 0.1).first()["promote"]
    assert promotion_decision(c, None).first()["promote"]


def test_score_uses_frozen_encoders(spark):
    from tidemark.plans.trips import trip_features

    f = trip_features(spark, "/root/testdata/sf0.001")
    train, test = f.where("seq < 800"), f.where("seq >= 800")
    state = en.fit_encoder(train, ["pickup_datetime", "seq"])
    feats = en.apply_encoder(train, state)
    m = mo.fit_tree(feats, numeric=list(mo.NUMERIC_FEATURES) + ["te_pu_zone_do_zone_long"], min_instances=20)
    a = mo.score(m, test, state).select("seq", "prediction").orderBy("seq").collect()
    b = mo.score(m, test, state).select("seq", "prediction").orderBy("seq").collect()
    assert a == b and len(a) == test.count()
    eta = mo.score_trips(mo.score(m, test, state)).first()
    assert abs(eta["eta_minutes"] - round(eta["eta_seconds"] / 60.0, 1)) <= 0.05 + 1e-9


def test_leaf_updates_merge_by_addition(spark):
    from tidemark.plans.trips import trip_features

    f = trip_features(spark, "/root/testdata/sf0.001")
    m = mo.fit_tree(f.where("seq < 600"), min_instances=30)
    a = mo.update_leaves(m, f.where("seq >= 600 AND seq < 800"))
    b = mo.update_leaves(m, f.where("seq >= 800"))
    both = mo.update_leaves(m, f.where("seq >= 600"))
    merged = a.unionByName(b).groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("sum_y").alias("s"))
    got = {r["leaf"]: (r["n"], round(r["s"], 6)) for r in merged.collect()}
    exp = {r["leaf"]: (r["n"], round(r["sum_y"], 6)) for r in both.collect()}
    assert got == exp


def test_metric_log_with_drift_counts(spark):
    from tidemark.operators.evaluation import metric_log

    m = spark.createDataFrame([(i, float(i)) for i in range(0, 2001)], "gidx long, mae double")
    events = spark.createDataFrame([("concept", 10, True), ("concept", 600, False), ("feature", 999, True),
                                    ("concept", 1000, True)], "type string, i long, validated boolean")
    got = {r["step"]: (r["concept_drift_events"], r["feature_drift_events"])
           for r in metric_log(m, cols=["mae"], events=events).collect()}
    assert got == {0: (0, 0), 500: (1, 0), 1000: (2, 1), 1500: (2, 1), 2000: (2, 1)}


def test_what_was_learned_when_shows_in_the_holdout(spark):
    rng = np.random.default_rng(12)
    n = 4000
    x = rng.normal(size=(n, 2))
    slope = np.where(np.arange(n) < 1500, 1.0, 4.0)  # the stream changes
    pdf = pd.DataFrame({"i": np.arange(n), "a": x[:, 0], "b": x[:, 1], "y": slope * x[:, 0] + x[:, 1] + rng.normal(size=n) * 0.1})
    df = spark.createDataFrame(pdf)
    maes = []
    for warm in (0.1, 0.7):
        cont, hold = mo.train_regime(df, ["a", "b"], "y", "i", n, warm_frac=warm, holdout_frac=0.2, batch_rows=100, window_batches=5)
        assert cont.count() == int(n * 0.8) - int(n * warm) and hold.count() == n - int(n * 0.8)
        maes.append(hold.agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0])
    assert maes[0] < maes[1]  # less of the old regime is kept for good


def test_continual_predictions_match_refits(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"i": np.arange(600), "a": rng.normal(5, 2, 600), "y": rng.normal(size=600)})
    pdf.loc[::9, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    for window in (None, 2):
        got = {r["i"]: r["prediction"] for r in mo.continual_linear(df, ["a"], "y", "i", 100, window_batches=window).collect()}
        for b in range(6):
            past = pdf[(pdf.i < b * 100) & (pdf.i >= (0 if window is None else (b - window) * 100)) & pdf.y.notna()]
            now = pdf[(pdf.i >= b * 100) & (pdf.i < (b + 1) * 100)]
            if past.empty:
                want = np.zeros(len(now))
            else:
                ac, yc = past.a - past.a.mean(), past.y - past.y.mean()
                w = (ac @ yc) / (ac @ ac + 2.0)
                want = past.y.mean() + w * (now.a - past.a.mean())
            assert np.allclose([got[i] for i in now.i], want, atol=1e-9)


def test_versions_claimed_by_another_writer_are_skipped(spark, tmp_dir):
    root = f"{tmp_dir}/reg2"
    assert rg._claim(spark, root, 1) and not rg._claim(spark, root, 1)
    assert rg.register(spark, root, "second writer", 1, {"mae": 1.0}) == 2


def test_continual_ridge_keeps_statistics_in_matrices(spark, monkeypatch):
    """Absent features and labels, a micro-batch without labels and one that is missing: equal to a plain loop,
    and the frame has no aggregate column a pair of features."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 3))
    yv = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 900)
    rows = [(i, *[None if (i + j) % 41 == 0 else float(v) for j, v in enumerate(x[i])], None if i % 7 == 0 or 200 <= i < 300 else float(yv[i])) for i in range(900) if not 500 <= i < 600]
    df = spark.createDataFrame(rows, "i bigint, a double, b double, c double, y double").repartition(5)
    aggregated = []
    group_by = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (aggregated.append(c) if c else None) or group_by(self, *c))
    got = {r["i"]: r["prediction"] for r in mo.continual_linear(df, ["a", "b", "c"], "y", "i", 100).collect()}
    monkeypatch.undo()
    assert not aggregated and len(got) == 800
    first = [r for r in rows if r[0] < 100 and r[4] is not None]
    mu = [np.mean([r[j] for r in first if r[j] is not None]) for j in (1, 2, 3, 4)]
    known = np.zeros((5, 5))
    for k in range(9):
        batch = [r for r in rows if r[0] // 100 == k]
        n = max(known[0, 0], 1.0)
        mx, my = known[0, 1:4] / n, known[0, 4] / n
        w = np.linalg.solve(known[1:4, 1:4] - n * np.outer(mx, mx) + 2.0 * np.eye(3), known[1:4, 4] - n * mx * my)
        for r in batch:
            want = None if any(v is None for v in r[1:4]) else mu[3] + my - w @ mx + w @ (np.array(r[1:4]) - mu[:3])
            if known[0, 0] == 0:
                want = 0.0
            assert (got[r[0]] is None) == (want is None) and (want is None or abs(got[r[0]] - want) < 1e-9)
        z = np.array([[1.0, *[0.0 if v is None else v - m for v, m in zip(r[1:], mu, strict=True)]] for r in batch if r[4] is not None]).reshape(-1, 5)
        known = known + z.T @ z
