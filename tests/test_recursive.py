"""The learner that moves with every row against a plain loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import recursive as rc
from tidemark.plans.ordering import sequence


def rows(n, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 1, n), rng.normal(0, 2, n)
    y = 3 + 2 * a - b + rng.normal(0, 0.1, n)
    y[n // 2:] += 4 * a[n // 2:]  # the slope changes
    return pd.DataFrame({"i": np.arange(n), "a": a, "b": b, "target": y})


def plain(pdf, features, forget, l2):
    p = len(features) + 1
    s, v, out = np.zeros((p, p)), np.zeros(p), []
    for r in pdf.itertuples():
        x = np.array([1.0, *[0.0 if np.isnan(getattr(r, f)) else getattr(r, f) for f in features]])
        out.append(x @ np.linalg.solve(s + l2 * np.eye(p), v))
        if not np.isnan(r.target):
            s, v = forget * s + np.outer(x, x), forget * v + r.target * x
    return np.array(out)


def predicted(spark, pdf, features, buckets=6, **kw):
    df = spark.createDataFrame(pdf)
    for c in ("target", *features):
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    seq = sequence(df.repartition(5), ["i"], buckets)
    return rc.recursive_least_squares(seq, features, **kw).df.orderBy("i").toPandas()["prediction"].to_numpy()


@pytest.mark.parametrize("forget", [1.0, 0.995, 0.2])
def test_predictions_equal_a_plain_loop(spark, forget):
    pdf = rows(10_000 if forget == 0.995 else 1500)
    pdf.loc[pdf.i % 7 == 0, "target"] = np.nan
    pdf.loc[pdf.i % 11 == 0, "a"] = np.nan
    assert np.allclose(predicted(spark, pdf, ["a", "b"], forget=forget), plain(pdf, ["a", "b"], forget, 1.0), atol=1e-7)


def test_the_cut_into_buckets_does_not_matter(spark):
    pdf = rows(2000, 1)
    one, many = (predicted(spark, pdf, ["a"], buckets=k, forget=0.99) for k in (1, 9))
    assert np.allclose(one, many, atol=1e-9)


def test_it_follows_a_change(spark):
    pdf = rows(4000, 2)
    late = slice(3500, None)
    err = lambda f: np.abs(predicted(spark, pdf, ["a", "b"], forget=f) - pdf["target"])[late].mean()
    assert err(0.99) < 0.15 < err(1.0)


def test_empty_unlabelled_and_wide(spark):
    pdf = rows(50, 3)
    assert len(predicted(spark, pdf.iloc[:1], ["a"])) == 1
    assert (predicted(spark, pdf.assign(target=np.nan), ["a"]) == 0).all()
    seq = sequence(spark.createDataFrame(pdf).limit(0), ["i"], 3)
    assert rc.recursive_least_squares(seq, ["a"]).df.count() == 0
    wide = rows(300, 4)
    names = [f"x{k}" for k in range(20)]
    wide[names] = np.random.default_rng(5).normal(0, 1, (300, 20))
    assert np.allclose(predicted(spark, wide, names, forget=0.99), plain(wide, names, 0.99, 1.0), atol=1e-7)
