"""One Gram matrix against least squares on each subset of the columns."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.gram import packed_gram, ridge_subsets
from tidemark.operators.models import linear_stats, solve_ridge


def table(n=3000, p=60, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p)) + 1000.0 * np.arange(p)
    y = x[:, :2] @ np.array([1.0, 2.0]) + rng.standard_normal(n)
    return pd.DataFrame({**{f"f{i}": x[:, i] for i in range(p)}, "target": y})


def test_sixty_columns_in_one_pass(spark):
    t = table()
    g = packed_gram(spark.createDataFrame(t).repartition(7), t.columns)
    c = t.to_numpy() - t.to_numpy().mean(axis=0)
    assert g.n == len(t)
    np.testing.assert_allclose(g.mean, t.to_numpy().mean(axis=0))
    np.testing.assert_allclose(g.moments, c.T @ c, atol=1e-4)


def test_subsets_equal_own_fits(spark):
    df = spark.createDataFrame(table(p=4)).repartition(5)
    g = packed_gram(df, ["f0", "f1", "f2", "f3", "target"])
    for fs in (["f0"], ["f3", "f1"], ["f2", "f0", "f3"], []):
        w, b = solve_ridge(g.stats(fs, "target"))
        w0, b0 = solve_ridge(linear_stats(df, fs))
        np.testing.assert_allclose([*w, b], [*w0, b0], rtol=1e-6, atol=1e-6)


def test_scores_and_absent_values(spark):
    t = table(n=400, p=2)
    t["extra"] = "x"
    train, hold = t.iloc[:300].copy(), t.iloc[300:].copy()
    train.loc[train.index[:7], "f0"] = np.nan
    train.loc[train.index[7:9], "f1"] = np.inf
    hold_df = spark.createDataFrame(hold).selectExpr("if(f0 < -1, null, f0) AS f0", "f1", "target", "extra AS setup")
    setups = {"none": [], "f1": ["f1"], "both": ["f1", "f0"]}
    got = {r["setup"]: r for r in ridge_subsets(spark.createDataFrame(train), hold_df, setups).collect()}
    full = train[np.isfinite(train[["f0", "f1"]]).all(axis=1)]
    for name, fs in setups.items():
        x = full[fs].to_numpy() - full[fs].to_numpy().mean(axis=0)
        w = np.linalg.solve(x.T @ x + 2 * np.eye(len(fs)), x.T @ (full.target - full.target.mean())) if fs else np.zeros(0)
        h = hold[hold.f0 >= -1] if "f0" in fs else hold
        e = h.target - (full.target.mean() + (h[fs].to_numpy() - full[fs].to_numpy().mean(axis=0)) @ w)
        r2 = 1 - (e ** 2).sum() / ((h.target - h.target.mean()) ** 2).sum()
        assert (got[name]["n_features"], got[name]["n"]) == (len(fs), len(h))
        assert got[name]["mae"] == pytest.approx(np.abs(e).mean(), rel=1e-6) and got[name]["r2"] == pytest.approx(r2, rel=1e-6, abs=1e-9)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "f0 double, target double")
    g = packed_gram(empty, ["f0", "target"])
    assert g.n == 0 and not g.moments.any()
    assert ridge_subsets(empty, empty, {"a": ["f0"]}).count() == 0
    assert ridge_subsets(empty, empty, {}).count() == 0
