"""Regressions by triangles, ranks over time and exact medians, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from indexloom.functions import stats
from indexloom.functions.median import exact_median
from indexloom.operators import ridge


def long(spark, table, value="r"):
    rows = [(t, a, None if x != x else float(x)) for a, xs in table.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, f"dt int, asset string, {value} double")


def near(spark, assets, members, dates=None):
    rows = [(a, b, i + 1) for a in assets for i, b in enumerate(members)]
    if dates is None:
        return spark.createDataFrame(rows, "asset string, basis string, rank int")
    return spark.createDataFrame([(t, *r) for t in dates for r in rows], "dt int, asset string, basis string, rank int")


def coefs(df, *keys):
    return {tuple(r[k] for k in keys): r.coef for r in df.collect()}


def test_members_that_are_almost_alike(spark):
    """Squares of the design would lose the difference of the two members."""
    rng = np.random.default_rng(0)
    b = rng.standard_normal(60)
    c = b + 1e-7 * rng.standard_normal(60)
    y = 2 * b - c + 1e-9 * rng.standard_normal(60)
    got = coefs(ridge.regress(long(spark, {"b": b, "c": c, "y": y}), near(spark, ["y"], ["b", "c"]), 0.0), "basis")
    want = np.linalg.lstsq(np.column_stack((b, c)), y, rcond=None)[0]
    assert [got[("b",)], got[("c",)]] == pytest.approx(want.tolist(), rel=1e-5)


def test_singular_designs_take_the_smallest_solution(spark):
    b = np.array([0.1, -0.2, 0.3, 0.4])
    twice = coefs(ridge.regress(long(spark, {"b": b, "c": b, "y": 3 * b}), near(spark, ["y"], ["b", "c"]), 0.0), "basis")
    assert twice == pytest.approx({("b",): 1.5, ("c",): 1.5})
    zero = coefs(ridge.regress(long(spark, {"b": 0 * b, "y": b}), near(spark, ["y"], ["b"]), 0.0), "basis")
    assert zero == {("b",): 0.0}
    one = coefs(ridge.regress(long(spark, {"b": [0.3, np.nan], "c": [0.4, 1.0], "y": [0.5, 0.1]}), near(spark, ["y"], ["b", "c"]), 0.0), "basis")
    assert one == pytest.approx({("b",): 0.6, ("c",): 0.8})
    none = ridge.regress(long(spark, {"b": [0.3, np.nan], "y": [np.nan, 0.1]}), near(spark, ["y"], ["b"]), 0.0)
    assert none.count() == 0


def test_one_regression_over_a_million_rows(spark):
    """One asset with all the rows: batches are reduced where they are."""
    n = 1_000_000
    x = F.array(F.sin(F.col("id") * 0.37), F.cos(F.col("id") * 0.11))
    rows = spark.range(n).select(F.lit("y").alias("asset"), F.lit(2).alias("n"), F.lit(2).alias("got"), x.alias("x")).withColumn("y", 0.5 * F.col("x")[0] - 2 * F.col("x")[1])
    tri = ridge.triangles(rows, ["asset"])
    got = tri.collect()
    assert len(got) == 1 and got[0].n_rows == n and len(got[0].r) == 9
    assert [r.coef for r in ridge.solve(tri, ["asset"], 0.0).orderBy("rank").collect()] == pytest.approx([0.5, -2.0], abs=1e-9)


def test_series_and_its_errors(spark):
    rng = np.random.default_rng(3)
    table = rng.standard_normal((30, 4)) * 0.1
    table[4, 0] = table[7, 2] = table[9, 3] = np.nan
    names = ["b", "c", "y", "z"]
    ret = long(spark, {n: table[:, j] for j, n in enumerate(names)})
    for alpha in (0.0, 0.3):
        fitted = ridge.regress_series(ret, near(spark, ["y", "z"], ["b", "c"], range(30)), alpha)
        got = coefs(fitted, "dt", "asset", "basis")
        errors = {(r.dt, r.asset): (r.rmse, r.n_obs, r.rmse_valid) for r in ridge.series_errors(ret, fitted).collect()}
        want, off = {}, {}
        for t in range(30):
            for j in (2, 3):
                there = ~np.isnan(table[:t, :2]).any(axis=1)
                ok = there & ~np.isnan(table[:t, j])
                if not ok.any():
                    continue
                x, y = table[:t][ok][:, :2], table[:t][ok][:, j]
                beta = np.linalg.pinv(x.T @ x + alpha * np.eye(2)) @ x.T @ y
                want |= {(t, names[j], names[k]): beta[k] for k in range(2)}
                rmse = np.sqrt(np.mean((y - x @ beta) ** 2))
                off[t, names[j]] = (pytest.approx(rmse, abs=1e-9) if ok.sum() == there.sum() else None, int(there.sum()), pytest.approx(rmse, abs=1e-9))
        assert got == pytest.approx(want, abs=1e-8)
        assert errors == off


@pytest.mark.parametrize("least", [1, 6])
def test_ranks_over_time(spark, least, monkeypatch):
    """Ties, gaps and a constant; assets in one tile and in several."""
    rng = np.random.default_rng(5)
    px = 100 * np.cumprod(1 + rng.integers(-2, 3, (14, 7)) * 0.05, axis=0).round(3)
    px[5, 1] = px[6, 2] = px[0, 3] = np.nan
    px[:, 4] = 5.0
    panel = long(spark, {f"a{j}": px[:, j] for j in range(7)}, "px")
    ret = pd.DataFrame(np.vstack((np.full(7, np.nan), px[1:] / px[:-1] - 1)))
    want = {}
    for t in range(1, 14):
        m = ret[:t].corr("spearman", min_periods=max(2, least)).to_numpy()
        want |= {(t, f"a{i}", f"a{j}"): None if np.isnan(m[i, j]) else pytest.approx(m[i, j], abs=1e-12) for i in range(7) for j in range(i + 1, 7)}
    for tile in (stats.RANK_TILE, 2):
        monkeypatch.setattr(stats, "RANK_TILE", tile)
        got = stats.expanding_spearman(panel, least).collect()
        assert len(got) == len(want) and {(r.dt, r.u, r.v): r.rho for r in got} == want


def test_median_of_any_group(spark):
    rng = np.random.default_rng(7)
    groups = {"odd": rng.standard_normal(1001), "even": rng.standard_normal(5000), "one": [4.0], "two": [1.0, 2.0], "ties": [3.0] * 50 + [9.0] * 50, "same": [2.5] * 3000, "gaps": [np.nan, 1.0, np.nan, 7.0, 8.0], "none": [np.nan]}
    df = long(spark, groups, "x").union(spark.createDataFrame([(0, None, 1.0)], "dt int, asset string, x double"))
    got = {r.asset: r.m for r in exact_median(df, ["asset"], "x", "m").collect()}
    assert got == {k: pytest.approx(float(np.nanmedian(v)), abs=0) for k, v in groups.items() if k != "none"}
    assert exact_median(df.where("false"), ["asset"], "x").count() == 0
    with pytest.raises(ValueError, match="groups"):
        exact_median(df, [], "x")


def test_median_of_a_million_rows_of_which_one_group_has_most(spark):
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("x"))
    want = {r.g: r.m for r in df.groupBy("g").agg(F.expr("percentile(x, 0.5)").alias("m")).collect()}
    assert {r.g: r.median for r in exact_median(df, ["g"], "x").collect()} == want
