"""Regressions, mapping, backtests, simulation and diagnostics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexloom.functions import stats
from indexloom.operators import backtest, diagnostics, mapping, ridge, selection, tree
from indexloom.plans import strategies
from indexloom.plans.tables import cut


def frame(spark, table, value, start=1):
    rows = [(f"2020-{t + start:02d}-01", a, None if x is None else float(x)) for a, xs in table.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, f"d string, asset string, {value} double").selectExpr("to_date(d) AS dt", "asset", value)


def by(df, *keys, value):
    return {tuple(str(r[k]) for k in keys): r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def ret(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((12, 3))
    y = x @ np.array([0.5, -0.2, 0.1]) + 0.01 * rng.standard_normal(12)
    z = x @ np.array([0.1, 0.9, 0.0]) + 0.01 * rng.standard_normal(12)
    table = {"b1": x[:, 0].tolist(), "b2": x[:, 1].tolist(), "b3": [*x[:11, 2].tolist(), None], "y": y.tolist(), "z": [None, *z[1:].tolist()]}
    return table, frame(spark, table, "r")


def near_all(spark):
    return spark.createDataFrame([(a, f"b{i}", i, 1.0) for a in "yz" for i in (1, 2, 3)], "asset string, basis string, rank int, dist double")


@pytest.mark.parametrize("alpha", [0.0, 0.5])
def test_regression(spark, ret, alpha):
    table, df = ret
    got = by(ridge.regress(df, near_all(spark), alpha), "asset", "basis", value="coef")
    for a in "yz":
        rows = [t for t in range(12) if all(table[k][t] is not None for k in ("b1", "b2", "b3", a))]
        x = np.array([[table[f"b{i}"][t] for i in (1, 2, 3)] for t in rows])
        want = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ np.array([table[a][t] for t in rows]))
        assert [got[a, f"b{i}"] for i in (1, 2, 3)] == pytest.approx(want.tolist())


def test_singular_designs_have_least_norm(spark):
    df = frame(spark, {"b1": [1, 2, 3], "b2": [1, 2, 3], "b3": [0, 0, 0], "y": [2, 4, 6], "z": [None] * 3}, "r")
    got = by(ridge.regress(df, near_all(spark), 0.0), "asset", "basis", value="coef")
    assert got == {("y", "b1"): pytest.approx(1.0), ("y", "b2"): pytest.approx(1.0), ("y", "b3"): pytest.approx(0.0)}


def test_one_neighbour_in_closed_form(spark, ret):
    near = near_all(spark).where("rank = 1")
    assert by(ridge.regress_on_one(ret[1], near, 0.3), "asset", value="coef") == pytest.approx(by(ridge.regress(ret[1], near, 0.3), "asset", value="coef"))


def test_reconstruction_and_errors(spark, ret):
    coefs = ridge.regress(ret[1], near_all(spark), 0.0)
    recon = ridge.reconstruct(ret[1], coefs)
    assert recon.count() == 22
    got = {r.asset: r for r in ridge.fit_errors(ret[1], recon).collect()}
    assert got["y"].n_obs == 11 and 0 < got["y"].rmse < 0.05 and got["y"].rmse == got["y"].rmse_valid
    assert got["z"].rmse is None and got["z"].rmse_valid < 0.05 and got["z"].n_obs == 11


def test_neighbours(spark):
    dist = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 1.0), ("a", "z", None), ("x", "y", 1.0), ("w", "x", 1.0), ("w", "y", 1.0)], "u string, v string, dist double")
    basis = spark.createDataFrame([("x",), ("y",), ("z",)], "asset string")
    got = [(r.asset, r.rank, r.basis) for r in ridge.neighbours(dist, basis, 2).orderBy("asset", "rank").collect()]
    assert got == [("a", 1, "y"), ("a", 2, "x"), ("w", 1, "x"), ("w", 2, "y")]
    assert ridge.neighbours(dist, basis, None).count() == 4
    with pytest.raises(ValueError):
        ridge.members_with_returns(spark.createDataFrame([("none",)], "asset string"), frame(spark, {"a": [1]}, "r"))


def test_series_uses_only_the_past(spark, ret):
    near = near_all(spark).selectExpr("to_date('2020-09-01') AS dt", "*")
    got = by(ridge.regress_series(ret[1], near, 0.0), "asset", "basis", value="coef")
    past = by(ridge.regress(ret[1].where("dt < '2020-09-01'"), near_all(spark), 0.0), "asset", "basis", value="coef")
    assert got == pytest.approx(past)
    # other neighbours at another date, one after all returns, one before
    more = near.where("rank < 3").withColumn("dt", F.to_date(F.lit("2021-05-01"))).unionByName(near).unionByName(near.withColumn("dt", F.to_date(F.lit("2020-01-01"))))
    both = ridge.regress_series(ret[1], more, 0.1)
    assert by(both, "dt", "asset", "basis", value="coef") == pytest.approx(
        {("2020-09-01", *k): v for k, v in by(ridge.regress(ret[1].where("dt < '2020-09-01'"), near_all(spark), 0.1), "asset", "basis", value="coef").items()}
        | {("2021-05-01", *k): v for k, v in by(ridge.regress(ret[1], near_all(spark).where("rank < 3"), 0.1), "asset", "basis", value="coef").items()}
    )
    errors = by(ridge.series_errors(ret[1], both.where("dt = '2021-05-01'")), "asset", value="rmse_valid")
    coefs = both.where("dt = '2021-05-01'").drop("dt")
    assert errors == pytest.approx(by(ridge.fit_errors(ret[1], ridge.reconstruct(ret[1], coefs)), "asset", value="rmse_valid"))
    assert [r.asset for r in ridge.worst_first(spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.3), ("d", 0.1)], "asset string, rmse double")).collect()] == ["c", "a", "d", "b"]


def coefs_of(spark, rows):
    return spark.createDataFrame(rows, "asset string, basis string, coef double")


def test_mapping(spark):
    weights = frame(spark, {"a": [0.5], "b": [0.3], "c": [0.2]}, "w")
    basis = spark.createDataFrame([("a",), ("b",)], "asset string")
    a = mapping.mapping(coefs_of(spark, [("c", "a", 0.5), ("c", "b", 0.25)]), basis)
    assert by(mapping.map_analytic(weights, a), "basis", value="w") == {("a",): pytest.approx(0.6), ("b",): pytest.approx(0.35)}
    over = mapping.mapping(coefs_of(spark, [("a", "b", 2.0)]), basis)
    assert by(mapping.map_analytic(weights, over), "basis", value="w") == {("b",): pytest.approx(1.3)}


def test_penalty(spark):
    a = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.25]])
    before, b = np.array([0.5, 0.5]), np.array([0.6, 0.3, 0.1])
    for lam in (0.01, 1.0):
        want = np.linalg.solve(a.T @ a + lam * np.eye(2), a.T @ b + lam * before)
        assert mapping.solve_penalised(a, b, before, lam) == pytest.approx(want)
        weights = frame(spark, {"a": [0.6], "b": [0.3], "c": [0.1]}, "w")
        rows = mapping.mapping(coefs_of(spark, [("c", "a", 0.5), ("c", "b", 0.25)]), spark.createDataFrame([("a",), ("b",)], "asset string"))
        rows = weights.select("dt").distinct().crossJoin(rows)
        got = by(mapping.map_penalised(weights, rows, lam, before={"a": 0.5, "b": 0.5}), "basis", value="w")
        assert [got["a",], got["b",]] == pytest.approx(want.tolist())
    free = by(mapping.map_penalised(weights, rows, 1.0, initial="skip"), "basis", value="w")
    assert [free["a",], free["b",]] == pytest.approx((a.T @ b).tolist())


def test_as_of_and_exact_series(spark):
    weights = frame(spark, {"a": [0.5] * 4, "c": [0.5] * 4}, "w")
    coefs = spark.createDataFrame([("2020-02-01", "c", "a", 1.0), ("2020-04-01", "c", "a", 3.0)], "d string, asset string, basis string, coef double").selectExpr("to_date(d) AS dt", "asset", "basis", "coef")
    basis = spark.createDataFrame([("a",)], "asset string")
    got = by(mapping.map_series_as_of(weights, coefs, basis), "dt", value="w")
    assert [got[f"2020-0{t}-01",] for t in (1, 2, 3, 4)] == pytest.approx([0.5, 1.0, 1.0, 2.0])
    got = by(mapping.map_series_exact(weights, coefs), "dt", value="w")
    assert [got[f"2020-0{t}-01",] for t in (1, 2, 3, 4)] == pytest.approx([0.0, 1.0, 0.0, 2.0])


def test_weights(spark):
    panel = frame(spark, {"a": [1, 0, None], "b": [3, 0, 5], "c": [None, None, None]}, "cap")
    got = by(backtest.index_weights(panel), "dt", "asset", value="w")
    assert [got["2020-01-01", x] for x in "abc"] == [0.25, 0.75, None]
    assert [got["2020-02-01", x] for x in "abc"] == [0.5, 0.5, None]
    assert [got["2020-03-01", x] for x in "abc"] == [None, 1.0, None]


def clipped(row, cap):
    """The same by clipping and sharing out what was cut, again and again."""
    w, fixed = dict(row), set()
    while any(v > cap + 1e-15 for k, v in w.items() if k not in fixed):
        fixed |= {k for k, v in w.items() if v > cap}
        rest = sum(row[k] for k in w if k not in fixed)
        w = {k: cap if k in fixed else row[k] * (1 - cap * len(fixed)) / rest for k in w}
    return w


@pytest.mark.parametrize("cap", [0.27, 0.3, 0.45, 0.9, None])
def test_cap(spark, cap):
    table = {"p": [0.41, 0.08, None], "q": [0.29, 0.61, None], "r": [0.17, 0.13, None], "s": [0.13, 0.18, 1.0]}
    got = by(backtest.cap_weights(frame(spark, {k: v[:2] for k, v in table.items()}, "w"), cap), "dt", "asset", value="w")
    for t in (0, 1):
        want = {k: v[t] for k, v in table.items()}
        want = want if cap is None else clipped(want, cap)
        assert {k: got[f"2020-0{t + 1}-01", k] for k in want} == pytest.approx(want)
    low = by(backtest.cap_weights(frame(spark, table, "w"), 0.27, infeasible="equal"), "dt", "asset", value="w")
    assert [low["2020-03-01", k] for k in "pqrs"] == [None, None, None, 1.0]


def test_cap_with_too_few_names(spark):
    got = by(backtest.cap_weights(frame(spark, {"a": [0.7], "b": [0.3], "c": [0.0], "d": [0.0]}, "w"), 0.4), "asset", value="w")
    assert got == {("a",): 0.4, ("b",): 0.4, ("c",): 0.0, ("d",): 0.0}


def test_cap_too_low(spark):
    w = frame(spark, {"a": [0.7, 0.9], "b": [0.3, None], "c": [0.0, 0.1]}, "w")
    with pytest.raises(ValueError):
        backtest.cap_weights(w, 0.44)
    with pytest.raises(ValueError):
        backtest.cap_weights(w, 0.44, infeasible="ignore")
    got = by(backtest.cap_weights(w, 0.44, infeasible="equal"), "dt", "asset", value="w")
    assert [got["2020-01-01", k] for k in "abc"] == [0.44, 0.44, 0.0] and [got["2020-02-01", k] for k in "abc"] == [0.5, None, 0.5]


def test_top(spark):
    got = by(backtest.top_weights(frame(spark, {"a": [0.4, 0.0, -1.0], "b": [0.4, 0.0, -1.0], "c": [0.2, 0.0, -2.0]}, "w"), 2), "dt", "asset", value="w")
    assert got["2020-01-01", "a"] == got["2020-01-01", "b"] == 0.5 and ("2020-01-01", "c") not in got
    assert got["2020-02-01", "a"] == 0.0


def test_turnover(spark):
    w = frame(spark, {"A": [0.5, 0.7], "B": [0.5, 0.3]}, "w")
    got = by(backtest.turnover(w), "dt", value="turnover")
    assert got == {("2020-01-01",): pytest.approx(0.5), ("2020-02-01",): pytest.approx(0.2)}
    asked = spark.createDataFrame([("2020-02-01",), ("2020-07-01",)], "d string").selectExpr("to_date(d) AS dt")
    assert by(backtest.turnover(w, asked), "dt", value="turnover") == {("2020-02-01",): pytest.approx(0.2), ("2020-07-01",): 0.0}


def series(spark, values):
    return frame(spark, {"x": values}, "diff").select("dt", "diff")


def test_summary(spark):
    d = [0.01, -0.02, 0.015, -0.005]
    got = backtest.summarise(series(spark, d)).first()
    assert (got.n, got.mean, got.std, got.rmse) == (4, pytest.approx(np.mean(d)), pytest.approx(np.std(d, ddof=1)), pytest.approx(np.sqrt(np.mean(np.square(d)))))
    assert got.std_annualised == pytest.approx(got.std * 12**0.5)
    assert backtest.summarise(series(spark, [None])).count() == 0
    run = [r.running_rmse for r in backtest.running_rmse(series(spark, [0.3, None, 0.6])).orderBy("dt").collect()]
    assert run == pytest.approx([0.3, (0.09 / 2) ** 0.5, (0.45 / 3) ** 0.5])
    cum = [r.cumulative for r in backtest.cumulative_return(series(spark, [0.1, None, -1.5]), "diff").orderBy("dt").collect()]
    assert cum == pytest.approx([0.1, 0.1, 1.1 * -0.5 - 1])
    assert backtest.tail(series(spark, [1, 2, 3, 4, 5, None]), 40).count() == 2
    assert backtest.tail(series(spark, [1, 2]), 1).count() == 1


def test_lag_and_evaluation(spark):
    panel = frame(spark, {"A": np.geomspace(8, 13, 12), "B": np.geomspace(31, 22, 12), "C": [7.0, 9.0] * 6}, "px")
    ret = stats.returns(panel)
    w = frame(spark, {"A": [0.25] * 12, "B": [0.6] * 12, "C": [0.15] * 12}, "w")
    got = by(backtest.lagged_return(w, ret), "dt", value="ret")
    r = by(ret, "dt", "asset", value="r")
    assert got["2020-01-01",] == 0.0
    assert got["2020-02-01",] == pytest.approx(sum(x * r["2020-02-01", a] for a, x in zip("ABC", (0.25, 0.6, 0.15), strict=True)))
    same = backtest.run_backtest(w, w, ret)["summary"].first()
    assert (same.n_tail, same.r2, same.rmse, same.information_ratio, same.tracking_error) == (2, 1.0, 0.0, None, 0.0)
    other = frame(spark, {"A": [1.0] * 12}, "w")
    res = backtest.run_backtest(w, other, ret, 50)["summary"].first()
    assert res.n_tail == 6 and res.tracking_error > 0 and res.avg_turnover == pytest.approx(0.0)
    with pytest.raises(RuntimeError):
        backtest.require_overlap(backtest.lagged_return(w, ret), backtest.lagged_return(w, ret).limit(0))


def test_diagnostics(spark):
    w = frame(spark, {"a": [0.6, 0.5, 0.0], "b": [0.4, 0.0, 0.0], "c": [0.0, 0.5, 1.0]}, "w")
    assert by(diagnostics.concentration(w, 1), "dt", value="top_k") == {("2020-01-01",): 0.6, ("2020-02-01",): 0.5, ("2020-03-01",): 1.0}
    assert by(diagnostics.constituents(w), "dt", value="n") == {("2020-01-01",): 2, ("2020-02-01",): 2, ("2020-03-01",): 1}
    assert by(diagnostics.count_turnover(w), "dt", value="count_turnover") == {("2020-01-01",): None, ("2020-02-01",): 0.5, ("2020-03-01",): 0.5}
    levels = diagnostics.index_level(frame(spark, {"a": [None, 10, None, 20]}, "cap")).orderBy("dt").collect()
    assert [r.level for r in levels] == [1.0, 1.0, 1.0, 2.0]
    hist = by(diagnostics.histogram(frame(spark, {"a": [-1, 0.0, 0.05, 0.99, 1.0, None]}, "r"), "r", 0.0, 1.0, 10), "bin", value="n")
    assert hist == {("0",): 1, ("1",): 2, ("10",): 1, ("11",): 1}


def test_branches_of_one_tree_and_of_a_table(spark):
    """The choice in numpy, as the series makes it, is that of the relational operator."""
    rng = np.random.default_rng(5)
    n = 9
    m = np.abs(rng.standard_normal((n, n)))
    names = [f"n{i}" for i in range(n)]
    dist = spark.createDataFrame([(names[i], names[j], float(m[min(i, j), max(i, j)])) for i in range(n) for j in range(i + 1, n)], "u string, v string, dist double")
    t = tree.mst(dist)
    paths = cut(tree.walks(t))
    edges = [(names.index(r.u), names.index(r.v), r.w) for r in t.collect()]
    weight = rng.random(n)
    unit = (weight - weight.min()) / (weight.max() - weight.min())
    caps = spark.createDataFrame(list(zip(names, weight.tolist(), strict=True)), "asset string, w double")
    for k, h, before, sticky in ((4, None, (), 0.0), (7, 2, (8, 1), 0.4)):
        got = [r.asset for r in selection.hub_branch(t, paths, k, h, caps, alpha=0.3, gamma=0.2, stickiness=sticky, before=[names[i] for i in before]).orderBy("pos").collect()]
        assert [names[i] for i in selection.branch_order(edges, n, unit, k, h, 0.3, 0.2, stickiness=sticky, before=before)] == got


def test_whole_strategies(spark):
    rng = np.random.default_rng(6)
    steps = rng.standard_normal((12, 6)) * 0.03 + rng.standard_normal((12, 1)) * 0.03
    px = 100 * np.cumprod(1 + steps, axis=0)
    panel = frame(spark, {f"a{j}": px[:, j].tolist() for j in range(6)}, "px").join(frame(spark, {f"a{j}": (px[:, j] * (j + 1)).tolist() for j in range(6)}, "cap"), ["dt", "asset"])
    assert [r.pos for r in strategies.static_basis(panel, 3).orderBy("pos").collect()] == [0, 1, 2]
    assert strategies.static_basis(panel, 3, "hub_branch").count() == 3
    basis = strategies.basis_over_time(panel, 2, stickiness=0.1)
    coefs = strategies.regressions_over_time(panel, basis, q=2)
    got = strategies.strategy_backtest(panel, coefs, basis.select("asset").distinct())["summary"].first()
    assert got.n_tail == 2 and got.tracking_error is not None
    penal = strategies.strategy_backtest(panel, coefs, basis.select("asset").distinct(), penalty=0.1)["summary"].first()
    assert penal.tracking_error is not None
    assert strategies.baseline_backtest(panel, 2)["summary"].first().n_tail == 2
