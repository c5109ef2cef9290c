"""Readers, basis files, settings and sinks."""

import numpy as np
import pandas as pd
import pytest

from indexloom.plans import runs, strategies
from indexloom.sources import basis, panel, settings, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_wide_csv(spark, tmp_path):
    got = panel.load_prices(spark, write(tmp_path / "p.csv", "date,AAA,BBB\n2020-02-01,2.5,NaN\n2020-01-01,1.0,\n"))
    rows = {(str(r.dt)[:10], r.asset): r.px for r in got.collect()}
    assert rows == {("2020-02-01", "AAA"): 2.5, ("2020-02-01", "BBB"): None, ("2020-01-01", "AAA"): 1.0, ("2020-01-01", "BBB"): None}
    assert panel.load_weights(spark, str(tmp_path / "p.csv")).columns == ["dt", "asset", "w"]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("ticker\nA\nB\n", ["A", "B"]),
        ("basis\nA\nB\nC\n", ["A", "B", "C"]),
        ("basis\nA;B; C\n", ["A", "B", "C"]),
        ('basis\n"A, B,C"\n', ["A", "B", "C"]),
        ("date,basis\n2020-01-01,A;B\n2020-02-01,C;D\n", ["C", "D"]),
        ("basis\n A \n", ["A"]),
        ("basis,x\n,1\n", []),
        ("basis\n", []),
        ('basis\n"A;B,C"\n', ["A", "B,C"]),
        ("basis\nA;;B;\n", ["A", "B"]),
        ("name\nX\nY\n", ["X", "Y"]),
        ("name\n1\n2\n", ["1", "2"]),
        ("basis,x\nA,1\n,2\nB,3\n", ["A", "B"]),
    ],
)
def test_basis_layouts(spark, tmp_path, text, names):
    got = basis.read_basis_list(spark, write(tmp_path / "b.csv", text)).orderBy("pos").collect()
    assert [r.asset for r in got] == names
    assert [r.pos for r in got] == list(range(len(names)))


def test_series_round_trip(spark):
    rows = spark.createDataFrame([("2020-01-01", 0, "B"), ("2020-01-01", 1, "A"), ("2020-02-01", 0, "C")], "d string, pos int, asset string").selectExpr("to_date(d) AS dt", "pos", "asset")
    series = basis.series_form(rows)
    assert {(r.date, r.basis) for r in series.collect()} == {("2020-01-01", "B;A"), ("2020-02-01", "C")}
    assert {(str(r.dt), r.pos, r.asset) for r in basis.series_rows(series).collect()} == {("2020-01-01", 0, "B"), ("2020-01-01", 1, "A"), ("2020-02-01", 0, "C")}


def test_settings():
    cfg = {"a": {"x": {"value": 0}, "y": {"value": ""}, "z": {}}, "output": {"folder": {"value": "out"}}}
    assert settings.setting(cfg, "a", "x", 5) == 0
    assert settings.setting(cfg, "a", "y", "d") == ""
    assert settings.setting(cfg, "a", "z", 7) == settings.setting(cfg, "b", "x", 7) == settings.setting({}, "b", "x", 7) == 7
    assert settings.locations(cfg, "/r")["outputs"] == "/r/out"
    assert settings.locations({}, "/r")["prices"].startswith("/r/")


def test_locations(tmp_path):
    given = {"input": {"prices_path": {"value": "a/p.csv"}, "weights_path": {"value": "/abs/w.csv"}, "basis": {"value": ""}}, "output": {"basis_path": {"value": "o/b.csv"}}}
    got = settings.locations(given, str(tmp_path), make=True)
    assert got == {"outputs": f"{tmp_path}/outputs", "prices": f"{tmp_path}/a/p.csv", "weights": "/abs/w.csv", "basis": f"{tmp_path}/o/b.csv", "coefficients": f"{tmp_path}/outputs/coefficients_ridge_panel.csv"}
    assert (tmp_path / "outputs").is_dir()
    assert settings.locations({"paths": {"prices_path": {"value": "x.csv"}}, "output": {"folder": {"value": "out"}}}, "/r") == {"outputs": "/r/out", "prices": "/r/x.csv", "weights": "/r/synthetic_data/market_index_weights.csv", "basis": "/r/out/basis_selected.csv", "coefficients": "/r/out/coefficients_ridge_panel.csv"}


def test_sinks(spark, tmp_path):
    data = spark.createDataFrame([("2020-01-01", "A", 1.5), ("2020-01-01", "B", None), ("2020-02-01", "B", 2.5)], "dt string, asset string, px double")
    sinks.write_wide_csv(data, "px", str(tmp_path / "wide"))
    back = panel.read_wide_csv(spark, str(tmp_path / "wide"), "px")
    assert {(str(r.dt)[:10], r.asset, r.px) for r in back.where("px is not null").collect()} == {("2020-01-01", "A", 1.5), ("2020-02-01", "B", 2.5)}
    coefs = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "asset string, basis string, coef double")
    assert {tuple(r) for r in sinks.coefficient_panel(coefs).select("asset", "x", "y").collect()} == {("a", 1.0, 2.0), ("b", 3.0, 0.0)}
    sinks.write_json(coefs.limit(1), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_second_value_of_a_cell(spark):
    rows = spark.createDataFrame([("2020-01-01", "A", 1.5), ("2020-01-01", "A", 2.5)], "dt string, asset string, px double")
    with pytest.raises(Exception, match="more than one value"):
        panel.long_to_wide(rows, "px", ["A"]).collect()
    assert [tuple(r) for r in panel.long_to_wide(rows.limit(1), "px", ["A", "B"]).collect()] == [("2020-01-01", 1.5, None)]


def test_runs_from_files_to_files(spark, tmp_path):
    """Regressions, the map of one row and a backtest, each read back from its files."""
    rng = np.random.default_rng(2)
    px = 10 * np.cumprod(1 + 0.05 * rng.standard_normal((14, 4)) + 0.02 * rng.standard_normal((14, 1)), axis=0)
    days = [f"20{10 + t // 12}-{t % 12 + 1:02d}-01" for t in range(14)]
    head = "date,A,B,C,D\n"
    prices = write(tmp_path / "prices.csv", head + "".join(f"{d},{','.join(map(repr, map(float, x)))}\n" for d, x in zip(days, px, strict=True)))
    weights = write(tmp_path / "weights.csv", head + "".join(f"{d},0.4,0.3,0.2,0.1\n" for d in days))
    names = spark.createDataFrame([("A",), ("B",), ("gone",)], "asset string")
    got = runs.local_ridge(panel.load_prices(spark, prices), names, q=2, alpha=0.1, folder=str(tmp_path / "out"))
    ret = px[1:] / px[:-1] - 1
    want = {(n, b): v for n, j in (("C", 2), ("D", 3)) for b, v in zip("AB", np.linalg.solve(ret[:, :2].T @ ret[:, :2] + 0.1 * np.eye(2), ret[:, :2].T @ ret[:, j]), strict=True)}
    assert {(r.asset, r.basis): r.coef for r in got["coefs"].collect()} == pytest.approx(want)
    back = spark.read.csv(str(tmp_path / "out/regression_errors.csv"), header=True, inferSchema=True).collect()
    assert {r.asset for r in back} == {"C", "D"} and back[0].rmse >= back[1].rmse and all(r.n_obs == 13 for r in back)
    with pytest.raises(ValueError):
        runs.local_ridge(panel.load_prices(spark, prices), names.where("asset = 'gone'"))

    sinks.write_csv(sinks.coefficient_panel(got["coefs"]), str(tmp_path / "panel"))
    coefs = panel.read_coefficients(spark, str(tmp_path / "panel"))
    assert {(r.asset, r.basis): r.coef for r in coefs.collect()} == pytest.approx(want)
    row = runs.map_row(panel.load_weights(spark, weights), coefs, names.where("asset <> 'gone'"), folder=str(tmp_path / "out"))
    mapped = {b: 0.4 * (b == "A") + 0.3 * (b == "B") + 0.2 * want["C", b] + 0.1 * want["D", b] for b in "AB"}
    assert {r.basis: r.w for r in row.collect()} == pytest.approx(mapped)
    before = panel.read_last_weights(spark, str(tmp_path / "out/basis_weights.csv"))
    assert before == pytest.approx(mapped)
    held = runs.map_row(panel.load_weights(spark, weights), coefs, names.where("asset <> 'gone'"), 1e9, before)
    assert {r.basis: r.w for r in held.collect()} == pytest.approx(mapped, abs=1e-6)

    series = write(tmp_path / "series.csv", "date,asset,basis,coef\n" + "".join(f"{days[5]},{a},{b},{v}\n" for (a, b), v in want.items()))
    out = runs.strategy_files(spark, prices, weights, series, write(tmp_path / "basis.csv", "ticker\nA\nB\n"), str(tmp_path / "bt"))
    summary = spark.read.json(str(tmp_path / "bt/backtest_timeseries_summary.json")).first()
    assert summary.n_tail == 2 and summary.tracking_error == pytest.approx(out["summary"].first().tracking_error)
    assert spark.read.csv(str(tmp_path / "bt/backtest_timeseries.csv"), header=True).count() == 2
    assert spark.read.csv(str(tmp_path / "bt/backtest_replicate_turnover_turnover.csv"), header=True).count() == 14


def test_baseline_and_series_files(spark, tmp_path):
    rng = np.random.default_rng(12)
    px = 100 * np.cumprod(1 + rng.normal(0, 0.02, (16, 4)), axis=0)
    days = [f"20{10 + t // 12}-{t % 12 + 1:02d}-01" for t in range(16)]
    head = "date,A,B,C,D\n"
    prices = write(tmp_path / "prices.csv", head + "".join(f"{d},{','.join(map(repr, map(float, x)))}\n" for d, x in zip(days, px, strict=True)))
    weights = write(tmp_path / "weights.csv", head + "".join(f"{d},0.4,0.3,0.2,0.1\n" for d in days))
    ret = px[1:] / px[:-1] - 1
    out = runs.baseline_files(spark, prices, weights, str(tmp_path / "bt"), top=2)
    diff = ret @ [4 / 7, 3 / 7, 0, 0] - ret @ [0.4, 0.3, 0.2, 0.1]
    assert out["summary"].first().tracking_error == pytest.approx(np.sqrt(np.mean(np.append(diff, 0.0) ** 2)))
    assert spark.read.csv(str(tmp_path / "bt/baseline_timeseries.csv"), header=True).count() == 3
    basis_file = write(tmp_path / "basis.csv", f"date,basis\n{days[9]},A;B\n{days[12]},B\n")
    for corr in ("pearson", "spearman"):
        got = runs.ridge_series_files(spark, prices, basis_file, str(tmp_path / corr), q=1, alpha=0.1, corr=corr, min_periods=2)
        coefs = {(str(r.dt), r.asset): (r.basis, r.coef) for r in got["coefs"].collect()}
        errors = {(str(r.dt), r.asset): r.rmse for r in got["errors"].collect()}
        for t, members in ((9, "AB"), (12, "B")):
            past = pd.DataFrame(ret[: t - 1], columns=list("ABCD"))
            rho = past.corr(corr)
            for name in sorted(set("ABCD") - set(members)):
                near = max(members, key=lambda m: rho.loc[name, m])
                x, y = past[near].to_numpy(), past[name].to_numpy()
                beta = x @ y / (x @ x + 0.1)
                assert coefs[days[t], name] == (near, pytest.approx(beta))
                assert errors[days[t], name] == pytest.approx(np.sqrt(np.mean((y - beta * x) ** 2)))
    assert [tuple(r) for r in strategies.basis_of_columns(panel.load_weights(spark, weights)).orderBy("pos").collect()] == [(i, a) for i, a in enumerate("ABCD")]


def test_market_files(spark, tmp_path):
    rows = [("2020-01-01", "a", 2.0, 0.25, 8.0), ("2020-01-01", "b", 3.0, 0.75, 24.0), ("2020-02-01", "b", 4.0, 1.0, 32.0)]
    market = spark.createDataFrame(rows, "dt string, asset string, px double, w double, cap double")
    sinks.write_simulation(market.select("dt", "asset", "px"), market.select("dt", "asset", "w"), market.select("dt", "asset", "cap"), str(tmp_path))
    assert panel.load_prices(spark, f"{tmp_path}/prices_monthly.csv").where("px is not null").count() == 3
    sinks.write_basis_series(spark.createDataFrame([("2020-02-01", "A;B"), ("2020-01-01", "C")], "date string, basis string"), f"{tmp_path}/basis")
    assert [r.date for r in spark.read.csv(f"{tmp_path}/basis", header=True).collect()] == ["2020-01-01", "2020-02-01"]


def test_densify(spark):
    got = panel.densify(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "dt int, asset string, px double"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", 1.0), (1, "b", None), (2, "a", None), (2, "b", 2.0)}
