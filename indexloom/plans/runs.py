"""Runs from files to files: regressions of one sample, the map of one row of weights, and whole strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from indexloom.functions import stats
from indexloom.operators import mapping, ridge
from indexloom.plans import strategies
from indexloom.plans.tables import cut
from indexloom.sources import basis as basis_files
from indexloom.sources import panel as panels
from indexloom.sources import sinks


def local_ridge(prices: DataFrame, basis: DataFrame, q: int | None = None, alpha: float = 1.0, folder: str | None = None, **distance) -> dict[str, DataFrame]:
    """Coefficients, reconstructed returns and errors (the worst first) of all assets outside the basis.

    Members without returns are left out; a ValueError if none is left.  ``distance``: settings of price_distance.
    With a folder the three tables are written there.
    """
    ret = stats.returns(prices)
    members = ridge.members_with_returns(basis, ret.where("r is not null"))
    near = cut(ridge.neighbours(stats.price_distance(prices, **distance), members, q))
    coefs = cut(ridge.regress(ret, near, alpha))
    recon = ridge.reconstruct(ret, coefs)
    errors = ridge.worst_first(ridge.fit_errors(ret, recon))
    if folder:
        sinks.write_regressions(coefs, recon, errors, folder)
    return {"coefs": coefs, "recon": recon, "errors": errors}


def map_row(weights: DataFrame, coefs: DataFrame, members: DataFrame, penalty: float = 0.0, before: dict[str, float] | None = None, folder: str | None = None) -> DataFrame:
    """(dt, basis, w): the first date's weights on the basis, held to ``before`` where that is known and the penalty above 0."""
    row = mapping.first_row(weights)
    a = mapping.mapping(coefs, members)
    if penalty > 0 and before:
        dates = row.select("dt").distinct()
        got = mapping.map_penalised(row, dates.crossJoin(a), penalty, before=before)  # one date
    else:
        got = mapping.map_analytic(row, a)
    if folder:
        sinks.write_basis_weights(got, folder)
    return got


def _panel_files(spark: SparkSession, prices: str | DataFrame, weights: str | DataFrame) -> DataFrame:
    """(dt, asset, px, cap) from files, or from tables given in their place."""
    px = panels.load_prices(spark, prices) if isinstance(prices, str) else prices
    w = panels.load_weights(spark, weights) if isinstance(weights, str) else weights
    return cut(px.selectExpr("cast(dt AS date) AS dt", "asset", "px").join(w.selectExpr("cast(dt AS date) AS dt", "asset", "w AS cap"), ["dt", "asset"], "left"))


def baseline_files(spark: SparkSession, prices: str | DataFrame, weights: str | DataFrame, folder: str, top: int = 10, percent: float = 20.0, name: str = "baseline_timeseries") -> dict[str, DataFrame]:
    """The backtest of the largest names from files, written to a folder: tail, summary and turnover."""
    out = strategies.baseline_backtest(_panel_files(spark, prices, weights), top, percent)
    sinks.write_backtest(out["tail"], out["summary"], out["turnover"], folder, name)
    return out


def ridge_series_files(spark: SparkSession, prices: str | DataFrame, basis: str, folder: str, q: int | None = 3, alpha: float = 0.0, **distance) -> dict[str, DataFrame]:
    """Regressions of every date of a basis series (date, basis) on the returns before it, from files: coefs and errors, which are written to a folder.

    ``distance``: corr, shrink, min_periods, n_components and explained of ``regressions_over_time``.
    """
    px = panels.load_prices(spark, prices) if isinstance(prices, str) else prices
    panel = cut(px.selectExpr("cast(dt AS date) AS dt", "asset", "px"))
    members = cut(basis_files.series_rows(spark.read.csv(basis, header=True)))
    coefs = cut(strategies.regressions_over_time(panel, members, q, alpha, **distance))
    errors = ridge.series_errors(stats.returns(panel), coefs)
    sinks.write_csv(coefs.orderBy("dt", "asset", "basis"), f"{folder}/coefficients_ridge_timeseries_by_date.csv")
    sinks.write_csv(errors.orderBy("dt", "asset"), f"{folder}/regression_errors_by_date.csv")
    return {"coefs": coefs, "errors": errors}


def strategy_files(spark: SparkSession, prices: str, weights: str, coefs: str, basis: str, folder: str, name: str = "backtest_timeseries", penalty: float = 0.0) -> dict[str, DataFrame]:
    """The backtest of a series of coefficients from files, written to a folder: tail, summary and turnover."""
    panel = _panel_files(spark, prices, weights)
    members = basis_files.read_basis_list(spark, basis).select("asset")
    out = strategies.strategy_backtest(panel, cut(panels.read_coefficient_series(spark, coefs)), members, penalty)
    sinks.write_backtest(out["tail"], out["summary"], out["turnover"], folder, name)
    return out
