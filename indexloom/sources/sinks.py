"""Results as files: long tables, wide tables and one-row summaries, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.sources.panel import long_to_wide, single


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_wide_csv(panel: DataFrame, value: str, path: str) -> None:
    """Dates by assets; the assets are found first."""
    assets = [r[0] for r in panel.select("asset").distinct().orderBy("asset").collect()]  # the columns of the file
    write_csv(long_to_wide(panel, value, assets).orderBy("dt"), path)


def coefficient_panel(coefs: DataFrame) -> DataFrame:
    """Assets by basis, 0 where there is no coefficient; two of one place are an error when the table is read."""
    return single(coefs, ["asset", "basis"], "coef").groupBy("asset").pivot("basis").agg(F.first("coef")).fillna(0.0)


def write_regressions(coefs: DataFrame, recon: DataFrame, errors: DataFrame, folder: str) -> None:
    write_csv(coefs, f"{folder}/coefficients_ridge.csv")
    write_wide_csv(recon, "recon", f"{folder}/recon_returns.csv")
    write_csv(errors, f"{folder}/regression_errors.csv")


def write_basis_weights(mapped: DataFrame, folder: str) -> None:
    """(dt, basis, w) as dates by basis, as they are: not scaled to 1."""
    write_wide_csv(mapped.select("dt", F.col("basis").alias("asset"), "w"), "w", f"{folder}/basis_weights.csv")


def write_basis_series(series: DataFrame, path: str) -> None:
    """The series form (date, basis) by date."""
    write_csv(series.orderBy("date"), path)


def write_backtest(tail: DataFrame, summary: DataFrame, turnover: DataFrame, folder: str, name: str) -> None:
    write_csv(tail, f"{folder}/{name}.csv")
    write_json(summary, f"{folder}/{name}_summary.json")
    write_csv(turnover, f"{folder}/{name.replace('timeseries', 'replicate_turnover')}_turnover.csv")


def write_simulation(prices: DataFrame, weights: DataFrame, caps: DataFrame, folder: str) -> None:
    write_wide_csv(prices, "px", f"{folder}/prices_monthly.csv")
    write_wide_csv(weights, "w", f"{folder}/market_index_weights.csv")
    write_wide_csv(caps, "cap", f"{folder}/market_caps.csv")
