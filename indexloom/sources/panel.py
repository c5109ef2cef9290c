"""Panels as long tables (dt, asset, value): readers of wide CSV files, gaps, and the market panel.

NULL stands for an inactive cell; NaN becomes NULL where data comes in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def wide_to_long(wide: DataFrame, value: str, date_col: str | None = None) -> DataFrame:
    """One row per date and column of a wide frame; its first column, or ``date_col``, is the date."""
    date_col = date_col or wide.columns[0]
    names = [c for c in wide.columns if c != date_col]
    typed = wide.select(F.to_timestamp(F.col(f"`{date_col}`")).alias("dt"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return typed.unpivot(["dt"], [F.col(f"`{c}`") for c in names], "asset", value).withColumn(value, null_if_nan(F.col(value)))


def read_wide_csv(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A wide CSV file (dates by assets) as a long table."""
    return wide_to_long(spark.read.csv(path, header=True), value)


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    return read_wide_csv(spark, path, "px")


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return read_wide_csv(spark, path, "w")


def single(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key; a second row of a key is an error when the table is read."""
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value))
    twice = F.raise_error(F.concat_ws(" ", F.lit("more than one value for"), *keys)).cast("double")
    return got.select(*keys, F.when(F.col("_n") > 1, twice).otherwise(F.col(value)).alias(value))


def long_to_wide(panel: DataFrame, value: str, assets: list[str]) -> DataFrame:
    """Dates by the named assets; two rows of a cell are an error when the table is read."""
    return single(panel, ["dt", "asset"], value).groupBy("dt").pivot("asset", assets).agg(F.first(value))


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """(asset, basis, coef) from a file of assets by basis; 0 and missing cells are no coefficients."""
    wide = spark.read.csv(path, header=True)
    names = wide.columns[1:]
    rows = wide.select(F.col(f"`{wide.columns[0]}`").alias("asset"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(["asset"], [F.col(f"`{c}`") for c in names], "basis", "coef")
    return rows.withColumn("coef", null_if_nan(F.col("coef"))).where("coef <> 0")


def read_coefficient_series(spark: SparkSession, path: str) -> DataFrame:
    """(dt, asset, basis, coef) from a long file with the columns date, asset, basis and coef."""
    return spark.read.csv(path, header=True).select(F.to_date("date").alias("dt"), F.col("asset").cast("string").alias("asset"), F.col("basis").cast("string").alias("basis"), F.col("coef").cast("double").alias("coef"))


def read_last_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """The weights of the last date of a file of dates by basis, as the state before of a penalised map; a basis has few names."""
    w = read_wide_csv(spark, path, "w")
    return {r.asset: r.w for r in w.join(w.agg(F.max("dt").alias("dt")), "dt", "left_semi").where("w is not null").collect()}


def densify(panel: DataFrame) -> DataFrame:
    """Every date with every asset; cells that were not there are NULL."""
    grid = panel.select("dt").distinct().crossJoin(panel.select("asset").distinct())  # dates by assets: the panel itself
    return grid.join(panel, ["dt", "asset"], "left")


def market_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly price and cap of every brand sold: dt, asset, px, cap; only the cells that are there."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("asset"))
    month = F.trunc("l_shipdate", "MM").alias("dt")
    cap = F.sum("l_extendedprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(month, "asset").agg(F.try_divide(cap, F.sum("l_quantity")).alias("px"), cap.alias("cap"))


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by part: most cells are NULL."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cap = F.sum("l_extendedprice")
    return lines.groupBy(F.trunc("l_shipdate", "MM").alias("dt"), F.col("l_partkey").alias("asset")).agg(F.try_divide(cap, F.sum("l_quantity")).alias("px"), cap.alias("cap"))
