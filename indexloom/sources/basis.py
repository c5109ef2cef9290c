"""Basis lists: files of chosen assets in several layouts, and the series form (date, joined names)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_names(text: Column) -> Column:
    """Names in a delimited string: at semicolons if there are any, else at commas; blanks and empties go."""
    parts = F.when(F.contains(text, F.lit(";")), F.split(text, ";")).otherwise(F.split(text, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def join_names(names: Column) -> Column:
    """The series form of a list of names."""
    return F.array_join(names, ";")


def basis_list(rows: DataFrame) -> DataFrame:
    """(pos, asset) from the rows of a basis file, in file order.

    A column ``ticker`` gives one name per row.  A column ``basis`` gives one name per row if there are several
    rows and none is delimited, the names of its last row if any is, and the names of its only row otherwise; nulls
    are left out.  Without either the first column is taken.
    """
    at = F.monotonically_increasing_id().alias("_at")
    if "ticker" in rows.columns or "basis" not in rows.columns:
        name = "ticker" if "ticker" in rows.columns else rows.columns[0]
        return _positions(rows.select(at, F.array(F.trim(F.col(f"`{name}`").cast("string"))).alias("names")))
    b = rows.select(at, F.col("basis").cast("string").alias("b")).where("b is not null")
    delimited = F.contains(F.col("b"), F.lit(";")) | F.contains(F.col("b"), F.lit(","))
    facts = b.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(delimited), F.lit(False)).alias("some"), F.max_by("b", "_at").alias("last"))
    plain = b.crossJoin(F.broadcast(facts.where("n > 1 and not some").select("n"))).select("_at", F.array("b").alias("names"))  # one row at most
    joined = facts.where("n = 1 or some").select(F.lit(0).cast("long").alias("_at"), split_names(F.col("last")).alias("names"))
    return _positions(plain.unionByName(joined))


def _positions(lists: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    names = lists.select("_at", F.posexplode("names").alias("_k", "asset")).where("asset is not null and asset <> ''")
    return names.select((F.row_number().over(Window.orderBy("_at", "_k")) - 1).alias("pos"), "asset")  # a basis: a few names


def read_basis_list(spark: SparkSession, path: str) -> DataFrame:
    return basis_list(spark.read.csv(path, header=True))


def series_form(basis: DataFrame) -> DataFrame:
    """(dt, pos, asset) as (date, basis): ISO dates and joined names, by position."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "asset"))), lambda x: x["asset"])
    return basis.groupBy("dt").agg(names.alias("names")).select(F.date_format("dt", "yyyy-MM-dd").alias("date"), join_names(F.col("names")).alias("basis"))


def series_rows(series: DataFrame) -> DataFrame:
    """The other way: (date, basis) as (dt, pos, asset)."""
    return series.select(F.to_date("date").alias("dt"), F.posexplode(split_names(F.coalesce("basis", F.lit("")))).alias("pos", "asset"))
