"""Exact medians of groups of any size, without the values of a group in one buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.functions.scan import running

#: Rank error of the sketch that brackets the median, as 1 / ACCURACY of a group.
ACCURACY = 1000


def exact_median(rows: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(by, name): the median of ``value`` in each group, the mean of the two middle values where their number is even.

    A mergeable sketch gives two values of the group that have the median between them; values below are only counted, and
    those between (some thousandths of the group) are counted by value and run over in order, in ranges.  NULL values
    are skipped, and groups without a value or with a NULL key have no row.  ``rows`` is read twice.  A bracket that
    does not hold the median is an error, never a wrong value.
    """
    keys = list(by)
    if not keys:
        raise ValueError("name the columns of the groups")
    there = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x")).na.drop(subset=keys)
    share = 2.0 / ACCURACY
    ends = F.percentile_approx("_x", [0.5 - share, 0.5 + share], ACCURACY)
    bracket = there.groupBy(*keys).agg(F.count("_x").alias("_n"), ends.alias("_ends")).select(*keys, "_n", F.col("_ends")[0].alias("_lo"), F.col("_ends")[1].alias("_hi"))
    placed = there.join(bracket, keys)
    below = placed.groupBy(*keys).agg(F.count(F.when(F.col("_x") < F.col("_lo"), 1)).alias("_below"), F.first("_n").alias("_n"))
    inside = placed.where("_x between _lo and _hi").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_k"))
    upto = running(inside, ["_x"], {"_upto": ("sum", "_k")}, keys).join(below, keys)
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    at = F.col("_below") + F.col("_upto")
    found = upto.groupBy(*keys).agg(
        F.min(F.when(at >= lower, F.col("_x"))).alias("_a"), F.min(F.when(at >= upper, F.col("_x"))).alias("_b"), F.bool_and(F.col("_below") < lower).alias("_ok")
    )
    holds = F.col("_ok") & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    middle = F.col("_a") + (F.col("_b") - F.col("_a")) / 2
    return found.select(*keys, F.when(holds, middle).otherwise(F.raise_error(F.lit("the sketch does not hold the median")).cast("double")).alias(name))
