"""Tables behind the usual pictures of an index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concentration(weights: DataFrame, k: int) -> DataFrame:
    """(dt, top_k): the sum of the k largest weights."""
    w = Window.partitionBy("dt").orderBy(F.desc_nulls_last("w"), "asset")
    return weights.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("dt").agg(F.sum("w").alias("top_k"))


def constituents(weights: DataFrame) -> DataFrame:
    return weights.groupBy("dt").agg(F.count(F.when(F.col("w") > 0, F.lit(1))).alias("n"))


def count_turnover(weights: DataFrame) -> DataFrame:
    """(dt, count_turnover): the share of the members of the date before that left; NULL at first or if it had none."""
    here = weights.where("w > 0").select("dt", "asset")
    days = weights.select("dt").distinct().select("dt", F.lag("dt").over(Window.orderBy("dt")).alias("before"))  # one row a date
    before = days.join(here.select(F.col("dt").alias("before"), "asset"), "before").select("dt", "asset")
    kept = before.join(here, ["dt", "asset"], "left_semi").groupBy("dt").agg(F.count(F.lit(1)).alias("k"))
    had = before.groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    return days.select("dt").join(had, "dt", "left").join(kept, "dt", "left").select("dt", (1 - F.try_divide(F.when(F.col("n") > 0, F.coalesce("k", F.lit(0))), F.col("n"))).alias("count_turnover"))


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bins 1 to ``bins`` of equal width, 0 below and bins + 1 above."""
    return values.where(F.col(value).isNotNull()).groupBy(F.expr(f"width_bucket({value}, {low}D, {high}D, {bins})").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(values: DataFrame, value: str, low: float, high: float, bins: int, bandwidth: float | None = None) -> DataFrame:
    """(bin, x, density): a Gaussian kernel density at the middles of ``bins`` equal bins from ``low`` to ``high``.

    The values are counted by bin, and the counts are convolved with the kernel, so its cost does not follow the values; those outside
    count in none of the bins but in the total.  The default bandwidth is Scott's: the standard deviation by n to the power of -1/5.
    """
    known = values.where(F.col(value).isNotNull())
    wide = F.lit(bandwidth) if bandwidth is not None else F.stddev_samp(value) * F.pow(F.count(F.lit(1)), F.lit(-0.2))
    facts = known.agg(F.count(F.lit(1)).alias("n"), wide.alias("h"))  # one row
    width = (high - low) / bins
    middle = lambda c: F.lit(low) + (F.col(c) - 0.5) * F.lit(width)
    counts = histogram(values, value, low, high, bins).where(F.col("bin").between(1, bins)).select(F.col("bin").alias("from"), F.col("n").alias("c"))
    grid = values.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    met = counts.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long")))).join(F.broadcast(facts))  # bins by bins rows, and one
    z = (middle("bin") - middle("from")) / F.col("h")
    kernel = F.try_divide(F.col("c") * F.exp(-z * z / 2), F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return grid.join(met.groupBy("bin").agg(F.sum(kernel).alias("density")), "bin", "left").select("bin", middle("bin").alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def index_level(panel: DataFrame) -> DataFrame:
    """(dt, level): total cap over the first total; gaps take the last level, those at first the next."""
    total = panel.groupBy("dt").agg(F.sum("cap").alias("cap"))
    back = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("dt").rowsBetween(0, Window.unboundedFollowing)
    filled = total.select("dt", F.coalesce(F.last("cap", ignorenulls=True).over(back), F.first("cap", ignorenulls=True).over(ahead)).alias("cap"))  # one row a date
    return filled.select("dt", F.try_divide(F.col("cap"), F.first("cap").over(Window.orderBy("dt"))).alias("level"))


def initial_caps(panel: DataFrame, high: float, bins: int) -> DataFrame:
    """(bin, n): the caps in millions that assets have on their first date with one, in equal bins from 0 to ``high``."""
    first = panel.where("cap is not null").groupBy("asset").agg(F.min_by("cap", "dt").alias("cap"))
    return histogram(first.withColumn("cap", F.col("cap") / F.lit(1e6)), "cap", 0.0, high, bins)


def normalised_prices(panel: DataFrame) -> DataFrame:
    """(dt, asset, level): prices over each asset's first."""
    w = Window.partitionBy("asset").orderBy("dt")
    first = F.first("px", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return panel.select("dt", "asset", F.try_divide(F.col("px"), first).alias("level"))


def top_by_final_cap(panel: DataFrame, n: int) -> DataFrame:
    """(asset, cap_millions) of the largest caps on the last date."""
    last = panel.join(panel.agg(F.max("dt").alias("dt")), "dt", "left_semi")
    return last.where("cap is not null").orderBy(F.desc("cap"), "asset").limit(n).select("asset", (F.col("cap") / F.lit(1e6)).alias("cap_millions"))


def top_by_mean_weight(weights: DataFrame, n: int) -> DataFrame:
    return weights.groupBy("asset").agg(F.avg("w").alias("mean_w")).orderBy(F.desc_nulls_last("mean_w"), "asset").limit(n)


def availability(panel: DataFrame) -> DataFrame:
    """(asset, n_dates): dates with a price."""
    return panel.groupBy("asset").agg(F.count("px").alias("n_dates"))


def available_corr(ret: DataFrame, panel: DataFrame, n: int) -> DataFrame:
    """Correlations of the n assets with most prices, missing returns as 0."""
    from indexloom.functions.stats import pearson

    most = availability(panel).orderBy(F.desc("n_dates"), "asset").limit(n).select("asset")
    return pearson(ret.join(most, "asset", "left_semi").withColumn("r", F.coalesce("r", F.lit(0.0))))
