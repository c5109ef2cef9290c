"""Weights, lagged returns, and how well a replica tracks its index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions.scan import running, running_product

#: Months of a year.
YEAR = 12


def index_weights(panel: DataFrame) -> DataFrame:
    """(dt, asset, w): the share of each active asset in the caps of its date; equal shares where they sum to 0."""
    day = Window.partitionBy("dt")
    total, active = F.sum("cap").over(day), F.count("cap").over(day)
    w = F.when(F.col("cap").isNotNull(), F.when(total == 0, F.lit(1.0) / active).otherwise(F.try_divide(F.col("cap"), total)))
    return panel.select("dt", "asset", w.alias("w"))


def cap_weights(weights: DataFrame, most: float | None, infeasible: str = "raise", by: tuple[str, ...] = ("dt",)) -> DataFrame:
    """No weight above ``most``; what is cut goes to the others in proportion, until none is above.

    From the largest down, the first m are capped where m is the least number that leaves the rest below the
    cap after scaling.  Where the names above 0 are too few for the cap, each gets it and the date's sum stays
    below 1.  None changes nothing.  A cap below 1 / active is impossible: a job of its own looks for such dates
    and a ValueError is raised, or (infeasible="equal") they get equal weights, the lowest maximum that there is.
    ``by``: the columns of one set of weights.
    """
    if most is None:
        return weights
    if infeasible not in ("raise", "equal"):
        raise ValueError("infeasible is raise or equal")
    low = (F.col("n") > 0) & (F.col("n") * F.lit(most) < 1 - 1e-12)
    if infeasible == "raise" and not weights.groupBy(*by).agg(F.count("w").alias("n")).where(low).isEmpty():
        raise ValueError("the cap is below equal weights")
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("w"), "asset")
    day = Window.partitionBy(*by)
    n = F.count("w").over(day)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    m = F.row_number().over(order) - 1
    rest = F.sum("w").over(day) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = weights.withColumn("_m", m).withColumn("_s", F.try_divide(1 - F.col("_m") * F.lit(most), rest))
    fits = F.col("w") * F.col("_s") <= F.lit(most) + 1e-15
    at = F.min(F.when(fits, F.struct("_m", "_s"))).over(day)
    capped = F.when(at.isNull(), F.when(F.col("w") > 0, F.lit(most)).otherwise(F.col("w"))).when(F.col("_m") < at["_m"], F.lit(most)).otherwise(F.col("w") * at["_s"])
    capped = F.when(n * F.lit(most) < 1 - 1e-12, F.lit(1.0) / n).otherwise(capped)
    return rows.select(*by, "asset", F.when(F.col("w").isNotNull(), capped).alias("w"))


def top_weights(weights: DataFrame, n: int) -> DataFrame:
    """The n largest weights of each date, scaled to 1; if they sum to 0 or less, equal shares of the positive ones."""
    order = Window.partitionBy("dt").orderBy(F.desc_nulls_last("w"), "asset")
    top = weights.where("w is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    day = Window.partitionBy("dt")
    total, positive = F.sum("w").over(day), F.count(F.when(F.col("w") > 0, F.lit(1))).over(day)
    equal = F.when(F.col("w") > 0, F.lit(1.0) / positive).otherwise(F.lit(0.0))
    return top.select("dt", "asset", F.when(total > 0, F.col("w") / total).otherwise(equal).alias("w"))


def calendar(panel: DataFrame) -> DataFrame:
    """dt and the date before it, of a panel's dates."""
    return panel.select("dt").distinct().select("dt", F.lag("dt").over(Window.orderBy("dt")).alias("before"))  # one row a date


def lagged_return(weights: DataFrame, ret: DataFrame, name: str = "ret") -> DataFrame:
    """(dt, name): sum of the weights of the date before times the returns of the date; 0 where there is none."""
    held = calendar(weights).join(weights.select(F.col("dt").alias("before"), "asset", "w"), "before").select("dt", "asset", "w")
    got = held.join(ret, ["dt", "asset"]).groupBy("dt").agg(F.sum(F.col("w") * F.col("r")).alias("s"))
    return ret.select("dt").distinct().join(got, "dt", "left").select("dt", F.coalesce("s", F.lit(0.0)).alias(name))


def turnover(weights: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(dt, turnover): half the sum of changes since the date before; the first date against nothing.

    ``dates``: those wanted; one that has no weights gets 0.
    """
    assets = weights.select("asset").distinct()
    days = weights.select("dt").distinct()
    full = days.crossJoin(assets).join(weights, ["dt", "asset"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))  # dates by assets
    w = Window.partitionBy("asset").orderBy("dt")
    got = full.withColumn("c", F.abs(F.col("w") - F.lag("w", 1, 0.0).over(w))).groupBy("dt").agg((F.sum("c") * 0.5).alias("turnover"))
    return got if dates is None else dates.select("dt").distinct().join(got, "dt", "left").select("dt", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def running_rmse(series: DataFrame, value: str = "diff") -> DataFrame:
    """(dt, running_rmse): root mean square up to each date; missing counts as 0."""
    x = F.coalesce(F.col(value), F.lit(0.0))
    squares = series.select("dt", (x * x).alias("_x"), F.lit(1).alias("_one"))
    return running(squares, ["dt"], {"_sum": ("sum", "_x"), "_n": ("sum", "_one")}).select("dt", F.sqrt(F.col("_sum") / F.col("_n")).alias("running_rmse"))


def cumulative_return(series: DataFrame, value: str) -> DataFrame:
    """(dt, cumulative): the product of 1 + return up to each date, less 1; missing counts as 0."""
    got = running_product(series.select("dt", F.col(value).alias("_r")), ["dt"], 1 + F.col("_r"), "_p")
    return got.select("dt", (F.col("_p") - 1).alias("cumulative"))


def active_returns(index: DataFrame, replica: DataFrame) -> DataFrame:
    """dt, index_return, rep_return, diff over the dates of both."""
    both = index.select("dt", F.col("ret").alias("index_return")).join(replica.select("dt", F.col("ret").alias("rep_return")), "dt")
    return both.withColumn("diff", F.col("rep_return") - F.col("index_return"))


def tail(series: DataFrame, percent: float = 20.0, value: str = "diff") -> DataFrame:
    """The last dates that have a value: max(1, int(n * percent / 100)) of them."""
    rows = series.where(F.col(value).isNotNull())
    w = Window.orderBy(F.desc("dt"))  # one row a date
    n = F.count(F.lit(1)).over(Window.partitionBy())
    keep = F.greatest(F.lit(1), F.floor(n * F.lit(percent) / F.lit(100.0)))
    return rows.withColumn("_k", keep).withColumn("_r", F.row_number().over(w)).where("_r <= _k").drop("_k", "_r")


def summarise(series: DataFrame, value: str = "diff") -> DataFrame:
    """n, mean, std, rmse, std_annualised of a series; no row for an empty one."""
    d = F.col(value)
    got = series.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.sqrt(F.avg(d * d)).alias("rmse"))
    return got.where("n > 0").withColumn("std_annualised", F.col("std") * F.sqrt(F.lit(float(YEAR))))


def evaluate(active: DataFrame, turn: DataFrame, percent: float = 20.0) -> DataFrame:
    """One row: the tail's statistics, R2, information ratio and mean turnover, and the error over all dates."""
    last = tail(active, percent)
    y, p, d = F.col("index_return"), F.col("rep_return"), F.col("diff")
    spread = F.var_pop(y) * F.count(y)
    miss = F.sum((y - p) * (y - p))
    r2 = F.when(F.count(y) < 2, F.lit(None)).when(spread == 0, F.when(miss == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - F.try_divide(miss, spread))
    scale = F.sqrt(F.lit(float(YEAR)))
    stats = last.join(turn, "dt", "left").agg(
        F.count(d).alias("n_tail"), r2.alias("r2"), F.avg(d).alias("mean_active"), F.stddev_samp(d).alias("std_active"), F.sqrt(F.avg(d * d)).alias("rmse"),
        (F.stddev_samp(d) * scale).alias("std_annualised"), F.when(F.stddev_samp(d) > 0, F.try_divide(F.avg(d), F.stddev_samp(d)) * scale).alias("information_ratio"),
        F.avg(F.coalesce("turnover", F.lit(0.0))).alias("avg_turnover"),
    )
    whole = active.agg(F.sqrt(F.avg(d * d)).alias("tracking_error"), (F.sqrt(F.avg(d * d)) * scale).alias("tracking_error_annualised"))
    return stats.crossJoin(whole)  # one row each


def require_overlap(index: DataFrame, replica: DataFrame) -> DataFrame:
    """Active returns of series that must share a date."""
    out = active_returns(index, replica)
    if out.isEmpty():
        raise RuntimeError("index and replica have no date in common")
    return out


def run_backtest(weights: DataFrame, held: DataFrame, ret: DataFrame, percent: float = 20.0) -> dict[str, DataFrame]:
    """Index ``weights`` against ``held`` (dt, asset, w): tail, summary, turnover and all active returns.

    A RuntimeError if there is no date at all.
    """
    active = require_overlap(lagged_return(weights, ret), lagged_return(held, ret))
    turn = turnover(held)
    return {"active": active, "tail": tail(active, percent), "summary": evaluate(active, turn, percent), "turnover": turn}
