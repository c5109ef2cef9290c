"""Whole runs: from prices and weights to a basis, its regressions, its weights and a backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions import stats
from indexloom.operators import backtest, mapping, ridge, selection, tree
from indexloom.plans.tables import cut

#: Digits to which distances of a date are compared: sums of few returns are exact to fewer than doubles have.
DIGITS = 6


def static_basis(panel: DataFrame, k: int, method: str = "max_spread", alpha: float = 0.5, shrink: str | None = None) -> DataFrame:
    """(pos, asset) chosen over the whole panel, weighed by the caps of its last date."""
    dist = stats.price_distance(panel, shrink=shrink)
    t = tree.mst(dist)
    paths = cut(tree.walks(t))
    weights = mapping.last_row(panel.select("dt", "asset", F.coalesce("cap", F.lit(0.0)).alias("w"))).select("asset", "w")
    if method == "max_spread":
        return selection.max_spread(paths, k, weights, alpha).select("pos", "asset")
    return selection.hub_branch(t, paths, k, weights=weights, alpha=alpha)


def caps_before(panel: DataFrame) -> DataFrame:
    """(dt, asset, w): the caps of the date before each date; the first date has none."""
    days = backtest.calendar(panel).where("before is not null")
    return days.join(panel.select(F.col("dt").alias("before"), "asset", F.coalesce("cap", F.lit(0.0)).alias("w")), "before").select("dt", "asset", "w")


def basis_over_time(panel: DataFrame, k: int, alpha: float = 0.5, stickiness: float = 0.0, method: str = "max_spread", shrink: str | None = None, n_components: int | None = None, explained: float | None = None, corr: str = "pearson", min_periods: int = 1, **hub_branch) -> DataFrame:
    """(dt, pos, asset): a basis for each date from what was known before it.

    ``method``: max_spread, or hub_branch with its own settings (h, gamma, rep_alpha); the others are those of the distances.
    """
    dist = stats.expanding_distance(panel, min_periods, corr, shrink, n_components, explained).withColumn("dist", F.round("dist", DIGITS))
    return selection.basis_series(dist, k, caps_before(panel), alpha, stickiness, method, **hub_branch)


def regressions_over_time(panel: DataFrame, basis: DataFrame, q: int | None = 3, alpha: float = 0.0, corr: str = "pearson", shrink: str | None = None, min_periods: int = 1, n_components: int | None = None, explained: float | None = None) -> DataFrame:
    """(dt, asset, basis, coef) on the ``q`` nearest members (None: all) by the distances before each date, which the settings behind ``alpha`` choose."""
    dist = stats.expanding_distance(panel, min_periods, corr, shrink, n_components, explained)
    near = cut(ridge.neighbours(dist, basis.select("dt", "asset"), q, by=("dt",), digits=DIGITS))
    return ridge.regress_series(stats.returns(panel), near, alpha)


def strategy_backtest(panel: DataFrame, coefs: DataFrame, members: DataFrame, penalty: float = 0.0, percent: float = 20.0) -> dict[str, DataFrame]:
    """The basis weights mapped as of each date, against the index.  ``coefs`` is read more than once."""
    weights = backtest.index_weights(panel).select("dt", "asset", F.coalesce("w", F.lit(0.0)).alias("w"))
    held = cut(mapping.map_series_as_of(weights, coefs, members, penalty).select("dt", F.col("basis").alias("asset"), "w"))
    return backtest.run_backtest(weights, held, stats.returns(panel), percent)


def published_strategy(panel: DataFrame, k: int = 10, q: int = 3, alpha: float = 0.2, stickiness: float = 0.2, shrink: str | None = "pca", ridge_alpha: float = 0.0, penalty: float = 0.0, percent: float = 20.0, method: str = "max_spread") -> dict[str, DataFrame]:
    """The whole strategy, each date from what was known before it: a basis by the spread over denoised distances, local
    regressions on its nearest members, the index weights on them, and the backtest.  The settings are the published ones.
    """
    basis = cut(basis_over_time(panel, k, alpha, stickiness, method, shrink))
    coefs = cut(regressions_over_time(panel, basis, q, ridge_alpha))
    return {"basis": basis, "coefs": coefs, **strategy_backtest(panel, coefs, basis.select("asset").distinct(), penalty, percent)}


def baseline_backtest(panel: DataFrame, top: int = 10, percent: float = 20.0) -> dict[str, DataFrame]:
    """The largest names alone, against the index."""
    weights = backtest.index_weights(panel)
    return backtest.run_backtest(weights, backtest.top_weights(weights, top), stats.returns(panel), percent)


def basis_of_columns(weights: DataFrame) -> DataFrame:
    """(pos, asset): the members that a table of basis weights (dt, asset, w) has, by label, as a run takes them that gets no list."""
    names = weights.select("asset").distinct()
    return names.select((F.row_number().over(Window.orderBy("asset")) - 1).alias("pos"), "asset")  # a basis: a few names


def selection_steps(picks: DataFrame) -> DataFrame:
    """The steps of a choice with how much less each added than the one before."""
    return picks.withColumn("drop", F.lag("score").over(Window.orderBy("pos")) - F.col("score"))  # a basis: a few rows
