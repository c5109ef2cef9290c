"""Weights of an index as weights of its basis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.functions.scan import asof, running
from indexloom.plans.tables import cut


def mapping(coefs: DataFrame, basis: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sparse rows (keys, asset, basis, a): coefficients, and the identity for members without any."""
    keys = keys or []
    own = basis.select(*keys, "asset").distinct().join(coefs.select(*keys, "asset").distinct(), [*keys, "asset"], "left_anti")
    rows = coefs.select(*keys, "asset", "basis", F.col("coef").alias("a"))
    return rows.unionByName(own.select(*keys, "asset", F.col("asset").alias("basis"), F.lit(1.0).alias("a")))


def map_analytic(weights: DataFrame, a: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(dt, basis, w) = sum over assets of w * a; ``keys`` beside asset that both carry."""
    on = [*(keys or []), "asset"]
    return weights.where("w is not null").join(a, on).groupBy("dt", "basis").agg(F.sum(F.col("w") * F.col("a")).alias("w"))


def solve_penalised(a: np.ndarray, b: np.ndarray, before: np.ndarray, penalty: float) -> np.ndarray:
    """argmin |A w - b|^2 + penalty |w - before|^2, exactly."""
    n = a.shape[1]
    return np.linalg.lstsq(np.vstack((a, np.sqrt(penalty) * np.eye(n))), np.concatenate((b, np.sqrt(penalty) * before)), rcond=None)[0]


#: Dates that one task carries weights through, and ranges of dates that are composed together.
RANGE = 64
_AFFINE = "_range int, ins array<string>, outs array<string>, m array<double>, c array<double>"
_STATE = "_range int, names array<string>, x array<double>"


def _carried(ins: list[str], state: dict[str, float]) -> np.ndarray:
    return np.array([state.get(n, 0.0) for n in ins])


def _days(df: pd.DataFrame) -> Iterator[tuple[object, list[str], np.ndarray, np.ndarray]]:
    """(dt, names, Gram matrix, products) of each date, ascending."""
    for dt, day in df.groupby("dt", sort=True):
        names = sorted(day["i"].unique())
        at = {x: i for i, x in enumerate(names)}
        g, b = np.zeros((len(names), len(names))), np.zeros(len(names))
        for i, j, v in zip(day["i"], day["j"], day["v"], strict=True):
            if j is None or j != j:
                b[at[i]] = v
            else:
                g[at[i], at[j]] = v
        yield dt, names, g, b


def _starts(maps: DataFrame, before: dict[str, float]) -> DataFrame:
    """(_range, names, x): what stands before each range, for maps (``_AFFINE``) that each carry through one.

    More ranges than `RANGE` are composed to ranges of ranges first, so no task holds more than that many maps.
    """

    def fold(df: pd.DataFrame, state: dict[str, float]) -> pd.DataFrame:
        out = []
        for r in df.sort_values("_range").itertuples(index=False):
            out.append((r[0], list(state), list(state.values())))
            x = np.reshape(r.m, (len(r.outs), len(r.ins))) @ _carried(r.ins, state) + np.asarray(r.c)
            state = dict(zip(r.outs, x.tolist(), strict=True))
        return pd.DataFrame(out, columns=["_range", "names", "x"])

    def compose(df: pd.DataFrame) -> pd.DataFrame:
        rows = list(df.sort_values("_range").itertuples(index=False))
        ins, outs, m, c = rows[0].ins, rows[0].outs, np.reshape(rows[0].m, (len(rows[0].outs), len(rows[0].ins))), np.asarray(rows[0].c)
        for r in rows[1:]:
            a = np.reshape(r.m, (len(r.outs), len(r.ins))) @ (np.array(r.ins)[:, None] == np.array(outs)[None, :])
            outs, m, c = r.outs, a @ m, a @ c + np.asarray(r.c)
        return pd.DataFrame([(int(rows[0][0]) // RANGE, list(ins), list(outs), m.ravel().tolist(), c.tolist())], columns=["_range", "ins", "outs", "m", "c"])

    if maps.count() <= RANGE:
        return maps.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda df: fold(df.drop(columns="_g", errors="ignore"), dict(before)), _STATE)  # at most RANGE maps
    above = F.floor(F.col("_range") / RANGE).cast("int")
    upper = _starts(cut(maps.groupBy(above.alias("_g")).applyInPandas(compose, _AFFINE)), before)
    held = maps.withColumn("_up", above).join(upper.select(F.col("_range").alias("_up"), "names", "x"), "_up")
    return held.groupBy("_up").applyInPandas(lambda df: fold(df.drop(columns=["_up", "names", "x"]), dict(zip(df["names"].iloc[0], df["x"].iloc[0], strict=True))), _STATE)


def map_penalised(weights: DataFrame, a: DataFrame, penalty: float, initial: str = "zero", before: dict[str, float] | None = None) -> DataFrame:
    """(dt, basis, w): weights by date, each held to those of the date before.

    ``a``: (dt, asset, basis, a).  The Gram sums of every date are aggregated in parallel.  A date's weights are an affine map of
    those before, so ranges of dates are composed in parallel, what stands before each range follows from these, and each range
    is then carried through.  At first the weights are ``before``; without it zero, or (initial="skip") the first date is
    mapped analytically.
    """
    w = weights.where("w is not null").join(a, ["dt", "asset"]).groupBy("dt", "basis").agg(F.sum(F.col("w") * F.col("a")).alias("ab"))
    left, right = a.select("dt", "asset", F.col("basis").alias("i"), F.col("a").alias("ai")), a.select("dt", "asset", F.col("basis").alias("j"), F.col("a").alias("aj"))
    aa = left.join(right, ["dt", "asset"]).groupBy("dt", "i", "j").agg(F.sum(F.col("ai") * F.col("aj")).alias("aa"))
    rows = cut(aa.select("dt", "i", "j", F.col("aa").alias("v")).unionByName(w.select("dt", F.col("basis").alias("i"), F.lit(None).cast("string").alias("j"), F.col("ab").alias("v"))))
    days = running(rows.select("dt").distinct().withColumn("_one", F.lit(1)), ["dt"], {"_n": ("sum", "_one")})
    rows = cut(rows.join(days.select("dt", F.floor((F.col("_n") - 1) / RANGE).cast("int").alias("_range")), "dt"))
    skips = initial == "skip" and not before

    def step(first: bool, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matrix and the constant of one date."""
        if first and skips:
            return np.zeros_like(g), b
        p = np.linalg.pinv(g + penalty * np.eye(len(b)), hermitian=True)
        return penalty * p, p @ b

    def whole(df: pd.DataFrame) -> pd.DataFrame:
        ins = outs = m = c = None
        for n, (_, names, g, b) in enumerate(_days(df)):
            own, add = step(n == 0 and df["_range"].iloc[0] == 0, g, b)
            if ins is None:
                ins, outs, m, c = names, names, own, add
            else:
                own = own @ (np.array(names)[:, None] == np.array(outs)[None, :])
                outs, m, c = names, own @ m, own @ c + add
        return pd.DataFrame([(int(df["_range"].iloc[0]), ins, outs, m.ravel().tolist(), c.tolist())], columns=["_range", "ins", "outs", "m", "c"])

    def carry(df: pd.DataFrame) -> pd.DataFrame:
        state, out = dict(zip(df["names"].iloc[0], df["x"].iloc[0], strict=True)), []
        for n, (dt, names, g, b) in enumerate(_days(df)):
            own, add = step(n == 0 and df["_range"].iloc[0] == 0, g, b)
            state = dict(zip(names, (own @ _carried(names, state) + add).tolist(), strict=True))
            out += [(dt, x, v) for x, v in state.items()]
        return pd.DataFrame(out, columns=["dt", "basis", "w"])

    starts = _starts(cut(rows.groupBy("_range").applyInPandas(whole, _AFFINE)), before or {})
    return rows.join(starts, "_range").groupBy("_range").applyInPandas(carry, f"dt {dict(a.dtypes)['dt']}, basis string, w double")


def as_of(dates: DataFrame, known: DataFrame) -> DataFrame:
    """(dt, as_of): for every date the last date in ``known`` that is not later; dates before all have none."""
    return asof(dates.select("dt").distinct(), known.select("dt").distinct(), "dt").select("dt", F.col("dt_found").alias("as_of"))


def as_of_coefficients(dates: DataFrame, coefs: DataFrame) -> DataFrame:
    """(dt, asset, basis, coef) with the coefficients of the last date not later than dt."""
    at = as_of(dates, coefs.select("dt").distinct())
    return at.join(coefs.withColumnRenamed("dt", "as_of"), "as_of").select("dt", "asset", "basis", "coef")


def map_series_as_of(weights: DataFrame, coefs: DataFrame, members: DataFrame, penalty: float = 0.0) -> DataFrame:
    """Strategy weights by date: coefficients as of each date, the identity for all members without them."""
    dates = weights.select("dt").distinct()
    got = as_of_coefficients(dates, coefs)
    basis = dates.crossJoin(members.select("asset").distinct())  # dates by members
    a = mapping(got, basis, ["dt"])
    return map_analytic(weights, a, ["dt"]) if penalty <= 0 else map_penalised(weights, a, penalty)


def map_series_exact(weights: DataFrame, coefs: DataFrame, penalty: float = 0.0) -> DataFrame:
    """Weights by date from that date's own coefficients, over the union of all members: 0 where a date has none."""
    dates, members = weights.select("dt").distinct(), coefs.select("basis").distinct()
    present = coefs.select("dt", F.col("basis").alias("asset")).distinct()
    a = mapping(coefs, present, ["dt"])
    got = map_analytic(weights, a, ["dt"]) if penalty <= 0 else map_penalised(weights, a, penalty)
    return dates.crossJoin(members).join(got, ["dt", "basis"], "left").select("dt", "basis", F.coalesce("w", F.lit(0.0)).alias("w"))


def map_snapshot(weights: DataFrame, coefs: DataFrame, members: DataFrame) -> DataFrame:
    """One set of coefficients for all dates."""
    return map_analytic(weights, mapping(coefs, members))


def first_row(weights: DataFrame) -> DataFrame:
    """The weights of the first date."""
    return weights.join(weights.agg(F.min("dt").alias("dt")), "dt", "left_semi")


def last_row(weights: DataFrame) -> DataFrame:
    """The weights of the last date."""
    return weights.join(weights.agg(F.max("dt").alias("dt")), "dt", "left_semi")
