"""Returns, correlations and distances of long panels.

Pairs are made by a join on the date with u < v; only dates where both are active count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions.median import exact_median


def returns(panel: DataFrame) -> DataFrame:
    """Change since the date before; NULL where either price is missing.  The panel has no gaps."""
    w = Window.partitionBy("asset").orderBy("dt")
    return panel.select("dt", "asset", (F.try_divide(F.col("px"), F.lag("px").over(w)) - 1).alias("r"))


def pairs(ret: DataFrame) -> DataFrame:
    """dt, u, v, x, y for every two assets, both NULL where either is."""
    a = ret.select("dt", F.col("asset").alias("u"), F.col("r").alias("x"))
    b = ret.select("dt", F.col("asset").alias("v"), F.col("r").alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return a.join(b, "dt").where("u < v").withColumn("x", F.when(both, F.col("x"))).withColumn("y", F.when(both, F.col("y")))


def _rho(over=None) -> Column:  # noqa: ANN001
    def on(c: Column) -> Column:
        return c if over is None else c.over(over)

    return F.try_divide(on(F.covar_samp("x", "y")), on(F.stddev_samp("x")) * on(F.stddev_samp("y")))


#: Assets and dates of a tile: two tiles of returns are what a task of the pair sums holds.
TILE_ASSETS, TILE_DATES = 512, 1024


def pair_sums(ret: DataFrame) -> DataFrame:
    """u < v, n, cx, cxx, cy, cyy, cxy: number of common dates and sums over them, of returns less their asset's mean.

    Returns are dealt into tiles of assets by dates.  A tile meets every other tile of its dates once, and masked matrix
    products give the sums of all their pairs, so a return is copied once for each tile of assets, not for each asset, and no
    row is made for a date and pair.  The tiles of dates are added.
    """
    size = ret.agg(F.approx_count_distinct("asset").alias("a"), F.approx_count_distinct("dt").alias("d")).first()
    blocks, spans = -(-max(1, size.a) // TILE_ASSETS), -(-max(1, size.d) // TILE_DATES)
    mean = ret.groupBy("asset").agg(F.avg("r").alias("_m"))
    cells = ret.where("r is not null").join(mean, "asset").select("dt", "asset", (F.col("r") - F.col("_m")).alias("r"), F.pmod(F.xxhash64("asset"), F.lit(blocks)).alias("b"), F.pmod(F.xxhash64("dt"), F.lit(spans)).alias("span"))
    meet = cells.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("i", F.least("b", "k")).withColumn("j", F.greatest("b", "k"))

    def products(df: pd.DataFrame) -> pd.DataFrame:
        i, j = df["i"].iloc[0], df["j"].iloc[0]
        days = pd.factorize(df["dt"])[0]

        def tile(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = (df["b"] == block).to_numpy()
            code, names = pd.factorize(df["asset"][own], sort=True)
            x, there = np.zeros((days.max() + 1, len(names))), np.zeros((days.max() + 1, len(names)))
            x[days[own], code], there[days[own], code] = df["r"][own], 1.0
            return np.array(names, object), x, there

        (names, x, mx), (others, y, my) = tile(i), tile(j)
        if not len(names) or not len(others):
            return pd.DataFrame({c: [] for c in ("u", "v", "n", "cx", "cxx", "cy", "cyy", "cxy")})
        n = mx.T @ my
        k, m = np.nonzero((n > 0) & (names[:, None] < others[None, :] if i == j else names[:, None] != others[None, :]))
        sums = {"cx": x.T @ my, "cxx": (x * x).T @ my, "cy": mx.T @ y, "cyy": mx.T @ (y * y), "cxy": x.T @ y}
        u, v, turned = names[k], others[m], names[k] > others[m]
        out = {c: t[k, m] for c, t in sums.items()}
        for c, d in (("cx", "cy"), ("cxx", "cyy")):
            out[c], out[d] = np.where(turned, out[d], out[c]), np.where(turned, out[c], out[d])
        return pd.DataFrame({"u": np.where(turned, v, u), "v": np.where(turned, u, v), "n": n[k, m].astype(int), **out})

    found = meet.groupBy("i", "j", "span").applyInPandas(products, "u string, v string, n long, cx double, cxx double, cy double, cyy double, cxy double")
    return found.groupBy("u", "v").agg(*[F.sum(c).alias(c) for c in ("n", "cx", "cxx", "cy", "cyy", "cxy")])


def _moments(sums: DataFrame) -> DataFrame:
    """u, v, n, vx, vy, cxy: sums of squares and products about the means of the common dates; what rounding leaves of a constant is 0."""
    def about(square: str, total: str) -> Column:
        left = F.col(square) - F.col(total) * F.col(total) / F.col("n")
        return F.when(left > 1e-12 * F.col(square), left).otherwise(0.0)

    return sums.select("u", "v", "n", about("cxx", "cx").alias("vx"), about("cyy", "cy").alias("vy"), (F.col("cxy") - F.col("cx") * F.col("cy") / F.col("n")).alias("cxy"))


def every_pair(ret: DataFrame) -> DataFrame:
    """u < v of all assets."""
    names = ret.select("asset").distinct()
    return names.select(F.col("asset").alias("u")).join(names.select(F.col("asset").alias("v")), F.col("u") < F.col("v"))


def pearson(ret: DataFrame, min_periods: int = 1) -> DataFrame:
    """u, v, rho, n_obs of all pairs; rho is NULL below ``min_periods`` common dates or without variance."""
    m = _moments(pair_sums(ret))
    rho = F.when(F.col("n") >= min_periods, F.try_divide(F.col("cxy"), F.sqrt("vx") * F.sqrt("vy")))
    return every_pair(ret).join(m, ["u", "v"], "left").select("u", "v", rho.alias("rho"), F.coalesce("n", F.lit(0).cast("long")).alias("n_obs"))


def spearman(ret: DataFrame, min_periods: int = 1) -> DataFrame:
    """The same over ranks among each pair's common dates, ties averaged."""
    both = pairs(ret).where("x is not null")

    def rank(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy("u", "v", c))
        return F.rank().over(Window.partitionBy("u", "v").orderBy(c)) + (ties - 1) / F.lit(2.0)

    ranked = both.select("u", "v", rank("x").alias("x"), rank("y").alias("y"))
    got = ranked.groupBy("u", "v").agg(_rho().alias("rho"), F.count("x").alias("n_obs"))
    return got.withColumn("rho", F.when(F.col("n_obs") >= min_periods, F.col("rho")))


def covariance(ret: DataFrame) -> DataFrame:
    """u, v, cov for u <= v over common dates."""
    own = ret.where("r is not null").groupBy(F.col("asset").alias("u")).agg(F.var_samp("r").alias("cov")).select("u", F.col("u").alias("v"), "cov")
    common = _moments(pair_sums(ret)).select("u", "v", F.try_divide(F.col("cxy"), F.col("n") - 1).alias("cov"))
    return own.unionByName(every_pair(ret).join(common, ["u", "v"], "left").select("u", "v", "cov"))


def cov_to_corr(cov: DataFrame) -> DataFrame:
    """rho by the variances on the diagonal, within [-1, 1]: without variance 0 beside and NULL on the diagonal."""
    d = cov.where("u = v").select(F.col("u").alias("k"), F.col("cov").alias("var"))
    du, dv = d.select(F.col("k").alias("u"), F.col("var").alias("vu")), d.select(F.col("k").alias("v"), F.col("var").alias("vv"))
    ok = (F.col("vu") > 0) & (F.col("vv") > 0)
    ratio = F.col("cov") / (F.sqrt("vu") * F.sqrt("vv"))
    rho = F.when(F.col("u") == F.col("v"), F.when(F.col("vu") > 0, F.lit(1.0))).otherwise(F.when(ok, clip(ratio, -1.0, 1.0)).otherwise(F.lit(0.0)))
    return cov.join(du, "u").join(dv, "v").select("u", "v", rho.alias("rho"))


def clip(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def distance(corr: DataFrame) -> DataFrame:
    """sqrt(2 (1 - rho)); 0 on the diagonal, NULL stays NULL."""
    d = F.sqrt(2 * (1 - clip(F.col("rho"), -1.0, 1.0)))
    return corr.select("u", "v", F.when(F.col("u") == F.col("v"), F.lit(0.0)).otherwise(d).alias("dist"))


def symmetric(edges: DataFrame, value: str) -> DataFrame:
    """Both directions of u < v."""
    return edges.select("u", "v", value).unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), value))


def windowed(panel: DataFrame, end=None, window: int | None = None) -> DataFrame:  # noqa: ANN001
    """Rows up to ``end``; of these the last ``window`` dates."""
    out = panel if end is None else panel.where(F.col("dt") <= F.lit(end))
    if window is None:
        return out
    last = out.select("dt").distinct().orderBy(F.desc("dt")).limit(window)
    return out.join(last, "dt", "left_semi")


def _check(method: str, shrink: str | None) -> None:
    if shrink not in (None, "lw", "pca") or method not in ("pearson", "spearman"):
        raise ValueError("method is pearson or spearman, shrink is None, lw or pca")


def price_distance(panel: DataFrame, method: str = "pearson", shrink: str | None = None, min_periods: int = 1, end=None, window: int | None = None, n_components: int | None = None, explained: float | None = None) -> DataFrame:  # noqa: ANN001
    """Prices to distances.  ``shrink``: None, "lw" or "pca"; the last two settings are those of "pca"."""
    _check(method, shrink)
    ret = returns(windowed(panel, end, window))
    if shrink == "lw":
        return distance(ledoit_wolf(ret))
    corr = (pearson if method == "pearson" else spearman)(ret, min_periods)
    if shrink == "pca":
        return distance(pca_denoised(corr.withColumn("_g", F.lit(0)), n_components, explained, by="_g").drop("_g"))
    return distance(corr)


def expanding_pearson(panel: DataFrame, min_periods: int = 1) -> DataFrame:
    """dt, u, v, rho, n_obs from the returns strictly before each date: one pass of window frames per pair."""
    w = Window.partitionBy("u", "v").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    got = pairs(returns(panel)).select("dt", "u", "v", _rho(w).alias("rho"), F.count("x").over(w).alias("n_obs"))
    return got.select("dt", "u", "v", F.when(F.col("n_obs") >= min_periods, clip(F.col("rho"), -1.0, 1.0)).alias("rho"), "n_obs")


#: Assets of a tile of rank correlations over time; a task holds two tiles and the ranks of their pairs.
RANK_TILE = 16


def expanding_spearman(panel: DataFrame, min_periods: int = 1) -> DataFrame:
    """dt, u, v, rho of the ranks among the common returns strictly before each date; the first date has none.

    A tile of assets meets every other once.  Within a pair of tiles the ranks of all pairs are kept from date to date: a new
    return raises the ranks of those above it by one and of those equal to it by half, and gets its own rank from the
    same comparison.  Ranks are multiples of a half, so the sums are exact.  No date is sent to later ones.
    """
    ret = returns(panel)
    blocks = -(-max(1, ret.agg(F.approx_count_distinct("asset").alias("a")).first().a) // RANK_TILE)
    cells = ret.select("dt", "asset", "r", F.pmod(F.xxhash64("asset"), F.lit(blocks)).alias("b"))
    meet = cells.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("i", F.least("b", "k")).withColumn("j", F.greatest("b", "k"))
    least = max(2, min_periods)

    def ranks(df: pd.DataFrame) -> pd.DataFrame:
        day, days = pd.factorize(df["dt"], sort=True)
        code, names = pd.factorize(df["asset"], sort=True)
        names = np.array(names, object)
        block = np.zeros(len(names), np.int64)
        block[code] = df["b"]
        table = np.full((len(days), len(names)), np.nan)
        table[day, code] = df["r"]
        u, v = np.triu_indices(len(names), 1)
        own = (block[u] != block[v]) | (df["i"].iloc[0] == df["j"].iloc[0])
        u, v = u[own], v[own]
        both = ~np.isnan(table[:, u]) & ~np.isnan(table[:, v])
        sides = [np.where(both, table[:, c], 0.0) for c in (u, v)]
        rank = [np.zeros(both.shape) for _ in sides]
        out = np.full(both.shape, np.nan)
        n = np.zeros(len(u))
        for t in range(len(days)):
            x, y = rank[0][:t], rank[1][:t]
            middle = n * ((n + 1) / 2) ** 2
            vx, vy = (x * x).sum(axis=0) - middle, (y * y).sum(axis=0) - middle
            ok = (n >= least) & (vx > 0) & (vy > 0)
            out[t, ok] = (((x * y).sum(axis=0) - middle)[ok] / (np.sqrt(vx[ok]) * np.sqrt(vy[ok]))).clip(-1.0, 1.0)
            met = both[:t] & both[t]
            for value, r in zip(sides, rank, strict=True):
                above = np.where(met, (1 + np.sign(value[:t] - value[t])) / 2, 0.0)
                r[:t] += above
                r[t] = np.where(both[t], 1 + met.sum(axis=0) - above.sum(axis=0), 0.0)
            n += both[t]
        k = len(u)
        return pd.DataFrame({"dt": np.repeat(np.array(days, object), k), "u": np.tile(names[u], len(days)), "v": np.tile(names[v], len(days)), "rho": out.ravel()})

    found = meet.groupBy("i", "j").applyInPandas(ranks, f"dt {dict(panel.dtypes)['dt']}, u string, v string, rho double")
    first = panel.agg(F.min("dt").alias("first"))
    return found.join(F.broadcast(first), F.col("dt") > F.col("first")).select("dt", "u", "v", F.when(~F.isnan("rho"), F.col("rho")).alias("rho"))


def expanding_matrices(panel: DataFrame, correlate: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """dt, u, v, rho of ``correlate(returns strictly before dt)``, for what has no running form.

    A date's row of returns goes to every later date, and each date is one Python call; the first date has none.
    """
    day = returns(panel).groupBy("dt").agg(F.array_sort(F.collect_list(F.struct("asset", "r"))).alias("row"))
    at = day.withColumn("i", F.row_number().over(Window.orderBy("dt")))  # a calendar: one row a date
    dates = at.select(F.col("i").alias("k"), F.col("dt").alias("t"))
    n = dates.agg(F.max("k").alias("n"))
    past = at.join(F.broadcast(n), F.col("i") < F.col("n")).withColumn("k", F.explode(F.sequence(F.col("i") + 1, F.col("n")))).join(dates, "k").select("t", "dt", "row")

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("dt")
        names = [x["asset"] for x in df["row"].iloc[0]]
        m = correlate(pd.DataFrame([[x["r"] for x in row] for row in df["row"]], columns=names, dtype=float))
        i, j = np.triu_indices(len(names), 1)
        return pd.DataFrame({"dt": df["t"].iloc[0], "u": np.array(names, object)[i], "v": np.array(names, object)[j], "rho": m[i, j]})

    return past.groupBy("t").applyInPandas(one, f"dt {dict(panel.dtypes)['dt']}, u string, v string, rho double")


def expanding_distance(panel: DataFrame, min_periods: int = 1, method: str = "pearson", shrink: str | None = None, n_components: int | None = None, explained: float | None = None) -> DataFrame:
    """dt, u, v, dist (and n_obs for the plain Pearson form) from the returns strictly before each date.

    ``method`` and ``shrink`` as in ``price_distance``.  Shrunk forms leave the first date out, which has no past.
    """
    _check(method, shrink)
    if shrink == "lw":
        corr = expanding_matrices(panel, lw_matrix)
    elif method == "spearman":
        corr = expanding_spearman(panel, min_periods)
    else:
        corr = expanding_pearson(panel, min_periods)
        if shrink is None:
            return corr.select("dt", "u", "v", F.sqrt(2 * (1 - F.col("rho"))).alias("dist"), "n_obs")
        corr = corr.join(F.broadcast(panel.agg(F.min("dt").alias("first"))), F.col("dt") > F.col("first")).select("dt", "u", "v", "rho")
    if shrink == "pca":
        corr = pca_denoised(corr, n_components, explained, by="dt")
    return corr.select("dt", "u", "v", F.sqrt(2 * (1 - clip(F.col("rho"), -1.0, 1.0))).alias("dist"))


def filled(ret: DataFrame) -> DataFrame:
    """Missing returns as the asset's median, or 0."""
    m = exact_median(ret, ["asset"], "r", "_m")
    return ret.join(m, "asset", "left").select("dt", "asset", F.coalesce("r", "_m", F.lit(0.0)).alias("r"))


def ledoit_wolf(ret: DataFrame) -> DataFrame:
    """u, v, rho (u < v) of the covariance shrunk towards its mean variance (Ledoit and Wolf 2004)."""
    x = filled(ret)
    mean = x.groupBy("asset").agg(F.avg("r").alias("_m"))
    x = x.join(mean, "asset").select("dt", "asset", (F.col("r") - F.col("_m")).alias("x"))
    a, b = x.select("dt", F.col("asset").alias("u"), F.col("x").alias("xu")), x.select("dt", F.col("asset").alias("v"), F.col("x").alias("xv"))
    s = a.join(b, "dt").where("u <= v").groupBy("u", "v").agg((F.sum(F.col("xu") * F.col("xv")) / F.count(F.lit(1))).alias("s"))
    shape = x.agg(F.count_distinct("asset").cast("double").alias("p"), F.count_distinct("dt").cast("double").alias("n"))
    squares = x.groupBy("dt").agg(F.sum(F.col("x") * F.col("x")).alias("q")).agg(F.sum(F.col("q") * F.col("q")).alias("q2"))
    diag = F.col("u") == F.col("v")
    sums = s.agg(F.sum(F.when(diag, F.col("s"))).alias("tr"), F.sum(F.when(diag, F.col("s") * F.col("s")).otherwise(2 * F.col("s") * F.col("s"))).alias("d2"))
    one = shape.crossJoin(squares).crossJoin(sums)  # one row each
    mu = F.col("tr") / F.col("p")
    beta = (F.col("q2") / F.col("n") - F.col("d2")) / (F.col("p") * F.col("n"))
    delta = (F.col("d2") - 2 * mu * F.col("tr") + F.col("p") * mu * mu) / F.col("p")
    one = one.select(mu.alias("mu"), beta.alias("beta"), delta.alias("delta"), "p")
    shrink = F.when((F.col("p") == 1) | (F.col("beta") == 0), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.least("beta", "delta"), F.col("delta")), F.lit(0.0)))
    one = one.select("mu", shrink.alias("k"))
    cov = s.crossJoin(F.broadcast(one)).select("u", "v", ((1 - F.col("k")) * F.col("s") + F.when(diag, F.col("k") * F.col("mu")).otherwise(F.lit(0.0))).alias("cov"))  # one row
    return cov_to_corr(cov).where("u < v")


def lw_matrix(ret: pd.DataFrame) -> np.ndarray:
    """The correlations of ``ledoit_wolf`` for one table of returns (dates by assets, NaN where missing)."""
    x = ret.fillna(ret.median()).fillna(0.0).to_numpy(float)
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu, d2 = np.trace(s) / p, float((s * s).sum())
    beta = (float(((x * x).sum(axis=1) ** 2).sum()) / n - d2) / (p * n)
    delta = (d2 - 2 * mu * np.trace(s) + p * mu * mu) / p
    k = 0.0 if p == 1 or beta == 0 or delta == 0 else min(beta, delta) / delta
    cov = (1 - k) * s + k * mu * np.eye(p)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    inv = np.divide(1.0, sd, out=np.zeros(p), where=sd > 0)
    return np.clip(cov * inv[:, None] * inv[None, :], -1.0, 1.0)


def denoise(c: np.ndarray, n_components: int | None = None, explained: float | None = None) -> np.ndarray:
    """A correlation matrix rebuilt from the principal components of its rows."""
    c = np.nan_to_num(c, nan=0.0)
    n = len(c)
    mean = c.mean(axis=0)
    _, sv, vt = np.linalg.svd(c - mean, full_matrices=False)
    if n_components is not None:
        k = min(n_components, n)
    elif explained is not None:
        share = np.cumsum(sv**2) / max(np.sum(sv**2), 1e-300)
        k = min(n, int(np.searchsorted(share, explained) + 1))
    else:
        k = max(1, n // 2)
    out = mean + (c - mean) @ vt[:k].T @ vt[:k]
    out = np.clip((out + out.T) / 2, -1, 1)
    np.fill_diagonal(out, 1.0)
    return out


def square(df: pd.DataFrame, u: str, v: str, value: str) -> tuple[list[str], np.ndarray]:
    """Sorted labels and the symmetric matrix of a table of pairs; NaN where there is none."""
    names = sorted(set(df[u]) | set(df[v]))
    at = {x: i for i, x in enumerate(names)}
    m = np.full((len(names), len(names)), np.nan)
    i, j = df[u].map(at).to_numpy(), df[v].map(at).to_numpy()
    m[i, j] = m[j, i] = df[value].to_numpy(float)
    return names, m


def pca_denoised(ret: DataFrame, n_components: int | None = None, explained: float | None = None, min_periods: int = 1, by: str | None = None) -> DataFrame:
    """u, v, rho (u < v) after denoising; a matrix per value of ``by``, each in one Python call."""
    corr = pearson(ret, min_periods).withColumn("_g", F.lit(0)) if by is None else ret
    key = "_g" if by is None else by

    def rebuild(df: pd.DataFrame) -> pd.DataFrame:
        names, m = square(df, "u", "v", "rho")
        np.fill_diagonal(m, 1.0)
        d = denoise(m, n_components, explained)
        i, j = np.triu_indices(len(names), 1)
        return pd.DataFrame({key: df[key].iloc[0], "u": np.array(names, object)[i], "v": np.array(names, object)[j], "rho": d[i, j]})

    kind = dict(corr.dtypes)[key]
    out = corr.groupBy(key).applyInPandas(rebuild, f"{key} {kind}, u string, v string, rho double")
    return out.drop("_g") if by is None else out
