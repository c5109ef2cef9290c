"""Local ridge regressions of every other asset on its nearest members of a basis.

Designs stay relational: neighbours by rank, complete dates by a count.  The rows of a regression, response included,
are reduced to the triangle of their QR factors: every batch to one, and triangles of an asset to one as they
stream by, so a regression over any number of rows needs one small triangle and its design is never squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def members_with_returns(basis: DataFrame, ret: DataFrame) -> DataFrame:
    """Members of the basis that have returns; at least one must."""
    out = basis.join(ret.select("asset").distinct(), "asset", "left_semi")
    if out.isEmpty():
        raise ValueError("no member of the basis has returns")
    return out


def neighbours(dist: DataFrame, basis: DataFrame, q: int | None = None, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """(asset, basis, rank, dist): the q nearest members of each asset outside the basis, ties by label.

    ``dist``: (u, v, dist), one direction.  ``by``: columns that both carry, such as the date.  With ``digits``
    distances that are equal when rounded are ties: from two returns all correlations are 1 or -1 but for the
    rounding of sums.
    """
    keys = list(by)
    near_first = F.col("dist") if digits is None else F.round("dist", digits)
    both = dist.select(*keys, "u", "v", "dist").unionByName(dist.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"), "dist"))
    members = basis.select(*keys, F.col("asset").alias("basis"))
    near = both.where("dist is not null").select(*keys, F.col("u").alias("asset"), F.col("v").alias("basis"), "dist").join(members, [*keys, "basis"])
    near = near.join(basis.select(*keys, "asset"), [*keys, "asset"], "left_anti")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "asset").orderBy(near_first, "basis")))
    return (ranked if q is None else ranked.where(F.col("rank") <= q)).select(*keys, "asset", "basis", "rank", "dist")


def design(ret: DataFrame, near: DataFrame) -> DataFrame:
    """asset, dt, y, n, x (the neighbours' returns by rank, NULL where missing), of every date."""
    x = near.select("asset", "basis", "rank").join(ret.select(F.col("asset").alias("basis"), "dt", F.col("r").alias("x")), "basis")
    rows = x.groupBy("asset", "dt").agg(F.count("x").alias("got"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda e: e["x"]).alias("x"))
    return rows.join(ret.select("asset", "dt", F.col("r").alias("y")), ["asset", "dt"], "left")


#: Singular values of a design below this share of its largest count as zero; of several solutions the smallest is taken.
RANK = 1e-12
#: Rows that are kept until they join their triangle.
WAITING = 256


def _triangle(*rows: np.ndarray) -> np.ndarray:
    """The triangle of rows (and triangles) one above the other."""
    return np.linalg.qr(np.vstack(rows), mode="r")


def _least_squares(r: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients from the triangle of [X y], with the penalty as rows of its own."""
    n = r.shape[1] - 1
    x, y = r[:, :-1], r[:, -1]
    if alpha:
        x, y = np.vstack((x, np.sqrt(alpha) * np.eye(n))), np.concatenate((y, np.zeros(n)))
    return np.linalg.lstsq(x, y, rcond=RANK)[0]


def triangles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows, n, r: the triangle of [x y] over the complete rows of each key, row by row.

    A key may hold any number of rows: its batches are reduced where they are, and only triangles are shuffled.
    """
    fields = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", n_rows long, n int, r array<double>"
    names = [*keys, "n_rows", "n", "r"]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for key, g in df.groupby(keys, dropna=False):
                z = np.array(g["z"].tolist(), float)
                out.append((*key, len(z), z.shape[1] - 1, _triangle(z).ravel()))
            yield pd.DataFrame(out, columns=names)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, count, r = None, 0, None
        for df in batches:
            out = []
            for row in df.itertuples(index=False):
                key, z = tuple(row[: len(keys)]), np.asarray(row.r, float).reshape(-1, row.n + 1)
                if key == at:
                    count, r = count + row.n_rows, _triangle(r, z)
                    continue
                if at is not None:
                    out.append((*at, count, r.shape[1] - 1, r.ravel()))
                at, count, r = key, row.n_rows, z
            if out:
                yield pd.DataFrame(out, columns=names)
        if at is not None:
            yield pd.DataFrame([(*at, count, r.shape[1] - 1, r.ravel())], columns=names)

    full = rows.where("y is not null and got = n").select(*keys, F.array_append("x", F.col("y")).alias("z"))
    return full.mapInPandas(reduce, fields).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(merge, fields)


def solve(reduced: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """keys, rank, coef: the least squares of each triangle with the penalty ``alpha``, of least norm where that is singular."""
    fields = ", ".join(f"{k} {t}" for k, t in reduced.select(*keys).dtypes) + ", rank int, coef double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for row in df.itertuples(index=False):
                beta = _least_squares(np.asarray(row.r, float).reshape(-1, row.n + 1), alpha)
                out += [(*row[: len(keys)], i + 1, float(b)) for i, b in enumerate(beta)]
            yield pd.DataFrame(out, columns=[*keys, "rank", "coef"])

    return reduced.select(*keys, "n", "r").mapInPandas(run, fields)


def regress(ret: DataFrame, near: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(asset, basis, coef) of all regressions; assets without a complete date have none."""
    beta = solve(triangles(design(ret, near), ["asset"]), ["asset"], alpha)
    return near.join(beta, ["asset", "rank"]).select("asset", "basis", "coef")


def regress_on_one(ret: DataFrame, near: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The same for one neighbour, in closed form."""
    x = near.where("rank = 1").select("asset", "basis").join(ret.select(F.col("asset").alias("basis"), "dt", F.col("r").alias("x")), "basis")
    rows = x.join(ret.select("asset", "dt", F.col("r").alias("y")), ["asset", "dt"]).where("x is not null and y is not null")
    return rows.groupBy("asset", "basis").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")) + F.lit(float(alpha))).alias("coef"))


def reconstruct(ret: DataFrame, coefs: DataFrame) -> DataFrame:
    """(dt, asset, recon): the fitted return wherever all neighbours have one."""
    x = coefs.join(ret.select(F.col("asset").alias("basis"), "dt", F.col("r").alias("x")), "basis")
    got = x.groupBy("dt", "asset").agg(F.count("x").alias("got"), F.count(F.lit(1)).alias("n"), F.sum(F.col("coef") * F.col("x")).alias("recon"))
    return got.where("got = n").select("dt", "asset", "recon")


def fit_errors(ret: DataFrame, recon: DataFrame) -> DataFrame:
    """asset, rmse, n_obs, rmse_valid: the error over all fitted dates (NULL if a true return is missing),
    and over those with a true return."""
    both = recon.join(ret.select("dt", "asset", "r"), ["dt", "asset"], "left").withColumn("e2", (F.col("r") - F.col("recon")) * (F.col("r") - F.col("recon")))
    rmse = F.sqrt(F.avg("e2"))
    return both.groupBy("asset").agg(F.when(F.count("e2") == F.count("recon"), rmse).alias("rmse"), F.count("recon").alias("n_obs"), rmse.alias("rmse_valid"))


def _asked(ret: DataFrame, used: DataFrame, answer: Callable[[np.ndarray | None, int, int, np.ndarray | None], list[tuple]], fields: str) -> DataFrame:
    """(dt, asset, *fields) for the dates, assets, neighbours and coefficients (dt, asset, nbrs, ask) of ``used``.

    The rows of every set of neighbours that an asset ever has pass once, in order of dates, and add to a triangle;
    a date asked for gets ``answer(triangle, rows with all neighbours, of these with the asset's return, ask)`` of what is
    strictly before it.
    """
    sets = used.select("asset", "nbrs").distinct()
    x = sets.select("asset", "nbrs", F.posexplode("nbrs").alias("i", "basis")).join(ret.select(F.col("asset").alias("basis"), "dt", F.col("r").alias("x")), "basis")
    row = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    rows = x.groupBy("asset", "nbrs", "dt").agg(F.count("x").alias("got"), row.alias("x")).where(F.col("got") == F.size("nbrs"))
    rows = rows.join(ret.select("asset", "dt", F.col("r").alias("y")), ["asset", "dt"], "left")
    rows = rows.select("asset", "nbrs", "dt", "x", "y", F.lit(None).cast("array<double>").alias("ask"), F.lit(False).alias("asked"))
    rows = rows.unionByName(used.select("asset", "nbrs", "dt", F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("double").alias("y"), "ask", F.lit(True).alias("asked")))
    names = ["dt", "asset", *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, r, waiting, n_x, n_y = None, None, [], 0, 0
        for df in batches:
            out = []
            for row in df.itertuples(index=False):
                key = (row.asset, *row.nbrs)
                if key != at:
                    at, r, waiting, n_x, n_y = key, None, [], 0, 0
                if not row.asked:
                    n_x += 1
                    if row.y == row.y and row.y is not None:
                        n_y += 1
                        waiting.append(np.append(np.asarray(row.x, float), row.y))
                if waiting and (row.asked or len(waiting) >= WAITING):
                    r, waiting = _triangle(*([] if r is None else [r]), np.array(waiting)), []
                if row.asked:
                    out += [(row.dt, row.asset, *a) for a in answer(r, n_x, n_y, None if row.ask is None else np.asarray(row.ask, float))]
            yield pd.DataFrame(out, columns=names)

    # a date asked for comes before its own returns
    ordered = rows.repartition("asset", "nbrs").sortWithinPartitions("asset", "nbrs", "dt", F.desc("asked"))
    return ordered.mapInPandas(run, f"dt {dict(used.dtypes)['dt']}, asset string, {fields}")


def regress_series(ret: DataFrame, near: DataFrame, alpha: float = 0.0) -> DataFrame:
    """(dt, asset, basis, coef): for every date its own neighbours (dt, asset, basis, rank), fitted on the returns
    strictly before.  Dates without a complete row before them have none.
    """
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "basis"))), lambda e: e["basis"])
    used = near.groupBy("dt", "asset").agg(names.alias("nbrs")).withColumn("ask", F.lit(None).cast("array<double>"))

    def coefficients(r: np.ndarray | None, n_x: int, n_y: int, ask: np.ndarray | None) -> list[tuple]:
        return [] if r is None else [(i + 1, float(b)) for i, b in enumerate(_least_squares(r, alpha))]

    beta = _asked(ret, used, coefficients, "rank int, coef double")
    return near.select("dt", "asset", "basis", "rank").join(beta, ["dt", "asset", "rank"]).select("dt", "asset", "basis", "coef")


def series_errors(ret: DataFrame, coefs: DataFrame) -> DataFrame:
    """(dt, asset, rmse, n_obs, rmse_valid) of coefficients by date, each over the returns strictly before its date.

    The residuals' norm is that of the triangle times the coefficients, so no earlier return is read again for a later date.
    """
    sets = F.array_sort(F.collect_list(F.struct("basis", "coef")))
    used = coefs.groupBy("dt", "asset").agg(sets.alias("s")).select("dt", "asset", F.transform("s", lambda e: e["basis"]).alias("nbrs"), F.transform("s", lambda e: e["coef"]).alias("ask"))

    def errors(r: np.ndarray | None, n_x: int, n_y: int, ask: np.ndarray | None) -> list[tuple]:
        if not n_x:
            return []
        valid = None if r is None else float(np.linalg.norm(r @ np.append(ask, -1.0)) / np.sqrt(n_y))
        return [(valid if n_x == n_y else None, n_x, valid)]

    return _asked(ret, used, errors, "rmse double, n_obs long, rmse_valid double")


def worst_first(errors: DataFrame) -> DataFrame:
    """Errors from the largest down, unknown ones last, ties by label."""
    return errors.orderBy(F.desc_nulls_last("rmse"), "asset")
