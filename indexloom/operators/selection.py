"""Choosing a basis: a few assets that stand for all.

The greedy steps of a spread depend on each other, so they run in one Python call over one tree's distances
(a group per date); scores, hubs, branches and the filling up with the farthest are relational.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions.stats import square
from indexloom.operators.tree import betweenness, components_without, degrees, nodes, prim
from indexloom.plans.tables import cut


def normalised(c: Column, over=None) -> Column:  # noqa: ANN001
    """(x - min) / (max - min) over all rows; one value alone gives 0."""
    w = over if over is not None else Window.partitionBy()
    low, high = F.min(c).over(w), F.max(c).over(w)
    return (c - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))


def scaled(values: dict[str, float] | None, names: Sequence[str], fallback: float = 0.0) -> np.ndarray:
    """Values by name, brought to [0, 1]; missing ones get the fallback."""
    if not values:
        return np.full(len(names), fallback)
    v = np.array([values.get(x, np.nan) for x in names], float)
    v = np.where(np.isnan(v), np.nan, v)
    low, high = np.nanmin(v), np.nanmax(v)
    out = (v - low) / ((high - low) if high > low else 1.0)
    return np.where(np.isnan(out), fallback, out)


def spread_order(d: np.ndarray, weight: np.ndarray, k: int, alpha: float = 0.5, stickiness: float = 0.0, before: Sequence[int] = (), trace: list[np.ndarray] | None = None) -> list[tuple[int, float]]:
    """Positions of the basis with the scores that chose them; ``trace`` gets the scores of all at each step.

    The first has the largest alpha * mean distance + (1 - alpha) * weight; each further one the
    largest alpha * distance to the nearest chosen + (1 - alpha) * weight.  Members of the basis
    before get stickiness * the largest first score on top (for the first choice, its first k).
    k of all or more gives all, in order.
    """
    n = len(d)
    if k <= 0 or not n:
        return []
    first = alpha * d.mean(axis=1) + (1 - alpha) * weight
    if k >= n:
        return [(i, float(x)) for i, x in enumerate(first)]
    early, bonus = np.zeros(n), np.zeros(n)
    if stickiness and len(before):
        early[list(before)[:k]] = bonus[list(before)] = stickiness * first.max()
    score = first + early
    out, near = [], np.full(n, np.inf)
    for _ in range(min(k, n)):
        best = int(np.argmax(score))
        out.append((best, float(score[best])))
        if trace is not None:
            trace.append(score.copy())
        near = np.minimum(near, d[best])
        score = alpha * near + (1 - alpha) * weight + bonus
        score[[i for i, _ in out]] = -np.inf
    return out


def edge_distances(edges: Sequence[tuple[int, int, float]], n: int) -> np.ndarray:
    """Distances along a tree of n nodes, from its edges."""
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0.0)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    # from the first node outwards: a new node is as far from all seen ones as its neighbour, and the edge
    for root in range(n):
        if not np.isinf(d[root, :root]).all():
            continue
        seen, todo = [root], [root]
        while todo:
            u = todo.pop()
            for v, w in near[u]:
                if np.isinf(d[u, v]):
                    d[v, seen] = d[seen, v] = d[u, seen] + w
                    seen.append(v)
                    todo.append(v)
    return d


def tree_distances(m: np.ndarray) -> np.ndarray:
    """Distances along the minimum spanning tree of a dense matrix."""
    return edge_distances(prim(m), len(m))


def max_spread(paths: DataFrame, k: int, weights: DataFrame | None = None, alpha: float = 0.5, stickiness: float = 0.0, before: Sequence[str] = ()) -> DataFrame:
    """(pos, asset, score) chosen by spread over tree distances (src, dst, d); weights: (asset, w).

    k of all nodes or more gives all nodes; k of 0 or less none.
    """
    rows = paths.select("src", "dst", "d")
    if weights is not None:
        rows = rows.join(weights.select(F.col("asset").alias("src"), "w"), "src", "left")
    else:
        rows = rows.withColumn("w", F.lit(None).cast("double"))

    weighed = weights is not None

    def choose(df: pd.DataFrame) -> pd.DataFrame:
        names, d = square(df, "src", "dst", "d")
        got = df.dropna(subset=["w"]).groupby("src")["w"].first().to_dict()
        w = scaled({x: got.get(x, 0.0) for x in names} if weighed else None, names)
        prev = [names.index(x) for x in dict.fromkeys(before) if x in names]
        picks = spread_order(d, w, k, alpha, stickiness, prev)
        return pd.DataFrame({"pos": range(len(picks)), "asset": pd.Series([names[i] for i, _ in picks], dtype=object), "score": [s for _, s in picks]})

    return rows.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda df: choose(df.drop(columns="_g", errors="ignore")), "pos int, asset string, score double")


def spread_trace(paths: DataFrame, k: int, weights: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(step, asset, score, chosen): the score of every asset not chosen yet at each step of ``max_spread``."""
    rows = paths.select("src", "dst", "d").join(weights.select(F.col("asset").alias("src"), "w"), "src", "left")

    def steps(df: pd.DataFrame) -> pd.DataFrame:
        names, d = square(df, "src", "dst", "d")
        got = df.dropna(subset=["w"]).groupby("src")["w"].first().to_dict()
        trace: list[np.ndarray] = []
        picks = [i for i, _ in spread_order(d, scaled({x: got.get(x, 0.0) for x in names}, names), k, alpha, trace=trace)]
        out = [(s, names[i], float(x), i == picks[s]) for s, score in enumerate(trace) for i, x in enumerate(score) if x > -np.inf]
        return pd.DataFrame(out, columns=["step", "asset", "score", "chosen"], dtype=None if out else object)

    return rows.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda df: steps(df.drop(columns="_g", errors="ignore")), "step int, asset string, score double, chosen boolean")


def hub_scores(tree: DataFrame, between: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, gamma: float = 0.0) -> DataFrame:
    """``between`` has asset, betweenness.  asset, score: (1 - gamma) * centrality + gamma * weight, both brought to [0, 1]; the centrality is
    alpha * degree + (1 - alpha) * betweenness."""
    c = degrees(tree).join(between, "asset").withColumn("c", alpha * F.col("degree") + (1 - alpha) * F.col("betweenness"))
    if weights is not None:
        c = c.join(weights.select("asset", "w"), "asset", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        wn = normalised(F.col("w"))
    else:
        wn = F.lit(0.0)
    return c.select("asset", ((1 - gamma) * normalised(F.col("c")) + gamma * wn).alias("score"), wn.alias("wn"))


def hubs(scores: DataFrame, h: int) -> DataFrame:
    """The h assets of largest score, ties by label: (pos, asset, score)."""
    w = Window.orderBy(F.desc("score"), "asset")
    return scores.select((F.row_number().over(w) - 1).alias("pos"), "asset", "score").where(F.col("pos") < h)  # assets of one index


def default_hubs(k: int) -> int:
    return max(1, min(k - 1, round(0.2 * k)))


def hub_branch(tree: DataFrame, paths: DataFrame, k: int, h: int | None = None, weights: DataFrame | None = None, alpha: float = 0.5, gamma: float = 0.0, rep_alpha: float = 0.5, stickiness: float = 0.0, before: Sequence[str] = ()) -> DataFrame:
    """(pos, asset): hubs by score, then the representatives of the branches between them, then the farthest left.

    A branch is a component of the tree without hubs; its representative has the largest
    rep_alpha * distance to the nearest hub + (1 - rep_alpha) * weight (+ stickiness for a member before).
    """
    spark = tree.sparkSession
    labels = [r.asset for r in nodes(tree).orderBy("asset").collect()] if k > 0 else []  # the assets of one index
    if k >= len(labels):
        return spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "pos int, asset string")
    scores = hub_scores(tree, betweenness(paths), weights, alpha, gamma)
    known = [x for x in dict.fromkeys(before) if x in set(labels)]
    sticky = F.col("asset").isin(known) if known else F.lit(False)
    sticky_hub = F.col("asset").isin(known[:k]) if known else F.lit(False)
    top = scores.agg(F.max("score").alias("top"))
    scores = scores.crossJoin(F.broadcast(top)).select("asset", "wn", (F.col("score") + F.when(sticky_hub, stickiness * F.col("top")).otherwise(0.0)).alias("score"))  # one row
    n_hubs = min(default_hubs(k) if h is None else h, k)
    chosen = hubs(scores, n_hubs)
    comp = components_without(paths, chosen)
    near = paths.join(chosen.select(F.col("asset").alias("dst")), "dst").groupBy(F.col("src").alias("asset")).agg(F.min("d").alias("near"))
    rep = comp.join(near, "asset").join(scores.select("asset", "wn"), "asset").select("comp", "asset", (rep_alpha * F.col("near") + (1 - rep_alpha) * F.col("wn") + F.when(sticky, stickiness).otherwise(0.0)).alias("s"))
    best = rep.withColumn("_r", F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("s"), "asset"))).where("_r = 1")
    reps = best.select((F.lit(n_hubs) + F.row_number().over(Window.orderBy(F.desc("s"), "asset")) - 1).alias("pos"), "asset").where(F.col("pos") < k)  # branches of one tree
    picks = chosen.select("pos", "asset").unionByName(reps)
    names = [r.asset for r in picks.orderBy("pos").collect()]  # at most k
    more = farthest_fill(paths, names, k)
    return spark.createDataFrame([(i, x) for i, x in enumerate(names)], "pos int, asset string").unionByName(more.select("pos", "asset"))


def farthest_fill(paths: DataFrame, chosen: Sequence[str], k: int) -> DataFrame:
    """(pos, asset, near): assets that are farthest from all chosen, one after another, up to k; ties by label.

    A round for each: the farthest asset is one row to the driver, and only the distances from it are read then.
    What is left stays a table of a row for each asset; ``paths`` should be a stored one.
    """
    spark = paths.sparkSession
    start, beyond = list(dict.fromkeys(chosen)), F.lit(float("inf"))
    given = F.col("src").isin(start) if start else F.lit(False)
    names = paths.select("src", given.alias("given")).distinct()
    have, out = names.where("given").count(), []
    if have < k:
        near = paths.where(given).groupBy(F.col("dst").alias("asset")).agg(F.min("d").alias("near"))
        left = cut(names.where("not given").select(F.col("src").alias("asset")).join(near, "asset", "left").select("asset", F.coalesce("near", beyond).alias("near")))
    while have + len(out) < k:
        best = left.orderBy(F.desc("near"), "asset").first()
        if best is None:
            break
        out.append((have + len(out), best.asset, best.near))
        step = paths.where(F.col("src") == best.asset).select(F.col("dst").alias("asset"), "d")
        left = cut(left.where(F.col("asset") != best.asset).join(step, "asset", "left").select("asset", F.least("near", F.coalesce("d", beyond)).alias("near")))
    return spark.createDataFrame(out, "pos int, asset string, near double")  # at most k rows


def branch_order(edges: Sequence[tuple[int, int, float]], n: int, weight: np.ndarray, k: int, h: int | None = None, alpha: float = 0.5, gamma: float = 0.0, rep_alpha: float = 0.5, stickiness: float = 0.0, before: Sequence[int] = ()) -> list[int]:
    """The positions that ``hub_branch`` chooses in one tree of n nodes, in order; ties by position."""
    if k <= 0 or k >= n:
        return list(range(n)) if k > 0 else []
    d = edge_distances(edges, n)
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b, _ in edges:
        near[a].append(b)
        near[b].append(a)
    # nodes from the first one outwards, and the sizes of the subtrees behind them
    parent, order = [-1] * n, [0]
    for u in order:
        for v in near[u]:
            if v != parent[u]:
                parent[v] = u
                order.append(v)
    size = np.ones(n, np.int64)
    for u in reversed(order[1:]):
        size[parent[u]] += size[u]
    between = np.array([((n - 1) ** 2 - sum(int(size[v]) ** 2 if parent[v] == u else (n - int(size[u])) ** 2 for v in near[u])) // 2 for u in range(n)], float)
    score = (1 - gamma) * _unit(alpha * np.array([len(x) for x in near], float) + (1 - alpha) * between) + gamma * weight
    early, sticky = np.zeros(n), np.zeros(n)
    if stickiness and len(before):
        early[list(before)[:k]], sticky[list(before)] = stickiness * score.max(), stickiness
    hubs = np.lexsort((np.arange(n), -(score + early)))[: min(default_hubs(k) if h is None else h, k)].tolist()
    comp = np.full(n, -1)
    comp[hubs] = n
    for s in range(n):
        if comp[s] < 0:
            comp[s], todo = s, [s]
            while todo:
                for v in near[todo.pop()]:
                    if comp[v] < 0:
                        comp[v] = s
                        todo.append(v)
    value = rep_alpha * d[hubs].min(axis=0) + (1 - rep_alpha) * weight + sticky
    best: dict[int, int] = {}
    for u in np.lexsort((np.arange(n), -value)).tolist():
        if comp[u] < n:
            best.setdefault(int(comp[u]), u)
    out = hubs + sorted(best.values(), key=lambda u: (-value[u], u))[: k - len(hubs)]
    left = d[out].min(axis=0)
    while len(out) < k:
        left[out] = -np.inf
        out.append(int(np.argmax(left)))
        left = np.minimum(left, d[out[-1]])
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    low, high = v.min(), v.max()
    return (v - low) / ((high - low) if high > low else 1.0)


def basis_series(dist: DataFrame, k: int, caps: DataFrame | None = None, alpha: float = 0.5, stickiness: float = 0.0, method: str = "max_spread", **hub_branch) -> DataFrame:
    """(dt, pos, asset): a basis for every date from the distances strictly before it (dt, u, v, dist).

    Trees are made per date in parallel; with stickiness the choice is a fold over the dates' edges, else it
    is made beside them.  Dates without distances have no basis.  ``caps``: (dt, asset, w), the weights of the
    last date before; without them, or on a date that has none, all weigh the same.
    """
    if method not in ("max_spread", "hub_branch"):
        raise ValueError("method is max_spread or hub_branch")
    rows = dist.where("dist is not null").select("dt", "u", "v", "dist")

    def tree(df: pd.DataFrame) -> pd.DataFrame:
        names, m = square(df, "u", "v", "dist")
        a, b, w = zip(*prim(m), strict=True)
        return pd.DataFrame({"dt": [df["dt"].iloc[0]], "names": [names], "a": [list(a)], "b": [list(b)], "d": [list(w)]})

    trees = rows.groupBy("dt").applyInPandas(tree, f"dt {dict(dist.dtypes)['dt']}, names array<string>, a array<int>, b array<int>, d array<double>")
    if caps is not None:
        maps = caps.groupBy("dt").agg(F.map_from_entries(F.collect_list(F.struct("asset", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("w"))
        trees = trees.join(maps, "dt", "left")
    else:
        trees = trees.withColumn("w", F.lit(None).cast("map<string,double>"))

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        out, prev = [], []
        for r in df.sort_values("dt").itertuples():
            names = list(r.names)
            edges = list(zip(map(int, r.a), map(int, r.b), map(float, r.d), strict=True))
            got = dict(r.w) if r.w is not None else None
            w = scaled({x: got.get(x, 0.0) for x in names} if got else None, names)
            known = [names.index(x) for x in prev if x in names]
            if method == "max_spread":
                picks = [i for i, _ in spread_order(edge_distances(edges, len(names)), w, k, alpha, stickiness, known)]
            else:
                picks = branch_order(edges, len(names), w, k, alpha=alpha, stickiness=stickiness, before=known, **hub_branch)
            prev = [names[i] for i in picks] if stickiness else []
            out += [(r.dt, p, names[i]) for p, i in enumerate(picks)]
        return pd.DataFrame(out, columns=["dt", "pos", "asset"], dtype=None if out else object)

    group = F.lit(0) if stickiness else F.col("dt")
    return trees.withColumn("_g", group.cast("string")).groupBy("_g").applyInPandas(lambda df: fold(df), f"dt {dict(dist.dtypes)['dt']}, pos int, asset string")


def mean_tree_distance(paths: DataFrame) -> DataFrame:
    """The mean over all nodes, the node itself (0) among them."""
    return paths.groupBy(F.col("src").alias("asset")).agg(F.avg("d").alias("avg_dist"))


def normalise_scores(scores: DataFrame, value: str, fallback: float = 0.0) -> DataFrame:
    """``value`` brought to [0, 1]; missing ones get the fallback."""
    return scores.select("asset", F.coalesce(normalised(F.col(value)), F.lit(fallback)).alias("score"))


def nearest_member(paths: DataFrame, members: DataFrame) -> DataFrame:
    """asset, member, d: the nearest member of a basis by tree distance, ties by label."""
    got = paths.join(members.select(F.col("asset").alias("dst")), "dst").groupBy(F.col("src").alias("asset")).agg(F.min(F.struct("d", "dst")).alias("x"))
    return got.select("asset", F.col("x.dst").alias("member"), F.col("x.d").alias("d"))
