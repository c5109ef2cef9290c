"""Minimum spanning trees and questions about trees.

A tree is an edge table (u, v, w) with u < v; labels order ties.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.functions.stats import square, symmetric
from indexloom.operators.forest import spanning_forest
from indexloom.plans.tables import cut


class UnionFind:
    """Disjoint sets of labels, joined by size; of equal sets the second gives the root."""

    def __init__(self, labels: Iterable[Hashable] = ()):
        self.parent = {x: x for x in labels}
        self.size = dict.fromkeys(self.parent, 1)

    def find(self, x: Hashable) -> Hashable:
        self.parent.setdefault(x, x)
        self.size.setdefault(x, 1)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while x != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: Hashable, b: Hashable) -> bool:
        """Whether they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] > self.size[b]:
            a, b = b, a
        self.parent[a] = b
        self.size[b] += self.size[a]
        return True

    def get_size(self, x: Hashable) -> int:
        return self.size[self.find(x)]


def mst(dist: DataFrame) -> DataFrame:
    """The minimum spanning tree of (u, v, dist); NULL distances come last, ties by labels."""
    return spanning_forest(dist)


def prim(m: np.ndarray) -> list[tuple[int, int, float]]:
    """The tree of a dense matrix; NaN is farthest, ties by (u, v)."""
    n = len(m)
    if n < 2:
        return []
    m = np.where(np.isnan(m), np.inf, m)
    i, j = np.triu_indices(n, 1)
    order = np.lexsort((j, i, m[i, j]))
    sets, out = UnionFind(range(n)), []
    for e in order:
        a, b = int(i[e]), int(j[e])
        if sets.union(a, b):
            out.append((a, b, float(m[a, b])))
            if len(out) == n - 1:
                break
    return out


def mst_by(dist: DataFrame, by: str = "dt") -> DataFrame:
    """A tree per value of ``by``: (by, u, v, w), each in one Python call over its own pairs."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        names, m = square(df, "u", "v", "dist")
        t = prim(m)
        return pd.DataFrame([(df[by].iloc[0], names[a], names[b], w) for a, b, w in t], columns=[by, "u", "v", "w"], dtype=None if t else object)

    return dist.groupBy(by).applyInPandas(one, f"{by} {dict(dist.dtypes)[by]}, u string, v string, w double")


def check_matrix(rows: list[list[float]], labels: list | None = None) -> None:
    """Whether a matrix can be spanned: square, not empty, and as many labels."""
    if not rows or any(len(r) != len(rows) for r in rows):
        raise ValueError("the matrix must be square and not empty")
    if labels is not None and len(labels) != len(rows):
        raise ValueError("there must be a label for each row")


def from_matrix(spark, rows: list[list[float]], labels: list | None = None) -> DataFrame:  # noqa: ANN001
    """(u, v, dist) of the upper triangle."""
    check_matrix(rows, labels)
    names = [str(x) for x in (labels or range(len(rows)))]
    data = [(names[i], names[j], float(rows[i][j])) for i in range(len(rows)) for j in range(i + 1, len(rows))]
    return spark.createDataFrame(data, "u string, v string, dist double")


def nodes(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("u").alias("asset")).union(tree.select(F.col("v").alias("asset"))).distinct()


def walks(tree: DataFrame, depth: int = 1000) -> DataFrame:
    """src, dst, d, hops, first_hop, path between all nodes, by a recursive query over the edges."""
    spark = tree.sparkSession
    symmetric(tree, "w").createOrReplaceTempView("_tree_edges")
    nodes(tree).createOrReplaceTempView("_tree_nodes")
    return spark.sql(f"""
        WITH RECURSIVE walk(src, dst, prev, d, hops, first_hop, path) MAX RECURSION LEVEL {depth} AS (
          SELECT asset, asset, CAST(NULL AS STRING), CAST(0 AS DOUBLE), 0, CAST(NULL AS STRING), array(asset) FROM _tree_nodes
          UNION ALL
          SELECT src, e.v, dst, d + e.w, hops + 1, coalesce(first_hop, e.v), concat(path, array(e.v))
          FROM walk JOIN _tree_edges e ON dst = e.u WHERE prev IS NULL OR e.v <> prev
        ) SELECT src, dst, d, hops, first_hop, path FROM walk""")


def path_length(paths: DataFrame, src: str, dst: str) -> DataFrame:
    """One row, d: 0 for a node itself, infinite where there is no way."""
    same = F.lit(0.0 if src == dst else float("inf"))
    return paths.where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.coalesce(F.min("d"), same).alias("d"))


def degrees(tree: DataFrame) -> DataFrame:
    both = symmetric(tree, "w")
    return both.groupBy(F.col("u").alias("asset")).agg(F.count(F.lit(1)).alias("degree"))


def betweenness(paths: DataFrame) -> DataFrame:
    """Pairs of other nodes whose way leads through each node, from the sizes of its branches."""
    size = paths.where("first_hop is not null").groupBy("src", "first_hop").agg(F.count(F.lit(1)).alias("s"))
    n = paths.select("src").distinct().agg(F.count(F.lit(1)).alias("n"))
    got = size.groupBy(F.col("src").alias("asset")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    return got.crossJoin(F.broadcast(n)).select("asset", (((F.col("n") - 1) * (F.col("n") - 1) - F.col("q")) / 2).cast("long").alias("betweenness"))  # n: one row


def components_without(paths: DataFrame, removed: DataFrame) -> DataFrame:
    """asset, comp (its smallest asset) when the ``removed`` assets are taken out of the tree."""
    gone = removed.agg(F.collect_set("asset").alias("gone"))  # the hubs: a few
    left = paths.crossJoin(F.broadcast(gone)).where(~F.arrays_overlap("path", "gone"))
    return left.groupBy(F.col("src").alias("asset")).agg(F.min("dst").alias("comp"))


def euclidean(points: DataFrame) -> DataFrame:
    """(u, v, dist) of points (id, x, y)."""
    a = points.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = points.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return a.join(b, F.col("u") < F.col("v")).select("u", "v", F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")).alias("dist"))


#: The plane around a point in eight sectors of 45 degrees: left (4), below (2), steep (1).
_SECTORS = 8


def _sector(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return (dx < 0) * 4 + (dy < 0) * 2 + (np.abs(dy) > np.abs(dx))


def _turned(s: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Boxes, relative to a point, mirrored so that its sector ``s`` becomes 0 <= y <= x."""
    left, below, steep = s & 4 > 0, s & 2 > 0, s & 1 > 0
    x0, x1 = np.where(left, -x1, x0), np.where(left, -x0, x1)
    y0, y1 = np.where(below, -y1, y0), np.where(below, -y0, y1)
    return np.where(steep, y0, x0), np.where(steep, y1, x1), np.where(steep, x0, y0), np.where(steep, x1, y1)


def nearest_by_sector(x: np.ndarray, y: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """For each point and sector the index of the nearest other point (the first of equal ones) and its distance, infinite without one."""
    near, dist = np.zeros((len(x), _SECTORS), np.int64), np.full((len(x), _SECTORS), np.inf)
    for k in range(0, len(x), block):
        rows = np.arange(k, min(k + block, len(x)))
        dx, dy = x - x[rows, None], y - y[rows, None]
        d, sector = np.hypot(dx, dy), _sector(dx, dy)
        d[rows - k, rows] = np.inf
        for s in range(_SECTORS):
            own = np.where(sector == s, d, np.inf)
            near[rows, s] = own.argmin(axis=1)
            dist[rows, s] = own[rows - k, near[rows, s]]
    return near, dist


def blocks_to_ask(px: np.ndarray, py: np.ndarray, s: np.ndarray, d: np.ndarray, boxes: np.ndarray, marks: np.ndarray, own: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(which, box): the boxes other than ``own`` that may hold a point of sector ``s`` around (px, py) not farther than ``d``.

    ``boxes``: x from, x to, y from, y to; ``marks``: some of the points, which bound the distance where the own box holds no point of the sector.
    """
    which, box = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(px), block):
        x, y, sector = px[k : k + block, None], py[k : k + block, None], s[k : k + block, None]
        dx, dy = marks[:, 0] - x, marks[:, 1] - y
        there = (_sector(dx, dy) == sector) & ((dx != 0) | (dy != 0))
        reach = np.minimum(d[k : k + block], np.where(there, np.hypot(dx, dy), np.inf).min(axis=1))[:, None]
        x0, x1, y0, y1 = _turned(sector, boxes[:, 0] - x, boxes[:, 1] - x, boxes[:, 2] - y, boxes[:, 3] - y)
        meets = (y1 >= 0) & (x1 >= np.maximum(y0, 0)) & (np.hypot(np.maximum(x0, 0), np.maximum(y0, 0)) * (1 - 1e-9) <= reach)
        meets[:, own] = False
        i, j = np.nonzero(meets)
        which.append(i + k)
        box.append(j)
    return np.concatenate(which), np.concatenate(box)


def _dealt(first: DataFrame, rows: int) -> DataFrame:
    """The points (id, x, y) with their ``block``: strips of x, cut by y, of about ``rows`` points each; 64 x 64 at most."""
    side = max(1, min(64, math.ceil(math.sqrt(first.count() / rows))))
    if side == 1:
        return first.withColumn("block", F.lit(0))
    shares = [k / side for k in range(1, side)]

    def place(c: str, cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda cut_at: F.col(c) > cut_at))

    strips = cut(first.withColumn("strip", place("x", F.array(*[F.lit(c) for c in first.approxQuantile("x", shares, 0.001)]))))
    inner = strips.groupBy("strip").agg(F.percentile_approx("y", shares, 10000).alias("cuts"))
    return cut(strips.join(F.broadcast(inner), "strip").select("id", "x", "y", (F.col("strip") * side + place("y", F.col("cuts"))).alias("block")))  # 64 rows at most


def near_edges(dealt: DataFrame, block: int = 1024) -> DataFrame:
    """(u, v, dist): edges among which all of the tree are, of points (id, x, y, block), no two at one place.

    Of the edges of a point within a sector of 45 degrees only the shortest can be in the tree: any other is the longest
    of the triangle with it.  So each point looks for the nearest in its eight sectors, first in its own block, then in
    those blocks whose boxes reach into the sector nearer than what was found.  An edge longer than both ways by another
    one found is dropped.
    """
    at = F.struct("x", "y")
    marks = [f(at, c).alias(f"{n}{c}") for c in "xy" for n, f in (("least", F.min_by), ("most", F.max_by))]
    table = dealt.groupBy("block").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), *marks).orderBy("block").collect()  # 4,096 rows at most
    names, boxes, corners = np.array([r.block for r in table]), np.array([r[1:5] for r in table], float).reshape(-1, 4), np.array([tuple(m) for r in table for m in r[5:]], float).reshape(-1, 2)
    label = dict(dealt.dtypes)["id"]
    columns = ["u", "ux", "uy", "sector", "dist", "v", "vx", "vy", "block"]

    def inside(df: pd.DataFrame) -> pd.DataFrame:
        """What the block itself holds (block -1), and who must ask which other blocks."""
        df = df.sort_values("id")
        ids, x, y = df["id"].to_numpy(), df["x"].to_numpy(), df["y"].to_numpy()
        own = int(np.searchsorted(names, df["block"].iloc[0]))
        near, d = nearest_by_sector(x, y, block)
        i, s = np.nonzero(np.isfinite(d))
        j = near[i, s]
        found = pd.DataFrame({"u": ids[i], "ux": x[i], "uy": y[i], "sector": s, "dist": d[i, s], "v": ids[j], "vx": x[j], "vy": y[j], "block": -1})
        # no other block has points within the box of this one
        room = np.stack([np.minimum(np.where(s & 4, x - x.min(), x.max() - x), np.where(s & 2, y - y.min(), y.max() - y)) for s in range(_SECTORS)], axis=1)
        i, s = np.nonzero(d > room * (1 - 1e-9))
        which, box = blocks_to_ask(x[i], y[i], s, d[i, s], boxes, corners, own, block)
        i, s = i[which], s[which]
        asked = pd.DataFrame({"u": ids[i], "ux": x[i], "uy": y[i], "sector": s, "dist": d[i, s], "v": None, "vx": np.nan, "vy": np.nan, "block": names[box]})
        return pd.concat([found, asked[columns]]) if len(asked) else found

    def answer(asked: pd.DataFrame, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        ids, x, y = df["id"].to_numpy(), df["x"].to_numpy(), df["y"].to_numpy()
        out = [asked.iloc[:0]]
        for k in range(0, len(asked) if len(df) else 0, block):
            part = asked.iloc[k : k + block]
            dx, dy = x - part["ux"].to_numpy()[:, None], y - part["uy"].to_numpy()[:, None]
            d = np.where(_sector(dx, dy) == part["sector"].to_numpy()[:, None], np.hypot(dx, dy), np.inf)
            j = d.argmin(axis=1)
            best = d[np.arange(len(part)), j]
            got = part.assign(dist=best, v=ids[j], vx=x[j], vy=y[j], block=-1)
            out.append(got[np.isfinite(best) & (best <= part["dist"].to_numpy())])
        return pd.concat(out)

    schema = f"u {label}, ux double, uy double, sector int, dist double, v {label}, vx double, vy double, block int"
    first = cut(dealt.groupBy("block").applyInPandas(inside, schema))
    more = first.where("block >= 0").groupBy("block").cogroup(dealt.groupBy("block")).applyInPandas(answer, schema)
    best = first.where("block < 0").unionByName(more).groupBy("u", "sector").agg(F.min(F.struct("dist", "v", "vx", "vy")).alias("to"))
    ways = best.groupBy("u").agg(F.collect_list("to").alias("ways"))  # one for each sector
    shorter = F.filter("ways", lambda e: ~F.exists("ways", lambda o: (o["dist"] < e["dist"]) & (F.hypot(o["vx"] - e["vx"], o["vy"] - e["vy"]) < e["dist"] * (1 - 1e-9))))
    edges = ways.select("u", F.explode(shorter).alias("e"))
    return edges.select(F.least("u", "e.v").alias("u"), F.greatest("u", "e.v").alias("v"), "e.dist").groupBy("u", "v").agg(F.min("dist").alias("dist"))


def euclidean_mst(points: DataFrame, rows: int = 1024, block: int = 1024) -> DataFrame:
    """The minimum spanning tree of all points (id, x, y) of the plane, without all their pairs; ties by labels.

    Points are dealt into blocks of about ``rows`` (4,096 blocks at most), a task each, which compares ``block`` points at a time
    with all of its block.  Of points at one place the first takes part, and the others hang on it.  Points without a
    place (NULL, NaN or infinite) come last, as NULL distances do.
    """
    known = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    first = cut(points.where(known).groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y"))
    edges = points.where(known).join(first.withColumnRenamed("id", "u"), ["x", "y"]).where("id <> u").select("u", F.col("id").alias("v"), F.lit(0.0).alias("dist"))
    edges = edges.unionByName(near_edges(_dealt(first, rows), block))
    lost = points.where(~known).select("id")
    if not lost.isEmpty():
        lost = lost.union(first.agg(F.min("id")).where("`min(id)` is not null"))
        hub = F.lit(lost.agg(F.min("id")).first()[0])
        edges = edges.unionByName(lost.where(F.col("id") != hub).select(hub.alias("u"), F.col("id").alias("v"), F.lit(None).cast("double").alias("dist")))
    return mst(edges)


def argmax(scores: DataFrame, score: str = "score", order: str = "asset") -> DataFrame:
    """The label with the largest score; the first of equal ones."""
    return scores.orderBy(F.desc_nulls_last(score), order).limit(1)
