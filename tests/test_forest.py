"""Forests from edges alone, prefix scans and as-of joins, against brute force."""

import bisect
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexloom.functions import scan
from indexloom.operators import forest, tree


def edges(spark, rows):
    return spark.createDataFrame([(u, v, float(w)) for u, v, w in rows], "u string, v string, w double")


def random_tree(seed, n, reach=None):
    """(parent, child, weight); ``reach`` makes it deep."""
    r = random.Random(seed)
    names = [f"n{i:06d}" for i in range(n)]
    r.shuffle(names)
    return [(names[i], names[r.randrange(max(0, i - reach) if reach else 0, i)], r.randint(1, 9)) for i in range(1, n)]


def brute(rows, root):
    """asset: (parent, depth, d, size, step), depth first, children by label."""
    near = defaultdict(list)
    for u, v, w in rows:
        near[u].append((v, w))
        near[v].append((u, w))
    out, stack, order = {}, [(root, None, 0, 0.0)], []
    while stack:
        x, parent, depth, d = stack.pop()
        out[x] = [parent, depth, d, 1, len(order)]
        order.append(x)
        stack += [(y, x, depth + 1, d + w) for y, w in sorted(near[x], reverse=True) if y != parent]
    for x in reversed(order):
        if out[x][0] is not None:
            out[out[x][0]][3] += out[x][3]
    return {k: tuple(v) for k, v in out.items()}


def kruskal(rows):
    sets, out = tree.UnionFind(), []
    for u, v, w in sorted(rows, key=lambda r: (r[2] is None, r[2] if r[2] is not None else 0, min(r[:2]), max(r[:2]))):
        if u != v and sets.union(u, v):
            out.append((min(u, v), max(u, v), w))
    return sorted(out, key=repr), sets


@pytest.mark.parametrize(("n", "reach"), [(2, None), (40, None), (40, 2)])
def test_rooted(spark, n, reach):
    rows = random_tree(n, n, reach)
    t = edges(spark, rows)
    want = brute(rows, min(x for r in rows for x in r[:2]))
    nodes = forest.rooted(t).cache()
    assert {r.asset: (r.parent, r.depth, r.d, r.size, r.step) for r in nodes.collect()} == want
    if n > 2:
        paths = tree.walks(t).cache()
        assert sorted(forest.betweenness(nodes).collect()) == sorted(tree.betweenness(paths).collect())
        means = {r.src: r.m for r in paths.groupBy("src").agg(F.avg("d").alias("m")).collect()}
        assert {r.asset: pytest.approx(r.avg_dist) for r in forest.mean_distance(nodes).collect()} == means
        assert sorted(tuple(r) for r in forest.branches(nodes).collect()) == sorted((r.src, r.first_hop, r["count"]) for r in paths.where("first_hop is not null").groupBy("src", "first_hop").count().collect())
        got = forest.Ways(t).between(paths.select("src", "dst", F.col("d").alias("want")))
        assert got.where("d <> want").count() == 0
        gone = spark.createDataFrame([(rows[0][0],), (rows[5][1],)], "asset string")
        assert sorted(forest.components_without(t, gone).collect()) == sorted(tree.components_without(paths, gone).collect())
    trace = forest.betweenness_trace(nodes).orderBy("step").collect()
    assert [r.step for r in trace] == list(range(n))


def test_forest_of_several_trees(spark):
    rows = [("a", "b", 1), ("c", "d", 2), ("d", "e", 3)]
    nodes = {r.asset: r for r in forest.rooted(edges(spark, rows)).collect()}
    assert {k: (r.root, r.n, r.size, r.total) for k, r in nodes.items()} == {"a": ("a", 2, 2, 1.0), "b": ("a", 2, 1, 1.0), "c": ("c", 3, 3, 7.0), "d": ("c", 3, 2, 5.0), "e": ("c", 3, 1, 8.0)}
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("e", "c"), ("zz", "zz"), ("zz", "a")], "src string, dst string")
    assert {(r.src, r.dst): r.d for r in forest.Ways(edges(spark, rows)).between(asked).collect()} == {("a", "b"): 1.0, ("a", "c"): math.inf, ("e", "c"): 5.0, ("zz", "zz"): 0.0, ("zz", "a"): math.inf}


def test_spanning_forest(spark):
    r = random.Random(4)
    rows = [(f"x{r.randrange(60):02d}", f"x{r.randrange(60):02d}", r.choice([None, 1.0, 2.0, 3.5, 4.0])) for _ in range(150)] + [("y1", "y2", None), ("y3", "y3", 1.0)]
    df = spark.createDataFrame(rows, "u string, v string, dist double")
    least = {}
    for u, v, w in rows:
        k = (min(u, v), max(u, v))
        least[k] = min([x for x in (least.get(k), w) if x is not None], default=None)
    want, sets = kruskal([(*k, w) for k, w in least.items()])
    assert sorted((tuple(x) for x in forest.spanning_forest(df).collect()), key=repr) == want
    got = {x.asset: x.comp for x in forest.components(df.select("u", "v"), df.select(F.col("u").alias("asset")).union(df.select("v"))).collect()}
    members = defaultdict(set)
    for x in got:
        members[sets.find(x)].add(x)
    assert got == {x: min(m) for m in members.values() for x in m}
    assert forest.spanning_forest(df.where("false")).count() == 0


def test_large_tree(spark):
    """10,000 nodes, some thousand deep: no recursion, no list of labels."""
    rows = random_tree(7, 10_000, 4)
    want = brute(rows, "n000000")
    got = forest.rooted(edges(spark, rows), spark.createDataFrame([("n000000",)], "asset string")).collect()
    assert {r.asset: (r.parent, r.depth, r.d, r.size, r.step) for r in got} == want
    assert max(r.depth for r in got) > 1000


def test_running(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, r.randint(-9, 9)])) for i in range(500)] + [("one", 1000, None)]
    df = spark.createDataFrame(rows, "g string, i int, x int").repartition(3)
    got = scan.running(df, ["i"], {"s": ("sum", "x"), "m": ("max", "x"), "l": ("last", "x")}, ["g"], parts=7).collect()
    seen = defaultdict(list)
    want = {}
    for g, i, x in rows:
        if x is not None:
            seen[g].append(x)
        v = seen[g]
        want[i] = (sum(v), max(v), v[-1]) if v else (None, None, None)
    assert {x.i: (x.s, x.m, x.l) for x in got} == want
    product = scan.running_product(df, ["i"], F.col("x").cast("double") / 4, "p").collect()
    p, wanted = 1.0, {}
    for _, i, x in rows:
        p *= 1 if x is None else x / 4
        wanted[i] = p
    assert {x.i: pytest.approx(x.p) for x in product} == wanted


def test_running_over_a_million_rows(spark):
    got = scan.running(spark.range(1_000_000).select(F.col("id").alias("i"), F.lit(1).alias("x")), ["i"], {"s": ("sum", "x")}, parts=8)
    assert got.where("s <> i + 1").count() == 0
    assert got.count() == 1_000_000


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    r = random.Random(2)
    right = sorted({(r.choice("ab"), r.randrange(100)) for _ in range(30)})
    left = [(r.choice("abc"), r.randrange(100), k) for k in range(200)]
    got = scan.asof(spark.createDataFrame(left, "g string, t int, k int"), spark.createDataFrame([(g, t, t * 2.0) for g, t in right], "g string, t int, v double"), "t", ["g"], strict, parts=5).collect()
    for row in got:
        times = [t for g, t in right if g == row.g]
        at = (bisect.bisect_left if strict else bisect.bisect_right)(times, row.t) - 1
        assert (row.t_found, row.v) == ((times[at], times[at] * 2.0) if at >= 0 else (None, None))
    assert sorted(x.k for x in got) == list(range(200))
    assert np.isfinite([x.v for x in got if x.v is not None]).all()


def test_rooted_forest_contracts_once(spark, monkeypatch):
    """Roots come from the labels of the one contraction that gives the forest; parallel edges of equal length, loops and NULLs."""
    r = random.Random(8)
    rows = [(f"x{r.randrange(40):02d}", f"x{r.randrange(40):02d}", r.choice([None, 1.0, 2.0])) for _ in range(60)]
    rows += rows[:9] + [(v, u, w) for u, v, w in rows[:5]] + [("y2", "y1", 1.0), ("y3", "y3", 1.0)]
    df = spark.createDataFrame(rows, "u string, v string, dist double")
    calls, contract = [], forest.contract
    monkeypatch.setattr(forest, "contract", lambda *a, **k: calls.append(1) or contract(*a, **k))
    got = {x.asset: (x.root, x.parent) for x in forest.rooted_forest(df).collect()}
    assert len(calls) == 1
    least = {}
    for u, v, w in rows:
        k = (min(u, v), max(u, v))
        least[k] = min([x for x in (least.get(k), w) if x is not None], default=None)
    want, sets = kruskal([(*k, w) for k, w in least.items()])
    assert sorted((min(a, p), max(a, p)) for a, (_, p) in got.items() if p) == sorted((u, v) for u, v, _ in want)
    members = defaultdict(set)
    for x in got:
        members[sets.find(x)].add(x)
    assert {a: root for a, (root, _) in got.items()} == {x: min(m) for m in members.values() for x in m}
