"""Spanning trees, tree queries and selection."""

from itertools import combinations

import numpy as np
import pytest

from indexloom.operators import selection, tree
from indexloom.plans.tables import cut

CHAIN = [(i, i + 1, 1.0) for i in range(4)]
STAR = [(0, i, 1.0) for i in (1, 2, 3)]


def edges(spark, rows):
    return spark.createDataFrame([(str(u), str(v), float(w)) for u, v, w in rows], "u string, v string, w double")


def matrix(spark, rows, labels=None):
    return tree.from_matrix(spark, rows, labels)


def test_union_find():
    sets = tree.UnionFind("abc")
    assert sets.union("a", "b") and not sets.union("b", "a")
    assert sets.find("a") == sets.find("b") == "b"
    assert (sets.get_size("a"), sets.get_size("c"), sets.find("new")) == (2, 1, "new")


def test_small_trees(spark):
    triangle = matrix(spark, [[0, 1, 5], [1, 0, 2], [5, 2, 0]])
    assert {tuple(r) for r in tree.mst(triangle).collect()} == {("0", "1", 1.0), ("1", "2", 2.0)}
    full = matrix(spark, [[0, 1, 4, 5], [1, 0, 2, 3], [4, 2, 0, 1.5], [5, 3, 1.5, 0]])
    assert sorted(r.w for r in tree.mst(full).collect()) == [1.0, 1.5, 2.0]
    named = matrix(spark, [[0, 1, 3], [1, 0, 2], [3, 2, 0]], list("ABC"))
    assert {r.u + r.v for r in tree.mst(named).collect()} == {"AB", "BC"}


def test_random_trees_agree(spark):
    rng = np.random.default_rng(8)
    m = rng.integers(1, 6, (12, 12)).astype(float)
    m = np.triu(m, 1) + np.triu(m, 1).T
    names = [f"n{i:02d}" for i in range(12)]
    df = matrix(spark, m.tolist(), names)
    assert sorted(tuple(r) for r in tree.mst(df).collect()) == sorted((names[a], names[b], w) for a, b, w in tree.prim(m))
    by = tree.mst_by(df.selectExpr("1 AS dt", "*"))
    assert sorted((r.u, r.v, r.w) for r in by.collect()) == sorted((names[a], names[b], w) for a, b, w in tree.prim(m))


def test_missing_distances_come_last(spark):
    df = spark.createDataFrame([("a", "b", None), ("a", "c", 1.0), ("b", "c", 9.0)], "u string, v string, dist double")
    assert {r.u + r.v for r in tree.mst(df).collect()} == {"ac", "bc"}


@pytest.mark.parametrize("bad", [[], [[0, 1]], [[0, 1], [1]]])
def test_bad_matrices(bad):
    with pytest.raises(ValueError):
        tree.check_matrix(bad)


def test_labels_must_fit():
    with pytest.raises(ValueError):
        tree.check_matrix([[0]], ["a", "b"])


def test_tree_queries(spark):
    t = edges(spark, [(0, 1, 1), (1, 2, 2)])
    paths = tree.walks(t)
    assert {(r.src, r.dst): r.d for r in paths.collect()}["0", "2"] == 3.0
    assert tree.path_length(paths, "0", "2").first().d == 3.0
    assert tree.path_length(paths, "0", "0").first().d == 0.0
    assert tree.path_length(paths, "0", "zz").first().d == float("inf")


@pytest.mark.parametrize(("rows", "between", "degree"), [(CHAIN, [0, 3, 4, 3, 0], [1, 2, 2, 2, 1]), (STAR, [3, 0, 0, 0], [3, 1, 1, 1]), (CHAIN[:3], [0, 2, 2, 0], [1, 2, 2, 1])])
def test_centrality(spark, rows, between, degree):
    t = edges(spark, rows)
    assert {int(r.asset): r.betweenness for r in tree.betweenness(tree.walks(t)).collect()} == dict(enumerate(between))
    assert {int(r.asset): r.degree for r in tree.degrees(t).collect()} == dict(enumerate(degree))


def test_components(spark):
    paths = tree.walks(edges(spark, CHAIN))
    gone = spark.createDataFrame([("2",)], "asset string")
    assert {r.asset: r.comp for r in tree.components_without(paths, gone).collect()} == {"0": "0", "1": "0", "3": "3", "4": "3"}


def test_max_spread(spark):
    paths = tree.walks(edges(spark, CHAIN))
    assert [r.asset for r in selection.max_spread(paths, 2, alpha=1.0).orderBy("pos").collect()] == ["0", "4"]
    assert selection.max_spread(paths, 0).count() == 0
    assert [r.asset for r in selection.max_spread(paths, 99).orderBy("pos").collect()] == ["0", "1", "2", "3", "4"]
    heavy = spark.createDataFrame([("3", 5.0), ("0", 1.0)], "asset string, w double")
    assert selection.max_spread(paths, 1, heavy, alpha=0.0).first().asset == "3"
    sticky = selection.max_spread(paths, 1, alpha=1.0, stickiness=5.0, before=["2", "2", "nobody"])
    assert sticky.first().asset == "2"


def brute_spread(d, w, k, alpha):
    picks = []
    for _ in range(k):
        best, score = None, -np.inf
        for i in range(len(d)):
            if i in picks:
                continue
            s = alpha * (min(d[i][j] for j in picks) if picks else np.mean(d[i])) + (1 - alpha) * w[i]
            if s > score + 1e-15:
                best, score = i, s
        picks.append(best)
    return picks


def test_spread_order_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.random((9, 2))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        w = rng.random(9)
        assert [i for i, _ in selection.spread_order(d, w, 5, 0.4)] == brute_spread(d, w, 5, 0.4)


def test_hub_branch(spark):
    t = edges(spark, STAR)
    paths = tree.walks(t)
    got = [r.asset for r in selection.hub_branch(t, paths, 3, h=1).orderBy("pos").collect()]
    assert got == ["0", "1", "2"]
    got = [r.asset for r in selection.hub_branch(edges(spark, CHAIN), tree.walks(edges(spark, CHAIN)), 3, h=1, rep_alpha=1.0).orderBy("pos").collect()]
    assert got == ["2", "0", "4"]
    sticky = [r.asset for r in selection.hub_branch(t, paths, 2, h=1, stickiness=9.0, before=["3"]).orderBy("pos").collect()]
    assert "3" in sticky
    assert [r.asset for r in selection.hub_branch(t, paths, 4).orderBy("pos").collect()] == ["0", "1", "2", "3"]
    assert selection.hub_branch(t, paths, 0).count() == 0
    assert selection.default_hubs(10) == 2 and selection.default_hubs(2) == 1


def test_farthest_fill(spark):
    paths = cut(tree.walks(edges(spark, CHAIN)))
    got = selection.farthest_fill(paths, ["0"], 3).orderBy("pos").collect()
    assert [(r.pos, r.asset) for r in got] == [(1, "4"), (2, "2")]
    assert [(r.pos, r.asset) for r in selection.farthest_fill(paths, [], 2).orderBy("pos").collect()] == [(0, "0"), (1, "4")]
    assert [r.asset for r in selection.farthest_fill(paths, ["0", "4", "0", "nobody"], 99).orderBy("pos").collect()][0] == "2"
    assert selection.farthest_fill(paths, ["0", "4", "0"], 99).count() == 3
    assert selection.farthest_fill(paths, ["0"], 1).count() == 0


def test_scores(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "asset string, w double")
    assert {r.asset: r.score for r in selection.normalise_scores(s, "w", 0.25).collect()} == {"a": 0.0, "b": 1.0, "c": 0.25}
    assert selection.scaled(None, ["a"], 0.5).tolist() == [0.5]
    assert selection.scaled({"a": 2.0}, ["a", "b"], 0.5).tolist() == [0.0, 0.5]
    assert tree.argmax(s, "w").first().asset == "b"


def test_series_carries_the_basis(spark):
    rows = []
    rng = np.random.default_rng(1)
    for t in range(1, 5):
        rows += [(f"2020-0{t}-01", u, v, float(rng.random() + 0.1)) for u, v in combinations("abcde", 2)]
    dist = spark.createDataFrame(rows, "d string, u string, v string, dist double").selectExpr("to_date(d) AS dt", "u", "v", "dist")
    loose = selection.basis_series(dist, 2, stickiness=0.0)
    assert loose.count() == 8
    tight = {}
    for r in selection.basis_series(dist, 2, stickiness=100.0).collect():
        tight.setdefault(str(r.dt), set()).add(r.asset)
    assert len({frozenset(x) for x in tight.values()}) == 1


def test_stream_agrees_with_the_fold(spark, tmp_path):
    from indexloom.streaming.carry import carried_basis

    rng = np.random.default_rng(1)
    rows = [("p", f"2020-0{t}-01", u, v, float(rng.random() + 0.1)) for t in range(1, 5) for u, v in combinations("abcde", 2)]
    schema = "portfolio string, dt string, u string, v string, dist double"
    for k in (0, 1):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = carried_basis(stream, 2, 0.5, 0.2).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.dt, r.pos): r.asset for r in spark.sql("SELECT * FROM carried").collect()}
    batch = selection.basis_series(spark.createDataFrame(rows, schema).selectExpr("to_date(dt) AS dt", "u", "v", "dist"), 2, None, 0.5, 0.2)
    assert got == {(str(r.dt), r.pos): r.asset for r in batch.collect()}


@pytest.mark.parametrize("block", [4, 1000])
def test_trees_of_the_plane(spark, block):
    """Blocks and pairs of them give the tree of all distances: ties, copies, outliers and missing places."""
    rng = np.random.default_rng(12)
    xy = [(float(a), float(b)) for a, b in rng.integers(0, 9, (60, 2))] + [(float(a), float(b)) for a, b in rng.standard_normal((70, 2)) * 3] + [(80.0, -4.0), (-500.0, 3.0), (None, 1.0), (2.0, None)]
    points = spark.createDataFrame([(f"p{i:03d}", a, b) for i, (a, b) in enumerate(xy)], "id string, x double, y double")
    want = {(r.u, r.v): r.w for r in tree.mst(tree.euclidean(points)).collect()}
    got = {(r.u, r.v): r.w for r in tree.euclidean_mst(points, rows=max(8, block), block=block).collect()}
    assert len(got) == len(xy) - 1 and got.keys() == want.keys()
    assert all(w is None and got[e] is None or got[e] == pytest.approx(w) for e, w in want.items())


def test_trees_of_the_plane_from_few_edges(spark):
    """Each point contributes its nearest by sectors, not all pairs of its block with others: shapes far apart, one infinite place."""
    rng = np.random.default_rng(5)
    turn = np.linspace(0, 6, 120)
    shapes = [rng.standard_normal((150, 2)), np.stack([np.arange(120.0), np.zeros(120)], 1), np.stack([np.cos(turn), np.sin(turn)], 1) * 9, np.stack(np.divmod(np.arange(100.0), 10), 1), np.full((40, 2), 3.0) + rng.integers(0, 3, (40, 1)) * 1e-9]
    xy = np.unique(np.concatenate([p + np.array([50.0 * k, (-1) ** k * 30.0]) for k, p in enumerate(shapes)]), axis=0)
    xy = xy[rng.permutation(len(xy))]
    points = spark.createDataFrame([(f"{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(xy)], "id string, x double, y double")
    m = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    want = {(f"{a:04d}", f"{b:04d}"): w for a, b, w in tree.prim(m)}
    lost = spark.createDataFrame([("9999", float("inf"), 0.0)], "id string, x double, y double")
    got = {(r.u, r.v): r.w for r in tree.euclidean_mst(points.union(lost), rows=16, block=10).collect()}
    assert got.pop(("0000", "9999")) is None
    assert got == pytest.approx(want)
    edges = tree.near_edges(tree._dealt(points, 16), 10)
    assert edges.count() < 3 * len(xy)
