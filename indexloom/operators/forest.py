"""Spanning forests and questions about them, from edge tables alone: no walks between all nodes, no list of labels on the driver.

A forest is an edge table (u, v, w).  Every step is a join or an aggregate of as many rows as there are edges or nodes, and
the number of steps follows the logarithm of their number: contraction halves the components at least, pointer
jumping doubles how far a node sees.  Intermediate tables are written, so plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions.scan import running
from indexloom.functions.stats import symmetric
from indexloom.plans.tables import cut


def _roots(pointers: DataFrame) -> DataFrame:
    """(c, p): for pointers (c, p) without cycles but loops, the node at the end of each one's way, by pointer jumping."""
    while True:
        ahead = pointers.select(F.col("c").alias("p"), F.col("p").alias("further"))
        pointers = cut(pointers.join(ahead, "p").select("c", F.col("further").alias("p"), (F.col("further") != F.col("p")).alias("moved")))
        if pointers.where("moved").isEmpty():
            return pointers.select("c", "p")


def contract(edges: DataFrame, labels: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The edges (e) of the minimum spanning forest of (u, v, e), and with ``labels`` (asset, comp) of all nodes that have an edge to another.

    ``e`` orders the edges; they are sorted once, and only their places in that order go through the rounds.  In each round
    every component takes its smallest outgoing edge; the trees that these make are contracted to one of their nodes, and of
    parallel edges the smallest is kept.  Labels are composed from the contractions in the end, the smallest first.
    """
    order = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "e").orderBy("e").withColumn("k", F.monotonically_increasing_id()))
    live, chosen, steps = order.select("u", "v", "k"), order.where("false").select("k"), []
    while not live.isEmpty():
        least = live.select(F.col("u").alias("c"), "k").union(live.select("v", "k")).groupBy("c").agg(F.min("k").alias("k"))
        best = cut(least.join(live, "k").select("c", "k", F.when(F.col("u") == F.col("c"), F.col("v")).otherwise(F.col("u")).alias("o")))
        chosen = chosen.union(best.select("k"))
        # two components that took the same edge would point at each other: the smaller stays
        back = best.select(F.col("c").alias("o"), F.col("o").alias("back"))
        to = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o"))
        roots = _roots(cut(best.join(back, "o").select("c", to.alias("p"))))
        steps.append(roots)
        a, b = roots.select(F.col("c").alias("u"), F.col("p").alias("cu")), roots.select(F.col("c").alias("v"), F.col("p").alias("cv"))
        left = live.join(a, "u").join(b, "v").where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v"), "k")
        live = cut(left.groupBy("u", "v").agg(F.min("k").alias("k")))
    names = None
    if labels:
        names = order.where("false").select(F.col("u").alias("c"), F.col("v").alias("p"))
        for roots in reversed(steps):
            after = names.select(F.col("c").alias("p"), F.col("p").alias("last"))
            names = cut(roots.join(after, "p", "left").select("c", F.coalesce("last", "p").alias("p")))
        names = names.select(F.col("c").alias("asset"), F.col("p").alias("comp"))
    return order.join(chosen.distinct(), "k").select("e"), names


def spanning_forest(dist: DataFrame) -> DataFrame:
    """(u, v, w): the minimum spanning tree of each component of (u, v, dist); NULL distances come last, ties by labels."""
    return _spanned(dist)[0]


def _spanned(dist: DataFrame, labels: bool = False) -> tuple[DataFrame, DataFrame | None]:
    u, v = F.least("u", "v"), F.greatest("u", "v")
    e = F.struct(F.col("dist").isNull().alias("none"), F.col("dist").alias("w"), u.alias("u"), v.alias("v"))
    tree, names = contract(dist.where("u <> v").select("u", "v", e.alias("e")), labels)
    return tree.select("e.u", "e.v", "e.w"), names


def rooted_forest(dist: DataFrame) -> DataFrame:
    """The spanning forest of (u, v, dist), ``rooted`` at the smallest labels, which its contraction gives."""
    tree, names = _spanned(dist, labels=True)
    return rooted(cut(tree), names.groupBy("comp").agg(F.min("asset").alias("asset")))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(asset, comp): the smallest asset of each node's component; ``nodes`` may add some without edges."""
    u, v = F.least("u", "v"), F.greatest("u", "v")
    _, names = contract(edges.where("u <> v").select(u.alias("u"), v.alias("v")).distinct().withColumn("e", F.struct("u", "v")), labels=True)
    least = names.groupBy("comp").agg(F.min("asset").alias("least"))
    got = names.join(least, "comp").select("asset", F.col("least").alias("comp"))
    if nodes is None:
        return got
    return nodes.select("asset").distinct().join(got, "asset", "left").select("asset", F.coalesce("comp", "asset").alias("comp"))


def components_without(tree: DataFrame, removed: DataFrame) -> DataFrame:
    """(asset, comp) when the ``removed`` assets are taken out of the tree: what is left is contracted."""
    gone = removed.select("asset").distinct()
    nodes = tree.select(F.col("u").alias("asset")).union(tree.select("v")).distinct().join(gone, "asset", "left_anti")
    left = tree.join(gone.withColumnRenamed("asset", "u"), "u", "left_anti").join(gone.withColumnRenamed("asset", "v"), "v", "left_anti")
    return components(left.select("u", "v"), nodes)


#: Parts of a node's neighbours, so that those of a hub are ordered in several tasks.
_FANS = 64


def _tour(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, w, c): the arcs of the tree, both ways, with the number of arcs from there to the end of the Euler tour of its root.

    The arc a to b is followed by that from b to its next neighbour after a, around in a circle which is cut at the root.
    The list is ranked by pointer jumping.
    """
    arcs = symmetric(tree, "w").select(F.col("u").alias("b"), F.col("v").alias("a"), "w", F.pmod(F.xxhash64("u", "v"), F.lit(_FANS)).alias("fan"))
    arcs = arcs.withColumn("next", F.lead("a").over(Window.partitionBy("b", "fan").orderBy("a")))
    arcs = cut(arcs.withColumn("i", F.monotonically_increasing_id()))
    fans = arcs.groupBy("b", "fan").agg(F.min("a").alias("head")).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("fan", "head"))).alias("fans"))  # at most _FANS of a node
    after = fans.select("b", F.explode(F.expr("transform(fans, (x, i) -> struct(x.fan AS fan, get(fans, i + 1).head AS follows, fans[0].head AS begins))")).alias("x")).select("b", "x.*")
    ends = roots.select(F.col("asset").alias("b"), F.lit(True).alias("end"))
    to = F.coalesce("next", "follows", F.when(F.col("end").isNull(), F.col("begins")))
    linked = arcs.join(after, ["b", "fan"]).join(ends, "b", "left").select("i", "b", to.alias("to"))
    heads = arcs.select(F.col("a").alias("b"), F.col("b").alias("to"), F.col("i").alias("n"))
    ranked = cut(linked.join(heads, ["b", "to"], "left").select("i", "n", F.lit(1).cast("long").alias("c")))
    while not ranked.where("n is not null").isEmpty():
        ahead = ranked.select(F.col("i").alias("n"), F.col("n").alias("n2"), F.col("c").alias("c2"))
        further = ranked.where("n is not null").join(ahead, "n").select("i", F.col("n2").alias("n"), (F.col("c") + F.col("c2")).alias("c"))
        ranked = cut(further.unionByName(ranked.where("n is null")))  # those at the end stay where they are
    return cut(arcs.join(ranked, "i").select("a", "b", "w", "c"))


def rooted(tree: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """A row for each node: asset, parent and w (NULL at a root), size (nodes below and itself), depth, d (way from the root), step (its place
    in discovery order: depth first, children by label, from 0), total (sum of the ways to all nodes of its tree), n (nodes of its tree).

    ``roots`` (asset): one node of each tree; the smallest labels if not given.  Sizes follow from places in the Euler tour.
    Depths, ways, steps and totals are sums along the way to the root, doubled by pointer jumping.
    """
    return _rooted(tree, roots)[0]


def _rooted(tree: DataFrame, roots: DataFrame | None, keep: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    if roots is None:
        roots = components(tree).select(F.col("comp").alias("asset")).distinct()
    roots = cut(roots.select("asset"))
    tour = _tour(tree, roots)
    back = tour.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("c").alias("back"))
    down = tour.join(back, ["a", "b"]).where("c > back").select(F.col("b").alias("asset"), F.col("a").alias("parent"), "w", ((F.col("c") - F.col("back") + 1) / 2).cast("long").alias("size"))
    top = tour.join(roots.select(F.col("asset").alias("a")), "a").groupBy(F.col("a").alias("asset")).agg(F.max("c").alias("c"))
    top = top.select("asset", F.lit(None).cast(dict(tree.dtypes)["u"]).alias("parent"), F.lit(None).cast("double").alias("w"), (F.col("c") / 2 + 1).cast("long").alias("size"))
    below = running(down, ["asset"], {"_upto": ("sum", "size")}, ["parent"])  # children by label
    own = below.select("asset", "parent", "w", "size", (F.col("_upto") - F.col("size") + 1).alias("step")).unionByName(top.withColumn("step", F.lit(0).cast("long")))
    far = own.select("asset", "parent", "w", "size", F.col("parent").alias("at"), F.coalesce("parent", "asset").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("w", F.lit(0.0)).alias("d"), "step", F.coalesce(F.col("size") * F.col("w"), F.lit(0.0)).alias("heavy"))
    far, levels = cut(far), []
    while not far.where("at is not null").isEmpty():
        if keep:
            levels.append(far.where("at is not null").select("asset", F.col("at").alias("up")))
        ahead = far.select(F.col("asset").alias("at"), F.col("at").alias("at2"), *[F.col(c).alias(f"{c}2") for c in ("root", "depth", "d", "step", "heavy")])
        sums = [(F.col(c) + F.col(f"{c}2")).alias(c) for c in ("depth", "d", "step", "heavy")]
        further = far.where("at is not null").join(ahead, "at").select("asset", "parent", "w", "size", F.col("at2").alias("at"), F.col("root2").alias("root"), *sums)
        far = cut(further.unionByName(far.where("at is null")))
    # from a node to its child, the ways to the child's nodes shorten by w and the others lengthen: total(child) = total(parent) + (n - 2 size) w
    whole = far.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("of_root"))
    total = F.col("of_root") + F.col("n") * F.col("d") - 2 * F.col("heavy")
    return far.join(whole, "root").select("asset", "root", "parent", "w", "size", "depth", "d", "step", total.alias("total"), "n"), levels


def branches(nodes: DataFrame) -> DataFrame:
    """(asset, branch, size): the nodes behind each neighbour (``branch``) of each node of a rooted forest."""
    below = nodes.where("parent is not null")
    return below.select(F.col("parent").alias("asset"), F.col("asset").alias("branch"), "size").unionByName(below.select("asset", F.col("parent").alias("branch"), (F.col("n") - F.col("size")).alias("size")))


def betweenness(nodes: DataFrame) -> DataFrame:
    """(asset, betweenness): pairs of other nodes whose way leads through each node, from the sizes of its branches."""
    squares = branches(nodes).groupBy("asset").agg(F.sum(F.col("size") * F.col("size")).alias("q"))
    return nodes.join(squares, "asset").select("asset", (((F.col("n") - 1) * (F.col("n") - 1) - F.col("q")) / 2).cast("long").alias("betweenness"))


def betweenness_trace(nodes: DataFrame) -> DataFrame:
    """(step, asset, parent, size, branches, betweenness): the nodes in discovery order, with what each one's score is made of; sizes of branches ascend."""
    sizes = branches(nodes).groupBy("asset").agg(F.array_sort(F.collect_list("size")).alias("branches"))
    score = F.aggregate("branches", (F.col("n") - 1) * (F.col("n") - 1), lambda x, s: x - s * s)
    return nodes.join(sizes, "asset").select("step", "asset", "parent", "size", "branches", (score / 2).cast("long").alias("betweenness"))


def mean_distance(nodes: DataFrame) -> DataFrame:
    """(asset, avg_dist): the mean way to all nodes of the tree, the node itself (0) among them."""
    return nodes.select("asset", (F.col("total") / F.col("n")).alias("avg_dist"))


class Ways:
    """Answers how far pairs of nodes are apart, by the lowest common ancestor of each pair.

    Holds the rooted forest and, by powers of two, who is that many parents up: as many tables of n rows as the logarithm of
    the depth.  A pair's first node climbs by falling powers while it is no ancestor of the second.
    """

    def __init__(self, tree: DataFrame, roots: DataFrame | None = None):
        nodes, self.levels = _rooted(tree, roots, keep=True)
        self.nodes = cut(nodes)

    def _inside(self, x: str) -> DataFrame:
        return self.nodes.select(F.col("asset").alias(x), F.col("step").alias("_from"), (F.col("step") + F.col("size")).alias("_to"))

    def between(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (src, dst, ...) with lca and d: 0 for a node itself, infinite (no lca) where there is no way or no such node."""
        known = self.nodes.select(F.col("asset").alias("dst"), F.col("d").alias("_dv"), F.col("step").alias("_step"), F.col("root").alias("_rv"))
        other = self.nodes.select(F.col("asset").alias("src"), F.col("d").alias("_du"), F.col("root").alias("_ru"))
        at = pairs.join(known, "dst", "left").join(other, "src", "left").withColumn("_x", F.when(F.col("_ru") == F.col("_rv"), F.col("src")))
        for level in reversed(self.levels):
            up = level.join(self._inside("up"), "up").select(F.col("asset").alias("_x"), "up", "_from", "_to")
            apart = ~((F.col("_from") <= F.col("_step")) & (F.col("_step") < F.col("_to")))
            at = at.join(up, "_x", "left").withColumn("_x", F.when(F.col("up").isNotNull() & apart, F.col("up")).otherwise(F.col("_x"))).drop("up", "_from", "_to")
        # now an ancestor of the second node, or one below the lowest
        last = self.nodes.select(F.col("asset").alias("_x"), F.col("parent").alias("_parent"), F.col("step").alias("_from"), (F.col("step") + F.col("size")).alias("_to"))
        holds = (F.col("_from") <= F.col("_step")) & (F.col("_step") < F.col("_to"))
        at = at.join(last, "_x", "left").withColumn("lca", F.when(holds, F.col("_x")).otherwise(F.col("_parent")))
        deep = self.nodes.select(F.col("asset").alias("lca"), F.col("d").alias("_dl"))
        d = F.when(F.col("src") == F.col("dst"), 0.0).when(F.col("lca").isNull(), float("inf")).otherwise(F.col("_du") + F.col("_dv") - 2 * F.col("_dl"))
        return at.join(deep, "lca", "left").select(*[F.col(f"`{c}`") for c in pairs.columns], "lca", d.alias("d"))
