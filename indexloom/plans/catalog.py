"""Registered queries of the library and their DuckDB counterparts.

All run over the market of ``indexloom.sources.panel``: brands by month.  Dates are ISO strings and
numbers are rounded in both engines, since sums of floating-point numbers depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from indexloom.functions import stats
from indexloom.functions.median import exact_median
from indexloom.operators import backtest, diagnostics, forest, mapping, ridge, selection, tree
from indexloom.plans import strategies
from indexloom.plans.tables import cut
from indexloom.sources import basis as basis_files
from indexloom.sources.panel import densify, long_to_wide, market_cells, sparse_panel

FLAGSHIP = "backtest_summary"

#: The basis of the regression and mapping queries, and all brands that the market has.
BASIS = ("Brand#1", "Brand#12", "Brand#17", "Brand#21", "Brand#8")
BRANDS = tuple(f"Brand#{i}" for i in range(1, 26))

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MADE: dict[str, DataFrame] = {}

_PANEL = """cells AS (
  SELECT cast(date_trunc('month', l_shipdate) AS date) AS dt, p_brand AS asset,
         sum(l_extendedprice) / sum(l_quantity) AS px, sum(l_extendedprice) AS cap
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), panel AS (
  SELECT dt, asset, px, cap FROM (SELECT DISTINCT dt FROM cells) CROSS JOIN (SELECT DISTINCT asset FROM cells) LEFT JOIN cells USING (dt, asset)
), ret AS (
  SELECT dt, asset, px / nullif(lag(px) OVER (PARTITION BY asset ORDER BY dt), 0) - 1 AS r FROM panel
), weights AS (
  SELECT dt, asset, cap / nullif(sum(cap) OVER (PARTITION BY dt), 0) AS w FROM panel
), pairs AS (
  SELECT a.dt, a.asset AS u, b.asset AS v, CASE WHEN b.r IS NOT NULL THEN a.r END AS x, CASE WHEN a.r IS NOT NULL THEN b.r END AS y
  FROM ret a JOIN ret b ON a.dt = b.dt AND a.asset < b.asset
), corr AS (
  SELECT u, v, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS rho, count(x) AS n_obs FROM pairs GROUP BY u, v
), dist AS (
  SELECT u, v, sqrt(2 * (1 - least(1, greatest(-1, rho)))) AS dist FROM corr
)"""

_TREE = """, prim AS (
  SELECT 0 AS step, [(SELECT min(asset) FROM panel)] AS s, NULL::varchar AS u, NULL::varchar AS v, NULL::double AS w
  UNION ALL
  SELECT * FROM (
    SELECT step + 1, list_append(s, CASE WHEN list_contains(s, d.u) THEN d.v ELSE d.u END), d.u, d.v, d.dist
    FROM prim JOIN dist d ON list_contains(s, d.u) <> list_contains(s, d.v) ORDER BY d.dist, d.u, d.v LIMIT 1)
), tree AS (SELECT u, v, w FROM prim WHERE step > 0
), edge AS (SELECT u, v, w FROM tree UNION ALL SELECT v, u, w FROM tree
), walk AS (
  SELECT DISTINCT u AS src, u AS dst, NULL::varchar AS prev, 0.0::double AS d, 0 AS hops, NULL::varchar AS first_hop, [u] AS path FROM edge
  UNION ALL
  SELECT src, e.v, dst, d + e.w, hops + 1, coalesce(first_hop, e.v), list_append(path, e.v)
  FROM walk JOIN edge e ON dst = e.u WHERE prev IS NULL OR e.v <> prev
), wn AS (
  SELECT asset, (w - min(w) OVER ()) / nullif(max(w) OVER () - min(w) OVER (), 0) AS wn
  FROM (SELECT asset, coalesce(cap, 0) AS w FROM panel WHERE dt = (SELECT max(dt) FROM panel))
), deg AS (SELECT u AS asset, count(*) AS degree FROM edge GROUP BY u
), btw AS (
  SELECT asset, cast(((n - 1) * (n - 1) - sum(s * s)) // 2 AS bigint) AS betweenness
  FROM (SELECT src AS asset, first_hop, count(*) AS s FROM walk WHERE first_hop IS NOT NULL GROUP BY 1, 2)
  CROSS JOIN (SELECT count(DISTINCT src) AS n FROM walk) GROUP BY asset, n
), hub AS (
  SELECT asset, (c - min(c) OVER ()) / nullif(max(c) OVER () - min(c) OVER (), 0) AS score,
         row_number() OVER (ORDER BY c DESC, asset) - 1 AS pos
  FROM (SELECT asset, 0.5 * degree + 0.5 * betweenness AS c FROM deg JOIN btw USING (asset))
)"""

_BASIS_SQL = "(VALUES " + ", ".join(f"('{b}')" for b in BASIS) + ") AS basis(asset)"

_RIDGE = f""", near AS (
  SELECT asset, basis, row_number() OVER (PARTITION BY asset ORDER BY dist, basis) AS rank, dist
  FROM (SELECT u AS asset, v AS basis, dist FROM dist UNION ALL SELECT v, u, dist FROM dist)
  WHERE dist IS NOT NULL AND basis IN (SELECT asset FROM {_BASIS_SQL}) AND asset NOT IN (SELECT asset FROM {_BASIS_SQL})
), rows3 AS (
  SELECT n.asset, y.dt, y.r AS y,
         max(CASE WHEN rank = 1 THEN x.r END) AS x1, max(CASE WHEN rank = 2 THEN x.r END) AS x2, max(CASE WHEN rank = 3 THEN x.r END) AS x3
  FROM near n JOIN ret x ON x.asset = n.basis JOIN ret y ON y.asset = n.asset AND y.dt = x.dt WHERE rank <= 3 GROUP BY 1, 2, 3
), g3 AS (
  SELECT asset, sum(x1*x1) + 0.001 a, sum(x1*x2) b, sum(x1*x3) c, sum(x2*x2) + 0.001 d, sum(x2*x3) e, sum(x3*x3) + 0.001 f, sum(x1*y) p, sum(x2*y) q, sum(x3*y) r
  FROM rows3 WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL GROUP BY asset
), det3 AS (
  SELECT *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) AS det FROM g3
), beta3 AS (
  SELECT asset, 1 AS rank, (p*(d*f-e*e) - b*(q*f-e*r) + c*(q*e-d*r)) / det AS coef FROM det3
  UNION ALL SELECT asset, 2, (a*(q*f-e*r) - p*(b*f-c*e) + c*(b*r-q*c)) / det FROM det3
  UNION ALL SELECT asset, 3, (a*(d*r-q*e) - b*(b*r-q*c) + p*(b*e-d*c)) / det FROM det3
), coefs AS (
  SELECT n.asset, n.basis, coef FROM near n JOIN beta3 USING (asset, rank)
)"""

_MAP = f""", a AS (
  SELECT asset, basis, coef AS a FROM coefs UNION ALL SELECT asset, asset, 1.0 FROM {_BASIS_SQL}
), tops AS (
  SELECT dt, asset, w / sum(w) OVER (PARTITION BY dt) AS w FROM (
    SELECT dt, asset, w, row_number() OVER (PARTITION BY dt ORDER BY w DESC, asset) AS k FROM weights WHERE w IS NOT NULL) WHERE k <= 10
), cal AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS before FROM (SELECT DISTINCT dt FROM panel)
), idx AS (
  SELECT c.dt, coalesce(sum(w.w * r.r), 0) AS ret FROM cal c LEFT JOIN weights w ON w.dt = c.before LEFT JOIN ret r ON r.dt = c.dt AND r.asset = w.asset GROUP BY c.dt
), rep AS (
  SELECT c.dt, coalesce(sum(w.w * r.r), 0) AS ret FROM cal c LEFT JOIN tops w ON w.dt = c.before LEFT JOIN ret r ON r.dt = c.dt AND r.asset = w.asset GROUP BY c.dt
), act AS (
  SELECT dt, idx.ret AS index_return, rep.ret AS rep_return, rep.ret - idx.ret AS diff FROM idx JOIN rep USING (dt)
), turn AS (
  SELECT dt, 0.5 * sum(c) AS turnover FROM (
    SELECT dt, asset, abs(coalesce(w, 0) - lag(coalesce(w, 0), 1, 0) OVER (PARTITION BY asset ORDER BY dt)) AS c
    FROM (SELECT DISTINCT dt FROM tops) CROSS JOIN (SELECT DISTINCT asset FROM tops) LEFT JOIN tops USING (dt, asset)) GROUP BY dt
), last AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY dt DESC) AS k, count(*) OVER () AS n FROM act) WHERE k <= greatest(1, floor(n * 20.0 / 100.0))
)"""


def query(name: str, sql: str | None = None, *, with_tree: bool = False, with_ridge: bool = False, with_map: bool = False, plain: bool = False) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` follows the common tables it asks for."""

    def put(f: Query) -> Query:
        @wraps(f)
        def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
            _MADE.clear()
            return f(spark, sf_dir)

        _QUERIES[name] = fresh
        if sql is not None:
            parts = _PANEL + (_TREE if with_tree else "") + (_RIDGE if with_ridge or with_map else "") + (_MAP if with_map else "")
            head, rest = ("", sql) if plain else (f"WITH RECURSIVE {parts}", sql)
            _SQL[name] = f"{head}{',' if rest.startswith(' also ') else ''} {rest.removeprefix(' also ')}"
        return f

    return put


def rounded(df: DataFrame, digits: int = 8, **other: int) -> DataFrame:
    """Dates as ISO strings, doubles rounded (by column: ``other``)."""
    cols = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        cols.append(F.round(x, other.get(c, digits)).alias(c) if kind == "double" else x.cast("string").alias(c) if kind in ("date", "timestamp", "timestamp_ntz") else x)
    return df.select(*cols)


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    """The market without gaps; its cells are computed once in a query, from one scan of the lines."""
    if sf not in _MADE:
        _MADE[sf] = densify(cut(market_cells(spark, sf)))
    return _MADE[sf]


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return stats.returns(_panel(spark, sf))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.index_weights(_panel(spark, sf))


def _basis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, b) for i, b in enumerate(BASIS)], "pos int, asset string")


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return tree.mst(stats.price_distance(_panel(spark, sf)))


def _nodes(spark: SparkSession, sf: str, t: DataFrame | None = None) -> DataFrame:
    """The tree of the brands, rooted at the first label."""
    t = t or cut(_tree(spark, sf))
    return forest.rooted(t, t.agg(F.min("u").alias("asset")))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return cut(tree.walks(_tree(spark, sf)))


def _last_caps(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.last_row(_panel(spark, sf)).select("asset", F.coalesce("cap", F.lit(0.0)).alias("w"))


def _near(spark: SparkSession, sf: str, q: int | None = 3) -> DataFrame:
    return ridge.neighbours(stats.price_distance(_panel(spark, sf)), _basis(spark), q)


def _coefs(spark: SparkSession, sf: str) -> DataFrame:
    return ridge.regress(_returns(spark, sf), _near(spark, sf), 0.001)


# panels, weights


@query("panel_dense", "SELECT cast(dt AS varchar) AS dt, asset, round(px, 6) AS px, round(cap, 2) AS cap FROM panel")
def panel_dense(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_panel(spark, sf), px=6, cap=2)


@query("returns", "SELECT cast(dt AS varchar) AS dt, asset, round(r, 8) AS r FROM ret")
def returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_returns(spark, sf))


@query("returns_long_to_wide", "SELECT cast(dt AS varchar) AS dt, " + ", ".join(f"round(max(CASE WHEN asset = '{b}' THEN r END), 8) AS \"{b}\"" for b in BRANDS) + " FROM ret GROUP BY dt")
def returns_long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A column for every asset of the panel, by label."""
    ret = _returns(spark, sf)
    assets = [r.asset for r in ret.select("asset").distinct().orderBy("asset").collect()]  # the columns of the result
    return rounded(long_to_wide(ret, "r", assets))


@query(
    "sparse_returns",
    """SELECT cast(dt AS varchar) AS dt, asset, round(r, 8) AS r FROM (
  SELECT dt, asset, px / nullif(CASE WHEN lag(dt) OVER s = dt - INTERVAL 1 MONTH THEN lag(px) OVER s END, 0) - 1 AS r
  FROM (SELECT cast(date_trunc('month', l_shipdate) AS date) AS dt, l_partkey AS asset, sum(l_extendedprice) / sum(l_quantity) AS px FROM lineitem GROUP BY 1, 2)
  WINDOW s AS (PARTITION BY asset ORDER BY dt)) WHERE r IS NOT NULL""",
    plain=True,
)
def sparse_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Returns of a panel with gaps, without laying out its empty cells."""
    w = Window.partitionBy("asset").orderBy("dt")
    adjacent = F.lag("dt").over(w) == F.add_months("dt", -1)
    got = sparse_panel(spark, sf).select("dt", "asset", (F.try_divide(F.col("px"), F.when(adjacent, F.lag("px").over(w))) - 1).alias("r"))
    return rounded(got.where("r is not null"))


@query("index_weights", "SELECT cast(dt AS varchar) AS dt, asset, round(w, 8) AS w FROM weights")
def index_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_weights(spark, sf))


@query("uniform_fallback", "SELECT cast(dt AS varchar) AS dt, asset, round(CASE WHEN cap IS NOT NULL THEN CASE WHEN month(dt) = 6 THEN 1.0 / count(cap) OVER (PARTITION BY dt) ELSE cap / sum(cap) OVER (PARTITION BY dt) END END, 8) AS w FROM panel")
def uniform_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of a market whose caps are 0 every June."""
    return rounded(backtest.index_weights(_panel(spark, sf).withColumn("cap", F.when(F.month("dt") == 6, F.col("cap") * 0).otherwise(F.col("cap")))))


@query(
    "max_weight_cap",
    """SELECT cast(dt AS varchar) AS dt, asset, round(CASE WHEN w IS NULL THEN NULL WHEN n * 0.045 < 1 - 1e-12 THEN 1.0 / n WHEN m < m0 OR m0 IS NULL THEN 0.045 ELSE w * s0 END, 8) AS w FROM (
  SELECT *, min(CASE WHEN fits THEN m END) OVER (PARTITION BY dt) AS m0, max(CASE WHEN fits THEN s END) FILTER (fits AND m = m1) OVER (PARTITION BY dt) AS s0 FROM (
    SELECT *, min(CASE WHEN fits THEN m END) OVER (PARTITION BY dt) AS m1 FROM (
      SELECT *, w * s <= 0.045 + 1e-15 AS fits FROM (
        SELECT dt, asset, w, m, n, (1 - m * 0.045) / nullif(total - coalesce(before, 0), 0) AS s FROM (
          SELECT dt, asset, w, count(w) OVER (PARTITION BY dt) AS n, row_number() OVER o - 1 AS m, sum(w) OVER (PARTITION BY dt) AS total, sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM weights WINDOW o AS (PARTITION BY dt ORDER BY w DESC NULLS LAST, asset))))))""",
)
def max_weight_cap(spark: SparkSession, sf: str) -> DataFrame:
    """At most 4.5 % a name; dates with too few names for that get equal weights."""
    return rounded(backtest.cap_weights(_weights(spark, sf), 0.045, infeasible="equal"))


# correlations, distances


@query("corr_pearson", "SELECT u, v, round(rho, 8) AS rho, n_obs FROM corr")
def corr_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.pearson(_returns(spark, sf)))


@query(
    "corr_spearman",
    """SELECT u, v, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 8) AS rho, count(*) AS n_obs FROM (
  SELECT u, v, rank() OVER (PARTITION BY u, v ORDER BY x) + (count(*) OVER (PARTITION BY u, v, x) - 1) / 2.0 AS x,
         rank() OVER (PARTITION BY u, v ORDER BY y) + (count(*) OVER (PARTITION BY u, v, y) - 1) / 2.0 AS y
  FROM pairs WHERE x IS NOT NULL) GROUP BY u, v""",
)
def corr_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.spearman(_returns(spark, sf)))


@query("median_return", "SELECT asset, round(median(r), 8) AS median FROM ret WHERE r IS NOT NULL GROUP BY asset")
def median_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(exact_median(_returns(spark, sf), ["asset"], "r"))


@query("median_line_price", "SELECT l_returnflag, l_linestatus, round(median(cast(l_extendedprice AS double)), 6) AS median FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2", plain=True)
def median_line_price(spark: SparkSession, sf: str) -> DataFrame:
    """Few groups of very many rows."""
    return rounded(exact_median(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 6)


@query("corr_min_periods", "SELECT u, v, round(CASE WHEN n_obs >= 82 THEN rho END, 8) AS rho, n_obs FROM corr")
def corr_min_periods(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.pearson(_returns(spark, sf), 82))


@query(
    "cov_to_corr",
    """ also cov AS (SELECT u, v, covar_samp(x, y) AS cov FROM pairs GROUP BY u, v UNION ALL SELECT asset, asset, var_samp(r) FROM ret WHERE r IS NOT NULL GROUP BY asset),
d AS (SELECT u AS k, cov AS var FROM cov WHERE u = v)
SELECT u, v, round(CASE WHEN u = v THEN 1.0 ELSE least(1, greatest(-1, cov / (sqrt(a.var) * sqrt(b.var)))) END, 8) AS rho FROM cov JOIN d a ON a.k = u JOIN d b ON b.k = v""",
)
def cov_to_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.cov_to_corr(stats.covariance(_returns(spark, sf))))


@query(
    "corr_lw",
    """ also f AS (SELECT dt, asset, coalesce(r, m, 0) AS r FROM ret JOIN (SELECT asset, median(r) AS m FROM ret GROUP BY asset) USING (asset)),
x AS (SELECT dt, asset, r - avg(r) OVER (PARTITION BY asset) AS x FROM f),
s AS (SELECT a.asset AS u, b.asset AS v, sum(a.x * b.x) / count(*) AS s FROM x a JOIN x b ON a.dt = b.dt AND a.asset <= b.asset GROUP BY 1, 2),
k AS (SELECT (SELECT count(DISTINCT asset) FROM x)::double AS p, (SELECT count(DISTINCT dt) FROM x)::double AS n,
  (SELECT sum(q * q) FROM (SELECT sum(x * x) AS q FROM x GROUP BY dt)) AS q2, (SELECT sum(s) FROM s WHERE u = v) AS tr,
  (SELECT sum(CASE WHEN u = v THEN s * s ELSE 2 * s * s END) FROM s) AS d2),
l AS (SELECT tr / p AS mu, (q2 / n - d2) / (p * n) AS beta, (d2 - 2 * tr / p * tr + tr * tr / p) / p AS delta FROM k),
c AS (SELECT u, v, (1 - least(beta, delta) / delta) * s + CASE WHEN u = v THEN least(beta, delta) / delta * mu ELSE 0 END AS c FROM s CROSS JOIN l)
SELECT c.u, c.v, round(c.c / (sqrt(a.c) * sqrt(b.c)), 8) AS rho FROM c JOIN c a ON a.u = c.u AND a.v = c.u JOIN c b ON b.u = c.v AND b.v = c.v WHERE c.u < c.v""",
)
def corr_lw(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.ledoit_wolf(_returns(spark, sf)))


@query("corr_pca")
def corr_pca(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.pca_denoised(_returns(spark, sf), n_components=8))


@query("distance", "SELECT u, v, round(dist, 8) AS dist FROM dist")
def distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.price_distance(_panel(spark, sf)))


@query(
    "distance_windowed",
    """SELECT u, v, round(sqrt(2 * (1 - least(1, greatest(-1, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0))))), 8) AS dist
FROM pairs WHERE dt > (SELECT min(dt) FROM (SELECT DISTINCT dt FROM panel WHERE dt <= date '2000-06-01' ORDER BY dt DESC LIMIT 36)) AND dt <= date '2000-06-01' GROUP BY u, v""",
)
def distance_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.price_distance(_panel(spark, sf), end="2000-06-01", window=36))


@query(
    "distance_expanding",
    """SELECT cast(dt AS varchar) AS dt, u, v, round(CASE WHEN n_obs >= 3 THEN sqrt(2 * (1 - least(1, greatest(-1, rho)))) END, 6) AS dist, n_obs FROM (
  SELECT dt, u, v, count(x) OVER o AS n_obs, covar_samp(x, y) OVER o / nullif(stddev_samp(x) OVER o * stddev_samp(y) OVER o, 0) AS rho
  FROM pairs WINDOW o AS (PARTITION BY u, v ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def distance_expanding(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.expanding_distance(_panel(spark, sf), 3), 6)


# trees


@query("mst", "SELECT u, v, round(w, 8) AS w FROM tree", with_tree=True)
def mst(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_tree(spark, sf))


@query("tree_distance", "SELECT src, dst, round(d, 8) AS d, hops FROM walk", with_tree=True)
def tree_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_paths(spark, sf).select("src", "dst", "d", "hops"))


@query("tree_degree", "SELECT asset, degree FROM deg", with_tree=True)
def tree_degree(spark: SparkSession, sf: str) -> DataFrame:
    return tree.degrees(_tree(spark, sf))


@query("tree_betweenness", "SELECT asset, betweenness FROM btw", with_tree=True)
def tree_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return forest.betweenness(_nodes(spark, sf))


@query("tree_branches", "SELECT src AS asset, first_hop AS branch, count(*) AS size FROM walk WHERE first_hop IS NOT NULL GROUP BY 1, 2", with_tree=True)
def tree_branches(spark: SparkSession, sf: str) -> DataFrame:
    """The branch sizes that betweenness is made of."""
    return forest.branches(_nodes(spark, sf))


@query("tree_components", "SELECT src AS asset, min(dst) AS comp FROM walk WHERE NOT list_has_any(path, (SELECT list(asset) FROM hub WHERE pos < 2)) GROUP BY src", with_tree=True)
def tree_components(spark: SparkSession, sf: str) -> DataFrame:
    t = cut(_tree(spark, sf))
    return forest.components_without(t, selection.hubs(selection.hub_scores(t, forest.betweenness(_nodes(spark, sf, t))), 2))


@query("tree_path_length", "SELECT round(d, 8) AS d FROM walk WHERE src = 'Brand#1' AND dst = 'Brand#9'", with_tree=True)
def tree_path_length(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([("Brand#1", "Brand#9")], "src string, dst string")
    return rounded(forest.Ways(_tree(spark, sf)).between(asked).select("d"))


@query(
    "tree_rooted",
    """SELECT asset, parent, round(w, 8) AS w, depth, round(d, 8) AS d, size, row_number() OVER (ORDER BY path) - 1 AS step, round(total, 6) AS total
FROM (SELECT dst AS asset, prev AS parent, hops AS depth, d, path FROM walk WHERE src = (SELECT min(u) FROM edge))
JOIN (SELECT asset AS a, count(*) AS size FROM (SELECT unnest(path) AS asset FROM walk WHERE src = (SELECT min(u) FROM edge)) GROUP BY asset) ON a = asset
JOIN (SELECT src, sum(d) AS total FROM walk GROUP BY src) ON src = asset LEFT JOIN (SELECT u, v, w FROM edge) ON u = parent AND v = asset""",
    with_tree=True,
)
def tree_rooted(spark: SparkSession, sf: str) -> DataFrame:
    """Parents, sizes, depths, ways from the root, discovery order and sums of ways, from the Euler tour."""
    return rounded(_nodes(spark, sf).select("asset", "parent", "w", "depth", "d", "size", "step", "total"), total=6)


@query(
    "betweenness_trace",
    """SELECT row_number() OVER (ORDER BY path) - 1 AS step, asset, parent, size, branches, btw.betweenness
FROM (SELECT dst AS asset, prev AS parent, path FROM walk WHERE src = (SELECT min(u) FROM edge))
JOIN (SELECT x AS a, count(*) AS size FROM (SELECT unnest(path) AS x FROM walk WHERE src = (SELECT min(u) FROM edge)) GROUP BY x) ON a = asset
JOIN (SELECT src, string_agg(n, ' ' ORDER BY n) AS branches FROM (SELECT src, first_hop, count(*) AS n FROM walk WHERE first_hop IS NOT NULL GROUP BY 1, 2) GROUP BY src) ON src = asset
JOIN btw USING (asset)""",
    with_tree=True,
)
def betweenness_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes as they are discovered, with the sizes of their branches and what follows from these."""
    return forest.betweenness_trace(_nodes(spark, sf)).withColumn("branches", F.array_join(F.col("branches").cast("array<string>"), " "))


@query("tree_pairs", "SELECT a.asset AS src, a.other AS dst, round(d, 8) AS d FROM (SELECT asset, lead(asset) OVER (ORDER BY asset) AS other FROM (SELECT DISTINCT asset FROM panel)) a JOIN walk ON src = asset AND dst = other", with_tree=True)
def tree_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How far labels that follow each other are apart, by lowest common ancestors."""
    names = _panel(spark, sf).select("asset").distinct()
    asked = names.select(F.col("asset").alias("src"), F.lead("asset").over(Window.orderBy("asset")).alias("dst")).where("dst is not null")  # brands
    return rounded(forest.Ways(_tree(spark, sf)).between(asked).select("src", "dst", "d"))


def _bought_together(spark: SparkSession, sf: str) -> DataFrame:
    """(u, v, dist) of parts on neighbouring lines of an order: the closer, the oftener."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.format_string("%08d", "l_partkey").alias("part"))
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("part").alias("other"))
    both = lines.join(after, ["l_orderkey", "l_linenumber"]).where("part <> other")
    return both.groupBy(F.least("part", "other").alias("u"), F.greatest("part", "other").alias("v")).agg((1 / F.count(F.lit(1))).alias("dist"))


@query("part_forest")
def part_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum spanning forest of a large, sparse graph: parts bought together."""
    return rounded(forest.spanning_forest(_bought_together(spark, sf)))


@query("part_forest_nodes")
def part_forest_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """That forest rooted, with the betweenness of every part."""
    nodes = cut(forest.rooted_forest(_bought_together(spark, sf)))
    return rounded(nodes.join(forest.betweenness(nodes), "asset"), 6)


@query(
    "euclid_mst",
    """WITH RECURSIVE pt AS (SELECT printf('%06d', vec_id) AS id, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings
), prim AS (
  SELECT 0 AS step, id, x, y, id = (SELECT min(id) FROM pt) AS held, CASE WHEN id <> (SELECT min(id) FROM pt) THEN sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) END AS best, (SELECT min(id) FROM pt) AS hook
  FROM pt CROSS JOIN (SELECT x AS x0, y AS y0 FROM pt WHERE id = (SELECT min(id) FROM pt))
  UNION ALL
  SELECT step + 1, id, x, y, held OR id = chosen,
         CASE WHEN held OR id = chosen THEN NULL WHEN d < best OR (d = best AND (least(id, chosen), greatest(id, chosen)) < (least(id, hook), greatest(id, hook))) THEN d ELSE best END,
         CASE WHEN NOT held AND id <> chosen AND (d < best OR (d = best AND (least(id, chosen), greatest(id, chosen)) < (least(id, hook), greatest(id, hook)))) THEN chosen ELSE hook END
  FROM (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d
        FROM (SELECT *, first_value(id) OVER o AS chosen, first_value(x) OVER o AS cx, first_value(y) OVER o AS cy, first_value(held) OVER o AS finished
              FROM prim WINDOW o AS (ORDER BY held, best, least(id, hook), greatest(id, hook) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE NOT finished)
), done AS (SELECT id, hook, best, lead(held) OVER (PARTITION BY id ORDER BY step) AS next_held, held FROM prim)
SELECT least(id, hook) AS u, greatest(id, hook) AS v, round(best, 8) AS w FROM done WHERE NOT held AND next_held""",
    plain=True,
)
def euclid_mst(spark: SparkSession, sf: str) -> DataFrame:
    """The tree over all points of the plane."""
    pt = spark.read.parquet(f"{sf}/embeddings.parquet")
    pts = pt.select(F.format_string("%06d", "vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(tree.euclidean_mst(pts))


# scores, selection


@query("normalize_scores", "SELECT asset, round(wn, 8) AS score FROM wn", with_tree=True)
def normalize_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.normalise_scores(_last_caps(spark, sf), "w"))


@query("avg_tree_distance", "SELECT src AS asset, round(avg(d), 8) AS avg_dist FROM walk GROUP BY src", with_tree=True)
def avg_tree_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(forest.mean_distance(_nodes(spark, sf)))


@query("hub_ranking", "SELECT cast(pos AS integer) AS pos, asset, round(score, 8) AS score FROM hub WHERE pos < 5", with_tree=True)
def hub_ranking(spark: SparkSession, sf: str) -> DataFrame:
    t = cut(_tree(spark, sf))
    return rounded(selection.hubs(selection.hub_scores(t, forest.betweenness(_nodes(spark, sf, t))), 5))


@query("most_central", "SELECT asset, betweenness FROM btw ORDER BY betweenness DESC, asset LIMIT 1", with_tree=True)
def most_central(spark: SparkSession, sf: str) -> DataFrame:
    return tree.argmax(forest.betweenness(_nodes(spark, sf)), "betweenness")


_SPREAD = """ also pick AS (
  SELECT 0 AS pos, [asset] AS s, asset, score FROM (SELECT src AS asset, 0.2 * avg(d) + 0.8 * max(wn) AS score FROM walk JOIN wn ON wn.asset = src GROUP BY src ORDER BY score DESC, asset LIMIT 1)
  UNION ALL
  SELECT * FROM (SELECT pos + 1, list_append(s, c), c, score FROM (
    SELECT pos, s, dst AS c, 0.2 * min(d) + 0.8 * max(wn) AS score FROM pick JOIN walk ON list_contains(s, src) AND NOT list_contains(s, dst) JOIN wn ON wn.asset = dst
    WHERE pos < 4 GROUP BY pos, s, dst) ORDER BY score DESC, c LIMIT 1)
)"""


@query("basis_max_spread", _SPREAD + " SELECT pos, asset, round(score, 8) AS score FROM pick", with_tree=True)
def basis_max_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.max_spread(_paths(spark, sf), 5, _last_caps(spark, sf), alpha=0.2))


@query("selection_steps", _SPREAD + " SELECT pos, asset, round(score, 8) AS score, round(lag(score) OVER (ORDER BY pos) - score, 8) AS drop FROM pick", with_tree=True)
def selection_steps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strategies.selection_steps(selection.max_spread(_paths(spark, sf), 5, _last_caps(spark, sf), alpha=0.2)))


@query(
    "selection_trace",
    _SPREAD
    + """, steps AS (
  SELECT 0 AS step, src AS asset, 0.2 * avg(d) + 0.8 * max(wn) AS score FROM walk JOIN wn ON wn.asset = src GROUP BY src
  UNION ALL
  SELECT pos + 1, dst, 0.2 * min(d) + 0.8 * max(wn) FROM pick JOIN walk ON list_contains(s, src) AND NOT list_contains(s, dst) JOIN wn ON wn.asset = dst WHERE pos < 4 GROUP BY 1, 2
) SELECT cast(step AS integer) AS step, steps.asset, round(steps.score, 8) AS score, pick.asset = steps.asset AS chosen FROM steps JOIN pick ON pos = step""",
    with_tree=True,
)
def selection_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The scores of all candidates at each step of ``basis_max_spread``."""
    return rounded(selection.spread_trace(_paths(spark, sf), 5, _last_caps(spark, sf), 0.2))


@query("nearest_member", _SPREAD + " SELECT src AS asset, arg_min(dst, d) AS member, round(min(d), 8) AS d FROM walk WHERE dst IN (SELECT asset FROM pick) GROUP BY src", with_tree=True)
def nearest_member(spark: SparkSession, sf: str) -> DataFrame:
    """The representative nearest to each asset."""
    paths = _paths(spark, sf)
    return rounded(selection.nearest_member(paths, selection.max_spread(paths, 5, _last_caps(spark, sf), alpha=0.2)))


_IN_BASIS = ", ".join(f"'{b}'" for b in BASIS)


@query(
    "basis_sticky",
    f""" also first AS (SELECT src AS asset, 0.2 * avg(d) + 0.8 * max(wn) AS score FROM walk JOIN wn ON wn.asset = src GROUP BY src
), bonus AS (SELECT 0.5 * max(score) AS b FROM first
), pick AS (
  SELECT 0 AS pos, [asset] AS s, asset, score FROM (SELECT asset, score + CASE WHEN asset IN ({_IN_BASIS}) THEN b ELSE 0 END AS score FROM first CROSS JOIN bonus ORDER BY score DESC, asset LIMIT 1)
  UNION ALL
  SELECT * FROM (SELECT pos + 1, list_append(s, c), c, score FROM (
    SELECT pos, s, dst AS c, 0.2 * min(d) + 0.8 * max(wn) + CASE WHEN dst IN ({_IN_BASIS}) THEN max(b) ELSE 0 END AS score
    FROM pick JOIN walk ON list_contains(s, src) AND NOT list_contains(s, dst) JOIN wn ON wn.asset = dst CROSS JOIN bonus
    WHERE pos < 4 GROUP BY pos, s, dst) ORDER BY score DESC, c LIMIT 1)
) SELECT pos, asset, round(score, 8) AS score FROM pick""",
    with_tree=True,
)
def basis_sticky(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.max_spread(_paths(spark, sf), 5, _last_caps(spark, sf), alpha=0.2, stickiness=0.5, before=BASIS))


@query(
    "basis_hub_branch",
    """ also hubs AS (SELECT pos, asset, score FROM hub WHERE pos < 1
), comp AS (SELECT src AS asset, min(dst) AS comp FROM walk WHERE NOT list_has_any(path, (SELECT list(asset) FROM hubs)) GROUP BY src
), rep AS (
  SELECT comp, c.asset, 0.5 * d + 0.5 * wn AS s, row_number() OVER (PARTITION BY comp ORDER BY 0.5 * d + 0.5 * wn DESC, c.asset) AS k
  FROM comp c JOIN walk ON src = c.asset AND dst IN (SELECT asset FROM hubs) JOIN wn ON wn.asset = c.asset
), chosen AS (
  SELECT pos, asset FROM hubs UNION ALL SELECT row_number() OVER (ORDER BY s DESC, asset), asset FROM rep WHERE k = 1
), fill AS (
  SELECT count(*) - 1 AS pos, list(asset) AS s, NULL::varchar AS asset FROM chosen WHERE pos < 6
  UNION ALL
  SELECT * FROM (SELECT pos + 1, list_append(s, c), c FROM (
    SELECT pos, s, dst AS c, min(d) AS near FROM fill JOIN walk ON list_contains(s, src) AND NOT list_contains(s, dst) WHERE pos < 5 GROUP BY pos, s, dst) ORDER BY near DESC, c LIMIT 1)
) SELECT cast(pos AS integer) AS pos, asset FROM chosen WHERE pos < 6 UNION ALL SELECT cast(pos AS integer), asset FROM fill WHERE asset IS NOT NULL""",
    with_tree=True,
)
def basis_hub_branch(spark: SparkSession, sf: str) -> DataFrame:
    t = _tree(spark, sf)
    return selection.hub_branch(t, cut(tree.walks(t)), 6, weights=_last_caps(spark, sf))


@query(
    "farthest_fill",
    """ also pick AS (
  SELECT 0 AS pos, ['Brand#1'] AS s, 'Brand#1' AS asset, 0.0::double AS near
  UNION ALL
  SELECT * FROM (SELECT pos + 1, list_append(s, c), c, near FROM (
    SELECT pos, s, dst AS c, min(d) AS near FROM pick JOIN walk ON list_contains(s, src) AND NOT list_contains(s, dst) WHERE pos < 4 GROUP BY pos, s, dst) ORDER BY near DESC, c LIMIT 1)
) SELECT pos, asset, round(near, 8) AS near FROM pick WHERE pos > 0""",
    with_tree=True,
)
def farthest_fill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.farthest_fill(_paths(spark, sf), ["Brand#1"], 5))


@query(
    "basis_timeseries",
    """ also past AS (
  SELECT dt, u, v, covar_samp(x, y) OVER o / nullif(stddev_samp(x) OVER o * stddev_samp(y) OVER o, 0) AS rho
  FROM pairs WINDOW o AS (PARTITION BY u, v ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), days AS (SELECT dt, row_number() OVER (ORDER BY dt) AS t FROM (SELECT DISTINCT dt FROM panel)
), way AS (SELECT t, u, v, round(sqrt(2 * (1 - least(1, greatest(-1, rho)))), 6) AS d FROM past JOIN days USING (dt) WHERE rho IS NOT NULL
), both_ways AS (SELECT t, u, v, d FROM way UNION ALL SELECT t, v, u, d FROM way
), node AS (SELECT DISTINCT t, u AS id FROM both_ways
), start AS (SELECT t, min(id) AS root FROM node GROUP BY t
), grow AS (
  SELECT 0 AS step, n.t, n.id, n.id = root AS held, CASE WHEN n.id <> root THEN coalesce(d, 'inf'::double) END AS best, root AS hook FROM node n JOIN start s ON s.t = n.t LEFT JOIN both_ways b ON b.t = n.t AND b.u = n.id AND b.v = root
  UNION ALL
  SELECT step + 1, g.t, g.id, held OR g.id = chosen, CASE WHEN held OR g.id = chosen THEN NULL WHEN closer THEN way_d ELSE best END, CASE WHEN NOT held AND g.id <> chosen AND closer THEN chosen ELSE hook END
  FROM (SELECT g.*, coalesce(b.d, 'inf'::double) AS way_d,
               coalesce(coalesce(b.d, 'inf'::double) < best OR (coalesce(b.d, 'inf'::double) = best AND (least(g.id, chosen), greatest(g.id, chosen)) < (least(g.id, hook), greatest(g.id, hook))), false) AS closer
        FROM (SELECT *, first_value(id) OVER o AS chosen, first_value(held) OVER o AS finished FROM grow
              WINDOW o AS (PARTITION BY t ORDER BY held, best, least(id, hook), greatest(id, hook) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) g
        LEFT JOIN both_ways b ON b.t = g.t AND b.u = g.id AND b.v = chosen WHERE NOT finished) g
), joined AS (SELECT t, id, hook, best FROM (SELECT *, lead(held) OVER (PARTITION BY t, id ORDER BY step) AS next_held FROM grow) WHERE NOT held AND next_held
), link AS (SELECT t, id AS u, hook AS v, best AS d FROM joined UNION ALL SELECT t, hook, id, best FROM joined
), stroll AS (
  SELECT t, id AS src, id AS dst, NULL::varchar AS prev, 0.0::double AS d FROM node
  UNION ALL
  SELECT s.t, src, l.v, s.dst, s.d + l.d FROM stroll s JOIN link l ON l.t = s.t AND l.u = s.dst WHERE prev IS NULL OR l.v <> prev
), heavy AS (SELECT n.t, n.id, coalesce(p.cap, 0) AS w FROM node n JOIN days b ON b.t = n.t - 1 JOIN panel p ON p.dt = b.dt AND p.asset = n.id
), light AS (SELECT t, id, (w - min(w) OVER (PARTITION BY t)) / CASE WHEN max(w) OVER (PARTITION BY t) > min(w) OVER (PARTITION BY t) THEN max(w) OVER (PARTITION BY t) - min(w) OVER (PARTITION BY t) ELSE 1 END AS wn FROM heavy
), spread AS (SELECT s.t, s.src, avg(d) AS mean FROM stroll s GROUP BY 1, 2
), facts AS (SELECT l.t, l.id, wn, 0.2 * max(0.2 * mean + 0.8 * wn) OVER (PARTITION BY l.t) AS bonus FROM light l JOIN spread s ON s.t = l.t AND s.src = l.id
), pick AS (
  SELECT (SELECT min(t) FROM node) - 1 AS t, 4 AS pos, []::varchar[] AS s, []::varchar[] AS before, NULL::varchar AS asset
  UNION ALL
  SELECT * FROM (
    SELECT nt, np, list_append(ns, w.dst), nb, w.dst FROM (
      SELECT CASE WHEN pos < 4 THEN t ELSE t + 1 END AS nt, CASE WHEN pos < 4 THEN pos + 1 ELSE 0 END AS np, CASE WHEN pos < 4 THEN s ELSE []::varchar[] END AS ns, CASE WHEN pos < 4 THEN before ELSE s END AS nb FROM pick) q
    JOIN stroll w ON w.t = q.nt AND (np = 0 OR list_contains(ns, w.src)) AND NOT list_contains(ns, w.dst) JOIN facts f ON f.t = q.nt AND f.id = w.dst
    GROUP BY nt, np, ns, nb, w.dst
    ORDER BY 0.2 * CASE WHEN np = 0 THEN avg(w.d) ELSE min(w.d) END + 0.8 * max(wn) + CASE WHEN list_contains(nb, w.dst) THEN max(bonus) ELSE 0 END DESC, w.dst LIMIT 1)
) SELECT cast(dt AS varchar) AS dt, cast(pos AS integer) AS pos, asset FROM pick JOIN days USING (t) WHERE asset IS NOT NULL""",
)
def basis_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strategies.basis_over_time(_panel(spark, sf), 5, 0.2, 0.2))


@query("basis_hub_branch_timeseries")
def basis_hub_branch_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    """Hubs and branches at every date, with a bonus for members of the basis before."""
    return rounded(strategies.basis_over_time(_panel(spark, sf), 6, stickiness=0.1, method="hub_branch"))


@query("distance_denoised")
def distance_denoised(spark: SparkSession, sf: str) -> DataFrame:
    """Distances from denoised correlations of what was before each date, as the published strategy uses them."""
    return rounded(stats.expanding_distance(_panel(spark, sf), shrink="pca"), 6)


# regressions


@query("nearest_basis_neighbors", "SELECT asset, basis, cast(rank AS integer) AS rank, round(dist, 8) AS dist FROM near WHERE rank <= 3", with_ridge=True)
def nearest_basis_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_near(spark, sf))


@query("ridge_q1", "SELECT n.asset, n.basis, round(sum(x.r * y.r) / (sum(x.r * x.r) + 0.001), 8) AS coef FROM near n JOIN ret x ON x.asset = n.basis JOIN ret y ON y.asset = n.asset AND y.dt = x.dt WHERE rank = 1 AND x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2", with_ridge=True)
def ridge_q1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ridge.regress_on_one(_returns(spark, sf), _near(spark, sf, 1), 0.001))


@query("ridge_q3", "SELECT asset, basis, round(coef, 7) AS coef FROM coefs", with_ridge=True)
def ridge_q3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_coefs(spark, sf), 7)


_RECON = " also recon AS (SELECT r.dt, c.asset, sum(c.coef * r.r) AS recon FROM coefs c JOIN ret r ON r.asset = c.basis GROUP BY 1, 2 HAVING count(r.r) = count(*))"


@query("ridge_reconstruction", _RECON + " SELECT cast(dt AS varchar) AS dt, asset, round(recon, 7) AS recon FROM recon", with_ridge=True)
def ridge_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ridge.reconstruct(_returns(spark, sf), _coefs(spark, sf)), 7)


@query(
    "ridge_errors",
    _RECON
    + """ SELECT asset, round(CASE WHEN count(r.r) = count(recon) THEN sqrt(avg((r.r - recon) * (r.r - recon))) END, 7) AS rmse, count(recon) AS n_obs,
round(sqrt(avg((r.r - recon) * (r.r - recon))), 7) AS rmse_valid FROM recon LEFT JOIN ret r USING (dt, asset) GROUP BY asset""",
    with_ridge=True,
)
def ridge_errors(spark: SparkSession, sf: str) -> DataFrame:
    ret = _returns(spark, sf)
    return rounded(ridge.fit_errors(ret, ridge.reconstruct(ret, _coefs(spark, sf))), 7)


def _monthly(spark: SparkSession, sf: str, q: int, alpha: float = 0.001) -> DataFrame:
    """(dt, asset, basis, coef): a refit at every date, neighbours and returns from what was known before it."""
    panel = _panel(spark, sf)
    basis = panel.select("dt").distinct().crossJoin(_basis(spark).select("asset"))  # dates by members
    return strategies.regressions_over_time(panel, basis, q, alpha)


#: Neighbours by the distances before each date, and the refits on one and on three of them: complete rows before the
#: date, normal equations by Cramer's rule; a neighbour that an asset lacks is a column of zeros, whose coefficient is 0.
_REFITS = f""" also past AS (
  SELECT dt, u, v, covar_samp(x, y) OVER o / nullif(stddev_samp(x) OVER o * stddev_samp(y) OVER o, 0) AS rho
  FROM pairs WINDOW o AS (PARTITION BY u, v ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), near_at AS (
  SELECT dt, asset, basis, row_number() OVER (PARTITION BY dt, asset ORDER BY round(sqrt(2 * (1 - least(1, greatest(-1, rho)))), 6), basis) AS rank
  FROM (SELECT dt, u AS asset, v AS basis, rho FROM past UNION ALL SELECT dt, v, u, rho FROM past)
  WHERE rho IS NOT NULL AND basis IN (SELECT asset FROM {_BASIS_SQL}) AND asset NOT IN (SELECT asset FROM {_BASIS_SQL})
), before_at AS (
  SELECT n.dt AS t, n.asset, x.dt, any_value(y.r) AS y, coalesce(max(CASE WHEN rank = 1 THEN x.r END), 0) AS x1, coalesce(max(CASE WHEN rank = 2 THEN x.r END), 0) AS x2, coalesce(max(CASE WHEN rank = 3 THEN x.r END), 0) AS x3
  FROM near_at n JOIN ret x ON x.asset = n.basis AND x.dt < n.dt JOIN ret y ON y.asset = n.asset AND y.dt = x.dt
  WHERE rank <= {{q}} AND y.r IS NOT NULL GROUP BY 1, 2, 3 HAVING count(x.r) = count(*)
), g_at AS (
  SELECT t, asset, sum(x1*x1) + 0.001 a, sum(x1*x2) b, sum(x1*x3) c, sum(x2*x2) + 0.001 d, sum(x2*x3) e, sum(x3*x3) + 0.001 f, sum(x1*y) p, sum(x2*y) q, sum(x3*y) r FROM before_at GROUP BY 1, 2
), z_at AS (SELECT *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) AS det FROM g_at
), k_at AS (
  SELECT t, asset, 1 AS rank, (p*(d*f-e*e) - b*(q*f-e*r) + c*(q*e-d*r)) / det AS coef FROM z_at
  UNION ALL SELECT t, asset, 2, (a*(q*f-e*r) - p*(b*f-c*e) + c*(b*r-q*c)) / det FROM z_at
  UNION ALL SELECT t, asset, 3, (a*(d*r-q*e) - b*(b*r-q*c) + p*(b*e-d*c)) / det FROM z_at
), ser AS (SELECT t AS dt, k.asset, n.basis, coef FROM k_at k JOIN near_at n ON n.dt = k.t AND n.asset = k.asset AND n.rank = k.rank WHERE n.rank <= {{q}})"""


@query("ridge_timeseries", _REFITS.format(q=1) + " SELECT cast(dt AS varchar) AS dt, asset, basis, round(coef, 7) AS coef FROM ser")
def ridge_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_monthly(spark, sf, 1), 7)


@query("ridge_timeseries_q3", _REFITS.format(q=3) + " SELECT cast(dt AS varchar) AS dt, asset, basis, round(coef, 7) AS coef FROM ser")
def ridge_timeseries_q3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_monthly(spark, sf, 3), 7)


@query(
    "ridge_timeseries_unpenalized",
    _REFITS.format(q=1)
    + """ SELECT cast(t AS varchar) AS dt, b.asset, n.basis, round(coalesce(sum(x1*y) / nullif(sum(x1*x1), 0), 0), 7) AS coef
FROM before_at b JOIN near_at n ON n.dt = b.t AND n.asset = b.asset AND n.rank = 1 GROUP BY t, b.asset, n.basis""",
)
def ridge_timeseries_unpenalized(spark: SparkSession, sf: str) -> DataFrame:
    """The series without a penalty, as the published settings have it."""
    return rounded(_monthly(spark, sf, 1, 0.0), 7)


_ALL_RANKED = """ also past AS (
  SELECT t AS dt, u, v, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS rho
  FROM (SELECT t, u, v, rank() OVER (PARTITION BY t, u, v ORDER BY x) + (count(*) OVER (PARTITION BY t, u, v, x) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY t, u, v ORDER BY y) + (count(*) OVER (PARTITION BY t, u, v, y) - 1) / 2.0 AS ry
        FROM (SELECT c.dt AS t, u, v, x, y FROM (SELECT DISTINCT dt FROM panel) c JOIN pairs p ON p.dt < c.dt
              WHERE x IS NOT NULL{only}))
  GROUP BY 1, 2, 3
)"""
_RANKED = _ALL_RANKED.format(only=f" AND (u IN (SELECT asset FROM {_BASIS_SQL})) <> (v IN (SELECT asset FROM {_BASIS_SQL}))")


@query("corr_spearman_timeseries", _ALL_RANKED.format(only="") + " SELECT cast(dt AS varchar) AS dt, u, v, CASE WHEN round(rho, 8) = 0 THEN 0.0 ELSE round(rho, 8) END AS rho FROM past WHERE rho IS NOT NULL")
def corr_spearman_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlations of all pairs from the returns strictly before every date."""
    return rounded(stats.expanding_spearman(_panel(spark, sf)).where("rho is not null"))


@query("ridge_timeseries_spearman", _RANKED + _REFITS.format(q=1)[_REFITS.format(q=1).index(", near_at") :] + " SELECT cast(dt AS varchar) AS dt, asset, basis, round(coef, 7) AS coef FROM ser")
def ridge_timeseries_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours by rank correlation, as the settings of the series may ask for."""
    panel = _panel(spark, sf)
    members = panel.select("dt").distinct().join(F.broadcast(_basis(spark)))  # dates by the five members
    return rounded(strategies.regressions_over_time(panel, members, 1, 0.001, corr="spearman"), 7)


@query(
    "ridge_series_errors",
    _REFITS.format(q=3)
    + """, fit AS (SELECT s.dt AS t, s.asset, x.dt, sum(coef * x.r) AS recon FROM ser s JOIN ret x ON x.asset = s.basis AND x.dt < s.dt GROUP BY 1, 2, 3 HAVING count(x.r) = count(*))
SELECT cast(t AS varchar) AS dt, asset, round(CASE WHEN count(r.r) = count(recon) THEN sqrt(avg((r.r - recon) * (r.r - recon))) END, 7) AS rmse, count(recon) AS n_obs,
round(sqrt(avg((r.r - recon) * (r.r - recon))), 7) AS rmse_valid FROM fit LEFT JOIN ret r USING (dt, asset) GROUP BY t, asset""",
)
def ridge_series_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The fit error of every refit over the returns that it had."""
    return rounded(ridge.series_errors(_returns(spark, sf), cut(_monthly(spark, sf, 3))), 7)


# mapping

_SERIES = _REFITS.format(q=1) + ", known AS (SELECT c.dt, max(s.dt) AS as_of FROM cal c JOIN (SELECT DISTINCT dt FROM ser) s ON s.dt <= c.dt GROUP BY c.dt)"


@query("asof_coefficients", _SERIES + " SELECT cast(known.dt AS varchar) AS dt, asset, basis, round(coef, 7) AS coef FROM known JOIN ser ON ser.dt = as_of", with_map=True)
def asof_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    coefs = _monthly(spark, sf, 1)
    return rounded(mapping.as_of_coefficients(_panel(spark, sf).select("dt").distinct(), coefs), 7)


@query("map_analytic", "SELECT cast(dt AS varchar) AS dt, basis, round(sum(w * a), 7) AS w FROM weights JOIN a USING (asset) WHERE w IS NOT NULL AND dt = (SELECT min(dt) FROM weights) GROUP BY 1, 2", with_map=True)
def map_analytic(spark: SparkSession, sf: str) -> DataFrame:
    """The first date's weights on the basis."""
    return rounded(mapping.map_analytic(mapping.first_row(_weights(spark, sf)), mapping.mapping(_coefs(spark, sf), _basis(spark))), 7)


@query("map_snapshot", "SELECT cast(dt AS varchar) AS dt, basis, round(sum(w * a), 7) AS w FROM weights JOIN a USING (asset) WHERE w IS NOT NULL GROUP BY 1, 2", with_map=True)
def map_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mapping.map_snapshot(_weights(spark, sf), _coefs(spark, sf), _basis(spark)), 7)


@query(
    "map_penalized",
    f""" also place AS (SELECT asset AS basis, row_number() OVER (ORDER BY asset) AS i FROM {_BASIS_SQL}
), gram AS (
  SELECT x.i, y.i AS j, coalesce(sum(b.a * c.a), 0) + CASE WHEN x.i = y.i THEN 0.01 ELSE 0 END AS v
  FROM place x CROSS JOIN place y LEFT JOIN a b ON b.basis = x.basis LEFT JOIN a c ON c.basis = y.basis AND c.asset = b.asset GROUP BY x.i, y.i
), gauss AS (
  SELECT 1 AS k, i, j, v FROM gram UNION ALL SELECT 1, x.i, y.i + 5, CASE WHEN x.i = y.i THEN 1.0 ELSE 0.0 END FROM place x CROSS JOIN place y
), jordan AS (
  SELECT * FROM gauss
  UNION ALL
  SELECT k + 1, i, j, CASE WHEN i = k THEN v / piv ELSE v - across * below / piv END FROM (
    SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER () AS piv, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS across, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS below
    FROM jordan) WHERE k <= 5
), inverse AS (SELECT i, j - 5 AS j, v FROM jordan WHERE k = 6 AND j > 5
), days AS (SELECT dt, row_number() OVER (ORDER BY dt) AS t FROM (SELECT DISTINCT dt FROM weights WHERE w IS NOT NULL)
), ab AS (SELECT t, i, sum(w * a.a) AS v FROM weights JOIN a USING (asset) JOIN days USING (dt) JOIN place ON place.basis = a.basis WHERE w IS NOT NULL GROUP BY 1, 2
), held AS (
  SELECT 0::bigint AS t, i, 0.0::double AS w FROM place
  UNION ALL
  SELECT h.t + 1, n.i, sum(n.v * (coalesce(ab.v, 0) + 0.01 * h.w)) FROM held h JOIN inverse n ON n.j = h.i LEFT JOIN ab ON ab.t = h.t + 1 AND ab.i = h.i WHERE h.t < (SELECT max(t) FROM days) GROUP BY h.t, n.i
) SELECT cast(dt AS varchar) AS dt, basis, round(w, 6) AS w FROM held JOIN days USING (t) JOIN place USING (i)""",
    with_map=True,
)
def map_penalized(spark: SparkSession, sf: str) -> DataFrame:
    weights = _weights(spark, sf).where("w is not null")
    a = weights.select("dt").distinct().crossJoin(mapping.mapping(_coefs(spark, sf), _basis(spark)))
    return rounded(mapping.map_penalised(weights, a, 0.01), 6)


@query(
    "map_series_exact",
    _SERIES
    + """, pres AS (SELECT DISTINCT dt, basis FROM ser),
ax AS (SELECT dt, asset, basis, coef AS a FROM ser UNION ALL SELECT dt, basis, basis, 1.0 FROM pres WHERE (dt, basis) NOT IN (SELECT dt, asset FROM ser)),
m AS (SELECT w.dt, ax.basis, sum(w.w * ax.a) AS w FROM weights w JOIN ax ON ax.dt = w.dt AND ax.asset = w.asset WHERE w.w IS NOT NULL GROUP BY 1, 2)
SELECT cast(cal.dt AS varchar) AS dt, b.basis, round(coalesce(m.w, 0), 7) AS w FROM cal CROSS JOIN (SELECT DISTINCT basis FROM ser) b LEFT JOIN m ON m.dt = cal.dt AND m.basis = b.basis""",
    with_map=True,
)
def map_series_exact(spark: SparkSession, sf: str) -> DataFrame:
    coefs = cut(_monthly(spark, sf, 1))
    return rounded(mapping.map_series_exact(_weights(spark, sf), coefs), 7)


@query("map_series_exact_penalized")
def map_series_exact_penalized(spark: SparkSession, sf: str) -> DataFrame:
    """The mapping series with the penalty of its settings, 0.01."""
    coefs = cut(_monthly(spark, sf, 3))
    return rounded(mapping.map_series_exact(_weights(spark, sf), coefs, 0.01), 7)


_AS_OF = (
    _SERIES
    + f""", ax AS (SELECT known.dt, ser.asset, ser.basis, coef AS a FROM known JOIN ser ON ser.dt = as_of UNION ALL SELECT cal.dt, b.asset, b.asset, 1.0 FROM cal CROSS JOIN {_BASIS_SQL.replace(' AS basis(asset)', ' AS b(asset)')}),
held AS (SELECT w.dt, ax.basis AS asset, sum(w.w * ax.a) AS w FROM weights w JOIN ax ON ax.dt = w.dt AND ax.asset = w.asset WHERE w.w IS NOT NULL GROUP BY 1, 2)"""
)


@query("map_series_asof", _AS_OF + " SELECT cast(dt AS varchar) AS dt, asset AS basis, round(w, 7) AS w FROM held", with_map=True)
def map_series_asof(spark: SparkSession, sf: str) -> DataFrame:
    coefs = cut(_monthly(spark, sf, 1))
    return rounded(mapping.map_series_as_of(_weights(spark, sf), coefs, _basis(spark)), 7)


# backtests


@query("topn_weights", "SELECT cast(dt AS varchar) AS dt, asset, round(w, 8) AS w FROM tops", with_map=True)
def topn_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.top_weights(_weights(spark, sf), 10))


@query("lagged_index_return", "SELECT cast(dt AS varchar) AS dt, round(ret, 8) AS ret FROM idx", with_map=True)
def lagged_index_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.lagged_return(_weights(spark, sf), _returns(spark, sf)))


@query("replica_return", "SELECT cast(dt AS varchar) AS dt, round(ret, 8) AS ret FROM rep", with_map=True)
def replica_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.lagged_return(backtest.top_weights(_weights(spark, sf), 10), _returns(spark, sf)))


@query("turnover", "SELECT cast(dt AS varchar) AS dt, round(turnover, 8) AS turnover FROM turn", with_map=True)
def turnover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.turnover(backtest.top_weights(_weights(spark, sf), 10)))


def _baseline(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return strategies.baseline_backtest(_panel(spark, sf), 10)


@query("running_rmse", "SELECT cast(dt AS varchar) AS dt, round(sqrt(avg(diff * diff) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING)), 8) AS running_rmse FROM act", with_map=True)
def running_rmse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.running_rmse(_baseline(spark, sf)["active"]))


@query("cumulative_return", "SELECT cast(dt AS varchar) AS dt, round(exp(sum(ln(1 + index_return)) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING)) - 1, 8) AS cumulative FROM act", with_map=True)
def cumulative_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.cumulative_return(_baseline(spark, sf)["active"], "index_return"))


@query("tail_slice", "SELECT cast(dt AS varchar) AS dt, round(index_return, 8) AS index_return, round(rep_return, 8) AS rep_return, round(diff, 8) AS diff FROM last", with_map=True)
def tail_slice(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_baseline(spark, sf)["tail"])


_SUMMARY = """SELECT count(diff) AS n_tail, round(1 - sum((index_return - rep_return) * (index_return - rep_return)) / nullif(var_pop(index_return) * count(*), 0), 7) AS r2,
round(avg(diff), 8) AS mean_active, round(stddev_samp(diff), 8) AS std_active, round(sqrt(avg(diff * diff)), 8) AS rmse, round(stddev_samp(diff) * sqrt(12), 8) AS std_annualised,
round(avg(diff) / stddev_samp(diff) * sqrt(12), 7) AS information_ratio, round(avg(coalesce(turnover, 0)), 8) AS avg_turnover,
round(any_value(te), 8) AS tracking_error, round(any_value(te) * sqrt(12), 8) AS tracking_error_annualised
FROM {last} LEFT JOIN {turn} t USING (dt) CROSS JOIN (SELECT sqrt(avg(diff * diff)) AS te FROM {act})"""


@query("backtest_summary", _SUMMARY.format(last="last", turn="turn", act="act"), with_map=True)
def backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The largest ten names against the whole index."""
    return rounded(_baseline(spark, sf)["summary"], r2=7, information_ratio=7)


@query(
    "strategy_summary",
    _AS_OF
    + """, srep AS (SELECT c.dt, coalesce(sum(w.w * r.r), 0) AS ret FROM cal c LEFT JOIN held w ON w.dt = c.before LEFT JOIN ret r ON r.dt = c.dt AND r.asset = w.asset GROUP BY c.dt),
sact AS (SELECT dt, idx.ret AS index_return, srep.ret AS rep_return, srep.ret - idx.ret AS diff FROM idx JOIN srep USING (dt)),
slast AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY dt DESC) AS k, count(*) OVER () AS n FROM sact) WHERE k <= greatest(1, floor(n * 20.0 / 100.0))),
sturn AS (SELECT dt, 0.5 * sum(c) AS turnover FROM (SELECT dt, asset, abs(coalesce(w, 0) - lag(coalesce(w, 0), 1, 0) OVER (PARTITION BY asset ORDER BY dt)) AS c
  FROM (SELECT DISTINCT dt FROM held) CROSS JOIN (SELECT DISTINCT asset FROM held) LEFT JOIN held USING (dt, asset)) GROUP BY dt) """
    + _SUMMARY.format(last="slast", turn="sturn", act="sact"),
    with_map=True,
)
def strategy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The mapped basis against the whole index."""
    panel = _panel(spark, sf)
    coefs = cut(_monthly(spark, sf, 1))
    return rounded(strategies.strategy_backtest(panel, coefs, _basis(spark))["summary"], r2=7, information_ratio=7)


@query("published_strategy")
def published_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """The published settings on the market of brands: the ten metrics of the strategy, beside ``backtest_summary``."""
    return rounded(strategies.published_strategy(_panel(spark, sf))["summary"], r2=7, information_ratio=7)


@query("published_strategy_penalized")
def published_strategy_penalized(spark: SparkSession, sf: str) -> DataFrame:
    """The same with plain distances and weights held to those of the date before."""
    return rounded(strategies.published_strategy(_panel(spark, sf), shrink=None, ridge_alpha=0.001, penalty=0.01)["summary"], r2=6, information_ratio=6)


@query("summarize", "SELECT count(diff) AS n, round(avg(diff), 8) AS mean, round(stddev_samp(diff), 8) AS std, round(sqrt(avg(diff * diff)), 8) AS rmse, round(stddev_samp(diff) * sqrt(12), 8) AS std_annualised FROM act", with_map=True)
def summarize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(backtest.summarise(_baseline(spark, sf)["active"]))


# diagnostics


@query("concentration_topk", "SELECT cast(dt AS varchar) AS dt, round(sum(w), 8) AS top_k FROM (SELECT dt, w, row_number() OVER (PARTITION BY dt ORDER BY w DESC NULLS LAST, asset) AS k FROM weights) WHERE k <= 5 GROUP BY 1")
def concentration_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.concentration(_weights(spark, sf), 5))


@query("constituent_counts", "SELECT cast(dt AS varchar) AS dt, count(*) FILTER (w > 0) AS n FROM weights GROUP BY 1")
def constituent_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.constituents(_weights(spark, sf)))


@query(
    "count_turnover",
    """ also c AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS before FROM (SELECT DISTINCT dt FROM weights)), h AS (SELECT dt, asset FROM weights WHERE w > 0)
SELECT cast(c.dt AS varchar) AS dt, round(1 - count(n.asset) / nullif(count(p.asset), 0), 8) AS count_turnover FROM c LEFT JOIN h p ON p.dt = c.before LEFT JOIN h n ON n.dt = c.dt AND n.asset = p.asset GROUP BY 1""",
)
def count_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.count_turnover(_weights(spark, sf)))


@query(
    "return_density",
    """, f AS (SELECT count(r) AS n, stddev_samp(r) * pow(count(r), -0.2) AS h FROM ret
), b AS (SELECT cast(floor((r + 0.2) / 0.4 * 40) + 1 AS bigint) AS bin, count(*) AS c FROM ret WHERE r >= -0.2 AND r < 0.2 GROUP BY 1
), g AS (SELECT unnest(range(1, 41)) AS bin)
SELECT g.bin, round(-0.2 + (g.bin - 0.5) * 0.01, 8) AS x, round((SELECT sum(c * exp(-pow((g.bin - b.bin) * 0.01 / h, 2) / 2) / (n * h * sqrt(2 * pi()))) FROM b, f), 6) AS density FROM g""".replace(", f AS", " also f AS", 1),
)
def return_density(spark: SparkSession, sf: str) -> DataFrame:
    """A kernel density of the returns, from their histogram."""
    return rounded(diagnostics.density(_returns(spark, sf), "r", -0.2, 0.2, 40), density=6)


@query("return_histogram", "SELECT cast(CASE WHEN r < -0.2 THEN 0 WHEN r >= 0.2 THEN 21 ELSE floor((r + 0.2) / 0.4 * 20) + 1 END AS bigint) AS bin, count(*) AS n FROM ret WHERE r IS NOT NULL GROUP BY 1")
def return_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.histogram(_returns(spark, sf), "r", -0.2, 0.2, 20)


@query("index_level", "SELECT cast(dt AS varchar) AS dt, round(cap / first_value(cap) OVER (ORDER BY dt), 8) AS level FROM (SELECT dt, sum(cap) AS cap FROM panel GROUP BY dt)")
def index_level(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.index_level(_panel(spark, sf)))


@query("normalised_prices", "SELECT cast(dt AS varchar) AS dt, asset, round(px / first_value(px IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 8) AS level FROM panel")
def normalised_prices(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.normalised_prices(_panel(spark, sf)))


@query("top_by_final_cap", "SELECT asset, round(cap / 1e6, 8) AS cap_millions FROM panel WHERE dt = (SELECT max(dt) FROM panel) AND cap IS NOT NULL ORDER BY cap DESC, asset LIMIT 10")
def top_by_final_cap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.top_by_final_cap(_panel(spark, sf), 10))


@query("initial_cap_histogram", "SELECT cast(least(21, floor(greatest(cap / 1e6, 0) / 2.0 * 20) + 1) AS bigint) AS bin, count(*) AS n FROM (SELECT asset, arg_min(cap, dt) AS cap FROM panel WHERE cap IS NOT NULL GROUP BY asset) GROUP BY 1")
def initial_cap_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.initial_caps(_panel(spark, sf), 2.0, 20)


@query("top_by_mean_weight", "SELECT asset, round(avg(w), 8) AS mean_w FROM weights GROUP BY asset ORDER BY avg(w) DESC NULLS LAST, asset LIMIT 10")
def top_by_mean_weight(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.top_by_mean_weight(_weights(spark, sf), 10))


@query("availability", "SELECT asset, count(px) AS n_dates FROM panel GROUP BY asset")
def availability(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.availability(_panel(spark, sf))


@query(
    "available_corr",
    """ also m AS (SELECT asset FROM panel GROUP BY asset ORDER BY count(px) DESC, asset LIMIT 8), z AS (SELECT dt, asset, coalesce(r, 0) AS r FROM ret WHERE asset IN (SELECT asset FROM m))
SELECT a.asset AS u, b.asset AS v, round(covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0), 8) AS rho, count(*) AS n_obs FROM z a JOIN z b ON a.dt = b.dt AND a.asset < b.asset GROUP BY 1, 2""",
)
def available_corr(spark: SparkSession, sf: str) -> DataFrame:
    panel = _panel(spark, sf)
    return rounded(diagnostics.available_corr(stats.returns(panel), panel, 8))


# basis files


@query("basis_list_format", "SELECT cast(dt AS varchar) AS date, string_agg(asset, ';' ORDER BY k) AS basis FROM (SELECT dt, asset, row_number() OVER (PARTITION BY dt ORDER BY w DESC NULLS LAST, asset) AS k FROM weights) WHERE k <= 5 GROUP BY 1")
def basis_list_format(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("dt").orderBy(F.desc_nulls_last("w"), "asset")
    top = _weights(spark, sf).select("dt", (F.row_number().over(w) - 1).alias("pos"), "asset").where("pos < 5")
    return basis_files.series_form(top)


@query("basis_list_parse", "SELECT cast(dt AS varchar) AS dt, cast(k - 1 AS integer) AS pos, asset FROM (SELECT dt, asset, row_number() OVER (PARTITION BY dt ORDER BY w DESC NULLS LAST, asset) AS k FROM weights) WHERE k <= 5")
def basis_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(basis_files.series_rows(basis_list_format(spark, sf)))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

