"""Registered queries over small markets against brute force."""

import numpy as np
import pytest

from indexloom.operators import tree
from indexloom.plans import catalog, strategies

BRANDS = [*catalog.BASIS, "Brand#2", "Brand#3", "Brand#30"]
MONTHS = [f"{1995 + m // 12}-{m % 12 + 1:02d}-01" for m in range(26)]


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Prices by month and brand (NaN: not sold), and the folder of their tables."""
    rng = np.random.default_rng(4)
    px = 100 * np.cumprod(1 + 0.05 * rng.standard_normal((len(MONTHS), len(BRANDS))) + 0.03 * rng.standard_normal((len(MONTHS), 1)), axis=0)
    px[3, 6] = px[7, 1] = np.nan
    lines = [(j, m, float(px[t, j]), 1.0) for t, m in enumerate(MONTHS) for j in range(len(BRANDS)) if px[t, j] == px[t, j]]
    sf = str(tmp_path_factory.mktemp("market"))
    spark.createDataFrame(lines, "l_partkey long, d string, l_extendedprice double, l_quantity double").selectExpr("*", "to_date(d) AS l_shipdate").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame(list(enumerate(BRANDS)), "p_partkey long, p_brand string").write.parquet(f"{sf}/part.parquet")
    return px, sf


def refits(px, q):
    """{(date, asset, member): coefficient}, each date from the prices strictly before it."""
    out = {}
    with np.errstate(invalid="ignore"):
        ret = np.vstack((np.full(px.shape[1], np.nan), px[1:] / px[:-1] - 1))
    for t in range(len(px)):
        for j in range(len(catalog.BASIS), len(BRANDS)):
            near = []
            for b in range(len(catalog.BASIS)):
                ok = ~np.isnan(ret[:t, j]) & ~np.isnan(ret[:t, b])
                if ok.sum() > 1:
                    near.append((np.sqrt(2 * (1 - np.clip(np.corrcoef(ret[:t, j][ok], ret[:t, b][ok])[0, 1], -1, 1))).round(strategies.DIGITS), BRANDS[b], b))
            members = [b for _, _, b in sorted(near)[:q]]
            rows = ~np.isnan(ret[:t, [j, *members]]).any(axis=1)
            if members and rows.any():
                x = ret[:t][rows][:, members]
                beta = np.linalg.solve(x.T @ x + 0.001 * np.eye(len(members)), x.T @ ret[:t][rows][:, j])
                out |= {(MONTHS[t], BRANDS[j], BRANDS[b]): c for b, c in zip(members, beta, strict=True)}
    return out


@pytest.mark.parametrize(("name", "q"), [("ridge_timeseries", 1), ("ridge_timeseries_q3", 3)])
def test_refits_at_every_date(spark, market, name, q):
    px, sf = market
    got = {(r.dt, r.asset, r.basis): r.coef for r in catalog.queries()[name](spark, sf).collect()}
    want = refits(px, q)
    assert {k[0] for k in got} == {k[0] for k in want} == set(MONTHS[3:])
    assert got == pytest.approx(want, abs=2e-7)


def test_maps_at_every_date(spark, market):
    """Exact and as-of maps, and the strategy, from the refits of all dates."""
    px, sf = market
    run = catalog.queries()
    coefs = {}
    for r in run["ridge_timeseries"](spark, sf).collect():
        coefs.setdefault(r.dt, {})[r.asset] = (r.basis, r.coef)
    w = {(r.dt, r.asset): r.w for r in run["index_weights"](spark, sf).collect() if r.w is not None}
    exact, as_of = {}, {}
    for dt in MONTHS:
        day = coefs.get(dt, {})
        members = {b for b, _ in day.values()}
        for asset in BRANDS:
            b, c = day.get(asset, (asset, 1.0))
            x = w.get((dt, asset), 0.0) * c
            if asset in catalog.BASIS or asset in day:
                as_of[dt, b] = as_of.get((dt, b), 0.0) + x
            if asset in day or asset in members:
                exact[dt, b] = exact.get((dt, b), 0.0) + x
    got = {(r.dt, r.basis): r.w for r in run["map_series_exact"](spark, sf).collect()}
    assert {k: v for k, v in got.items() if v} == pytest.approx(exact, abs=1e-6)
    assert len({k[0] for k, v in got.items() if v}) == len(MONTHS) - 3
    got = {(r.dt, r.basis): r.w for r in run["map_series_asof"](spark, sf).collect()}
    assert got == pytest.approx({k: v for k, v in as_of.items() if k in got}, abs=1e-6)
    known = {r.dt for r in run["asof_coefficients"](spark, sf).collect()}
    assert known == set(MONTHS[3:])
    assert run["strategy_summary"](spark, sf).first().tracking_error > 0


def test_wide_returns_have_all_assets(spark, market):
    px, sf = market
    got = catalog.queries()["returns_long_to_wide"](spark, sf)
    assert got.columns == ["dt", *sorted(BRANDS)]
    rows = {r.dt: r for r in got.collect()}
    want = [None if x != x else pytest.approx(x, abs=1e-7) for x in px[5] / px[4] - 1]
    assert len(rows) == len(MONTHS) and [rows[MONTHS[5]][b] for b in BRANDS] == want


def test_tree_spans_all_points(spark, tmp_path):
    rng = np.random.default_rng(2)
    xy = rng.standard_normal((130, 2)).astype("float32")
    spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(xy)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["euclid_mst"](spark, str(tmp_path)).collect()
    m = np.hypot(*(xy[:, None].astype(float) - xy[None].astype(float)).transpose(2, 0, 1))
    assert {(r.u, r.v): r.w for r in got} == pytest.approx({(f"{a:06d}", f"{b:06d}"): w for a, b, w in tree.prim(m)}, abs=1e-7)
