"""Returns, correlations, distances."""

import numpy as np
import pytest

from indexloom.functions import stats


def long(spark, table, value="r"):
    rows = [(t, a, None if x is None else float(x)) for a, xs in table.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, f"dt int, asset string, {value} double")


def rho(df):
    return {(r.u, r.v): r.rho for r in df.collect()}


def test_returns_across_gaps(spark):
    got = stats.returns(long(spark, {"a": [100, None, 110, 121], "b": [0, 5, 5, None]}, "px")).collect()
    assert {(r.dt, r.asset): r.r and round(r.r, 9) for r in got} == {(0, "a"): None, (1, "a"): None, (2, "a"): None, (3, "a"): 0.1, (0, "b"): None, (1, "b"): None, (2, "b"): 0.0, (3, "b"): None}


def test_correlations(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3, 40))
    x[1] += x[0]
    table = {"a": x[0].tolist(), "b": x[1].tolist(), "c": [None, *x[2, 1:].tolist()], "d": [1.0] * 40}
    df = long(spark, table)
    got = rho(stats.pearson(df))
    assert got["a", "b"] == pytest.approx(np.corrcoef(x[0], x[1])[0, 1])
    assert got["a", "c"] == pytest.approx(np.corrcoef(x[0, 1:], x[2, 1:])[0, 1])
    assert got["a", "d"] is None
    assert rho(stats.pearson(df, 40))["a", "c"] is None
    ranks = [np.argsort(np.argsort(v)) for v in x[:2]]
    assert rho(stats.spearman(df))["a", "b"] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    ties = long(spark, {"a": [1, 1, 2, 3], "b": [1, 2, 2, 4]})
    assert rho(stats.spearman(ties))["a", "b"] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4])[0, 1])


def test_null_returns_of_one_side_do_not_count(spark):
    got = stats.pearson(long(spark, {"a": [0.4, None, 0.1, None], "b": [None, -0.2, 0.3, 0.5]})).first()
    assert (got.rho, got.n_obs) == (None, 1)
    got = stats.pearson(long(spark, {"a": [0.4, 0.2, 0.1, None, 0.9], "b": [0.8, 0.4, 0.2, 0.5, None]})).first()
    assert got.rho == pytest.approx(1.0) and got.n_obs == 3


@pytest.mark.parametrize(("value", "expected"), [(0.5, 1.0), (-0.5, 3**0.5), (1.0, 0.0), (-1.0, 2.0), (1.2, 0.0), (None, None)])
def test_distance(spark, value, expected):
    got = stats.distance(spark.createDataFrame([("a", "b", value)], "u string, v string, rho double")).first().dist
    assert got == (None if expected is None else pytest.approx(expected))


def test_covariance_to_correlation(spark):
    x = np.random.default_rng(8).standard_normal((3, 30)) * [[1.0], [7.0], [0.2]]
    c = np.cov(x)
    cov = spark.createDataFrame([("xyz"[i], "xyz"[j], float(c[i, j])) for i in range(3) for j in range(i, 3)], "u string, v string, cov double")
    want = np.corrcoef(x)
    assert rho(stats.cov_to_corr(cov)) == pytest.approx({("xyz"[i], "xyz"[j]): want[i, j] for i in range(3) for j in range(i, 3)})
    flat = spark.createDataFrame([("x", "x", 0.0), ("x", "y", 0.0), ("y", "y", 2.5)], "u string, v string, cov double")
    assert rho(stats.cov_to_corr(flat)) == {("x", "x"): None, ("x", "y"): 0.0, ("y", "y"): 1.0}


def test_ledoit_wolf(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((25, 5)) @ rng.standard_normal((5, 5))
    table = {f"a{j}": [None, *x[:, j].tolist()] for j in range(5)}
    filled = np.vstack((np.median(x, axis=0), x))
    c = filled - filled.mean(axis=0)
    n, p = c.shape
    s = c.T @ c / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n**2 / p, delta)
    want = (1 - beta / delta) * s + beta / delta * mu * np.eye(p)
    d = np.sqrt(np.diag(want))
    for (u, v), r in rho(stats.ledoit_wolf(long(spark, table))).items():
        i, j = int(u[1]), int(v[1])
        assert r == pytest.approx(want[i, j] / d[i] / d[j])


def test_denoised(spark):
    rng = np.random.default_rng(4)
    c = np.corrcoef(rng.standard_normal((6, 30)))
    full = stats.denoise(c, n_components=6)
    assert full == pytest.approx(c)
    one = stats.denoise(c, n_components=1)
    assert one == pytest.approx(one.T) and np.diag(one) == pytest.approx(np.ones(6)) and np.abs(one).max() <= 1
    assert stats.denoise(c, explained=1.0) == pytest.approx(c)
    assert not np.isnan(stats.denoise(np.where(np.eye(6) > 0, 1.0, np.nan))).any()


def test_windows(spark):
    panel = long(spark, {"a": [1, 2, 4, 3, 5, 9], "b": [3, 4, 9, 7, 7, 8]}, "px")
    last = stats.pearson(stats.returns(stats.windowed(panel, window=4))).first()
    assert last.n_obs == 3
    assert stats.windowed(panel, end=2).count() == 6
    got = {r.dt: r for r in stats.expanding_distance(panel).collect()}
    assert got[0].n_obs == 0 and got[0].dist is None and got[5].n_obs == 4
    before = stats.price_distance(panel.where("dt < 5")).first().dist
    assert got[5].dist == pytest.approx(before)


@pytest.mark.parametrize("kind", [{"method": "spearman"}, {"shrink": "lw"}, {"shrink": "pca"}, {"shrink": "pca", "n_components": 2}, {"shrink": "pca", "explained": 0.7}, {"method": "spearman", "shrink": "pca"}])
def test_expanding_forms(spark, kind):
    """Each date's distances are those of the panel before it."""
    rng = np.random.default_rng(12)
    px = 50 * np.cumprod(1 + 0.1 * rng.standard_normal((9, 4)), axis=0)
    panel = long(spark, {f"a{j}": [None if (t, j) == (4, 2) else px[t, j] for t in range(9)] for j in range(4)}, "px")
    got = {(r.dt, r.u, r.v): r.dist for r in stats.expanding_distance(panel, **kind).collect()}
    for t in (4, 6, 8):
        want = {(t, r.u, r.v): r.dist for r in stats.price_distance(panel.where(f"dt < {t}"), **kind).collect()}
        assert {k: v for k, v in got.items() if k[0] == t} == pytest.approx(want, abs=1e-7)
    assert 0 not in {k[0] for k in got if got[k] is not None}


def test_bad_methods(spark):
    panel = long(spark, {"a": [1, 2], "b": [2, 3]}, "px")
    for bad in ({"shrink": "xx"}, {"method": "kendall"}):
        with pytest.raises(ValueError):
            stats.price_distance(panel, **bad)
        with pytest.raises(ValueError):
            stats.expanding_distance(panel, **bad)
