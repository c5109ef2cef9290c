"""Penalised weights over many dates, carried through ranges, against a plain loop."""

from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from indexloom.operators import mapping
from indexloom.plans import catalog


def loop(weights, a, penalty, initial="zero", before=None):
    """weights: {(t, asset): w}, a: {t: {(asset, basis): a}}; the weights of each date from those of the date before."""
    prev, out = dict(before or {}), {}
    for t in sorted(a):
        names = sorted({b for _, b in a[t]})
        assets = sorted({x for x, _ in a[t]})
        m = np.array([[a[t].get((x, n), 0.0) for n in names] for x in assets])
        b = np.array([weights.get((t, x), 0.0) for x in assets])
        if not prev and initial == "skip":
            x = m.T @ b
        else:
            x = np.linalg.solve(m.T @ m + penalty * np.eye(len(names)), m.T @ b + penalty * np.array([prev.get(n, 0.0) for n in names]))
        prev = dict(zip(names, x, strict=True))
        out |= {(t, n): v for n, v in prev.items()}
    return out


@pytest.mark.parametrize(("initial", "before"), [("zero", None), ("skip", None), ("zero", {"b0": 0.7, "b9": 5.0})])
def test_ranges(spark, monkeypatch, initial, before):
    """Ranges of ranges; members that come and go."""
    monkeypatch.setattr(mapping, "RANGE", 3)
    rng = np.random.default_rng(5)
    weights = {(t, f"a{i}"): float(rng.random()) for t in range(40) for i in range(6)}
    a = {t: {(f"a{i}", f"b{j}"): float(rng.normal()) for i in range(6) for j in range(4) if (t + j) % 7} for t in range(40)}
    w = spark.createDataFrame([(t, x, v) for (t, x), v in weights.items()], "dt int, asset string, w double")
    m = spark.createDataFrame([(t, x, n, v) for t, day in a.items() for (x, n), v in day.items()], "dt int, asset string, basis string, a double")
    got = {(r.dt, r.basis): r.w for r in mapping.map_penalised(w, m, 0.5, initial, before).collect()}
    assert got == pytest.approx(loop(weights, a, 0.5, initial, before))


def test_series_query(spark):
    """The registered series against the loop over its own coefficients."""
    sf = "/root/testdata/sf0.001"
    got = {(r.dt, r.basis): r.w for r in entry.queries()["map_series_exact_penalized"](spark, sf).collect()}
    coefs = catalog._monthly(spark, sf, 3).collect()
    weights = {(str(r.dt), r.asset): r.w for r in catalog._weights(spark, sf).where("w is not null").collect()}
    a = defaultdict(dict)
    for r in coefs:
        a[str(r.dt)][r.asset, r.basis] = r.coef
    for day in a.values():
        for b in {b for _, b in day}:
            if not any(x == b for x, _ in day):
                day[b, b] = 1.0
    want = loop(weights, a, 0.01)
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-6)
    assert all(v == 0 for k, v in got.items() if k not in want)
