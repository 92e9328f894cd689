"""Robust local regression against a NumPy loop."""

from __future__ import annotations

import math

import numpy as np
import pytest

from marktwert.operators import stats


def local_fit(x, y, r, x0, frac):
    d = np.abs(x - x0)
    h = np.sort(d)[math.ceil(frac * len(x)) - 1]
    u = d / h if h > 0 else np.where(d == 0, 0.0, 1.0)
    w = np.where(u < 1, (1 - u ** 3) ** 3, 0.0) * r
    dx = x - x0
    s0, s1, s2, t0, t1 = w.sum(), (w * dx).sum(), (w * dx * dx).sum(), (w * y).sum(), (w * dx * y).sum()
    den = s0 * s2 - s1 * s1
    slope = (s0 * t1 - s1 * t0) / den if abs(den) > 1e-12 else 0.0
    return (t0 - slope * s1) / s0 if s0 > 0 else np.nan


def loop(x, y, grid, rounds, frac=2 / 3):
    points = x.min() + np.arange(grid) * (x.max() - x.min()) / max(grid - 1, 1)
    r = np.ones(len(x))
    fits = np.array([local_fit(x, y, r, p, frac) for p in points])
    for _ in range(rounds):
        e = np.abs(y - np.interp(x, points, fits))
        s = np.median(e)
        if s > 0:
            u = e / (6 * s)
            r = np.where(u < 1, (1 - u * u) ** 2, 0.0)
        fits = np.array([local_fit(x, y, r, p, frac) for p in points])
    return points, fits


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for g, n in (("a", 300), ("b", 120)):
        x = rng.integers(1, 60, n) / 2.0
        y = np.round(100 - 2 * x + 10 * np.sin(x) + rng.normal(0, 3, n), 2)
        y[:: 15] += 400  # planted outliers
        out += [(g, float(a), float(b)) for a, b in zip(x, y)]
    out += out[:40]  # repeated rows
    out += [("one", 5.0, 7.0), ("same", 2.0, 1.0), ("same", 2.0, 4.0), (None, 1.0, 1.0), ("a", None, 1.0), ("a", 1.0, None)]
    return out


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_rounds_equal_a_loop(spark, rows, rounds):
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = stats.lowess_trend(df, "x", "y", "g", grid=9, robust_rounds=rounds).collect()
    for g in ("a", "b", "one", "same"):
        x, y = (np.array([r[i] for r in rows if r[0] == g and None not in r]) for i in (1, 2))
        points, fits = loop(x, y, 9, rounds)
        mine = sorted((r["point"], r["x"], r["fitted"]) for r in got if r["g"] == g)
        assert [m[1] for m in mine] == pytest.approx(points.tolist(), abs=1e-6)
        assert [m[2] for m in mine] == pytest.approx(fits.tolist(), abs=1e-5)
    if rounds == 3:  # the outliers no longer lift the trend
        worst = max(abs(r["fitted"] - (100 - 2 * r["x"])) for r in got if r["g"] == "a")
        assert worst < 25


def test_medians_put_few_values_in_order(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.integers(1, 40, 6000), np.round(rng.gamma(2.0, 900.0, 6000), 2)
    df = spark.createDataFrame([("a", float(i), float(j)) for i, j in zip(x, y)], "g string, x double, y double")
    whole, ordered = stats.ordered_prefix, []

    def counted(rows, *args, **kw):
        ordered.append(rows.count())
        return whole(rows, *args, **kw)

    monkeypatch.setattr(stats, "ordered_prefix", counted)
    got = stats.lowess_trend(df, "x", "y", "g", grid=9, robust_rounds=1).collect()
    _, fits = loop(x.astype(float), y, 9, 1)
    assert [r["fitted"] for r in sorted(got, key=lambda r: r["point"])] == pytest.approx(fits.tolist(), abs=1e-5)
    assert ordered and max(ordered) < 300


@pytest.mark.parametrize("values", [
    [0.0, 0.0, 0.0, 5.0], [0.0, 3.0], [1e-9, 1e9, 4.0], [2.0] * 5, [7.0], [1.0, 1.0, 2.0, 1e6],
    [0.5, 100.0, 0.25, 1000.0, 0.125, 1e-300]])
def test_group_median(spark, values):
    rows = [(g, v, w) for g, w in (("a", 1), ("b", 3)) for v in values] + [("a", None, 1), ("none", None, 2)]
    df = spark.createDataFrame(rows, "g string, v double, _n long")
    got = {r["g"]: r["median"] for r in stats._group_median(df, "v", "g").collect()}
    assert got == pytest.approx({"a": np.median(values), "b": np.median(values * 3)})
