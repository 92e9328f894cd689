"""Every SQL-expressible registered query equals its DuckDB oracle (sf0.001)."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from conftest import SMALL_SF

ORACLE = entry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, duck, key):
    df = entry.queries()[key](spark, SMALL_SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(ORACLE[key])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_every_key_is_callable():
    qs = entry.queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 90


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["yearOfRegistration", "avg_price", "pct_change"]
