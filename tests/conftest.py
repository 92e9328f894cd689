from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL_SF = "/root/testdata/sf0.001"
MEDIUM_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from marktwert.session import get_session
    s = get_session("local[4]", app_name="marktwert-tests", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from marktwert.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_SF}/{t}.parquet')")
    return con
