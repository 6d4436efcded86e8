"""Each query with SQL against DuckDB on the smallest tables; a few without run for their shape."""

import math

import duckdb
import pytest

from factorloom import catalog

SAMPLE = ["panel_user_day", "rank_ic", "op_rank", "op_ema", "op_corr", "pit_panel_ffill", "roll_continuous_ratio", "exposures_all", "treadmill", "combine", "stream_bars", "target_hash"]


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return str(x) if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want and got


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.ORACLES) > 90


def test_formula_search_gates(spark, sf):
    assert {r["status"] for r in catalog.QUERIES["formula_search"](spark, sf).collect()} == {"rejected", "candidate"}
