"""Queries over suppliers return every supplier with returns, not a subset of ids."""

import math

import duckdb
import pytest

from factorloom import catalog
from factorloom.queries import statistics

PER_STRATEGY = ["tstat_sharpe_all", "moments_for_dsr_all", "autocorr_all", "newey_west_all", "log_wealth_all", "cpcv_all", "nonoverlap_all"]


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return str(x) if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    return c


@pytest.fixture(scope="module")
def names(spark, sf):
    found = {r["strategy"] for r in statistics.all_strategies(spark, sf).select("strategy").distinct().collect()}
    assert len(found) > 8
    return found


@pytest.mark.parametrize("name", PER_STRATEGY)
def test_every_supplier_is_a_strategy(spark, sf, db, names, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.collect()
    assert {r["strategy"] for r in rows} == names
    found = db.execute(catalog.ORACLES[name])
    at = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == want


def test_driver_side_statistics_take_every_supplier(spark, sf, names):
    pairs = catalog.QUERIES["effective_breadth_pairs_all"](spark, sf).collect()
    assert {r["a"] for r in pairs} | {r["b"] for r in pairs} == names
    assert {r["strategy"] for r in catalog.QUERIES["deflated_sharpe"](spark, sf).collect()} == names
    found = {r["measure"]: r["value"] for r in catalog.QUERIES["effective_trials"](spark, sf).collect()}
    assert found["n_raw"] == found["n_instruments"] == len(names)
    assert not math.isnan(catalog.QUERIES["overfitting_probability"](spark, "/root/testdata/sf0.01").first()["pbo"])


def test_metrics_of_every_supplier(spark, sf, db, names):
    df = catalog.QUERIES["metrics_all"](spark, sf)
    columns = sorted(df.columns)
    rows = df.collect()
    assert {r["run"] for r in rows} == names
    found = db.execute(catalog.ORACLES["metrics_all"])
    at = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == want
