"""What grows with the names of a panel: pairs, cross-sections and books stay right beyond one task or one batch."""

import datetime
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom import catalog
from factorloom.operators import books, risk
from factorloom.operators import statistics as st


def test_pairs_of_more_strategies_than_a_tile_holds(spark):
    """Tiles and their blocks meet in every pair once; before, more than 2,000 strategies were refused."""
    rng = np.random.default_rng(3)
    n, t = 2_100, 24
    x = rng.normal(size=(n, t)) + rng.normal(size=t)
    x[rng.random((n, t)) < 0.2] = np.nan
    x[7, :] = np.where(np.arange(t) % 2, 1.0, np.nan)  # flat: left out
    x[8, :20] = 1.5  # flat over the periods that it shares with strategy 9
    x[8, 20:], x[9, :18], x[9, 18:] = [1.0, 2.0, 3.0, 4.0], 0.5 * np.arange(18), np.nan
    i, k = np.nonzero(~np.isnan(x))
    frame = spark.createDataFrame(pd.DataFrame({"strategy": [f"s{a:04d}" for a in i], "t": k, "ret": x[i, k]}))
    got = st.pair_correlations(frame, least=5).toPandas().set_index(["a", "b"])["corr"]
    assert len(got) == (n - 1) * (n - 2) // 2 and got.index.is_unique and not {"s0007"} & set(got.index.get_level_values(0))
    for a, b in [(0, 1), (3, 600), (511, 512), (700, 2099), (1000, 1001), *rng.integers(10, n, (300, 2)).tolist()]:
        a, b = min(a, b), max(a, b)
        both = ~np.isnan(x[a]) & ~np.isnan(x[b])
        if a < b:
            assert got[f"s{a:04d}", f"s{b:04d}"] == pytest.approx(np.corrcoef(x[a, both], x[b, both])[0, 1], abs=1e-9)
    assert math.isnan(got["s0008", "s0009"])
    one = st.average_correlation(frame, least=5).first()
    assert one["n_raw"] == n - 1 and one["mean_abs_corr"] == pytest.approx(got.abs().sum() / len(got), rel=1e-9)
    m = np.eye(n - 1)
    m[np.triu_indices(n - 1, 1)] = got.sort_index().fillna(0.0).to_numpy()
    rho, independent = st.spectrum(*st.tiles(frame, 5))
    assert rho == pytest.approx(one["mean_abs_corr"], rel=1e-9) and independent == pytest.approx(st.participation(m), rel=1e-9)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_dates_are_neutralised_without_windows(spark):
    """A window over a date buffers it, and a chain of windows as often: before, executors ran out of memory at 6,000 names."""
    rng = np.random.default_rng(4)
    n = 5_000
    x = rng.normal(size=(n, 5))
    x[:, 3] = 2 * x[:, 0] - x[:, 1]  # determined by others
    alpha = np.where(rng.random(n) < 0.1, np.nan, x @ [1.0, -2.0, 0.5, 3.0, 0.1] + rng.normal(size=n))
    df = pd.DataFrame({"instrument": [f"n{i}" for i in range(n)], "alpha": alpha, **{f"z_{s}": x[:, i] for i, s in enumerate(risk.STYLES)}})
    frame = spark.createDataFrame(df, "instrument string, alpha double, " + ", ".join(f"z_{s} double" for s in risk.STYLES))
    frame = frame.select("instrument", F.lit("2020-01-03").cast("date").alias("dt"), F.when(~F.isnan("alpha"), F.col("alpha")).alias("alpha"), *[f"z_{s}" for s in risk.STYLES])
    frame = frame.unionByName(frame.limit(29).withColumn("dt", F.lit("2020-01-10").cast("date")))
    out = risk.neutralise(frame)
    assert "Window" not in plan_of(out) and "Window" not in plan_of(risk.zscored(frame.withColumnsRenamed({f"z_{s}": s for s in risk.STYLES})))
    got = {(r["dt"].day, r["instrument"]): r["alpha"] for r in out.collect()}
    ok = ~np.isnan(alpha)
    design = np.column_stack([np.ones(n), x])
    rest = alpha - design @ np.linalg.lstsq(design[ok], alpha[ok], rcond=None)[0]
    assert [got[3, f"n{i}"] for i in np.flatnonzero(ok)] == pytest.approx(rest[ok].tolist(), abs=1e-9)
    assert got[3, f"n{np.flatnonzero(~ok)[0]}"] is None and sum(k[0] == 10 for k in got) == 29
    few = {r["instrument"]: r["alpha"] for r in frame.where("dt = '2020-01-10'").collect()}
    assert all(got[10, k] == a for k, a in few.items())


def test_weighted_books_take_one_rebalance_at_a_time(spark):
    """More names than one part of a rebalance; before, one worker held every name's history for each book."""
    rng = np.random.default_rng(6)
    n, t = books.PART + 700, 9
    rows = pd.DataFrame({"instrument": np.repeat([f"n{i:05d}" for i in range(n)], t), "pos": np.tile(np.arange(t), n)})
    rows["dt"] = [datetime.date(2021, 1, 1) + datetime.timedelta(days=int(p)) for p in rows["pos"]]
    rows["score"] = np.where(rng.random(n * t) < 0.1, np.nan, rng.integers(0, 500, n * t))
    rows["ret"], rows["adv"], rows["suspended"] = rng.normal(0, 0.05, n * t), rng.uniform(1e3, 1e6, n * t), rng.random(n * t) < 0.1
    rows["specific"] = np.where(rng.random(n * t) < 0.1, np.nan, rng.uniform(0.1, 1, n * t))
    frame = spark.createDataFrame(rows)
    frame = frame.withColumns({"pos": F.col("pos").cast("int"), **{c: F.when(~F.isnan(c), F.col(c)) for c in ("score", "specific")}}).withColumns({"limit_up": F.lit(False), "limit_down": F.lit(False)})
    specs = {"long": books.Book(topk=3_000, max_weight=0.2, risk_scaled=True), "neutral": books.Book(mode="market_neutral", vol_target=0.1)}
    got = books.portfolio(frame, specs, 3, books.Costs()).toPandas()
    known = rows.dropna(subset=["score"])
    day = known.groupby("pos")
    rows["trade"], rows["end"] = rows["pos"].map({0: 1, 3: 4, 6: 7}), rows["pos"].map({0: 4, 3: 7, 6: 8})
    rows["scored"], rows["share"] = rows.groupby("pos")["score"].transform("count"), day["score"].rank(pct=True)
    rows["place"] = known.sort_values(["pos", "score", "instrument"], ascending=[True, False, True]).groupby("pos").cumcount()
    rows["risk"] = known["specific"].clip(lower=day["specific"].transform("median") / 2)
    for name, book in specs.items():
        want = books.book_run(rows, book, books.Costs()).set_index("dt").iloc[1:]
        mine = got[got["run"] == name].set_index("dt").sort_index()
        for c in ("ret", "turnover", "impact", "capped"):
            assert mine[c].tolist() == pytest.approx(want[c].tolist(), abs=1e-12, nan_ok=True)
        assert mine["turnover"].notna().sum() == 3


def test_a_rebalance_comes_from_cells_in_any_order():
    cells = pa.table({
        "i": pa.array([2, 0, 1, 0, 2, 1, 0], pa.int32()), "off": pa.array([0, 2, 1, 0, 1, 0, 1], pa.int32()), "score": [1.0, None, None, 1.0, None, None, None], "specific": [0.1, None, None, 1.0, None, 2.0, None],
        "ret": [None, 0.5, 0.2, None, 0.01, None, None], "adv": [None, None, 5.0, None, 6.0, None, 7.0], "suspended": [None, None, False, None, None, None, False],
    })
    score, place, share, risks, adv, can_trade, later = books.crossing(cells.to_batches(3), 3, 1, True)
    assert place.tolist() == pytest.approx([0, math.nan, 1], nan_ok=True) and share.tolist() == pytest.approx([0.75, math.nan, 0.75], nan_ok=True)
    assert risks.tolist() == pytest.approx([1.0, math.nan, 0.275], nan_ok=True) and adv.tolist() == [7.0, 5.0, 6.0]
    assert can_trade.tolist() == [1.0, 0.0, 0.0] and later.tolist() == pytest.approx([0.5, math.nan, math.nan], nan_ok=True)


def test_delays_are_one_pass(spark):
    """Before, every delay evaluated the values again."""
    rows = [(f, datetime.date(2020, 1, d), f"n{i:02d}", float((i * 7 + d * 3) % 11), float(i)) for f in ("a", "b") for d in range(1, 6) for i in range(31)]
    values = spark.createDataFrame(rows, "factor string, dt date, instrument string, value double, y double")
    out = st.lag_decay(values, (0, 2))
    assert "Union" not in plan_of(out) and {(r["factor"], r["lag"]) for r in out.collect()} == {(f, k) for f in "ab" for k in (0, 2)}


def test_combined_scores_make_their_values_once(spark, sf, monkeypatch):
    from factorloom.queries import crosssection as q

    calls, make = [], q.values
    monkeypatch.setattr(q, "values", lambda *a: calls.append(a) or make(*a))
    assert catalog.QUERIES["combine"](spark, sf).count() and len(calls) == 1
