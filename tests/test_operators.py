import datetime as dt
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import books, crosssection, pit, records, risk
from factorloom.operators import derivatives as dv
from factorloom.operators import statistics as st
from factorloom.sources import ingest, panels

D = dt.date


def returns_frame(spark, m):
    return spark.createDataFrame([(f"s{j}", i, float(m[i, j])) for j in range(m.shape[1]) for i in range(m.shape[0])], "strategy string, t int, ret double")


def test_noise_overfits_half_of_the_time_and_skill_does_not(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 0.01, (160, 12))
    assert 0.25 < st.overfitting_probability(returns_frame(spark, noise), blocks=8) < 0.75
    noise[:, 3] += 0.01
    assert st.overfitting_probability(returns_frame(spark, noise), blocks=8) < 0.05


def test_deflated_probability_falls_with_trials():
    few, many = (st.deflated_probability(500, 0.1, 1.0, 0.0, 3.0, n, 0.002) for n in (2, 2000))
    assert few > many
    assert st.hurdle_sharpe(1000, 0.002, 400) > st.hurdle_sharpe(10, 0.002, 400)
    assert st.deflated_probability(10, 1, 1, 0, 3, 5, 0.1) == 0


def test_effective_counts(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=(200, 1)) + rng.normal(0, 0.05, (200, 6))
    apart = rng.normal(size=(200, 6))
    assert st.effective_trials(returns_frame(spark, one))["n_eff_eigenvalue"] < 1.2
    assert st.effective_trials(returns_frame(spark, apart))["n_eff_eigenvalue"] > 5
    breadth = st.effective_breadth(returns_frame(spark, one))
    assert breadth["independent_bets_neutral"] > breadth["independent_bets"]


def test_newey_west_matches_its_formula(spark):
    rng = np.random.default_rng(2)
    x = np.convolve(rng.normal(0.1, 1, 120), [0.6, 0.4], "valid")
    e = x - x.mean()
    n = len(x)
    lr = e @ e / n + 2 * sum((1 - k / 4) * (e[k:] @ e[:-k]) / n for k in (1, 2, 3))
    got = st.newey_west(returns_frame(spark, x[:, None]), 3).first()["t_nw"]
    assert got == pytest.approx(x.mean() / math.sqrt(lr / n), rel=1e-9)


def test_log_wealth_knows_ruin(spark):
    r = {x["strategy"]: x for x in st.log_wealth(returns_frame(spark, np.array([[0.1, 0.5], [-0.1, -1.0], [0.1, 0.2]]))).collect()}
    assert not r["s0"]["ruined"] and r["s0"]["drag"] > 0
    assert r["s1"]["ruined"] and r["s1"]["log_growth"] is None


def test_two_latest_rules_differ_after_a_restatement(spark):
    rows = spark.createDataFrame(
        [(1, "a", D(2020, 3, 31), D(2020, 5, 1), 10.0), (1, "a", D(2020, 6, 30), D(2020, 8, 1), 20.0), (1, "a", D(2020, 3, 31), D(2020, 9, 1), 11.0), (2, "a", D(2020, 3, 31), D(2020, 5, 1), None)],
        "key long, tag string, period date, filed date, value double",
    )
    day = F.lit("2020-12-31").cast("date")
    assert [r["value"] for r in pit.as_of(rows, day).collect()] == [20.0]
    assert [r["value"] for r in pit.latest_filed(rows, day).collect()] == [11.0]
    dates = spark.createDataFrame([(D(2020, 4, 1),), (D(2020, 5, 1),), (D(2020, 8, 15),), (D(2020, 10, 1),)], "dt date")
    got = {r["dt"]: r["value"] for r in pit.panel(rows, dates).collect()}
    assert got == {D(2020, 5, 1): 10.0, D(2020, 8, 15): 20.0, D(2020, 10, 1): 11.0}


def contracts(spark, days=150):
    rows = []
    start = D(2020, 1, 1)
    for i in range(days):
        day = start + dt.timedelta(days=i)
        for k in range(4):
            expiry = start + dt.timedelta(days=40 * (k + 1))
            if expiry > day:
                price = 100 * 1.001**i * (1 + 0.02 * k)
                rows.append(("m", day, f"c{k}", price, 100.0 / (1 + abs((expiry - day).days - 20)), 1.0, expiry))
    return spark.createDataFrame(rows, "market string, dt date, contract string, settle double, volume double, open_interest double, expiry date")


def test_rolls_leave_no_gap(spark):
    c = contracts(spark)
    s = dv.roll_schedule(c, "calendar", 5)
    assert s.where("is_roll").count() == 3
    r = dv.chained_returns(c, s).orderBy("dt").toPandas()["ret"]
    assert r.iloc[0] == 0 and np.allclose(r.iloc[1:], 0.001)
    assert dv.invariant_gap(c, s).first()["gap"] < 1e-9
    naive = dv.continuous(c, s, "none").orderBy("dt").toPandas()["price"].pct_change()
    assert naive.max() > 0.015
    ratio = dv.continuous(c, s).orderBy("dt").toPandas()["price"].pct_change().iloc[1:]
    assert np.allclose(ratio, 0.001)
    later = dv.roll_schedule(c, "calendar", 1).where("is_roll").agg(F.min("dt")).first()[0]
    assert later >= s.where("is_roll").agg(F.min("dt")).first()[0]


def test_back_adjustment_adds_the_gap(spark):
    c = contracts(spark)
    s = dv.roll_schedule(c, "calendar", 5)
    d = dv.continuous(c, s, "back").orderBy("dt").toPandas()["price"].diff().iloc[1:]
    assert d.max() < 0.3


def test_reserve_thresholds_are_strict(spark):
    got = [tuple(r["s"]) for r in spark.createDataFrame([(x,) for x in (1100.0, 1096.0, 833.0, 400.0, 399.0)], "c double").select(dv.reserve_state(F.col("c")).alias("s")).collect()]
    assert [x[0] for x in got] == ["intake", "partial_intake", "neutral", "neutral", "release"]
    assert got[0][1] == pytest.approx(264) and got[1][1] == pytest.approx(263) and got[4][1] == -100


def test_auction_columns_are_found_or_missed_loudly(spark):
    raw = spark.createDataFrame([("2024-01-02", "70.5", "x", "10", "5")], "`Date` string, `Auction Price` string, `Auction Volume` string, `Total Amount of Bids` string, `Number of Bidders` string")
    assert dv.parse_auctions(raw).first().asDict() == {"dt": D(2024, 1, 2), "clearing_price": 70.5, "volume": None, "bids": 10.0, "bidders": 5.0}
    with pytest.raises(ValueError):
        dv.parse_auctions(raw.drop("Date"))


@pytest.fixture(scope="module")
def book_rows(spark):
    rng = np.random.default_rng(4)
    days, names = 120, 40
    close = 100 * np.cumprod(1 + rng.normal(0.0003, 0.02, (days, names)), axis=0)
    rows = [(f"US{j:02d}", D(2020, 1, 1) + dt.timedelta(days=i), i, float(close[i, j]), 1e6) for j in range(names) for i in range(days)]
    panel = spark.createDataFrame(rows, "instrument string, dt date, pos int, close double, volume double")
    score = panel.select("instrument", "dt", F.lit(None).cast("double").alias("score"))
    return books.inputs(score, panel).persist()


def test_oracle_earns_random_does_not(spark, book_rows):
    rows = books.sanity_runs(book_rows, 5)
    runs = spark.createDataFrame([(k, 1.0) for k in ("oracle", "random", "stale")], "run string, multiple double")
    bench = book_rows.groupBy("dt").agg(F.avg("ret").alias("bench"))
    m = {r["run"]: r for r in books.metrics(books.backtest(rows, runs, 5, 8, 16, books.Costs()), bench).collect()}
    assert m["oracle"]["info_ratio"] > 3 > m["random"]["info_ratio"]
    assert m["stale"]["info_ratio"] < 1


def test_costs_only_lower_returns(spark, book_rows):
    rows = books.sanity_runs(book_rows, 5).where("run = 'random'").drop("run")
    runs = spark.createDataFrame([("a", 0.0), ("b", 3.0)], "run string, multiple double")
    total = {r["run"]: r["s"] for r in books.backtest(rows, runs, 5, 8, 16, books.Costs()).groupBy("run").agg(F.sum("ret").alias("s")).collect()}
    assert total["a"] > total["b"]


def test_neutral_book_is_dollar_neutral():
    score = pd.Series(np.random.default_rng(0).normal(size=60), index=[f"n{i}" for i in range(60)])
    w = books.target_weights(score, books.Book(mode="market_neutral", max_weight=1.0))
    assert w.sum() == pytest.approx(0) and w.abs().sum() == pytest.approx(1)
    assert books.target_weights(score[:19], books.Book()).empty
    held = set(score.sort_values(ascending=False).index[30:40])
    assert len(books.target_weights(score, books.Book(topk=30, band=0.25, max_weight=1.0), held)) == 30


def test_capacity_falls_with_capital(spark, book_rows):
    rows = books.sanity_runs(book_rows, 5).where("run = 'random'").drop("run")
    bench = book_rows.groupBy("dt").agg(F.avg("ret").alias("bench"))
    m = {float(r["run"]): r["excess_ann"] for r in books.capacity(rows, books.Book(topk=8, max_weight=0.5), [1e4, 1e9], 5, books.Costs(), bench).collect()}
    assert m[1e4] > m[1e9] or m[1e4] == pytest.approx(m[1e9], abs=0.2)


def test_neutralised_alpha_has_no_style_left(spark):
    rng = np.random.default_rng(5)
    rows = [("n%d" % i, D(2020, 1, 1), float(rng.normal()), *map(float, rng.normal(size=5))) for i in range(60)]
    df = spark.createDataFrame(rows, "instrument string, dt date, alpha double, " + ", ".join(f"z_{s} double" for s in risk.STYLES))
    out = risk.neutralise(df).join(df.drop("alpha"), ["instrument", "dt"]).toPandas()
    assert all(abs(np.corrcoef(out["alpha"], out[f"z_{s}"])[0, 1]) < 1e-9 for s in risk.STYLES)


def test_appending_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("r", "s", "n", "f"), ("r", "s", "n", None)], "run_id string, stage string, name string, fingerprint string")
    for _ in range(2):
        records.append(spark, f"file://{tmp_path}/trials", rows, records.TRIAL_KEY)
    assert spark.read.parquet(f"file://{tmp_path}/trials").count() == 2


def test_library_lifecycle():
    m = records.Member("a", "$close", 1)
    m.recheck(2.5, 100, "d1")
    m.recheck(2.5, 100, "d2")
    assert m.status == "active"
    m.recheck(float("nan"), 100, "d3")
    m.recheck(-1.0, 10, "d4")
    assert m.status == "active" and m.strikes == 1
    m.recheck(-1.0, 100, "d5")
    assert m.status == "retired" and len(m.history) == 4


def test_gates_are_greedy():
    row = lambda n, t, f: {"name": n, "family": f, "fingerprint": n, "ic_t": t, "sign": 0, "dsr": 0.99 if n == "a" else 0.5}
    out = {r["name"]: (r["status"], r["reason"]) for r in records.greedy_gate([row("a", 5, "x"), row("b", 4, "x"), row("c", 3.5, "y"), row("d", 1, "y")], {("a", "b"): 0.9})}
    assert out["a"][0] == "active" and out["b"] == ("rejected", "correlation=0.90") and out["c"][0] == "probation" and out["d"][1].startswith("t=")


def test_bandit_keeps_a_floor_and_learns():
    b = records.Bandit(seed=1)
    for _ in range(50):
        b.update("trend", True)
        b.update("range", False)
    got = b.allocate(40)
    assert sum(got.values()) == 40 and min(got.values()) >= 1 and got["trend"] > got["range"]


def test_csv_ingest_coerces_and_refuses(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "AAA.csv").write_text(" Date ,Open,High,Low,Close,Volume\n2020-01-01,1,2,1,1.5,10\n2020-01-02,x,2,1,1.5,0\nbad,1,1,1,1,1\n")
    bars = ingest.read_csv(spark, f"file://{folder}")
    assert bars.count() == 2 and {r["instrument"] for r in bars.collect()} == {"aaa"}
    with pytest.raises(ingest.RefusedData):
        ingest.run(spark, f"file://{folder}", f"file://{tmp_path}/out")
    settings = ingest.run(spark, f"file://{folder}", f"file://{tmp_path}/out", force=True)
    assert settings["topk"] == 3
    back = ingest.read_provider(spark, f"file://{tmp_path}/out", start="2020-01-02").collect()
    assert len(back) == 1 and back[0]["vwap"] is None and back[0]["factor"] == 1.0


def test_dense_panel_has_every_cell(spark):
    bars = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("b", D(2020, 1, 3), 2.0)], "instrument string, dt date, close double")
    assert panels.densify(bars).count() == 4


def test_checks_flag_a_constant_factor(spark):
    rng = np.random.default_rng(6)
    rows = [(f, D(2020, 1, 1 + d), str(i), v) for d in range(6) for i in range(40) for f, v in (("good", float(rng.normal())), ("flat", 1.0), ("thin", float(rng.normal()) if i < 3 else None))]
    got = {r["factor"]: r["passed"] for r in crosssection.numerical_checks(spark.createDataFrame(rows, "factor string, dt date, instrument string, value double")).collect()}
    assert got == {"good": True, "flat": False, "thin": False}


def test_covariance_shrinks_toward_the_identity():
    from factorloom.operators.models import folds, shrunk_covariance

    rng = np.random.default_rng(7)
    few, many = (shrunk_covariance(rng.normal(size=(n, 10))) for n in (12, 5000))
    off = lambda m: np.abs(m - np.diag(np.diag(m))).max()
    assert off(few) < 0.35 and off(many) < 0.06 and np.linalg.eigvalsh(few).min() > 0
    assert folds(2010, 2018, 6) == [((2010, 2015), 2016, 2017), ((2011, 2016), 2017, 2018)]


def test_target_books_are_sealed(tmp_path):
    import json

    from factorloom.operators import reports

    path = str(tmp_path / "book.json")
    reports.write_targets(path, "2024-01-05", "s", {"a": 0.05, "b": 0.04})
    assert reports.read_targets(path)["weights"] == {"a": 0.05, "b": 0.04}
    with pytest.raises(reports.RefusedBook):
        reports.write_targets(path, "2024-01-05", "s", {"a": 0.5})
    book = json.loads(open(path).read())
    book["weights"]["a"] = 0.06
    open(path, "w").write(json.dumps(book))
    with pytest.raises(reports.RefusedBook):
        reports.read_targets(path)


def test_cards_and_preregistration():
    from factorloom.operators import reports
    from factorloom.plans.studies import preregister

    good = {"sharpe": 2.0, "info_ratio": 1.0, "n_days": 1000}
    assert reports.card(good, 0.99, good, 20, 3.0)["tier"] == "live candidate"
    assert reports.card(good | {"info_ratio": -1}, 0.2)["tier"] == "research"
    assert "Tier" in reports.card_text("x", reports.card(good, 0.99))
    assert preregister("$close+$open", 1, "why", "me")["content_sha"] == preregister("$open+$close", 1, "why", "me")["content_sha"]


def test_synthetic_panel_is_seeded(spark):
    from factorloom.sources.synthetic import panel

    a, b = (panel(spark, 10, 3, seed=1).agg(F.sum("close")).first()[0] for _ in range(2))
    assert a == b


def test_normal_distribution_as_a_column(spark):
    from statistics import NormalDist

    from factorloom.functions.scalars import normal_cdf

    points = [-4.0, -1.5, -0.1, 0.0, 0.7, 2.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in points], "x double").select(normal_cdf(F.col("x"))).collect()]
    assert np.allclose(got, [NormalDist().cdf(x) for x in points], atol=2e-7)


def test_normal_functions_are_exact_and_inverse(spark):
    from statistics import NormalDist

    from factorloom.functions.scalars import normal_cdf, normal_quantile

    points = [1e-12, 1e-5, 0.02, 0.024, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame([(x,) for x in points] + [(0.0,), (1.0,), (None,)], "p double").select("p", normal_quantile(F.col("p")).alias("z"), normal_cdf(normal_quantile(F.col("p"))).alias("back")).collect()
    for r in rows[: len(points)]:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-9) and r["back"] == pytest.approx(r["p"], rel=1e-9)
    assert all(r["z"] is None for r in rows[len(points) :])
    far = spark.createDataFrame([(x,) for x in (-9.0, -7.5, 7.5, 9.0)], "x double").select(normal_cdf(F.col("x"))).collect()
    assert [r[0] for r in far] == pytest.approx([NormalDist().cdf(x) for x in (-9.0, -7.5, 7.5, 9.0)], rel=1e-6)


def test_bandit_deals_in_proportion_and_remembers(tmp_path):
    path = str(tmp_path / "bandit.json")
    b = records.Bandit(seed=3, path=path)
    for _ in range(6):
        b.update("trend", True, True)
        b.update("range", False, True)
    b.save()
    again = records.Bandit(seed=3, path=path)
    rng = np.random.default_rng(3)
    draw = {k: float(rng.beta(1 + r["wins"], 1 + r["trials"] - r["wins"])) for k, r in again.record.items()}
    got, free = again.allocate(50), 50 - len(draw)
    floors = {k: 1 + int(free * d / sum(draw.values())) for k, d in draw.items()}
    best = max(draw, key=draw.get)
    assert got == floors | {best: floors[best] + 50 - sum(floors.values())}
    assert again.divergence()["range"] == {"trials": 6, "reward_rate": 0.0, "in_sample_rate": 1.0, "gap": 1.0} and again.rates()["liquidity"] is None
    assert records.Bandit().allocate(3) == dict.fromkeys(records.Bandit().record, 1)


def test_lifecycle_by_windows_follows_member_by_member(spark):
    from factorloom.operators import library

    rng = np.random.default_rng(8)
    rows, want = [], {}
    for i in range(60):
        m = records.Member(f"m{i}", "$close", 1, status=["probation", "active", "retired"][i % 3])
        for k in range(8):
            t, n = [float(rng.normal(1.2, 1.2)), None][int(rng.random() < 0.08)], int(rng.integers(5, 90))
            rows.append((m.name, k, t, n, ["probation", "active", "retired"][i % 3]))
            m.recheck(t, n, str(k), short="strike")
            want[m.name, k] = (m.status, m.strikes)
    got = {(r["name"], r["k"]): (r["status"], r["strikes"]) for r in library.lifecycle(spark.createDataFrame(rows, "name string, k int, t double, n int, status string")).collect()}
    assert got == want and len({s for s, _ in got.values()}) == 3


def test_weak_strong_weak_does_not_retire():
    m = records.Member("a", "$close", 1)
    for day, (t, n) in enumerate([(0.2, 60), (3.0, 60), (0.2, 60), (1.5, 60), (2.5, 60), (1.5, 60), (2.5, 60)]):
        m.recheck(t, n, str(day), short="strike")
    assert (m.status, m.strikes, m.passes) == ("probation", 0, 1)
    m.recheck(9.0, 10, "short", short="strike")
    m.recheck(None, 60, "none", short="strike")
    assert m.status == "retired"


def test_library_store_follows_its_rows(spark):
    from factorloom.operators import library

    cols = "name string, expr string, sign int, status string, passes int, strikes int, fingerprint string, family string, added_on date, updated_at int"
    old = spark.createDataFrame([("a", "$close", 1, "probation", 0, 0, "f1", "trend", D(2024, 1, 1), 1), ("b", "$open", 1, "active", 2, 0, "", "range", D(2024, 1, 2), 1), ("c", "$low", -1, "active", 0, 0, "f3", None, D(2024, 1, 3), 1)], cols)
    new = spark.createDataFrame([("a", "$close", -1, "active", 2, 0, "", "", D(2024, 2, 1), 2), ("b", "$open", 1, "active", 2, 0, "", "range", D(2024, 1, 2), 1), ("d", "$high", 1, "probation", 0, 0, "f4", "range", D(2024, 2, 1), 2)], cols)
    merged = {r["name"]: r for r in library.upsert(old, new).collect()}
    assert merged["a"]["status"] == "active" and merged["a"]["fingerprint"] == "f1" and merged["a"]["family"] == "trend" and merged["a"]["added_on"] == D(2024, 1, 1) and len(merged) == 4
    fields = ["expr", "sign", "status", "passes", "strikes"]
    assert {r["name"]: r["action"] for r in library.sync(old, new, "name", fields).collect()} == {"a": "update", "b": "keep", "c": "delete", "d": "insert"}
    after = library.applied(old, new, "name", fields)
    assert {r["name"] for r in after.collect()} == {"a", "b", "d"} and {r["action"] for r in library.sync(after, new, "name", fields).collect()} == {"keep"}
    assert [r["name"] for r in library.find(library.identity(old), spark.createDataFrame([("f3",), ("zz",)], "fingerprint string")).collect()] == ["c"]
    assert library.identity(old).where("name = 'b'").first()["fingerprint"]
    digest = lambda df: library.state_digest(df).first()["digest"]
    assert digest(old) == digest(old.repartition(3)) != digest(new)
    import hashlib

    assert digest(old.where("name <> 'b'")) == hashlib.sha1(b"a|probation|0|0|f1\nc|active|0|0|f3").hexdigest()


def test_cost_and_decay_verdicts(spark):
    curve = spark.createDataFrame([("a", m, v) for m, v in ((0.0, 5.0), (1.0, 3.0), (2.0, 1.0), (3.0, -1.0), (5.0, None))] + [("b", 2.0, 1.0), ("b", 3.0, 0.5)], "run string, multiple double, value double")
    got = {r["run"]: tuple(r)[1:] for r in st.cost_verdict(curve, ["run"]).collect()}
    assert got == {"a": (3.0, 3.0, 2.0, False), "b": (1.0, None, None, True)}
    lags = spark.createDataFrame([("x", 0, 4.0), ("x", 1, 2.0), ("x", 5, 1.0), ("y", 0, 1.0), ("z", 0, -1.0), ("z", 2, float("nan")), ("z", 3, -2.0)], "s string, lag int, v double")
    got = {r["s"]: tuple(r)[1:] for r in st.decay_shape(lags, "lag", "v", ["s"]).collect()}
    assert got == {"x": (4.0, 0.6, 1, 5, True), "z": (-1.0, pytest.approx(1 / 3), None, 3, False)}


def test_bracketed_quantiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(9)
    groups = {"wide": rng.normal(size=5000), "tied": rng.integers(0, 4, 3000).astype(float), "two": np.array([1.0, 2.0]), "one": np.array([7.0]), "none": np.array([])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    at = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    for accuracy in (10_000, 40):  # wide and narrow brackets
        monkeypatch.setattr(crosssection, "SKETCH", accuracy)
        got = {r["g"]: (r["n"], r["q"]) for r in crosssection.exact_quantiles(df, ["g"], "x", at).collect()}
        for g, x in groups.items():
            assert got[g][0] == len(x)
            assert got[g][1] == pytest.approx(np.quantile(x, at).tolist()) if len(x) else not got[g][1]


def test_written_tables_are_removed_with_the_application(spark):
    from factorloom import runtime

    before = list(runtime._made)
    df = runtime.written(spark.range(5), "test")
    path = runtime._made[-1][1].removeprefix("file://")
    assert df.count() == 5 and Path(path).exists()
    runtime._made[:-1] = []
    runtime.clean()
    assert not Path(path).exists()
    runtime._made[:] = before
