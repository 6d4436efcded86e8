"""Reports over the record: strategy cards, published weeks, decay, versions, budgets, target books."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import statistics as st
from .risk import returns

#: What a card asks of a strategy, and the haircut it puts on a backtest.
DECAY_HAIRCUT, LEAST_WEEKS = 0.58, 13


def card(metrics: dict, dsr: float, holdout: dict | None = None, forward_weeks: int = 0, break_even: float | None = None) -> dict:
    """Checks, tier and expectation of a strategy from its metric rows."""
    error = st.sharpe_error(metrics["sharpe"] or 0.0, metrics["n_days"])
    checks = {
        "positive": (metrics["info_ratio"] or 0) > 0,
        "significant": (metrics["sharpe"] or 0) > 2 * error,
        "costs": break_even is not None and break_even >= 2,
        "deflated": dsr >= 0.95,
        "holdout": holdout is not None and (holdout["info_ratio"] or 0) > 0,
        "forward": forward_weeks >= LEAST_WEEKS,
    }
    passed = sum(checks.values())
    tier = "live candidate" if passed == len(checks) else "paper" if checks["positive"] and checks["deflated"] else "research"
    return {"checks": checks, "tier": tier, "sharpe_error": error, "expected_sharpe": (metrics["sharpe"] or 0.0) * (1 - DECAY_HAIRCUT)}


def card_text(name: str, c: dict) -> str:
    lines = [f"# {name}", "", f"Tier: {c['tier']}. Expected Sharpe ratio after decay: {c['expected_sharpe']:.2f} (standard error {c['sharpe_error']:.2f}).", ""]
    return "\n".join([*lines, *(f"- {'pass' if ok else 'fail'}: {k}" for k, ok in c["checks"].items())])


def forward_results(published: DataFrame, panel: DataFrame, bench: DataFrame, horizon: int = 5) -> DataFrame:
    """signal_date, n, realised, benchmark, excess, hit of each published list (signal_date, instrument): mean return from the
    session after the signal over `horizon` sessions, against the benchmark (dt, pos, close)."""
    own = Window.partitionBy("instrument").orderBy("pos")
    moves = panel.select("instrument", F.col("dt").alias("signal_date"), (F.lead("close", 1 + horizon).over(own) / F.lead("close", 1).over(own) - 1).alias("move"))
    day = Window.orderBy("pos")  # one row a date
    base = bench.select(F.col("dt").alias("signal_date"), (F.lead("close", 1 + horizon).over(day) / F.lead("close", 1).over(day) - 1).alias("benchmark"))
    weeks = published.join(moves, ["signal_date", "instrument"]).groupBy("signal_date").agg(F.count("move").alias("n"), F.avg("move").alias("realised"))
    out = weeks.join(F.broadcast(base), "signal_date").withColumn("excess", F.col("realised") - F.col("benchmark"))
    return out.withColumn("hit", F.col("excess") > 0)


def decay(trials: DataFrame, top: int = 20) -> DataFrame:
    """n, discovery, later: mean coefficients of the strongest trials then and since."""
    return trials.where("later_ic_mean is not null").orderBy(F.desc(F.abs("ic_t")), "fingerprint", "name").limit(top).agg(F.count("*").alias("n"), F.avg(F.abs("ic_mean")).alias("discovery"), F.avg(F.col("later_ic_mean") * F.signum("ic_mean")).alias("later"))


def versions(runs: DataFrame) -> DataFrame:
    """version, config_sha, n, first, last."""
    return runs.groupBy("version", "config_sha").agg(F.count("*").alias("n"), F.min("started_at").alias("first"), F.max("started_at").alias("last"))


def search_allocation(trials: DataFrame) -> DataFrame:
    """family, evaluated, share, rewarded: where the search went and what it found (|t| of at least 1)."""
    each = trials.groupBy("family").agg(F.count("*").alias("evaluated"), F.count_if(F.abs("ic_t") >= 1).alias("rewarded"))
    total = each.agg(F.sum("evaluated").alias("all"))  # one row of a row a family
    return each.join(F.broadcast(total)).select("family", "evaluated", (F.col("evaluated") / F.col("all")).alias("share"), "rewarded")


def blocking_gate(counts: dict[str, int]) -> str:
    """The first step of the loop that has produced nothing: evaluated, strong, kept, holdout, forward."""
    return next((k for k in ("evaluated", "strong", "kept", "holdout", "forward") if not counts.get(k)), "none")


def book_digest(weights: dict[str, float]) -> str:
    return hashlib.sha256(",".join(f"{k}:{weights[k]:.8f}" for k in sorted(weights)).encode()).hexdigest()


class RefusedBook(ValueError):
    """A target book outside its limits, or one whose content does not match its digest."""


def write_targets(path: str, day: str, strategy: str, weights: dict[str, float], gross: float = 1.0, net: float = 1.0, name: float = 0.1) -> str:
    """Write a target book with its digest; outside the limits it is refused."""
    total, balance, most = sum(map(abs, weights.values())), sum(weights.values()), max(map(abs, weights.values()), default=0.0)
    if total > gross + 1e-9 or abs(balance) > net + 1e-9 or most > name + 1e-9:
        raise RefusedBook(f"gross {total:.4f}, net {balance:.4f}, largest {most:.4f}")
    digest = book_digest(weights)
    with open(path, "w") as f:
        json.dump({"as_of": day, "strategy": strategy, "weights": weights, "sha256": digest}, f, sort_keys=True)
    return digest


def read_targets(path: str) -> dict:
    with open(path) as f:
        book = json.load(f)
    if book_digest(book["weights"]) != book["sha256"]:
        raise RefusedBook("the digest does not match the weights")
    return book


def equal_weight(panel: DataFrame) -> DataFrame:
    """dt, bench: mean return of all instruments."""
    return returns(panel).groupBy("dt").agg(F.avg("ret").alias("bench"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """name, expr, sign, rationale of a JSON-lines candidate file; lines without an expression go."""
    return spark.read.schema("name string, expr string, sign int, rationale string").json(path).where("expr is not null")
