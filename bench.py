"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import random
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from factorloom import catalog  # noqa: E402
from factorloom.plans import compiler, discover  # noqa: E402
from factorloom.plans import formula as fm  # noqa: E402
from factorloom.queries.base import dense  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CANDIDATES = 40


def formulas(longest: int) -> dict[str, str]:
    rng = random.Random(7)
    out = {name: discover.rescale(f, longest) for name, f, _ in fm.HYPOTHESES}
    while len(out) < CANDIDATES:
        out[f"rand_{len(out)}"] = discover.rescale(fm.random_formula(rng), longest)
    return out


def candidates(spark):
    """Values of 40 formulas over the weekly panel."""
    return compiler.evaluate(dense(spark, SF, "supp_week"), formulas(20), engine="blocks")


def coefficients(spark):
    """Rank and Pearson coefficients and long-short spreads of 40 formulas over the weekly panel."""
    return discover.evaluate(dense(spark, SF, "supp_week"), formulas(20), 5)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    runs = {"candidates_40": candidates, "coefficients_40": coefficients}
    for name in ("rank_ic", "op_corr", "op_rank", "pit_panel_ffill", "exposures_all", "backtest_topk", "roll_continuous_ratio", "treadmill"):
        runs[name] = lambda s, name=name: catalog.QUERIES[name](s, SF)
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name, run in runs.items():
        began = time.time()
        run(spark).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    took["seconds_per_candidate"] = round(took["coefficients_40"] / CANDIDATES, 4)
    total = round(sum(v for k, v in took.items() if k != "seconds_per_candidate"), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
