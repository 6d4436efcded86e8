"""Ledger queries: orders stand for trials (run: year, stage, fingerprint: part of the key, status, family, scores)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import records as rec
from .base import rounded, sql_round

_TRIALS = """WITH t AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS run_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 'gp_1' ELSE 'discover' END AS stage, 'f' || CAST(o_orderkey AS VARCHAR) AS name,
  o_orderstatus AS source, o_orderpriority AS family, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS fingerprint, 'e' || CAST(o_orderkey % 97 AS VARCHAR) AS expr,
  CASE WHEN o_orderkey % 10 = 0 THEN 'active' WHEN o_orderkey % 10 = 1 THEN 'probation' ELSE 'rejected' END AS status, 'r' || CAST(o_orderkey % 5 AS VARCHAR) || '=1; x' AS reason,
  o_totalprice / 50000 - 5 AS ic_t, o_totalprice / 1e7 AS ic_mean, o_totalprice / 6e5 AS dsr, o_totalprice / 2e7 AS later_ic_mean FROM orders)"""
_ID = "coalesce(nullif(fingerprint, ''), expr)"


def trials(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return o.select(
        F.year("o_orderdate").cast("string").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(k % 3 == 0, "gp_1").otherwise("discover").alias("stage"), F.concat(F.lit("f"), k.cast("string")).alias("name"),
        F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("family"), F.when(k % 11 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("fingerprint"), F.concat(F.lit("e"), (k % 97).cast("string")).alias("expr"),
        F.when(k % 10 == 0, "active").when(k % 10 == 1, "probation").otherwise("rejected").alias("status"), F.concat(F.lit("r"), (k % 5).cast("string"), F.lit("=1; x")).alias("reason"),
        (price / 50000 - 5).alias("ic_t"), (price / 1e7).alias("ic_mean"), (price / 6e5).alias("dsr"), (price / 2e7).alias("later_ic_mean"),
    )


@query("trial_counts", f"{_TRIALS} SELECT run_id, status, count(*) AS n FROM t GROUP BY 1, 2")
def trial_counts(spark, sf_dir):
    return rec.status_counts(trials(spark, sf_dir))


@query("distinct_formulas", f"{_TRIALS} SELECT count(DISTINCT {_ID}) AS n_trials FROM t WHERE starts_with(stage, 'gp')")
def distinct_formulas(spark, sf_dir):
    return rec.trial_count(trials(spark, sf_dir), "gp")


@query("run_summary", f"{_TRIALS} SELECT run_id, count(*) AS n, count(DISTINCT {_ID}) AS n_distinct, CAST(min(created_at) AS DATE) AS first, CAST(max(created_at) AS DATE) AS last FROM t GROUP BY 1")
def run_summary(spark, sf_dir):
    return rec.run_summary(trials(spark, sf_dir)).withColumns({c: F.to_date(c) for c in ("first", "last")})


@query(
    "treadmill",
    f"""{_TRIALS}, f AS (SELECT {_ID} AS f, CAST(min(created_at) AS DATE) AS dt FROM t GROUP BY 1), d AS (SELECT dt, count(*) AS new FROM f GROUP BY 1),
g AS (SELECT dt, CAST(sum(new) OVER (ORDER BY dt) AS BIGINT) AS trials, row_number() OVER (ORDER BY dt) - 1 AS k, count(*) OVER () AS n FROM d) SELECT dt, trials FROM g WHERE k % greatest(CAST(ceil(n / 60.0) AS BIGINT), 1) = 0 OR k = n - 1""",
)
def treadmill(spark, sf_dir):
    return rec.treadmill(trials(spark, sf_dir))


@query(
    "family_diag",
    f"""{_TRIALS} SELECT family, count(*) AS n, count_if(abs(ic_t) >= 3) AS n_strong, count_if(status IN ('active', 'probation')) AS kept, {sql_round('avg(ic_mean)', 6)} AS ic_mean, {sql_round('avg(later_ic_mean) FILTER (WHERE abs(ic_t) >= 3)', 6)} AS later_ic_mean FROM t GROUP BY 1""",
)
def family_diag(spark, sf_dir):
    return rec.family_diagnostics(trials(spark, sf_dir)).withColumns({c: rounded(F.col(c), 6) for c in ("ic_mean", "later_ic_mean")})


@query("family_cap", f"{_TRIALS} SELECT family, name, {sql_round('ic_t', 6)} AS ic_t FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY abs(ic_t) DESC, fingerprint, name) AS k FROM t) WHERE k <= 5")
def family_cap(spark, sf_dir):
    return rec.family_cap(trials(spark, sf_dir).withColumn("fingerprint", F.concat_ws(" ", "fingerprint", "name")), 5).select("family", "name", rounded(F.col("ic_t"), 6).alias("ic_t"))


@query("journal", f"{_TRIALS} SELECT source, count(*) AS evaluated, count_if(status = 'probation') AS probation, count_if(status = 'active') AS active FROM t GROUP BY 1")
def journal(spark, sf_dir):
    return rec.journal(trials(spark, sf_dir))


@query("topk_trials", f"{_TRIALS} SELECT name, {sql_round('ic_t', 6)} AS ic_t FROM t WHERE status = 'active' AND dsr >= 0.2 ORDER BY t.ic_t DESC NULLS LAST, fingerprint, name LIMIT 20 OFFSET 10")
def topk_trials(spark, sf_dir):
    return rec.select_trials(trials(spark, sf_dir), status="active", min_dsr=0.2, limit=20, offset=10).select("name", rounded(F.col("ic_t"), 6).alias("ic_t"))


@query(
    "search_memory",
    f"""{_TRIALS}, b AS (SELECT family, trim(substr(split_part(split_part(reason, ';', 1), '=', 1), 1, 60)) AS why, count(*) AS c FROM t WHERE status = 'rejected' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY c DESC, why) AS k FROM b), r AS (SELECT family, string_agg(why, ',' ORDER BY k) AS reasons FROM k WHERE k <= 3 GROUP BY 1)
SELECT t.family, count_if(status <> 'rejected') AS good, count_if(status = 'rejected') AS bad, {sql_round("avg(later_ic_mean) FILTER (WHERE status <> 'rejected')", 6)} AS later_ic_mean, any_value(reasons) AS reasons FROM t JOIN r ON r.family = t.family GROUP BY 1""",
)
def search_memory(spark, sf_dir):
    out = rec.search_memory(trials(spark, sf_dir))
    return out.select("family", "good", "bad", rounded(F.col("later_ic_mean"), 6).alias("later_ic_mean"), F.array_join("reasons", ",").alias("reasons"))


@query(
    "reconcile",
    "SELECT 'only_first' AS side, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) UNION ALL SELECT DISTINCT 'only_second', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)",
)
def reconcile(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"))
    return rec.reconcile(c, spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key")), ["key"])


@query(
    "merge_duplicates",
    f"{_TRIALS}, l AS (SELECT name, fingerprint, status, created_at AS added_on, row_number() OVER (PARTITION BY fingerprint ORDER BY created_at, name) AS k FROM t WHERE status <> 'rejected') SELECT name, fingerprint, CASE WHEN k > 1 THEN 'retired' ELSE status END AS status FROM l",
)
def merge_duplicates(spark, sf_dir):
    t = trials(spark, sf_dir).where("status <> 'rejected'").select("name", "fingerprint", "status", F.col("created_at").alias("added_on"))
    return rec.merge_duplicates(t).select("name", "fingerprint", "status")


@query("formula_search")
def formula_search(spark, sf_dir):
    """Random candidates through the static gates, as trial rows; no SQL: a seeded grammar."""
    import random

    from ..plans import formula as fm

    rng, zoo, seen, out = random.Random(7), fm.Zoo(fm.ZOO), set(), []
    for i in range(120):
        f = fm.random_formula(rng)
        why = rec.screen(f, zoo, seen)
        ok = fm.is_valid(f)[0]
        out.append((f"rand_{i}", f, fm.fingerprint(f) if ok else None, fm.family(f), "rejected" if why else "candidate", why))
    return spark.createDataFrame(out, "name string, expr string, fingerprint string, family string, status string, reason string")


@query("discover")
def discover(spark, sf_dir):
    """The whole search over the quarterly part panel: candidates, gates, coefficients, statuses."""
    from ..plans.discover import discover as run
    from .base import dense

    return run(dense(spark, sf_dir, "part_quarter"))


@query(
    "target_hash",
    """WITH w AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS k, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS w FROM orders WHERE o_totalprice > 0)
SELECT o_custkey, sha256(string_agg(k || ':' || format('{:.8f}', w), ',' ORDER BY k)) AS sha, sum(abs(w)) <= 1 + 1e-9 AND abs(sum(w)) <= 1 + 1e-9 AND max(abs(w)) <= 0.5 + 1e-9 AS within FROM w GROUP BY 1""",
)
def target_hash(spark, sf_dir):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 0")
    w = o.select("o_custkey", F.col("o_orderkey").cast("string").alias("k"), (F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))).alias("w"))
    books = w.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("weights"))
    return books.select("o_custkey", rec.content_hash(F.col("weights")).alias("sha"), rec.book_limits(F.col("weights"), name=0.5).alias("within"))
