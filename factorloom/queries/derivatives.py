"""Futures queries over contracts derived from line items: a market is a line number, contracts expire at quarter ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import derivatives as dv
from .base import rounded, sql_round

_CONTRACTS = """WITH b AS (SELECT CAST(l_linenumber AS VARCHAR) AS market, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS vol FROM lineitem GROUP BY 1, 2),
c AS (SELECT market, dt, k, CAST(date_trunc('quarter', dt) + to_months(CAST(3 * (k + 1) AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS expiry, price * (1 + 0.01 * k) AS settle,
  vol * (CASE WHEN (date_diff('day', DATE '1970-01-05', dt) // 7 + k) % 3 = 0 THEN 3.0 ELSE 1.0 END) / (k + 1) AS volume FROM b, (SELECT unnest([0, 1, 2, 3]) AS k)),
p AS (SELECT market, dt, CAST(expiry AS VARCHAR) AS contract, settle, volume, expiry FROM c)"""


def contracts(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    b = t.groupBy(F.col("l_linenumber").cast("string").alias("market"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("dt")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_quantity").alias("vol"))
    c = b.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    week = F.floor(F.datediff("dt", F.lit("1970-01-05").cast("date")) / 7)
    expiry = F.date_sub(F.add_months(F.trunc("dt", "quarter"), 3 * (F.col("k") + 1)), 1)
    volume = F.col("vol") * F.when((week + F.col("k")) % 3 == 0, 3.0).otherwise(1.0) / (F.col("k") + 1)
    df = c.select("market", "dt", expiry.cast("string").alias("contract"), (F.col("price") * (1 + 0.01 * F.col("k"))).alias("settle"), volume.alias("volume"), expiry.alias("expiry"))
    return df.withColumn("open_interest", F.col("volume"))


_ORDERED = """, q AS (SELECT *, row_number() OVER (PARTITION BY market, dt ORDER BY expiry, contract) AS k FROM {rows} WHERE expiry > dt AND settle IS NOT NULL)"""
_CALENDAR = f"""{_CONTRACTS}{_ORDERED.format(rows='p')},
t AS (SELECT market, dt, max(contract) FILTER (WHERE k = 1) AS a, max(contract) FILTER (WHERE k = 2) AS b, max(expiry) FILTER (WHERE k = 1) AS due FROM q GROUP BY 1, 2),
h AS (SELECT market, dt, CASE WHEN b IS NOT NULL AND date_diff('day', dt, due) <= 14 THEN b ELSE a END AS held FROM t),
s AS (SELECT market, dt, held, coalesce(held <> lag(held) OVER (PARTITION BY market ORDER BY dt), false) AS is_roll FROM h)"""


def _schedule(spark, sf_dir):
    c = contracts(spark, sf_dir)
    return c, dv.roll_schedule(c, "calendar", 14)


@query("roll_calendar", f"{_CALENDAR} SELECT * FROM s")
def roll_calendar(spark, sf_dir):
    return _schedule(spark, sf_dir)[1].select("market", "dt", "held", "is_roll")


@query(
    "roll_volume",
    f"""{_CONTRACTS}, g AS (SELECT market, dt, lag(dt) OVER (PARTITION BY market ORDER BY dt) AS seen FROM (SELECT DISTINCT market, dt FROM p)),
x AS (SELECT p.*, z.volume AS liq FROM p JOIN g ON g.market = p.market AND g.dt = p.dt LEFT JOIN p z ON z.market = p.market AND z.contract = p.contract AND z.dt = g.seen){_ORDERED.format(rows='x')},
t AS (SELECT market, dt, max(contract) FILTER (WHERE k = 1) AS a, max(contract) FILTER (WHERE k = 2) AS b, max(liq) FILTER (WHERE k = 1) AS l1, max(liq) FILTER (WHERE k = 2) AS l2, count(liq) AS n FROM q GROUP BY 1, 2),
h AS (SELECT market, dt, CASE WHEN b IS NOT NULL AND n >= 2 AND coalesce(l2, 0) > coalesce(l1, 0) THEN b ELSE a END AS held FROM t)
SELECT market, dt, held, coalesce(held <> lag(held) OVER (PARTITION BY market ORDER BY dt), false) AS is_roll FROM h""",
)
def roll_volume(spark, sf_dir):
    return dv.roll_schedule(contracts(spark, sf_dir), "volume").select("market", "dt", "held", "is_roll")


@query(
    "roll_chained",
    f"""{_CALENDAR}, w AS (SELECT market, dt, contract, settle, lag(settle) OVER (PARTITION BY market, contract ORDER BY dt) AS b FROM p)
SELECT s.market, s.dt, held, {sql_round('CASE WHEN row_number() OVER (PARTITION BY s.market ORDER BY s.dt) = 1 THEN 0 ELSE coalesce(settle / b - 1, 0) END', 6)} AS ret FROM s LEFT JOIN w ON w.market = s.market AND w.dt = s.dt AND w.contract = s.held""",
)
def roll_chained(spark, sf_dir):
    return dv.chained_returns(*_schedule(spark, sf_dir)).withColumn("ret", rounded(F.col("ret"), 6))


_CONT = f"""{_CALENDAR}, o AS (SELECT s.*, lag(held) OVER (PARTITION BY market ORDER BY dt) AS old FROM s),
j AS (SELECT o.market, o.dt, o.is_roll, n.settle, z.settle AS old_settle FROM o LEFT JOIN p n ON n.market = o.market AND n.dt = o.dt AND n.contract = o.held LEFT JOIN p z ON z.market = o.market AND z.dt = o.dt AND z.contract = o.old)"""
_LATER = "(PARTITION BY market ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


@query("roll_continuous_ratio", f"{_CONT} SELECT market, dt, {sql_round(f'settle * exp(coalesce(sum(CASE WHEN is_roll AND old_settle > 0 THEN ln(settle / old_settle) END) OVER {_LATER}, 0))', 3)} AS price FROM j")
def roll_continuous_ratio(spark, sf_dir):
    return dv.continuous(*_schedule(spark, sf_dir)).withColumn("price", rounded(F.col("price"), 3))


@query("roll_continuous_back", f"{_CONT} SELECT market, dt, {sql_round(f'settle + coalesce(sum(CASE WHEN is_roll AND old_settle > 0 THEN settle - old_settle END) OVER {_LATER}, 0)', 3)} AS price FROM j")
def roll_continuous_back(spark, sf_dir):
    return dv.continuous(*_schedule(spark, sf_dir), "back").withColumn("price", rounded(F.col("price"), 3))


_CHAINED = "SELECT s.market, s.dt, is_roll, CASE WHEN row_number() OVER (PARTITION BY s.market ORDER BY s.dt) = 1 THEN 0 ELSE coalesce(settle / b - 1, 0) END AS ret FROM {s} s LEFT JOIN w ON w.market = s.market AND w.dt = s.dt AND w.contract = s.held"
_BEFORE = "w AS (SELECT market, dt, contract, settle, lag(settle) OVER (PARTITION BY market, contract ORDER BY dt) AS b FROM p)"


@query(
    "roll_invariant",
    f"""{_CONT}, {_BEFORE}, ch AS ({_CHAINED.format(s='s')}), we AS (SELECT market, dt, exp(sum(ln(1 + ret)) OVER (PARTITION BY market ORDER BY dt)) AS w FROM ch),
pr AS (SELECT market, dt, settle * exp(coalesce(sum(CASE WHEN is_roll AND old_settle > 0 THEN ln(settle / old_settle) END) OVER {_LATER}, 0)) AS price FROM j)
SELECT market, {sql_round('max(price / w) / min(price / w) - 1', 5)} AS gap FROM pr JOIN we USING (market, dt) GROUP BY market""",
)
def roll_invariant(spark, sf_dir):
    """Zero but for rounding where every contract held has a price at each session."""
    return dv.invariant_gap(*_schedule(spark, sf_dir)).withColumn("gap", rounded(F.col("gap"), 5))


def _rules_sql() -> str:
    """Each roll rule's schedule by the same steps, and the statistics of its chained returns."""
    ctes = [f"{_CONTRACTS}{_ORDERED.format(rows='p')}, {_BEFORE}, gx AS (SELECT market, dt, lag(dt) OVER (PARTITION BY market ORDER BY dt) AS seen FROM (SELECT DISTINCT market, dt FROM p))"]
    ctes.append("lq AS (SELECT q.*, z.volume AS liq FROM q JOIN gx ON gx.market = q.market AND gx.dt = q.dt LEFT JOIN p z ON z.market = q.market AND z.contract = q.contract AND z.dt = gx.seen)")
    ctes.append("tw AS (SELECT market, dt, max(contract) FILTER (WHERE k = 1) AS a, max(contract) FILTER (WHERE k = 2) AS b, max(expiry) FILTER (WHERE k = 1) AS due, max(liq) FILTER (WHERE k = 1) AS l1, max(liq) FILTER (WHERE k = 2) AS l2, count(liq) AS n FROM lq GROUP BY 1, 2)")
    parts = []
    for rule, test in [*((f"calendar_{o}", f"date_diff('day', dt, due) <= {o}") for o in (1, 3, 5, 10)), *((r, "n >= 2 AND coalesce(l2, 0) > coalesce(l1, 0)") for r in ("open_interest", "volume"))]:
        ctes.append(f"h_{rule} AS (SELECT market, dt, CASE WHEN b IS NOT NULL AND {test} THEN b ELSE a END AS held FROM tw)")
        ctes.append(f"s_{rule} AS (SELECT *, coalesce(held <> lag(held) OVER (PARTITION BY market ORDER BY dt), false) AS is_roll FROM h_{rule}), c_{rule} AS ({_CHAINED.format(s=f's_{rule}')})")
        parts.append(f"SELECT market, '{rule}' AS rule, count_if(is_roll) AS n_rolls, {sql_round('avg(ret) * 252', 5)} AS ann_return, {sql_round('stddev_samp(ret) * sqrt(252)', 5)} AS ann_vol, {sql_round('avg(ret) * sqrt(252) / nullif(stddev_samp(ret), 0)', 5)} AS sharpe FROM c_{rule} GROUP BY market")
    return ", ".join(ctes) + " " + " UNION ALL ".join(parts)


@query("roll_sensitivity", _rules_sql())
def roll_sensitivity(spark, sf_dir):
    out = dv.roll_sensitivity(contracts(spark, sf_dir))
    return out.select("market", "rule", "n_rolls", *[rounded(F.col(c), 5).alias(c) for c in ("ann_return", "ann_vol", "sharpe")])


@query(
    "roll_verdict",
    f"SELECT market, {sql_round('max(sharpe) - min(sharpe)', 4)} AS spread, max(sharpe) - min(sharpe) <= 0.5 AS robust FROM ({_rules_sql()}) GROUP BY market",
)
def roll_verdict(spark, sf_dir):
    return dv.roll_verdict(dv.roll_sensitivity(contracts(spark, sf_dir))).withColumn("spread", rounded(F.col("spread"), 4))


@query(
    "contract_costs",
    f"""SELECT o_orderkey, {sql_round('abs(q) * (1.5 + 2.0 / 2 * 50 * 0.25)', 4)} AS trade_cost, {sql_round('2 * abs(q) * (1.5 + 2.0 / 2 * 50 * 0.25)', 4)} AS roll_cost, {sql_round('(1.5 + 2.0 / 2 * 50 * 0.25) / (o_totalprice * 50) * 1e4', 6)} AS cost_bp,
CAST(trunc(1e6 * 0.1 / (0.2 * o_totalprice * 50) * 100) AS BIGINT) AS lots FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 7 - 3 AS q FROM orders WHERE o_totalprice > 0)""",
)
def contract_costs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 0")
    m, tick, fee, spread = F.lit(50.0), F.lit(0.25), F.lit(1.5), F.lit(2.0)
    side, q, price = dv.cost_per_side(m, tick, fee, spread), F.col("o_orderkey") % 7 - 3, F.col("o_totalprice")
    lots = dv.round_lots(dv.vol_target_contracts(F.lit(1e6), F.lit(0.1), F.lit(0.2), price, m) * 100)[0]
    return o.select("o_orderkey", rounded(dv.trade_cost(q, side), 4).alias("trade_cost"), rounded(dv.roll_cost(q, side), 4).alias("roll_cost"), rounded(dv.cost_in_bp(side, price, m), 6).alias("cost_bp"), lots.alias("lots"))


@query("funding_pnl", f"SELECT event_id, {sql_round('-value * 1000 * 0.0001', 6)} AS pnl, {sql_round('value / 1e5 * 24 / 8 * 365', 6)} AS annual FROM events")
def funding_pnl(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", rounded(dv.funding_pnl(F.col("value") * 1000, F.lit(0.0001)), 6).alias("pnl"), rounded(dv.annual_funding(F.col("value") / 1e5), 6).alias("annual"))


@query(
    "margin_book",
    f"""WITH t AS (SELECT sum(abs(l_quantity * l_extendedprice / l_quantity)) AS notional, sum(abs(l_quantity) * 5) AS margin FROM lineitem)
SELECT {sql_round('notional', 2)} AS notional, {sql_round('margin', 2)} AS margin, {sql_round('notional / 1e9', 6)} AS leverage, {sql_round('margin / 1e9', 6)} AS margin_use, notional / 1e9 <= 2 AND margin / 1e9 <= 0.5 AS within_limits FROM t""",
)
def margin_book(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").alias("contracts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.lit(1.0).alias("multiplier"), F.lit(5.0).alias("margin"))
    out = dv.book_totals(p, 1e9, 2.0, 0.5)
    return out.select(*[rounded(F.col(c), k).alias(c) for c, k in (("notional", 2), ("margin", 2), ("leverage", 6), ("margin_use", 6))], "within_limits")


@query(
    "archive_urls",
    """SELECT symbol, month, 'https://data.binance.vision/data/spot/monthly/klines/' || symbol || '/1d/' || symbol || '-1d-' || month || '.zip' AS url, CASE WHEN month >= '2025-01' THEN 'us' ELSE 'ms' END AS unit
FROM (SELECT DISTINCT upper(o_orderstatus) || 'USDT' AS symbol FROM orders), (SELECT unnest(['2024-12', '2025-01']) AS month)""",
)
def archive_urls(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.upper("o_orderstatus"), F.lit("USDT")).alias("symbol")).distinct()
    return dv.archive_urls(s, "spot", "klines", "1d", ["2024-12", "2025-01"]).select("symbol", "month", "url", "unit")


_AUCTIONS = """WITH a AS (SELECT CAST(l_linenumber AS VARCHAR) AS market, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, sum(l_extendedprice) / sum(l_quantity) AS clearing_price, sum(l_quantity) AS volume,
  sum(l_quantity * (1 + l_discount)) AS bids, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS bidders, CASE WHEN min(l_orderkey) % 2 = 0 THEN max(l_extendedprice / l_quantity) END AS secondary FROM lineitem GROUP BY 1, 2)"""


def _z_sql(x: str) -> str:
    return sql_round(f"CASE WHEN count({x}) OVER w >= 10 THEN ({x} - avg({x}) OVER w) / nullif(stddev_samp({x}) OVER w, 0) END", 5)


@query(
    "auction_signals",
    f"""{_AUCTIONS}, f AS (SELECT *, last_value(secondary IGNORE NULLS) OVER (PARTITION BY market ORDER BY dt) AS s FROM a), g AS (SELECT market, dt, bids / volume AS cover, clearing_price / s - 1 AS discount, bidders FROM f)
SELECT market, dt, {sql_round('cover', 6)} AS cover, {sql_round('discount', 6)} AS discount, {_z_sql('cover')} AS cover_z, {_z_sql('bidders')} AS bidders_z, {_z_sql('discount')} AS discount_z FROM g WINDOW w AS (PARTITION BY market ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def auction_signals(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = t.groupBy(F.col("l_linenumber").cast("string").alias("market"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("dt")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("clearing_price"), F.sum("l_quantity").alias("volume"), F.sum(F.col("l_quantity") * (1 + F.col("l_discount"))).alias("bids"),
        F.countDistinct("l_suppkey").cast("double").alias("bidders"), F.when(F.min("l_orderkey") % 2 == 0, F.max(F.col("l_extendedprice") / F.col("l_quantity"))).alias("secondary"),
    )
    out = dv.auction_signals(a, 20)
    return out.select("market", "dt", *[rounded(F.col(c), k).alias(c) for c, k in (("cover", 6), ("discount", 6), ("cover_z", 5), ("bidders_z", 5), ("discount_z", 5))])


@query(
    "reserve_state",
    f"""WITH x AS (SELECT p_partkey, p_retailprice AS c, CAST(DATE '2024-01-01' + CAST(p_partkey % 700 AS INTEGER) AS DATE) AS d FROM part)
SELECT p_partkey, CASE WHEN c > 1096 THEN 'intake' WHEN c > 833 THEN 'partial_intake' WHEN c < 400 THEN 'release' ELSE 'neutral' END AS state, {sql_round('CASE WHEN c > 1096 THEN 0.24 * c WHEN c > 833 THEN c - 833 WHEN c < 400 THEN -100 ELSE 0 END', 4)} AS amount,
CAST(date_diff('day', d, CASE WHEN d <= make_date(year(d), 9, 30) THEN make_date(year(d), 9, 30) ELSE make_date(year(d) + 1, 9, 30) END) AS INTEGER) AS days_left FROM x""",
)
def reserve_state(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    s, d = dv.reserve_state(F.col("p_retailprice")), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int"))
    return p.select("p_partkey", s["state"].alias("state"), rounded(s["amount"], 4).alias("amount"), dv.days_to_surrender(d).alias("days_left"))
