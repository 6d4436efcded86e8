"""Dated futures, perpetuals and auction markets.

Contracts are long rows (market, dt, contract, settle, volume, open_interest, expiry[, first_notice]); markets run side by
side. A roll schedule has no memory, so it is a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _market(name: str = "dt"):
    return Window.partitionBy("market").orderBy(name)


def roll_schedule(contracts: DataFrame, method: str = "calendar", offset_days: int = 5, lag_days: int = 1) -> DataFrame:
    """market, dt, held, next, is_roll, method, offset_days, lag_days.

    Holdable are contracts with a settlement whose deadline (first notice where there is one, else expiry) lies ahead, by
    deadline. `calendar` holds the first, or the second within `offset_days` of the first's deadline; `volume` and
    `open_interest` hold the second where it was larger `lag_days` sessions ago. Dates without a holdable contract have no
    row."""
    deadline = F.coalesce("first_notice", "expiry") if "first_notice" in contracts.columns else F.col("expiry")
    dates = contracts.select("market", "dt").distinct().withColumn("seen", F.lag("dt", lag_days).over(_market()))
    rows = contracts.withColumn("deadline", deadline).join(dates, ["market", "dt"])
    liquid = method if method in ("volume", "open_interest") else None
    if liquid:
        past = contracts.select("market", F.col("dt").alias("seen"), "contract", F.col(liquid).alias("liquidity"))
        rows = rows.join(past, ["market", "seen", "contract"], "left")
    else:
        rows = rows.withColumn("liquidity", F.lit(None).cast("double"))
    ahead = rows.where((F.col("deadline") > F.col("dt")) & F.col("settle").isNotNull())
    ordered = ahead.withColumn("k", F.row_number().over(Window.partitionBy("market", "dt").orderBy("deadline", "contract")))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    two = ordered.groupBy("market", "dt").agg(
        pick(1, "contract").alias("front"), pick(2, "contract").alias("second"), pick(1, "deadline").alias("due"), pick(1, "liquidity").alias("l1"), pick(2, "liquidity").alias("l2"), F.count("liquidity").alias("known")
    )
    if liquid:
        move = F.col("second").isNotNull() & (F.col("known") >= 2) & (F.coalesce("l2", F.lit(0.0)) > F.coalesce("l1", F.lit(0.0)))
    else:
        move = F.col("second").isNotNull() & (F.datediff("due", "dt") <= offset_days)
    held = two.select("market", "dt", F.when(move, F.col("second")).otherwise(F.col("front")).alias("held"), F.when(move, F.lit(None)).otherwise(F.col("second")).alias("next"))
    before = F.lag("held").over(_market())
    return held.select("market", "dt", "held", "next", F.coalesce(F.col("held") != before, F.lit(False)).alias("is_roll"), F.lit(method).alias("method"), F.lit(offset_days).alias("offset_days"), F.lit(lag_days).alias("lag_days"))


def chained_returns(contracts: DataFrame, schedule: DataFrame) -> DataFrame:
    """market, dt, held, ret: the held contract's own move since the session before, so a roll adds no gap; 0 first."""
    prices = contracts.select("market", "dt", F.col("contract").alias("held"), "settle")
    before = prices.withColumn("before", F.lag("settle").over(Window.partitionBy("market", "held").orderBy("dt")))
    first = F.row_number().over(_market()) == 1
    return schedule.join(before, ["market", "dt", "held"], "left").select("market", "dt", "held", F.when(first, 0.0).otherwise(F.coalesce(F.try_divide("settle", F.when(F.col("before") != 0, F.col("before"))) - 1, F.lit(0.0))).alias("ret"))


def continuous(contracts: DataFrame, schedule: DataFrame, adjust: str = "ratio") -> DataFrame:
    """market, dt, price. `ratio` multiplies earlier prices by new over old at each roll, `back` adds new minus old,
    `back_literal` subtracts it, `none` leaves the gaps."""
    p = contracts.select("market", "dt", "contract", "settle")
    held = schedule.withColumn("old", F.lag("held").over(_market())).join(p.withColumnRenamed("contract", "held"), ["market", "dt", "held"], "left")
    held = held.join(p.select("market", "dt", F.col("contract").alias("old"), F.col("settle").alias("old_settle")), ["market", "dt", "old"], "left")
    at_roll = F.col("is_roll") & (F.col("old_settle") > 0) & (F.col("settle") > 0)
    later = _market().rowsBetween(1, Window.unboundedFollowing)
    factor = F.exp(F.coalesce(F.sum(F.when(at_roll, F.ln(F.col("settle") / F.col("old_settle")))).over(later), F.lit(0.0)))
    shift = F.coalesce(F.sum(F.when(at_roll, F.col("settle") - F.col("old_settle"))).over(later), F.lit(0.0))
    price = {"none": F.col("settle"), "ratio": F.col("settle") * factor, "back": F.col("settle") + shift, "back_literal": F.col("settle") - shift}[adjust]
    return held.select("market", "dt", price.alias("price"))


def invariant_gap(contracts: DataFrame, schedule: DataFrame) -> DataFrame:
    """market, gap: how far the ratio-adjusted series over chained wealth is from a constant."""
    wealth = chained_returns(contracts, schedule).withColumn("w", F.exp(F.sum(F.log1p("ret")).over(_market().rowsBetween(Window.unboundedPreceding, 0))))
    k = continuous(contracts, schedule).join(wealth, ["market", "dt"]).withColumn("k", F.col("price") / F.col("w"))
    return k.groupBy("market").agg((F.max("k") / F.min("k") - 1).alias("gap"))


def roll_sensitivity(contracts: DataFrame, offsets: tuple[int, ...] = (1, 3, 5, 10), periods: float = 252.0) -> DataFrame:
    """market, rule, n_rolls, ann_return, ann_vol, sharpe of each roll rule."""
    out = None
    for method, offset in [*(("calendar", o) for o in offsets), ("open_interest", 0), ("volume", 0)]:
        schedule = roll_schedule(contracts, method, offset)
        r = chained_returns(contracts, schedule).join(schedule.select("market", "dt", "is_roll"), ["market", "dt"])
        s = F.stddev_samp("ret")
        part = r.groupBy("market").agg(
            F.lit(f"{method}_{offset}" if method == "calendar" else method).alias("rule"), F.count_if("is_roll").alias("n_rolls"), (F.avg("ret") * periods).alias("ann_return"), (s * periods**0.5).alias("ann_vol"), F.try_divide(F.avg("ret") * periods**0.5, F.when(s > 0, s)).alias("sharpe")
        )
        out = part if out is None else out.unionByName(part)
    return out


def roll_verdict(sensitivity: DataFrame, most: float = 0.5) -> DataFrame:
    return sensitivity.groupBy("market").agg((F.max("sharpe") - F.min("sharpe")).alias("spread")).withColumn("robust", F.col("spread") <= most)


# Costs: specs have multiplier, tick, fee (a contract and side) and spread_ticks ------------------------------------------


def tick_value(multiplier: Column, tick: Column) -> Column:
    return multiplier * tick


def cost_per_side(multiplier: Column, tick: Column, fee: Column, spread_ticks: Column) -> Column:
    """Fee and half the spread of one contract."""
    return fee + spread_ticks / 2 * multiplier * tick


def cost_in_bp(cost: Column, price: Column, multiplier: Column) -> Column:
    return F.try_divide(cost, F.when(price * multiplier != 0, F.abs(price * multiplier))) * 1e4


def trade_cost(contracts: Column, per_side: Column) -> Column:
    return F.abs(contracts) * per_side


def roll_cost(contracts: Column, per_side: Column) -> Column:
    """A roll trades both sides."""
    return 2 * F.abs(contracts) * per_side


def funding_pnl(position: Column, rate: Column) -> Column:
    """A long pays a positive rate."""
    return -position * rate


def annual_funding(rate: Column, hours: float = 8.0) -> Column:
    return rate * (24 / hours) * 365


def vol_target_contracts(capital: Column, target: Column, vol: Column, price: Column, multiplier: Column) -> Column:
    """Contracts, not yet whole, whose annual risk is `target` of the capital."""
    return F.try_divide(capital * target, F.when(vol * price * multiplier != 0, vol * F.abs(price) * multiplier))


def round_lots(contracts: Column) -> tuple[Column, Column]:
    """(whole contracts toward zero, what was cut off)."""
    whole = contracts.cast("bigint")
    return whole, contracts - whole


def book_totals(positions: DataFrame, capital: float, max_leverage: float, max_margin: float) -> DataFrame:
    """notional, margin, leverage, margin_use and whether both limits hold: positions (contracts, price, multiplier, margin)."""
    money = F.abs(F.col("contracts") * F.col("price") * F.col("multiplier"))
    t = positions.agg(F.coalesce(F.sum(money), F.lit(0.0)).alias("notional"), F.coalesce(F.sum(F.abs("contracts") * F.col("margin")), F.lit(0.0)).alias("margin"))
    t = t.withColumn("leverage", F.col("notional") / capital).withColumn("margin_use", F.col("margin") / capital)
    return t.withColumn("within_limits", (F.col("leverage") <= max_leverage) & (F.col("margin_use") <= max_margin))


# Exchange archives -----------------------------------------------------------------------------------------------------


def timestamp_unit(market: Column, day: Column) -> Column:
    """Spot archives count microseconds from 2025-01-01, all else milliseconds."""
    return F.when((market == "spot") & (day >= F.lit("2025-01-01").cast("date")), "us").otherwise("ms")


def archive_time(value: Column, unit: Column) -> Column:
    return F.when(unit == "us", F.timestamp_micros(value)).otherwise(F.timestamp_millis(value))


def archive_urls(symbols: DataFrame, market: str, kind: str, interval: str, months: list[str]) -> DataFrame:
    """symbol, month, url, checksum_url, unit of monthly public archives: symbols (symbol)."""
    base = "https://data.binance.vision/data"
    root = {"spot": "spot", "um": "futures/um", "cm": "futures/cm"}[market]
    df = symbols.select("symbol", F.explode(F.array(*map(F.lit, months))).alias("month"))
    part, tail = (F.lit(f"/{interval}/"), F.lit(f"-{interval}-")) if kind == "klines" else (F.lit("/"), F.lit(f"-{kind}-"))
    url = F.concat(F.lit(f"{base}/{root}/monthly/{kind}/"), F.col("symbol"), part, F.col("symbol"), tail, F.col("month"), F.lit(".zip"))
    return df.select("symbol", "month", url.alias("url"), F.concat(url, F.lit(".CHECKSUM")).alias("checksum_url"), timestamp_unit(F.lit(market), F.to_date(F.concat("month", F.lit("-01")))).alias("unit"))


def vanished(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Symbols of an archive that are not listed any more."""
    return archive.select("symbol").distinct().join(live.select("symbol").distinct(), "symbol", "left_anti")


# Carbon auctions -------------------------------------------------------------------------------------------------------

#: Column names under which auction reports carry a field, best first.
AUCTION_COLUMNS = {
    "dt": ("date", "auction date"),
    "clearing_price": ("auction price", "clearing price", "price"),
    "volume": ("auction volume", "volume"),
    "bids": ("total amount of bids", "total bids", "bids"),
    "bidders": ("number of bidders", "bidders"),
}


def parse_auctions(raw: DataFrame) -> DataFrame:
    """dt, clearing_price, volume, bids, bidders; a field without a column raises, cells that do not parse are NULL."""
    have = {c.strip().lower(): c for c in raw.columns}
    chosen = {}
    for field, names in AUCTION_COLUMNS.items():
        hit = next((have[n] for n in names if n in have), None) or next((c for n in names for k, c in have.items() if n in k), None)
        if hit is None:
            raise ValueError(f"no column for {field}; there are {', '.join(raw.columns)}")
        chosen[field] = hit
    cell = lambda f: F.col(f"`{chosen[f]}`")
    return raw.select(F.to_date(cell("dt").try_cast("timestamp")).alias("dt"), *[cell(f).try_cast("double").alias(f) for f in list(AUCTION_COLUMNS)[1:]]).where("dt is not null")


def rolling_z(x: Column, window: int, by: str = "market") -> Column:
    over = Window.partitionBy(by).orderBy("dt").rowsBetween(-(window - 1), 0)
    s = F.stddev_samp(x).over(over)
    return F.when(F.count(x).over(over) >= max(5, window // 2), F.try_divide(x - F.avg(x).over(over), F.when(s > 0, s)))


def auction_signals(auctions: DataFrame, window: int = 60) -> DataFrame:
    """market, dt, cover, discount and the z-scores of cover, bidders and discount. `secondary` is carried forward over
    auctions."""
    filled = F.last("secondary", ignorenulls=True).over(_market().rowsBetween(Window.unboundedPreceding, 0))
    df = auctions.withColumn("cover", F.try_divide("bids", F.when(F.col("volume") > 0, F.col("volume")))).withColumn("discount", F.try_divide("clearing_price", F.when(filled > 0, filled)) - 1)
    return df.select("market", "dt", "cover", "discount", rolling_z(F.col("cover"), window).alias("cover_z"), rolling_z(F.col("bidders"), window).alias("bidders_z"), rolling_z(F.col("discount"), window).alias("discount_z"))


def reserve_state(circulation: Column) -> Column:
    """Thresholds of the market stability reserve in million allowances; amount taken in or given out."""
    return F.struct(
        F.when(circulation > 1096, "intake").when(circulation > 833, "partial_intake").when(circulation < 400, "release").otherwise("neutral").alias("state"),
        F.when(circulation > 1096, 0.24 * circulation).when(circulation > 833, circulation - 833).when(circulation < 400, F.lit(-100.0)).otherwise(F.lit(0.0)).alias("amount"),
    )


def days_to_surrender(day: Column, month: int = 9, dom: int = 30) -> Column:
    this = F.make_date(F.year(day), F.lit(month), F.lit(dom))
    following = F.make_date(F.year(day) + 1, F.lit(month), F.lit(dom))
    return F.datediff(F.when(day <= this, this).otherwise(following), day)


def policy_as_of(releases: DataFrame, day: Column) -> DataFrame:
    """series, period, value released last by `day`, by the latest period."""
    known = releases.where(F.col("released") <= day)
    return known.groupBy("series").agg(F.max_by(F.struct("period", "value"), F.struct("period", "released")).alias("r")).select("series", "r.*")


AUCTION_IDEAS = (
    ("cover", "a high cover ratio precedes gains"),
    ("bidders", "wide participation precedes gains"),
    ("discount", "a clearing price under the secondary market precedes reversal"),
    ("reserve", "intake of the reserve tightens supply"),
    ("surrender", "demand rises before the surrender deadline"),
)
