"""The factor library as tables: lifecycles over rechecks, identity, upserts and synchronised stores.

A member is a row (name, expr, sign, source, status, fingerprint, family, added_on, ...). A lifecycle has no loop: what a
recheck does depends on the one before and on whether an earlier one has retired the member, which windows express.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship

OPEN = ("probation", "active")


def lifecycle(checks: DataFrame, min_t: float = 1.0, promote_t: float = 2.0, least: int = 21) -> DataFrame:
    """name, k, t, strikes, passes, status after each recheck (name, k in order, n, t signed[, status before the first]).

    A check is weak where t is below `min_t`, missing, or of fewer than `least` observations; two in a row retire for good.
    Two in a row of at least `promote_t` make probation active. Of several checks of one (name, k), one window, the first by
    t counts: the same evidence is never counted twice."""
    own = Window.partitionBy("name").orderBy("k")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("status") if "status" in checks.columns else F.lit("probation")
    one = checks.withColumn("__start", start).groupBy("name", "k").agg(F.min(F.struct(F.col("t").isNull(), "t", "n", "__start")).alias("c")).select("name", "k", "c.t", "c.n", F.col("c.__start").alias("start"))
    seen = F.col("n") >= least
    rows = one.withColumn("weak", ~F.coalesce(seen & (F.col("t") >= min_t), F.lit(False))).withColumn("strong", F.coalesce(seen & (F.col("t") >= promote_t), F.lit(False)))
    rows = rows.withColumn("start", F.first("start").over(upto)).withColumn("row", F.row_number().over(own))
    rows = rows.withColumn("second", F.col("weak") & F.coalesce(F.lag("weak").over(own), F.lit(False)))
    gone = F.col("start") == "retired"
    rows = rows.withColumn("retired", gone | F.coalesce(F.max("second").over(upto), F.lit(False))).withColumn("frozen", gone | F.coalesce(F.max("second").over(before), F.lit(False)))
    streak = F.col("row") - F.coalesce(F.max(F.when(~F.col("strong"), F.col("row"))).over(upto), F.lit(0))
    rows = rows.withColumn("passes", F.when(F.col("retired"), 0).otherwise(streak))
    active = (F.col("start") == "active") | F.coalesce(F.max(F.col("passes") >= 2).over(upto), F.lit(False))
    strikes = F.when(gone, 0).when(F.col("frozen") | F.col("second"), 2).otherwise(F.col("weak").cast("int"))
    status = F.when(F.col("retired"), "retired").when(active & F.col("start").isin(*OPEN), "active").otherwise(F.col("start"))
    return rows.select("name", "k", "t", strikes.alias("strikes"), F.col("passes").cast("int").alias("passes"), status.alias("status"))


def identity(members: DataFrame) -> DataFrame:
    """Members with an empty fingerprint replaced by their expression's."""
    from ..plans import formula as fm

    ship(members.sparkSession)

    @F.pandas_udf("string")
    def of(expr: pd.Series) -> pd.Series:
        return expr.map(lambda e: fm.fingerprint(e) if e and fm.is_valid(e)[0] else "")

    empty = F.coalesce("fingerprint", F.lit("")) == ""
    return members.withColumn("fingerprint", F.when(empty, of("expr")).otherwise(F.col("fingerprint")))


def state_digest(members: DataFrame) -> DataFrame:
    """digest: one sha1 over the members' lifecycle in the order of their names, a line 'name|status|passes|strikes|fingerprint'
    each (fixed format). A library is a few thousand rows; its lines meet in one row."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    line = F.struct("name", F.concat_ws("|", part("name"), part("status"), number("passes"), number("strikes"), part("fingerprint")).alias("line"))
    return members.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").cast("binary")).alias("digest"))


def find(members: DataFrame, prints: DataFrame) -> DataFrame:
    """fingerprint, name: the earliest member (by added_on, then name) of each wanted fingerprint."""
    first = F.min_by("name", F.struct("added_on", "name"))
    return members.join(prints.select("fingerprint").distinct(), "fingerprint").groupBy("fingerprint").agg(first.alias("name"))


def upsert(library: DataFrame, rows: DataFrame) -> DataFrame:
    """The library with `rows` (same columns, and `updated_at`) taken over: by name the newest row's fields, the first row's
    date, and a fingerprint or family that a newer row lacks is kept."""
    every = library.unionByName(rows, allowMissingColumns=True)
    newest = Window.partitionBy("name").orderBy(F.desc_nulls_last("updated_at")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = {c: F.first(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(newest) for c in ("fingerprint", "family") if c in every.columns}
    top = F.row_number().over(Window.partitionBy("name").orderBy(F.desc_nulls_last("updated_at")))
    return every.withColumns(kept).withColumn("added_on", F.min("added_on").over(Window.partitionBy("name"))).withColumn("__k", top).where("__k = 1").drop("__k")


def sync(store: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, action: what makes a store equal to `rows`: insert, update (a field differs), delete or keep. One row a key."""
    digest = lambda df, name: df.dropDuplicates([key]).select(key, F.xxhash64(*fields).alias(name))
    both = digest(store, "__old").join(digest(rows, "__new"), key, "full")
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(F.col("__old") != F.col("__new"), "update").otherwise("keep")
    return both.select(key, action.alias("action"))


def applied(store: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The store after its synchronisation with `rows`: unchanged rows as the store has them, the rest from `rows`."""
    plan = sync(store, rows, key, fields)
    same = store.dropDuplicates([key]).join(plan.where("action = 'keep'").select(key), key, "left_semi")
    new = rows.dropDuplicates([key]).join(plan.where("action in ('insert', 'update')").select(key), key, "left_semi")
    return same.unionByName(new.select(*store.columns))


def latest_books(forward: DataFrame, execution: DataFrame) -> DataFrame:
    """Published books (signal_date, strategy, published_at) with execution_date, the next session, and clean: whether they were
    published before the day of that session, where there is one. execution: (signal_date, trade_date)."""
    joined = forward.join(execution.select("signal_date", F.col("trade_date").alias("execution_date")), "signal_date", "left")
    return joined.withColumn("clean", F.coalesce(F.to_date("published_at") < F.col("execution_date"), F.lit(False)))
