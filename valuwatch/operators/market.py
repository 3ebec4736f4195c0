"""Market ETL: instrument universe, price series, proxy model, divergence, weekly grid.

Price series hold at most one row per instrument and traded day, so a window over one instrument
is bounded by the calendar; plain windows are used there and only there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_even


def universe_stats(trades: DataFrame, trading_days: int) -> DataFrame:
    """Per-instrument statistics.  Medians are exact: `median` keeps one counter per distinct
    value, combined map-side, and the columns live on tick or register grids."""
    return trades.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("traded_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        (F.max("db_type") == 3).alias("is144a"), F.median("ff30num").alias("ff30"),
        F.median("bond_maturity").alias("maturity_years"), F.median("bond_amt_outstanding").alias("amount"),
        F.min("pr").alias("min_pr"), F.max("pr").alias("max_pr"), F.median("pr").alias("med_pr"),
    ).withColumn("pct_days", F.col("traded_days") / F.lit(trading_days))


def bidask_median(trades: DataFrame) -> DataFrame:
    """Median quoted spread in percent of price, over rows quoting both sides with ask above bid."""
    spread = F.round((F.col("prc_ask") - F.col("prc_bid")) / F.col("pr") * 100, 6)
    return trades.where("prc_ask > prc_bid and pr is not null").groupBy("instrument_id").agg(
        F.median(spread).alias("bidask_pct"))


def illiquid_universe(stats: DataFrame, alive_from: str, alive_to: str, max_pct: float) -> DataFrame:
    alive = (F.col("first_day") <= F.lit(alive_from).cast("date")) & (F.col("last_day") >= F.lit(alive_to).cast("date"))
    return stats.where(alive & (F.col("is144a") | (F.col("pct_days") < max_pct))).withColumn(
        "defaulted", F.coalesce((F.col("min_pr") < 30) & (F.col("max_pr") > 70), F.lit(False)))


def average_rank_pct(df: DataFrame, value: str, out: str, grid: float) -> DataFrame:
    """Average rank of `value` over the number of rows, ties sharing the mean of their ranks.

    Ranking is done on value counts in two levels: buckets of width `grid` are put in order (one row
    per bucket reaches the single ordering task), values are ordered inside their bucket.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__k")).withColumn("__b", F.floor(F.col(value) / grid))
    ordered = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("__b").agg(F.sum("__k").alias("__bk")).select(
        "__b", F.coalesce(F.sum("__bk").over(ordered), F.lit(0)).alias("__base"),
        F.sum("__bk").over(Window.partitionBy(F.lit(1))).alias("__n"))
    inside = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("__less", F.coalesce(F.sum("__k").over(inside), F.lit(0))).join(base, "__b").select(
        value, ((F.col("__base") + F.col("__less") + (F.col("__k") + 1) / 2) / F.col("__n")).alias(out))
    return df.join(ranks, value)


def rank_universe(universe: DataFrame, n: int) -> DataFrame:
    """Top n by (days rank + spread rank); needs traded_days and bidask_pct."""
    df = universe.withColumn("spread", F.coalesce("bidask_pct", F.lit(0.0)))
    df = average_rank_pct(average_rank_pct(df, "traded_days", "__d", 1.0), "spread", "__s", 0.01)
    return (df.withColumn("score", F.round(F.col("__d") + F.col("__s"), 8))
            .orderBy(F.desc("score"), "instrument_id").limit(n).select("instrument_id", "traded_days", "bidask_pct", "score"))


def chartable(trades: DataFrame, universe: DataFrame, min_months: int, n: int) -> DataFrame:
    months = trades.join(universe.select("instrument_id"), "instrument_id", "left_semi").groupBy("instrument_id").agg(
        F.count_distinct(F.trunc("day", "month")).alias("months"))
    return (universe.join(months.where(F.col("months") >= min_months), "instrument_id")
            .orderBy(F.desc_nulls_last("bidask_pct"), "instrument_id").limit(n)
            .select("instrument_id", "months", "bidask_pct"))


def month_end(trades: DataFrame) -> DataFrame:
    """Last non-null value of every column per instrument and month, column by column.

    Most months of an instrument have one row, so rows are sent as they are and not as wide partial results, and
    by instrument, in whose order they are read afterwards.
    """
    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("day")))

    r3 = {c: F.round(last(c), 3) for c in ("pr", "prc_bid", "prc_ask")}
    rows = trades.select("instrument_id", "day", "pr", "prc_bid", "prc_ask", "ytm", "mod_dur").repartition("instrument_id")
    return rows.groupBy("instrument_id", F.trunc("day", "month").alias("month")).agg(
        F.max("day").alias("day"), r3["pr"].alias("pr"), last("ytm").alias("ytm"), last("mod_dur").alias("mod_dur"),
        r3["prc_bid"].alias("bid"), r3["prc_ask"].alias("ask"))


def daily_ohlc(trades: DataFrame) -> DataFrame:
    """One row per traded day with a price; OHLC only where several trades printed."""
    many = F.col("trade_count") > 1
    return trades.where("pr is not null").select(
        "instrument_id", "day", F.round("pr", 3).alias("pr"),
        *[F.when(many, F.round(c, 3)).alias(o) for o, c in
          (("open", "prc_first"), ("high", "prc_hi"), ("low", "prc_lo"), ("close", "prc_last"))],
        "trade_count", "ytm", F.round("prc_bid", 3).alias("bid"), F.round("prc_ask", 3).alias("ask"))


def curve_month_end(curve: DataFrame) -> DataFrame:
    """The last day of each month that has a curve row, blanks included."""
    month = F.trunc("day", "month")
    last = curve.groupBy(month.alias("month")).agg(F.max("day").alias("day"))
    return curve.join(last, "day").select("month", "day", "tenor_no", "tenor_years", "yield")


def curve_yield(points: DataFrame, durations: DataFrame) -> DataFrame:
    """Yield at each (month, duration): linear between neighbouring tenors, clamped at both ends.

    Needs one aggregation over the eleven tenors of a month; blank tenors are skipped, and a month
    without any point gives no row.
    """
    t, d, y = F.col("tenor_years"), F.col("duration"), F.col("yield")
    point = F.struct(t.alias("t"), y.alias("y"))
    near = (durations.join(points.where("yield is not null").select("month", "tenor_years", "yield"), "month")
            .groupBy("month", "duration")
            .agg(F.max(F.when(t < d, point)).alias("lo"), F.min(F.when(t >= d, point)).alias("hi")))
    lerp = F.col("lo.y") + (F.col("hi.y") - F.col("lo.y")) * (d - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t"))
    return near.select("month", "duration", F.when(F.col("lo").isNull(), F.col("hi.y"))
                       .when(F.col("hi").isNull(), F.col("lo.y")).otherwise(lerp).alias("treasury"))


def _percent(ytm: Column) -> Column:
    return F.when(ytm < 1.5, ytm * 100).otherwise(ytm)


def proxy_anchor(prices: DataFrame, curve: DataFrame) -> DataFrame:
    """First month with a usable price, yield and duration; its spread over the curve."""
    usable = "pr <> 0 and ytm <> 0 and mod_dur <> 0"
    first = prices.where(usable).groupBy("instrument_id").agg(
        F.min(F.struct("month", F.col("pr").alias("p0"), _percent(F.col("ytm")).alias("y0"),
                       F.col("mod_dur").alias("duration"))).alias("a")).select("instrument_id", "a.*")
    t0 = curve_yield(curve, first.select("month", "duration").distinct())
    return first.join(t0, ["month", "duration"], "left").select(
        "instrument_id", F.col("month").alias("base_month"), "p0", "y0", "duration",
        F.coalesce(F.col("y0") - F.col("treasury"), F.lit(2.0)).alias("spread0"))


def proxy_price(prices: DataFrame, anchor: DataFrame, curve: DataFrame) -> DataFrame:
    """Model price and divergence of every month-end observation of an anchored instrument.

    An observation without a yield repeats the last divergence emitted for its instrument (0 before
    the first); a month without a curve emits nothing.
    """
    obs = prices.where("pr is not null").join(anchor, "instrument_id")
    t = curve_yield(curve, obs.select("month", "duration").distinct())
    rows = obs.join(t, ["month", "duration"]).withColumn("proxy_y", F.col("treasury") + F.col("spread0"))
    price = half_even(F.col("p0") * (1 - F.col("duration") * (F.col("proxy_y") - F.col("y0")) / 100), 3)
    own = half_even((_percent(F.col("ytm")) - F.col("proxy_y")) * 100, 0)
    by_month = Window.partitionBy("instrument_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("instrument_id", "month", "day", F.col("pr").alias("observed"),
                       F.greatest(price, F.lit(1.0)).alias("proxy"),
                       F.coalesce(F.last(own, True).over(by_month), F.lit(0.0)).cast("bigint").alias("divergence_bps"))


def monthly_divergence(compared: DataFrame) -> DataFrame:
    """Divergence of every calendar month between an instrument's first and last, gaps carried forward."""
    last = compared.groupBy("instrument_id", "month").agg(F.max_by("divergence_bps", "day").alias("divergence_bps"))
    span = last.groupBy("instrument_id").agg(F.min("month").alias("a"), F.max("month").alias("z")).select(
        "instrument_id", F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("month"))
    w = Window.partitionBy("instrument_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return span.join(last, ["instrument_id", "month"], "left").select(
        "instrument_id", "month", F.last("divergence_bps", True).over(w).alias("divergence_bps"))


def week_grid(span: DataFrame, anchor: str) -> DataFrame:
    """Weeks from the anchor strictly after `start` up to `end`, for each row of (start, end)."""
    keys = [c for c in span.columns if c not in ("start", "end")]
    a = F.lit(anchor).cast("date")
    first = F.date_add(a, ((F.floor(F.date_diff("start", a) / 7) + 1) * 7).cast("int"))
    return span.where(first <= F.col("end")).select(
        *keys, F.explode(F.sequence(first, F.col("end"), F.expr("interval 7 days"))).alias("week"))


def month_ends(span: DataFrame) -> DataFrame:
    grid = span.select("start", "end", F.explode(
        F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))).alias("m"))
    return grid.select("start", "end", F.last_day("m").alias("month_end")).where(
        "month_end between start and end").select("month_end")


def interp_on_grid(prints: DataFrame, grid: DataFrame) -> DataFrame:
    """Value of each sparse series (instrument_id, day, pr) at every grid row (instrument_id, week):
    linear in days between the print before and the print at or after, clamped at the ends."""
    hit = F.struct("day", "pr")
    rows = grid.select("instrument_id", F.col("week").alias("day"), F.lit(0).alias("side"),
                       F.lit(None).cast("struct<day:date,pr:double>").alias("p")).unionByName(
        prints.where("pr is not null and pr <> 0").select("instrument_id", "day", F.lit(1).alias("side"), hit.alias("p")))
    w = Window.partitionBy("instrument_id")
    upto = (Window.unboundedPreceding, 0)   # both ways: a frame that runs to the end starts over at every row
    rows = rows.select("*", F.last("p", True).over(w.orderBy("day", "side").rowsBetween(*upto)).alias("a"),
                       F.last("p", True).over(w.orderBy(F.desc("day"), F.desc("side")).rowsBetween(*upto)).alias("b")).where("side = 0")
    step = F.greatest(F.date_diff("b.day", "a.day"), F.lit(1))
    lerp = F.col("a.pr") + (F.col("b.pr") - F.col("a.pr")) * F.date_diff("day", "a.day") / step
    return rows.select("instrument_id", F.col("day").alias("week"), F.when(F.col("a").isNull(), F.col("b.pr"))
                       .when(F.col("b").isNull(), F.col("a.pr")).otherwise(lerp).alias("value")).where("value is not null")


def common_factor(interp: DataFrame) -> DataFrame:
    """Mean log move of all series per week; 0 where no series moved between positive values."""
    w = Window.partitionBy("instrument_id").orderBy("week")
    moves = interp.withColumn("prev", F.lag("value").over(w)).where("prev is not null")
    move = F.when((F.col("value") > 0) & (F.col("prev") > 0), F.ln(F.col("value") / F.col("prev")))
    return moves.groupBy("week").agg(F.round(F.coalesce(F.avg(move), F.lit(0.0)), 6).alias("factor"))
