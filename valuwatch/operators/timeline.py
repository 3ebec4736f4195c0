"""Financial view of a position: prices, marker events and controls on one calendar.

Nothing is gathered into one array per position: a bundle is rows with a section and a sequence
number, so a position with any number of events stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import asof, row_numbers
from ..model import Book

# Labels drawn as markers, price level where nothing is known.
MARKERS = ("MethodologyChange", "PriceOverride", "IPVReview", "Approval", "Escalation", "MAPReview", "DecorrelationSignal")
NO_PRICE = 100.0


def marker_events(b: Book, prices_at_event: DataFrame) -> DataFrame:
    """Marker events with role, prices and divergence (given, else derived from mark and model)."""
    roles = b.person.select("person_id", "role")
    rows = (b.chronology.where(F.col("label").isin(*MARKERS)).join(roles, "person_id", "left")
            .join(prices_at_event.drop("label", "position_id"), "event_id", "left"))
    derived = F.floor((F.col("trader_mark") - F.col("model_price")) / F.col("model_price") * 10000 + 0.5)
    return rows.select("position_id", "event_id", "label", "event_at", F.coalesce("role", "actor_role").alias("role"),
                       "trader_mark", "model_price", "ipv_price",
                       F.coalesce("divergence_bps", F.when(F.col("model_price") > 0, derived)).alias("divergence_bps"))


def position_prices(b: Book, prices: DataFrame) -> DataFrame:
    return b.position.select("position_id", "instrument_id").join(prices, "instrument_id").select(
        "position_id", "side", "day", "price")


#: Columns of one section only, null in the others: the candle of a price, the prices of an event, the rule of a control.
CANDLE = ("open", "high", "low", "close", "trade_count")


def timeline_bundle(b: Book, prices: DataFrame, prices_at_event: DataFrame, controls: DataFrame) -> DataFrame:
    """position_id, section (price | event | control), seq, at_time, ref, label, role, value, divergence_bps, and
    the candle and trade count of a price, model and IPV price of an event, name of a control's rule.

    The source of a price is its label.
    """
    held = b.position.select("position_id", "instrument_id").join(prices, "instrument_id")
    price = held.select(
        "position_id", F.lit("price").alias("section"), F.col("day").cast("timestamp_ntz").alias("at_time"),
        F.col("side").alias("ref"), F.col("side").alias("label"), F.col("price").alias("value"), *CANDLE)
    event = marker_events(b, prices_at_event).select(
        "position_id", F.lit("event").alias("section"), F.col("event_at").alias("at_time"), F.col("event_id").alias("ref"),
        "label", "role", F.col("trader_mark").alias("value"), "divergence_bps", "model_price", "ipv_price")
    control = controls.select(
        "position_id", F.lit("control").alias("section"), F.col("due_by").alias("at_time"),
        F.concat_ws("/", "rule_id", "trigger_event_id", "observed_event_id").alias("ref"), F.col("status").alias("label"), "rule_name")
    rows = price.unionByName(event, allowMissingColumns=True).unionByName(control, allowMissingColumns=True)
    return row_numbers(rows, ["position_id", "section"], ["at_time", "ref"], "seq")


def ohlc_candles(daily: DataFrame) -> DataFrame:
    """One candle per instrument and day: real where several trades printed, else flat."""
    real = (F.col("trade_count") > 1) & F.col("open").isNotNull() & F.col("high").isNotNull() & F.col(
        "low").isNotNull() & F.col("close").isNotNull()
    return daily.select("instrument_id", "day", *[F.when(real, F.col(c)).otherwise(F.col("pr")).alias(c)
                                                  for c in ("open", "high", "low", "close")])


def day_span(b: Book, prices: DataFrame, gaps: DataFrame) -> DataFrame:
    """First and last day each position's view must cover; an instrument's prices are reduced to these before they meet positions."""
    def ends(first: str, last: str) -> list:
        return [F.min(first).alias("start"), F.max(last).alias("end")]

    priced = b.position.select("position_id", "instrument_id").join(
        prices.groupBy("instrument_id").agg(*ends("day", "day")), "instrument_id").select("position_id", "start", "end")
    days = (b.chronology.where(F.col("label").isin(*MARKERS)).select("position_id", F.to_date("event_at").alias("start"))
            .unionByName(gaps.select("position_id", F.to_date("due_by").alias("start"))))
    return priced.unionByName(days.withColumn("end", F.col("start"))).groupBy("position_id").agg(*ends("start", "end"))


def calendar_fill(b: Book, prices: DataFrame, gaps: DataFrame) -> DataFrame:
    """Every calendar day of a position's view; days without an observation stay null."""
    days = day_span(b, prices, gaps).select("position_id", F.explode(F.sequence("start", "end")).alias("day"))
    observed = position_prices(b, prices).where("side = 'observed'").select("position_id", "day", F.col("price").alias("observed"))
    return days.join(observed, ["position_id", "day"], "left")


def event_price_level(b: Book, prices: DataFrame) -> DataFrame:
    """Level at which to draw each event day: last observed price, else last model price, else 100."""
    days = b.chronology.where(F.col("label").isin(*MARKERS)).select(
        "position_id", F.to_date("event_at").alias("day")).distinct()
    wanted = days.select("*", F.explode(F.array(F.lit("observed"), F.lit("model"))).alias("side"))
    known = asof(wanted, position_prices(b, prices), ["position_id", "side"], "day", "day", {"price": "price"},
                 forward=False, inclusive=True)
    return known.groupBy("position_id", "day").agg(F.coalesce(
        F.max(F.when(F.col("side") == "observed", F.col("price"))),
        F.max(F.when(F.col("side") == "model", F.col("price"))), F.lit(NO_PRICE)).alias("value"))


def cumulative_broken(b: Book, prices: DataFrame, gaps: DataFrame) -> DataFrame:
    """On the first of each month, the gaps whose due day lies strictly before it.

    Gaps are first counted per month; the running total is over one row per month of the calendar.
    """
    next_month = F.add_months(F.trunc(F.to_date("due_by"), "month"), 1)
    counts = gaps.groupBy("position_id", next_month.alias("month_start")).agg(F.count(F.lit(1)).alias("k"))
    months = day_span(b, prices, gaps).select("position_id", "start", "end", F.explode(F.sequence(
        F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))).alias("month_start")).where(
        "month_start between start and end").select("position_id", "month_start")
    w = Window.partitionBy("position_id").orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    return months.join(counts, ["position_id", "month_start"], "left").select(
        "position_id", "month_start", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("broken"))


def rule_bars(controls: DataFrame) -> DataFrame:
    return controls.groupBy("position_id", "rule_id", "rule_name").agg(
        F.count_if(F.col("status") == "LATE").alias("late"), F.count_if(F.col("status") == "MISSED").alias("missed"))


def event_rules(controls: DataFrame) -> DataFrame:
    """Control rows that concern an event, as their trigger or as what was observed."""
    out = ["event_id", "rule_id", "status", "role"]
    trigger = controls.withColumn("event_id", F.col("trigger_event_id")).withColumn("role", F.lit("trigger")).select(*out)
    seen = controls.where("observed_event_id is not null and observed_event_id <> trigger_event_id").withColumn(
        "event_id", F.col("observed_event_id")).withColumn("role", F.lit("observed")).select(*out)
    return trigger.unionByName(seen)
