"""Registered queries: scans and market ETL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market as M
from ..sources.files import scan_trade_panel
from ..sources.tables import maturity_of, sector_of, tier, tier_source
from .prelude import half_even, rd
from .registry import query

ALIVE_FROM, ALIVE_TO, MAX_PCT = "1996-06-30", "2000-07-01", 0.0106
TRADING_DAYS = 2499
N_UNIVERSE, N_CHART, MIN_MONTHS = 3000, 120, 14
ANCHOR = "1995-01-06"

_VIEWS = {
    "bidask": """SELECT instrument_id, median(round((prc_ask - prc_bid) / pr * 100, 6)) AS bidask_pct FROM trade
                 WHERE prc_ask > prc_bid AND pr IS NOT NULL GROUP BY 1""",
    "stats": f"""
        SELECT instrument_id, count(*) AS traded_days, min(day) AS first_day, max(day) AS last_day,
               max(db_type) = 3 AS is144a, median(ff30num)::DOUBLE AS ff30, median(bond_maturity) AS maturity_years,
               median(bond_amt_outstanding) AS amount, min(pr) AS min_pr, max(pr) AS max_pr, median(pr) AS med_pr,
               count(*) / {TRADING_DAYS} AS pct_days FROM trade GROUP BY 1""",
    "universe": f"""
        SELECT *, coalesce(min_pr < 30 AND max_pr > 70, FALSE) AS defaulted FROM stats
        WHERE first_day <= DATE '{ALIVE_FROM}' AND last_day >= DATE '{ALIVE_TO}' AND (is144a OR pct_days < {MAX_PCT})""",
    "spread_universe": "SELECT u.*, b.bidask_pct FROM universe u LEFT JOIN bidask b USING (instrument_id)",
    "ranked": f"""
        SELECT instrument_id, traded_days, bidask_pct, round(d + s, 8) AS score FROM (
            SELECT *, (rank() OVER (ORDER BY traded_days) + (count(*) OVER (PARTITION BY traded_days) - 1) / 2) / count(*) OVER () AS d,
                   (rank() OVER (ORDER BY sp) + (count(*) OVER (PARTITION BY sp) - 1) / 2) / count(*) OVER () AS s
            FROM (SELECT *, coalesce(bidask_pct, 0) AS sp FROM spread_universe))
        ORDER BY score DESC, instrument_id LIMIT {N_UNIVERSE}""",
    "chart": f"""
        SELECT u.instrument_id, m.months, u.bidask_pct FROM ranked u JOIN (
            SELECT instrument_id, count(DISTINCT date_trunc('month', day)) AS months FROM trade GROUP BY 1) m USING (instrument_id)
        WHERE months >= {MIN_MONTHS} ORDER BY bidask_pct DESC NULLS LAST, instrument_id LIMIT {N_CHART}""",
    "month_price": f"""
        SELECT instrument_id, date_trunc('month', day)::DATE AS month, max(day) AS day,
               round(arg_max(pr, day) FILTER (pr IS NOT NULL), 3) AS pr, arg_max(ytm, day) FILTER (ytm IS NOT NULL) AS ytm,
               arg_max(mod_dur, day) FILTER (mod_dur IS NOT NULL) AS mod_dur,
               {rd('arg_max(prc_bid, day) FILTER (prc_bid IS NOT NULL)', 3)} AS bid,
               {rd('arg_max(prc_ask, day) FILTER (prc_ask IS NOT NULL)', 3)} AS ask FROM trade GROUP BY 1, 2""",
    "daily": f"""
        SELECT instrument_id, day, round(pr, 3) AS pr, CASE WHEN trade_count > 1 THEN round(prc_first, 3) END AS open,
               CASE WHEN trade_count > 1 THEN round(prc_hi, 3) END AS high, CASE WHEN trade_count > 1 THEN round(prc_lo, 3) END AS low,
               CASE WHEN trade_count > 1 THEN round(prc_last, 3) END AS close, trade_count, ytm,
               {rd('prc_bid', 3)} AS bid, {rd('prc_ask', 3)} AS ask FROM trade WHERE pr IS NOT NULL""",
    "curve_month": """
        SELECT date_trunc('month', day)::DATE AS month, day, tenor_no, tenor_years, yield FROM curve
        WHERE day IN (SELECT max(day) FROM curve GROUP BY date_trunc('month', day))""",
    "yields": """
        SELECT month, duration, CASE WHEN lt IS NULL THEN hy WHEN ht IS NULL THEN ly
               ELSE ly + (hy - ly) * (duration - lt) / (ht - lt) END AS treasury
        FROM (SELECT d.month, d.duration,
                     max(tenor_years) FILTER (tenor_years < duration) AS lt, min(tenor_years) FILTER (tenor_years >= duration) AS ht,
                     arg_max(yield, tenor_years) FILTER (tenor_years < duration) AS ly,
                     arg_min(yield, tenor_years) FILTER (tenor_years >= duration) AS hy
              FROM (SELECT DISTINCT c.month, p.duration FROM curve_month c,
                           (SELECT DISTINCT mod_dur AS duration FROM trade WHERE mod_dur IS NOT NULL) p) d
              JOIN curve_month c ON c.month = d.month AND c.yield IS NOT NULL GROUP BY 1, 2)""",
    "anchor": """
        SELECT a.instrument_id, a.month AS base_month, p0, y0, a.duration, coalesce(y0 - treasury, 2.0) AS spread0
        FROM (SELECT instrument_id, month, pr AS p0, CASE WHEN ytm < 1.5 THEN ytm * 100 ELSE ytm END AS y0, mod_dur AS duration
              FROM month_price WHERE pr <> 0 AND ytm <> 0 AND mod_dur <> 0
              QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY month) = 1) a
        LEFT JOIN yields y ON y.month = a.month AND y.duration = a.duration""",
    "proxied": f"""
        SELECT instrument_id, month, day, observed, proxy,
               coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY month), 0)::BIGINT AS divergence_bps
        FROM (SELECT o.instrument_id, o.month, o.day, o.pr AS observed,
                     greatest({half_even('p0 * (1 - a.duration * ((treasury + spread0) - y0) / 100)', 3)}, 1.0) AS proxy,
                     {half_even('(CASE WHEN ytm < 1.5 THEN ytm * 100 ELSE ytm END - (treasury + spread0)) * 100', 0)} AS own
              FROM month_price o JOIN anchor a USING (instrument_id)
              JOIN yields y ON y.month = o.month AND y.duration = a.duration WHERE o.pr IS NOT NULL)""",
    "diverged": """
        SELECT g.instrument_id, g.month,
               last_value(p.divergence_bps IGNORE NULLS) OVER (PARTITION BY g.instrument_id ORDER BY g.month) AS divergence_bps
        FROM (SELECT instrument_id, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month
              FROM proxied GROUP BY instrument_id) g LEFT JOIN proxied p USING (instrument_id, month)""",
    "weeks": f"""
        SELECT unnest(generate_series((DATE '{ANCHOR}' + ((floor(date_diff('day', DATE '{ANCHOR}', min(day)) / 7) + 1) * 7)::INT)::TIMESTAMP,
               max(day)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS week FROM trade""",
    "held": "SELECT DISTINCT instrument_id FROM position",
    "interp": """
        SELECT instrument_id, week, CASE WHEN pd IS NULL THEN np WHEN nd IS NULL THEN pp
               ELSE pp + (np - pp) * date_diff('day', pd, week) / greatest(date_diff('day', pd, nd), 1) END AS value
        FROM (SELECT h.instrument_id, w.week, max(t.day) FILTER (t.day < w.week) AS pd, min(t.day) FILTER (t.day >= w.week) AS nd,
                     arg_max(round(t.pr, 3), t.day) FILTER (t.day < w.week) AS pp,
                     arg_min(round(t.pr, 3), t.day) FILTER (t.day >= w.week) AS np
              FROM held h CROSS JOIN weeks w JOIN trade t ON t.instrument_id = h.instrument_id AND t.pr <> 0 GROUP BY 1, 2)""",
}


def q(name, oracle):
    return query(name, oracle, **_VIEWS)


def stats(b):
    return M.universe_stats(b.trade, TRADING_DAYS)


def universe(b):
    return M.illiquid_universe(stats(b), ALIVE_FROM, ALIVE_TO, MAX_PCT).join(
        M.bidask_median(b.trade), "instrument_id", "left")


def durations(b):
    """Every duration traded in a month."""
    return b.trade.where("mod_dur is not null").select(
        F.trunc("day", "month").alias("month"), F.col("mod_dur").alias("duration")).distinct()


def proxied(b):
    """Model prices and their comparison with the observed ones, the second half of the price table."""
    def make():
        # both are read several times below
        prices, curve = b.once("month_end", lambda: M.month_end(b.trade)), M.curve_month_end(b.curve)
        return M.proxy_price(prices, b.once("anchor", lambda: M.proxy_anchor(prices, curve)), curve)

    return b.once("proxied", make)


def span(b):
    return b.trade.agg(F.min("day").alias("start"), F.max("day").alias("end"))


def interp(b):
    held = b.position.select("instrument_id").distinct()
    whole = held.select("instrument_id", b.trade.agg(F.min("day")).scalar().alias("start"),
                        b.trade.agg(F.max("day")).scalar().alias("end"))
    prints = M.daily_ohlc(b.trade.join(held, "instrument_id", "left_semi"))
    return M.interp_on_grid(prints, M.week_grid(whole, ANCHOR))


q("scan_trade_panel", """
    SELECT l_partkey, l_shipdate, l_extendedprice, l_discount, l_tax FROM lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'""")(
    lambda b: scan_trade_panel(b.raw["lineitem"], "l_shipdate", "1997-01-01", "1998-12-31",
                               ["l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax"]))
q("scan_curve_csv", "SELECT month, day, tenor_no, yield FROM curve_month")(
    lambda b: M.curve_month_end(b.curve).select("month", "day", "tenor_no", "yield"))
q("universe_stats", "SELECT * REPLACE (round(pct_days, 8) AS pct_days) FROM stats")(
    lambda b: stats(b).withColumn("pct_days", F.round("pct_days", 8)))
q("bidask_median", """SELECT s.instrument_id, round(b.bidask_pct, 4) AS bidask_pct
                      FROM (SELECT DISTINCT instrument_id FROM trade) s LEFT JOIN bidask b USING (instrument_id)""")(
    lambda b: b.trade.select("instrument_id").distinct().join(M.bidask_median(b.trade), "instrument_id", "left")
    .select("instrument_id", F.round("bidask_pct", 4).alias("bidask_pct")))
q("universe_filter", "SELECT instrument_id, traded_days, first_day, last_day, is144a, defaulted FROM universe")(
    lambda b: M.illiquid_universe(stats(b), ALIVE_FROM, ALIVE_TO, MAX_PCT).select(
        "instrument_id", "traded_days", "first_day", "last_day", "is144a", "defaulted"))
q("universe_rank", "SELECT instrument_id, traded_days, round(bidask_pct, 4) AS bidask_pct, score FROM ranked")(
    lambda b: M.rank_universe(universe(b), N_UNIVERSE).withColumn("bidask_pct", F.round("bidask_pct", 4)))
q("chartable_select", "SELECT instrument_id, months, round(bidask_pct, 4) AS bidask_pct FROM chart")(
    lambda b: M.chartable(b.trade, M.rank_universe(universe(b), N_UNIVERSE), MIN_MONTHS, N_CHART)
    .withColumn("bidask_pct", F.round("bidask_pct", 4)))
q("month_end_price", "SELECT * FROM month_price")(lambda b: M.month_end(b.trade))
q("daily_ohlc", "SELECT * FROM daily")(lambda b: M.daily_ohlc(b.trade))
q("sector_bucket", "SELECT instrument_id, ff_code, sector FROM instrument")(
    lambda b: b.instrument.select("instrument_id", F.coalesce("ff_code", F.lit(30)).alias("ff_code"),
                                  sector_of(F.col("ff_code")).alias("sector")))
q("maturity_bucket", "SELECT instrument_id, maturity_years, bucket FROM instrument")(
    lambda b: b.instrument.select("instrument_id", "maturity_years", maturity_of(F.col("maturity_years")).alias("bucket")))
q("liquidity_tier", """
    SELECT instrument_id, liq AS tier, CASE WHEN register_liquid IS NULL THEN 'computed (share of days traded)'
           WHEN register_liquid THEN 'register' ELSE 'register (not assessed liquid)' END AS source FROM instrument""")(
    lambda b: b.instrument.select("instrument_id", tier(F.col("register_liquid")).alias("tier"),
                                  tier_source(F.col("register_liquid")).alias("source")))
q("risk_attributes", """
    SELECT replace('RA-' || ra_type || '-' || ra_value, ' ', '_') AS attribute_id, ra_type, ra_value,
           count(*) AS positions FROM attribute GROUP BY ra_type, ra_value""")(
    lambda b: b.attribute.groupBy("ra_type", "ra_value").agg(F.count(F.lit(1)).alias("positions")).select(
        F.translate(F.concat_ws("-", F.lit("RA"), "ra_type", "ra_value"), " ", "_").alias("attribute_id"),
        "ra_type", "ra_value", "positions"))
q("curve_interp", """SELECT month, duration, round(treasury, 6) AS treasury FROM yields
    WHERE (month, duration) IN (SELECT date_trunc('month', day)::DATE, mod_dur FROM trade)""")(
    lambda b: M.curve_yield(M.curve_month_end(b.curve), durations(b)).withColumn("treasury", F.round("treasury", 6)))
q("proxy_anchor", """SELECT instrument_id, base_month, p0, round(y0, 6) AS y0, duration, round(spread0, 6) AS spread0
                     FROM anchor""")(
    lambda b: M.proxy_anchor(M.month_end(b.trade), M.curve_month_end(b.curve))
    .withColumn("y0", F.round("y0", 6)).withColumn("spread0", F.round("spread0", 6)))
q("proxy_price", "SELECT instrument_id, month, day, observed, proxy FROM proxied")(
    lambda b: proxied(b).drop("divergence_bps"))
q("divergence_bps", "SELECT instrument_id, day, divergence_bps FROM proxied")(
    lambda b: proxied(b).select("instrument_id", "day", "divergence_bps"))
q("monthly_divergence", "SELECT * FROM diverged")(lambda b: M.monthly_divergence(proxied(b)))
q("weekly_interp", f"SELECT instrument_id, week, {rd('value', 4)} AS value FROM interp")(
    lambda b: interp(b).withColumn("value", F.round("value", 4)))
q("week_grid", "SELECT week FROM weeks")(lambda b: M.week_grid(span(b), ANCHOR))
q("common_factor", """
    SELECT week, round(coalesce(avg(CASE WHEN value > 0 AND prev > 0 THEN ln(value / prev) END), 0), 6) AS factor
    FROM (SELECT *, lag(value) OVER (PARTITION BY instrument_id ORDER BY week) AS prev FROM interp)
    WHERE prev IS NOT NULL GROUP BY 1""")(lambda b: M.common_factor(interp(b)))
q("month_ends", """
    SELECT month_end FROM (SELECT a, z, last_day(unnest(generate_series(date_trunc('month', a)::TIMESTAMP,
           date_trunc('month', z)::TIMESTAMP, INTERVAL 1 MONTH))::DATE) AS month_end
           FROM (SELECT min(day) AS a, max(day) AS z FROM trade)) WHERE month_end BETWEEN a AND z""")(
    lambda b: M.month_ends(span(b)))
