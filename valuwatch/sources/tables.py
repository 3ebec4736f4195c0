"""Binding of the star-schema tables to the canonical book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import days
from ..model import Book, Later
from ..session import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Most lines that are expected in a task that meets them with their events.
LINES_A_TASK = 1 << 19

REGIME_BREAKS = (("REGIME-2000", "2000-01-01 00:00:00"),)

# Roles by supplier remainder, labels by order priority, tenors of the curve.
ROLES = ("Trader", "Trader", "Desk head", "IPV analyst", "Risk officer", "Product controller", "MAP member")
TENORS = (1 / 12, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 20.0, 30.0)
FAMILIES = {"AUTOMOBILE": "matrix", "BUILDING": "proxy", "FURNITURE": "broker", "HOUSEHOLD": "model"}
# Sector of each industry code.
SECTORS = {
    1: "Consumer", 2: "Consumer", 3: "Consumer", 4: "Consumer", 5: "Consumer", 6: "Consumer", 7: "Consumer",
    8: "Healthcare", 9: "Materials", 10: "Materials", 11: "Industrials", 12: "Materials", 13: "Industrials",
    14: "Industrials", 15: "Industrials", 16: "Industrials", 17: "Materials", 18: "Energy", 19: "Energy",
    20: "Utilities", 21: "Telecom", 22: "Services", 23: "Technology", 24: "Materials", 25: "Transport",
    26: "Services", 27: "Consumer", 28: "Consumer", 29: "Financials", 30: "Other",
}


def _pick(values: tuple[str, ...], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sector_of(code):
    """Industry code to sector; a null code counts as 30, an unknown one as Other."""
    pairs = [F.lit(x) for code_and_sector in SECTORS.items() for x in code_and_sector]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(code.cast("int"), F.lit(30))),
                      F.lit("Other"))


def maturity_of(years):
    return (F.when(years.isNull(), "5-10Y").when(years < 2, "<2Y").when(years < 5, "2-5Y")
            .when(years < 10, "5-10Y").otherwise("10Y+"))


def _instrument(part: DataFrame) -> DataFrame:
    flag = F.col("p_partkey") % 3
    years = F.when(F.col("p_partkey") % 17 == 5, None).otherwise(F.col("p_size") / 2.0)
    return part.select(
        F.concat(F.lit("INS-"), "p_partkey").alias("instrument_id"),
        F.col("p_name").alias("name"),
        sector_of(_ff_code()).alias("sector"),
        _ff_code().alias("ff_code"),
        years.alias("maturity_years"),
        (F.col("p_retailprice") * 1000).alias("amount"),
        # register: 0 assessed not liquid, 1 assessed liquid, 2 absent from the register
        F.when(flag == 0, F.lit(False)).when(flag == 1, F.lit(True)).alias("register_liquid"),
    )


def _ff_code():
    return F.when(F.col("p_partkey") % 13 == 4, None).otherwise(F.col("p_partkey") % 32 + 1)


def tier(register_liquid):
    """Only an instrument assessed liquid is liquid; absence counts as illiquid."""
    return F.when(F.coalesce(register_liquid, F.lit(False)), "liquid").otherwise("illiquid")


def tier_source(register_liquid):
    return (F.when(register_liquid.isNull(), "computed (share of days traded)")
            .when(register_liquid, "register").otherwise("register (not assessed liquid)"))


def _event(orders: DataFrame, n_people) -> DataFrame:
    at = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    whole = F.floor("o_totalprice")
    first = F.substring("o_orderpriority", 1, 1)
    label = (F.when(first == "1", "PriceOverride").when(first == "2", "IPVReview").when(first == "3", "PnLSignal")
             .when(first == "4", "MethodologyChange").when(F.col("o_orderstatus") == "F", "MAPReview")
             .when(F.col("o_orderstatus") == "O", "Control").otherwise("DecorrelationSignal"))
    person = F.concat(F.lit("PER-"), F.col("o_custkey") % n_people)
    pos = F.concat(F.lit("POS-"), F.floor(F.col("o_custkey") / 12))
    out = orders.select(
        F.concat(F.lit("EV-"), "o_orderkey").alias("event_id"),
        label.alias("label"),
        pos.alias("position_id"),
        at.alias("event_at"),
        F.col("o_orderdate").alias("source_at"),
        F.when(F.col("o_orderstatus") == "F", None)
        .otherwise(at + days(F.col("o_orderkey") % 11)).alias("effective_at"),
        (whole % 60).alias("deviation_bps"),
        F.when(F.col("o_orderkey") % 2 == 0, "favourable").otherwise("adverse").alias("side"),
        (F.col("o_custkey") % 100).alias("pct_of_bid_ask"),
        (whole % 100).alias("divergence_bps"),
        ((F.col("o_custkey") % 100) / 1000.0).alias("unexplained_pct"),
        (F.col("o_orderkey") % 10).alias("consecutive_days"),
        F.element_at(F.array(F.lit("upheld"), F.lit("adjusted"), F.lit("explained"), F.lit(None)),
                     (F.col("o_orderkey") % 4 + 1).cast("int")).alias("outcome"),
        person.alias("performer_id"),
        F.element_at(F.array(F.lit("desk"), F.lit("control"), F.lit(None)),
                     (F.col("o_orderkey") % 3 + 1).cast("int")).alias("actor_role"),
    )
    return out.withColumn("kind", F.when(F.col("label") == "Control", "attribution")).withColumn(
        "description", F.concat_ws(" ", "label", "event_id", F.lit("on"), "position_id", F.lit("by"), "performer_id"))


def _response(lineitem: DataFrame, event: DataFrame, parts: int | None = None) -> DataFrame:
    # one-letter codes are compared as numbers, which keeps this a hash aggregation
    # most groups have one line, so lines are sent once, by the event they meet afterwards, and not as partial results
    by_event = ([] if parts is None else [parts]) + ["source_event_id"]
    lines = lineitem.select(
        F.concat(F.lit("EV-"), "l_orderkey").alias("source_event_id"), "l_linenumber", "l_shipdate", "l_suppkey",
        F.ascii("l_returnflag").alias("flag"), F.ascii("l_linestatus").alias("status")).repartition(*by_event)
    grouped = lines.groupBy("source_event_id", "l_linenumber").agg(
        F.min("l_shipdate").alias("shipped"), F.min("l_suppkey").alias("person"),
        F.char(F.min("flag")).alias("flag"), F.char(F.max("status")).alias("status"))
    kind = (F.when(F.col("flag") == "A", "Approval").when(F.col("flag") == "R", "Escalation")
            .when(F.col("status") == "O", "Challenge").otherwise("Adjustment"))
    source = event.select(F.col("event_id").alias("source_event_id"), F.col("label").alias("source_label"),
                          "position_id")
    return grouped.select(
        F.concat(F.lit("RS-"), F.substr("source_event_id", F.lit(4)), F.lit("-"), "l_linenumber").alias("response_id"),
        kind.alias("kind"),
        "source_event_id",
        (F.col("shipped") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("event_at"),
        F.concat(F.lit("PER-"), "person").alias("person_id"),
        (F.col("status") == "O").alias("evidenced"),
        # an escalation of the position itself rather than of one event
        ((F.col("flag") == "R") & (F.col("l_linenumber") == 7)).alias("of_position"),
    ).join(source, "source_event_id")


def _trade(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One row per (instrument, traded day); several prints of a day become its OHLC."""
    seq = ("l_orderkey", "l_linenumber", "l_extendedprice")
    # most days of an instrument have one line, so lines are sent as they are and not as wide partial results,
    # and by part, so that their days need not be sent again to meet it
    lines = lineitem.select("l_partkey", "l_shipdate", *seq, "l_discount", "l_tax", "l_quantity", "l_suppkey").repartition("l_partkey")
    made = F.lit(20) + (F.floor("l_extendedprice") % 10000) / 100.0
    daily = lines.groupBy("l_partkey", "l_shipdate").agg(
        F.max_by(F.struct(made.alias("pr"), "l_discount", "l_tax", "l_quantity", "l_suppkey"), F.struct(*seq)).alias("x"),
        F.min_by(made, F.struct(*seq)).alias("prc_first"), F.max(made).alias("prc_hi"), F.min(made).alias("prc_lo"),
        F.count(F.lit(1)).alias("trade_count")).withColumn("prc_last", F.col("x.pr"))
    pr = F.when(F.col("x.l_quantity") % 23 == 7, None).otherwise(F.col("x.pr"))
    quoted = F.col("x.l_quantity") % 5 != 0
    return daily.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("INS-"), "l_partkey").alias("instrument_id"),
        F.to_date("l_shipdate").alias("day"),
        pr.alias("pr"),
        F.when(F.col("x.l_quantity") % 7 == 3, None).otherwise(F.col("x.l_discount") + 0.01).alias("ytm"),
        F.when(F.col("x.l_quantity") % 11 == 5, None).otherwise(F.col("p_size") / 5.0).alias("mod_dur"),
        "trade_count",
        F.when(quoted, F.col("x.pr") * (1 - F.col("x.l_discount"))).alias("prc_bid"),
        F.when(quoted, F.col("x.pr") * (1 + F.col("x.l_tax"))).alias("prc_ask"),
        F.when(F.col("x.l_suppkey") % 50 == 0, 3).otherwise(F.col("x.l_suppkey") % 2 + 1).alias("db_type"),
        _ff_code().alias("ff30num"),
        F.when(F.col("p_partkey") % 17 == 5, None).otherwise(F.col("p_size") / 2.0).alias("bond_maturity"),
        (F.col("p_retailprice") * 1000).alias("bond_amt_outstanding"),
        "prc_first", "prc_hi", "prc_lo", "prc_last",
    )


def _curve(orders: DataFrame) -> DataFrame:
    """Daily curve on the days that carry orders; a fifth of the points is blank."""
    d = F.to_date("o_orderdate")
    day = orders.select(d.alias("day")).distinct()
    num = F.unix_date("day")
    level = (F.lit(2.0) + (num % 97) / 50.0)
    points = day.select("day", F.posexplode(F.array(*[F.lit(t) for t in TENORS])).alias("i", "tenor_years"))
    return points.select("day", F.col("i").alias("tenor_no"), "tenor_years",
                         F.when((num + F.col("i")) % 5 == 0, None)
                         .otherwise(level + F.col("i") / 8.0).alias("yield"))


def attributes_of_position(position: DataFrame, instrument: DataFrame) -> DataFrame:
    """A position inherits its instrument's attributes and adds its family and desk."""
    inst = instrument.select("instrument_id", "sector", maturity_of(F.col("maturity_years")).alias("bucket"),
                             tier(F.col("register_liquid")).alias("liq"))
    pairs = F.array(
        F.struct(F.lit("issuerSector").alias("t"), F.col("sector").alias("v")),
        F.struct(F.lit("maturityBucket").alias("t"), F.col("bucket").alias("v")),
        F.struct(F.lit("liquidityTier").alias("t"), F.col("liq").alias("v")),
        F.struct(F.lit("methodologyFamily").alias("t"), F.col("family").alias("v")),
        F.struct(F.lit("deskId").alias("t"), F.col("desk_id").alias("v")))
    return (position.join(inst, "instrument_id").select("position_id", F.explode(pairs).alias("a"))
            .select(F.col("position_id").alias("entity_id"), F.col("a.t").alias("ra_type"),
                    F.col("a.v").alias("ra_value")))


def bind(spark: SparkSession, sf_dir: str) -> Book:
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    n_people = t["supplier"].agg(F.count(F.lit(1))).scalar()
    n_parts = t["part"].agg(F.count(F.lit(1))).scalar()

    person = t["supplier"].select(
        F.concat(F.lit("PER-"), "s_suppkey").alias("person_id"), F.col("s_name").alias("name"),
        _pick(ROLES, F.col("s_suppkey") % 7).alias("role"),
        F.concat(F.lit("DESK-"), "s_nationkey").alias("desk_id"))
    desk = t["nation"].select(F.concat(F.lit("DESK-"), "n_nationkey").alias("desk_id"),
                              F.col("n_name").alias("name"), (F.col("n_regionkey") == 0).alias("control"))
    owner = t["supplier"].groupBy("s_nationkey").agg(F.min("s_suppkey").alias("owner"))
    lead = F.struct("c_nationkey", "c_mktsegment", "c_acctbal")
    no = F.floor(F.col("c_custkey") / 12)
    books = t["customer"].groupBy(no.alias("no")).agg(F.min_by(lead, "c_custkey").alias("lead"))
    span = t["orders"].groupBy(F.floor(F.col("o_custkey") / 12).alias("no")).agg(
        F.min("o_orderdate").alias("opened_at"), F.max("o_orderdate").alias("last_at"))
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]),
                                         F.col("lead.c_mktsegment")), F.lit("curve"))
    position = (books.join(span, "no").join(owner, F.col("lead.c_nationkey") == F.col("s_nationkey"), "left")
                .select(F.concat(F.lit("POS-"), "no").alias("position_id"),
                        F.concat(F.lit("Book "), "no").alias("name"),
                        F.concat(F.lit("DESK-"), "lead.c_nationkey").alias("desk_id"),
                        F.concat(F.lit("PER-"), "owner").alias("owner_id"),
                        F.concat(F.lit("INS-"), F.col("no") % n_parts).alias("instrument_id"),
                        F.concat(F.lit("METH-"), family).alias("methodology_id"),
                        family.alias("family"), "opened_at",
                        F.when(F.col("lead.c_acctbal") < 0, F.col("last_at")).alias("valid_to")))
    instrument = _instrument(t["part"])
    event = _event(t["orders"], n_people)
    incident = t["customer"].where("c_acctbal > 9900").select(
        F.concat(F.lit("INC-"), "c_custkey").alias("incident_id"),
        F.concat(F.lit("POS-"), no).alias("position_id"))
    month = F.trunc(F.to_date("o_orderdate"), "month")
    mark = t["orders"].groupBy(F.concat(F.lit("POS-"), F.floor(F.col("o_custkey") / 12)).alias("position_id"),
                               F.last_day(month).alias("day")).agg(
        # whole units add up the same in any order
        (F.sum(F.floor("o_totalprice")) / F.count(F.lit(1))).alias("clean"))
    return Book(
        spark=spark, desk=desk, person=person, instrument=instrument, position=position, event=event,
        response=_response(t["lineitem"], event), attribute=attributes_of_position(position, instrument),
        trades=_trade(t["lineitem"], t["part"]), curve=_curve(t["orders"]), incident=incident, marks=mark,
        regime_breaks=REGIME_BREAKS, raw=t)


def canonical(b: Book) -> Book:
    """Write each canonical table once, when something first reads it, laid out for what reads it: events by label,
    answers by kind.

    Every operator then prunes to the partitions it names instead of repeating the derivation, and a query
    neither makes nor stores a table it does not read.
    """
    event = Later(lambda: written(b.event, "event", by="label"))
    position = Later(lambda: written(b.position, "position"))

    def response() -> DataFrame:
        lines = b.raw["lineitem"]
        # tasks grow with the lines, so what one of them sorts does not
        parts = max(b.spark.sparkContext.defaultParallelism, lines.count() // LINES_A_TASK + 1)
        return written(_response(lines, event.table(), parts), "response", by="kind")

    return b.with_(event=event, position=position, response=Later(response), attribute=Later(
        lambda: written(attributes_of_position(position.table(), b.instrument), "attribute")))


_BOOKS: dict[tuple, Book] = {}


def book_for(spark: SparkSession, sf_dir: str) -> Book:
    """The book of a folder, kept for the session so its tables are written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BOOKS:
        _BOOKS[key] = canonical(bind(spark, sf_dir))
    return _BOOKS[key]
