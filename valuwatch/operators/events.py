"""Event modelling: chains, as-of prices, case intake, cascades and holdouts.  Case rows become a graph in `cases`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import elapsed_days
from ..functions.ordered import asof, neighbour
from ..model import POSITION_EDGE, Book
from ..session import written

# Event labels that carry prices.
PRICED_LABELS = ("MethodologyChange", "PriceOverride", "IPVReview", "Approval", "Escalation", "MAPReview")
# Edge from the position to an event of a loaded case, and labels loaded without one.
CASE_EDGE = {
    "MethodologyChange": "CHANGED_TO",
    "PriceOverride": "OVERRIDDEN_BY",
    "IPVReview": "REVIEWED_BY",
    "MAPReview": "REVIEWED_BY",
    "PnLSignal": "GENERATED_SIGNAL",
    "Control": "SUBJECT_TO_CONTROL",
    "Escalation": "ESCALATED_TO",
}
CASE_LABELS = (*CASE_EDGE, "Approval", "Evidence", "Incident", "CorrectiveAction", "RootCause")
# Day given to case rows that are dated to the month only.
MONTH_ROW_DAYS = {"MP-2011Q4": "2011-12-15", "MC-MARK-2012": "2012-01-30", "PNL-FEB": "2012-02-21",
                  "IPV-COLLATERAL": "2012-04-25", "CA-METHOD": "2012-05-24"}


def next_chain(events: DataFrame) -> DataFrame:
    """Edge from every event of a position to its successor by (time, id), with whole days between."""
    rows = events.where("position_id is not null").select("position_id", "event_id", "event_at")
    nxt = neighbour(rows, ["position_id"], ["event_at", "event_id"], {"to_id": "event_id", "to_at": "event_at"}, step=1)
    return nxt.where("to_id is not null").select(
        "position_id", F.col("event_id").alias("from_id"), "to_id",
        elapsed_days(F.col("event_at"), F.col("to_at")).alias("time_delta"))


def day_prices(prices: DataFrame) -> DataFrame:
    """Best price per (instrument, side, day): several prints of one day resolve to the highest."""
    return prices.groupBy("instrument_id", "side", "day").agg(F.max("price").alias("price"))


def annotate_event_prices(b: Book, prices: DataFrame) -> DataFrame:
    """Trader mark, model price and IPV price at event time for the six priced labels.

    `prices(instrument_id, side in observed|model, day, price)`.  The price is the last one at or
    before the event's day, or the first one of the series when the event predates it.
    """
    events = (b.chronology.where(F.col("label").isin(*PRICED_LABELS))
              .join(b.position.select("position_id", "instrument_id"), "position_id")
              .select("event_id", "label", "position_id", "instrument_id", F.to_date("event_at").alias("day"),
                      "deviation_bps", F.col("side").alias("direction"), "divergence_bps"))
    # prices are needed once per (instrument, day, side), however many events share them
    wanted = events.select("instrument_id", "day").distinct().select(
        "*", F.explode(F.array(F.lit("observed"), F.lit("model"))).alias("side"))
    known = asof(wanted, day_prices(prices), ["instrument_id", "side"], "day", "day", {"price": "price"},
                 forward=False, inclusive=True, else_first=True)
    pair = known.groupBy("instrument_id", "day").agg(
        F.max(F.when(F.col("side") == "observed", F.col("price"))).alias("observed"),
        F.max(F.when(F.col("side") == "model", F.col("price"))).alias("model"))
    rows = events.join(pair, ["instrument_id", "day"])
    mark = F.coalesce("observed", "model")
    sign = F.when(F.col("direction") == "favourable", 1).otherwise(-1)
    mark = F.when((F.col("label") == "PriceOverride") & F.col("deviation_bps").isNotNull(),
                  mark * (1 + sign * F.col("deviation_bps") / 10000)).otherwise(mark)
    ipv = F.when((F.col("label") == "IPVReview") & F.col("divergence_bps").isNotNull(),
                 mark * (1 - F.col("divergence_bps") / 10000))
    return rows.select("event_id", "label", "position_id", F.round(mark, 3).alias("trader_mark"),
                       F.round("model", 3).alias("model_price"), F.round(ipv, 3).alias("ipv_price"))


def shift_years(df: DataFrame, column: str, years: int, out: str) -> DataFrame:
    """Move a date by whole years (29 February becomes the 28th); the authentic date stays."""
    return df.withColumn(out, F.add_months(column, 12 * years))


def place_case_rows(case: DataFrame) -> DataFrame:
    """Give rows dated to the month their fixed day."""
    table = F.create_map(*[F.lit(x) for kv in MONTH_ROW_DAYS.items() for x in kv])
    return case.withColumn("date", F.coalesce(F.when(
        F.col("date_precision") == "month", F.try_element_at(table, F.col("event_id")).cast("date")), F.col("date")))


def weeks_of(prefix: Column, start: Column, end: Column) -> Column:
    """One override a week from start to end: deviation grows by 10 bps a week from 30, the share of the
    bid-ask by 6 points from 30 up to 95.  Null where a date is missing or the end comes first."""
    def week(w: Column) -> Column:
        no = (w + 1).cast("string")
        return F.struct(F.concat_ws("-", prefix, F.lpad(no, F.greatest(F.length(no), F.lit(2)), F.lit("0"))).alias("event_id"),
                        F.date_add(start, w * 7).alias("date"), (w * 10 + 30).alias("deviation_bps"),
                        F.least(w * 6 + 30, F.lit(95)).alias("pct_of_bid_ask"))

    return F.when(end >= start, F.transform(F.sequence(F.lit(0), F.floor(F.date_diff(end, start) / 7).cast("int")), week))


def weekly_overrides(series: DataFrame) -> DataFrame:
    """Expand weekly override series (event_id, position_id, start, end) into their overrides."""
    return series.select("position_id", F.inline(weeks_of(F.col("event_id"), F.col("start"), F.col("end")))).select(
        "event_id", "position_id", F.col("date").alias("day"), "deviation_bps", "pct_of_bid_ask")


def label_edges(events: DataFrame, edge_of: dict[str, str] = POSITION_EDGE) -> DataFrame:
    """Edge from the position to each of its events, by a fixed label-to-edge table."""
    table = F.create_map(*[F.lit(x) for kv in edge_of.items() for x in kv])
    return events.withColumn("rel_type", F.try_element_at(table, F.col("label"))).where("rel_type is not null").select(
        F.col("position_id").alias("src"), "rel_type", F.col("event_id").alias("dst"), F.lit("Position").alias("from_label"),
        F.col("label").alias("to_label"))


def load_case(case: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Other cases, told apart by position_id: (events, chain edges by sequence, unsupported rows).

    Rows of another label, or of none, are unsupported."""
    ok = F.coalesce(F.col("event_label").isin(*CASE_LABELS), F.lit(False))
    events = place_case_rows(case).where(ok).select(
        "event_id", F.col("event_label").alias("label"), "position_id",
        (F.col("date").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("event_at"), "seq", "description",
        "actor_role", "rules_broken")
    nxt = neighbour(events.select("position_id", "event_id", "seq"), ["position_id"], ["seq", "event_id"],
                    {"dst": "event_id"}, step=1, bucket=F.floor(F.col("seq") / 1024))
    chain = nxt.where("dst is not null").select(F.col("event_id").alias("src"), F.lit("NEXT").alias("rel_type"), "dst")
    return events, chain, case.where(~ok)


def rule_set_diff(declared: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rules declared broken (`position_id, rules` with `;` between) but not computed, and the reverse."""
    said = declared.select("position_id", F.explode(F.split("rules", ";")).alias("rule_id")).where(
        "rule_id <> ''").distinct().withColumn("said", F.lit(True))
    found = gaps.join(declared.select("position_id").distinct(), "position_id", "left_semi").select(
        "position_id", "rule_id").distinct().withColumn("found", F.lit(True))
    both = said.join(found, ["position_id", "rule_id"], "full_outer")
    return both.where("said is null or found is null").select(
        "position_id", "rule_id", F.when(F.col("said").isNull(), "computed only").otherwise("declared only").alias("side"))


def detach(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and every edge touching them; `ids` has one column, id."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone, edges.src == gone.id, "left_anti").join(gone, edges.dst == gone.id, "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept


def _holdable(b: Book) -> DataFrame:
    """Events that a holdout counts and removes: reviews only where they diverge beyond R5's limit."""
    r5 = next((r for r in b.rules if r.rule_id == "R5"), None)
    if r5 is None or r5.divergence_bps is None:
        return b.event
    return b.event.where((F.col("label") != "IPVReview") | (F.coalesce("divergence_bps", F.lit(0)) > r5.divergence_bps))


def gap_holdout(b: Book, plan: tuple[tuple[str, str], ...], exclude: DataFrame) -> DataFrame:
    """For each (rule, label) in turn the position with most such triggers, ties by id, among those
    not excluded and not taken yet: rule_id, position_id, label, removed.

    Counts are one row per (position, label).  Position k of the plan has at most k positions taken
    before it, so the first k+1 candidates of each label decide; only those few rows are compared.
    """
    counts = (_holdable(b).where(F.col("label").isin(*{label for _, label in plan})).groupBy("position_id", "label").agg(F.count(F.lit(1)).alias("removed"))
              .join(exclude.select("position_id").distinct(), "position_id", "left_anti"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("removed"), "position_id"))
    short = counts.withColumn("rank", rank).where(F.col("rank") <= len(plan)).collect()  # <= len(plan) rows per label
    taken: set[str] = set()
    chosen = []
    for rule_id, label in plan:
        free = [r for r in short if r.label == label and r.position_id not in taken]
        if free:
            best = min(free, key=lambda r: r["rank"])
            taken.add(best.position_id)
            chosen.append(F.struct(F.lit(rule_id).alias("rule_id"), F.lit(best.position_id).alias("position_id"),
                                   F.lit(label).alias("label"), F.lit(best.removed).cast("bigint").alias("removed")))
    if not chosen:
        return b.spark.createDataFrame([], "rule_id string, position_id string, label string, removed bigint")
    return b.spark.range(1).select(F.inline(F.array(*chosen)))


def without_holdout(b: Book, held: DataFrame) -> Book:
    """The book without the events that `held` (position_id, label) names, nor any edge that touches them:
    their answers stay as events of the position, but answer nothing."""
    gone = written(_holdable(b).join(held.select("position_id", "label").distinct(), ["position_id", "label"], "left_semi").select("event_id"), "held-out")
    mark = gone.distinct().select(F.col("event_id").alias("gone_id"))
    answers = b.response.join(mark, F.col("source_event_id") == F.col("gone_id"), "left")
    kept = F.col("gone_id").isNull()
    answers = answers.withColumns({c: F.when(kept, F.col(c)) for c in ("source_event_id", "source_label")}).drop("gone_id")
    return b.with_(event=b.event.join(gone, "event_id", "left_anti"), response=answers)


def without_links(bridge: DataFrame, held: DataFrame) -> DataFrame:
    """The bridge without the links drawn; links with a null in them are told apart as well."""
    cols = ["entity_id", "ra_type", "ra_value"]
    some = held.select(*[F.col(c).alias(f"held_{c}") for c in cols])
    same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in cols]
    return bridge.join(some, same[0] & same[1] & same[2], "left_anti")


def link_holdout(bridge: DataFrame, exclude: DataFrame, k: int, seed: int) -> DataFrame:
    """k pseudo-random attribute links, never of excluded entities and never liquidityTier.

    The draw orders links by md5 of the seed and the link, so it depends on neither partitioning nor engine."""
    draw = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[F.coalesce(c, F.lit("")) for c in ("entity_id", "ra_type", "ra_value")]))
    return (bridge.where("ra_type <> 'liquidityTier'").join(exclude, bridge.entity_id == exclude.position_id, "left_anti")
            .orderBy(draw, "entity_id", "ra_type", "ra_value").limit(k))
