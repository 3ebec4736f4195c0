"""Result shaping: graph-like payloads of query results, and the run rollup of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import neighbour, running_sum

FIRST_EVENTS = 60   # what a timeline or control payload shows of one position
FIRST_POSITIONS = 15

OUT = ("part", "owner", "id", "kind", "caption", "from_id", "to_id", "ord")


def _node(df: DataFrame, owner: Column, i: Column, kind: Column, caption: Column, order: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit("node").alias("part"), owner.alias("owner"), i.alias("id"), kind.alias("kind"), caption.alias("caption"),
                     none.alias("from_id"), none.alias("to_id"),
                     (order if order is not None else F.lit(None)).cast("bigint").alias("ord")).where("id is not null")


def _rel(df: DataFrame, owner: Column, i: Column, kind: Column, a: Column, z: Column) -> DataFrame:
    none = F.lit(None)
    return df.select(F.lit("rel").alias("part"), owner.alias("owner"), i.alias("id"), kind.alias("kind"),
                     none.cast("string").alias("caption"), a.alias("from_id"), z.alias("to_id"), none.cast("bigint").alias("ord"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _first(df: DataFrame, key: str, order: list, n: int, out: str) -> DataFrame:
    """The first n rows of each key; Spark cuts per task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def graph_timeline(timeline: DataFrame) -> DataFrame:
    """First events of each position in order, chained by NEXT from FIRST_EVENT."""
    c, pos = F.col, F.col("position_id")
    rows = _first(timeline.where("label not in ('MarketPrice', 'Curve')"), "position_id", ["at_time", "id"], FIRST_EVENTS, "n")
    rows = rows.withColumn("prev", F.lag("id").over(Window.partitionBy("position_id").orderBy("n")))  # at most 60 rows each
    return _all([
        _node(timeline.select("position_id").distinct(), pos, pos, F.lit("Position"), pos, F.lit(-1)),
        _node(rows, pos, c("id"), c("label"), F.concat_ws(" ", "label", F.date_format("at_time", "yyyy-MM-dd")), c("n") - 1),
        _rel(rows.where("n = 1"), pos, F.lit("pos-first"), F.lit("FIRST_EVENT"), pos, c("id")),
        _rel(rows.where("n > 1"), pos, F.concat(F.lit("next-"), c("n") - 2), F.lit("NEXT"), c("prev"), c("id"))])


def graph_controls(controls: DataFrame) -> DataFrame:
    """First control rows of each position: rules, triggers (linked once) and one edge per outcome."""
    c, pos = F.col, F.col("position_id")
    rows = _first(controls, "position_id", ["trigger_at", "rule_id", "trigger_event_id", F.asc_nulls_first("observed_event_id")],
                  FIRST_EVENTS, "n").withColumn("i", F.col("n") - 1)
    on_event = rows.where("trigger_event_id is not null and trigger_event_id <> position_id")
    seen = on_event.groupBy("position_id", "trigger_event_id").agg(F.min("i").alias("i"), F.min_by("trigger_label", "i").alias("label"))
    return _all([
        _node(rows.select("position_id").distinct(), pos, pos, F.lit("Position"), pos),
        _node(rows.select("position_id", "rule_id", "rule_name").distinct(), pos, c("rule_id"), F.lit("ControlObligation"),
              F.concat_ws(" ", "rule_id", "rule_name")),
        _node(seen, pos, c("trigger_event_id"), c("label"), c("trigger_event_id")),
        _rel(seen, pos, F.concat(F.lit("t-"), "i"), F.lit("HAS_EVENT"), pos, c("trigger_event_id")),
        _rel(on_event, pos, F.concat(F.lit("s-"), "i"), c("status"), c("trigger_event_id"), c("rule_id"))])


def graph_approvals(approved: DataFrame) -> DataFrame:
    """event -> approval -> person -> desk of every approved event; nodes once per event."""
    c, ev = F.col, F.col("source_event_id")
    named = approved.where("approver is not null")
    desked = named.where("approver_desk is not null")
    return _all([
        _node(approved.select("source_event_id").distinct(), ev, ev, F.lit("Event"), ev),
        _node(approved, ev, c("approval_id"), F.lit("Approval"), c("approval_id")),
        _node(named.select("source_event_id", "approver", "approver_role").distinct(), ev, c("approver"), F.lit("Person"),
              F.concat(c("approver"), F.lit(" ("), F.coalesce("approver_role", F.lit("?")), F.lit(")"))),
        _node(desked.select("source_event_id", "approver_desk").distinct(), ev, c("approver_desk"), F.lit("Desk"), c("approver_desk")),
        _rel(approved, ev, F.concat(F.lit("a-"), "approval_id"), F.lit("APPROVED_BY"), ev, c("approval_id")),
        _rel(named, ev, F.concat(F.lit("p-"), "approval_id"), F.lit("APPROVED_BY"), c("approval_id"), c("approver")),
        _rel(desked, ev, F.concat(F.lit("d-"), "approval_id"), F.lit("ON_DESK"), c("approver"), c("approver_desk"))])


def graph_read_across(ranked: DataFrame) -> DataFrame:
    """The leading positions of a ranking (position_id, rules, rule_count) and the rules they break."""
    c, pos = F.col, F.col("position_id")
    rows = ranked.orderBy(F.desc("rule_count"), "position_id").limit(FIRST_POSITIONS)
    broken = rows.select("position_id", F.explode(F.split("rules", ",")).alias("rule"))
    all_ = F.lit("all")
    return _all([
        _node(rows, all_, pos, F.lit("Position"), pos),
        _node(broken.select("rule").distinct(), all_, c("rule"), F.lit("GovernanceGap"), c("rule")),
        _rel(broken, all_, F.concat_ws("-", "position_id", "rule"), F.lit("HAS_GAP"), pos, c("rule"))])


def run_rollup(log: DataFrame) -> DataFrame:
    """Consecutive entries of one group collapse into a run; entries without a group never merge.

    `log(owner, at, entry_id, label, ms, rows, error)`; run ids count from 1 in each owner's order.
    """
    rows = neighbour(log, ["owner"], ["at", "entry_id"], {"before": "label"})
    opens = F.when(F.col("label").isNotNull() & (F.col("label") == F.col("before")), 0).otherwise(1)
    rows = running_sum(rows.withColumn("opens", opens), ["owner"], ["at", "entry_id"], "opens", "run_id")
    return rows.groupBy("owner", "run_id").agg(
        F.max("label").alias("label"), F.count(F.lit(1)).alias("entries"), F.round(F.sum("ms"), 2).alias("total_ms"),
        F.sum("rows").alias("total_rows"), F.bool_or("error").alias("has_error"))
