"""Case rows to a graph: dated nodes and typed edges by tables of emission rules.

A rule belongs to an event label, and to one row of it where it names that row.  Ids in rules are templates
over {event}, {position}, {instrument} and {incident}; an edge whose template has no value in a case (say a
case without an incident) is not emitted.  Rules are a short control table, cases may be any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import CASE_EDGE, CASE_LABELS, place_case_rows, weeks_of


@dataclass(frozen=True)
class CaseRules:
    """Edges (label, row, src, type, dst), further nodes (label, row, node label, id, days after the row),
    rows that stand for other ids, and weekly series (prefix, first day, last day) by row."""

    edges: tuple[tuple[str, str | None, str, str, str], ...]
    nodes: tuple[tuple[str, str | None, str, str, int], ...] = ()
    stands_for: dict[str, tuple[str, ...]] = field(default_factory=dict)
    series: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    years: int = 10

    def __add__(self, other: "CaseRules") -> "CaseRules":
        return CaseRules(self.edges + other.edges, self.nodes + other.nodes, {**self.stands_for, **other.stands_for},
                         {**self.series, **other.series}, self.years)


# Edges that every case row of a label has.
LABEL_RULES = CaseRules(edges=(
    ("MarketPrice", None, "{event}", "COMPARED_WITH", "{position}"),
    ("MarketPrice", None, "{event}", "PRICE_OF", "{instrument}"),
    *((label, None, "{position}", rel, "{event}") for label, rel in CASE_EDGE.items()),
    ("Incident", None, "{event}", "CAUSED_BY", "{position}"),
    ("CorrectiveAction", None, "{incident}", "MITIGATED_BY", "{event}"),
    ("RootCause", None, "{incident}", "CAUSED_BY", "{event}"),
))

# What single rows of the published case add.
PUBLISHED = CaseRules(
    stands_for={"INC-SCP": ("INC-TP",), "RC-REVIEW": ("RC-TP-1", "RC-TP-2", "RC-TP-3")},
    series={"PO-DAILY-SERIES": ("PO-TP", "2012-01-06", "2012-03-23")},
    nodes=(
        ("MAPReview", "MAP-TP-2011Q3", "Evidence", "EV-{event}", 0),
        ("MethodologyChange", "MC-VAR-2012", "Approval", "APR-{event}", 3),
        ("PnLSignal", "PNL-FEB", "Control", "CTL-{event}", 0),
        ("PriceOverride", "PO-DAILY-SERIES", "Approval", "APR-{event}", 0),
        ("PnLSignal", "PNL-0323", "Control", "CTL-{event}", 0),
        ("Escalation", "ESC-MEDIA", "Evidence", "EV-{event}", 0),
        ("PnLSignal", "PNL-0410", "PnLSignal", "PNL-0410-REISSUE", 0),
        ("Incident", "INC-SCP", "Control", "CTL-{event}", 0),
        ("CorrectiveAction", "CA-METHOD", "MethodologyChange", "MC-IPS-2012", 0),
        ("CorrectiveAction", "CA-METHOD", "Approval", "APR-MC-IPS-2012", -2),
        ("CorrectiveAction", "CA-METHOD", "Evidence", "EV-APR-MC-IPS-2012", -2),
        ("CorrectiveAction", "CA-METHOD", "IPVReview", "IPV-MC-IPS-2012", 12),
        ("CorrectiveAction", "CA-TASKFORCE", "Evidence", "EV-{event}", 0),
    ),
    edges=(
        ("MAPReview", "MAP-TP-2011Q3", "{event}", "EVIDENCED_BY", "EV-{event}"),
        ("MethodologyChange", "MC-VAR-2012", "{event}", "APPROVED_BY", "APR-{event}"),
        ("MethodologyChange", "MC-VAR-2012", "APR-{event}", "APPROVED_BY", "TP-MODEL-OWNER"),
        ("PnLSignal", "PNL-FEB", "{position}", "SUBJECT_TO_CONTROL", "CTL-{event}"),
        ("PriceOverride", "PO-DAILY-SERIES", "{event}", "PERFORMED_BY", "TP-TRADER-A"),
        ("PriceOverride", "PO-DAILY-SERIES", "{event}", "APPROVED_BY", "APR-{event}"),
        ("PriceOverride", "PO-DAILY-SERIES", "APR-{event}", "APPROVED_BY", "TP-DESKHEAD"),
        ("Evidence", "EV-SPREADSHEET", "PO-TP-10", "EVIDENCED_BY", "{event}"),
        ("PnLSignal", "PNL-0323", "{position}", "SUBJECT_TO_CONTROL", "CTL-{event}"),
        ("IPVReview", "IPV-Q1", "{event}", "PERFORMED_BY", "TP-VCG"),
        ("Escalation", "ESC-MEDIA", "{event}", "EVIDENCED_BY", "EV-{event}"),
        ("PnLSignal", "PNL-0410", "{position}", "GENERATED_SIGNAL", "PNL-0410-REISSUE"),
        ("PnLSignal", "PNL-0410", "{event}", "CHALLENGED_BY", "PNL-0410-REISSUE"),
        ("Incident", "INC-SCP", "{event}", "REVIEWED_BY", "CTL-{event}"),
        ("Incident", "INC-SCP", "CTL-{event}", "PERFORMED_BY", "TP-CONTROLLER"),
        ("CorrectiveAction", "CA-METHOD", "{position}", "CHANGED_TO", "MC-IPS-2012"),
        ("CorrectiveAction", "CA-METHOD", "MC-IPS-2012", "APPROVED_BY", "APR-MC-IPS-2012"),
        ("CorrectiveAction", "CA-METHOD", "APR-MC-IPS-2012", "APPROVED_BY", "TP-DEP-CRO"),
        ("CorrectiveAction", "CA-METHOD", "APR-MC-IPS-2012", "APPROVED_BY", "COM-VAL"),
        ("CorrectiveAction", "CA-METHOD", "APR-MC-IPS-2012", "EVIDENCED_BY", "EV-APR-MC-IPS-2012"),
        ("CorrectiveAction", "CA-METHOD", "{position}", "REVIEWED_BY", "IPV-MC-IPS-2012"),
        ("CorrectiveAction", "CA-TRANSFER", "{position}", "OWNED_BY", "DESK-IB"),
        ("CorrectiveAction", "CA-TASKFORCE", "{event}", "EVIDENCED_BY", "EV-{event}"),
        ("Evidence", "EV-PSI", "{incident}", "EVIDENCED_BY", "{event}"),
        ("Evidence", "EV-SEC", "{incident}", "EVIDENCED_BY", "{event}"),
    ))

ENCODED_LABELS = (*CASE_LABELS, "MarketPrice")
PROPERTIES = ("seq", "description", "actor_role", "amount_usd_m", "date_precision", "source", "confidence")


def _by_label(rules: tuple[tuple, ...], names: tuple[str, ...], label: Column, row: Column) -> Column:
    """The rules of a row's label and, where they name one, its id, as an array of structs."""
    def struct(rule: tuple) -> Column:
        return F.struct(*[F.lit(v).cast("int" if n == "days" else "string").alias(n) for n, v in zip(names, rule[1:], strict=True)])

    labels = sorted({rule[0] for rule in rules})
    if not labels:
        return F.lit(None).cast("array<struct<" + ",".join(f"{n}:{'int' if n == 'days' else 'string'}" for n in names) + ">>")
    table = F.create_map(*[x for at in labels for x in (F.lit(at), F.array(*[struct(r) for r in rules if r[0] == at]))])
    return F.filter(F.try_element_at(table, label), lambda r: r["row"].isNull() | (r["row"] == row))


def _filled(template: str) -> Column:
    """The template with its places filled; null where a place it uses has no value."""
    out = F.col(template)
    for place in ("event", "position", "instrument", "incident"):
        mark = F.lit("{" + place + "}")
        out = F.when(F.contains(out, mark), F.replace(out, mark, F.col(f"{place}_id"))).otherwise(out)
    return out


def _ids(rules: CaseRules) -> Column:
    """What a row stands for: (event_id, date, deviation_bps, pct_of_bid_ask), several for a series."""
    def one(event: Column) -> Column:
        return F.struct(event.alias("event_id"), F.col("date").alias("date"), F.lit(None).cast("int").alias("deviation_bps"),
                        F.lit(None).cast("int").alias("pct_of_bid_ask"))

    out = F.array(one(F.col("event_id")))
    for row, ids in sorted(rules.stands_for.items()):
        out = F.when(F.col("event_id") == row, F.array(*[one(F.lit(i)) for i in ids])).otherwise(out)
    given = F.when(F.col("series_start").isNotNull(), weeks_of(F.col("event_id"), F.col("series_start"), F.col("series_end")))
    out = F.coalesce(given, out)
    for row, (prefix, first, last) in sorted(rules.series.items()):
        out = F.when(F.col("event_id") == row, weeks_of(F.lit(prefix), F.lit(first).cast("date"), F.lit(last).cast("date"))).otherwise(out)
    return out


def encode_case(case: DataFrame, rules: CaseRules = LABEL_RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unsupported rows) of cases told apart by position_id.

    `case` has the case columns, position_id and, where known, instrument_id, series_start and series_end: a
    row with a start is a weekly series until its end (null or earlier: no event).  Rows dated to the month get
    their fixed day.  Nodes stand at noon, moved by `rules.years`, and keep the authentic time as source_at.
    {incident} is the case's incident, the smallest id of several.  Rows of another label, or of none, are
    unsupported; repeated rows repeat their nodes, edges are distinct.
    """
    for name, kind in (("instrument_id", "string"), ("series_start", "date"), ("series_end", "date")):
        if name not in case.columns:
            case = case.withColumn(name, F.lit(None).cast(kind))
    ok = F.coalesce(F.col("event_label").isin(*ENCODED_LABELS), F.lit(False))
    rows = place_case_rows(case).where(ok).select(
        "position_id", "instrument_id", F.col("event_label").alias("label"), F.col("event_id").alias("row_id"),
        *PROPERTIES, F.inline(_ids(rules)))
    incident = rows.where("label = 'Incident'").groupBy(F.col("position_id").alias("of")).agg(F.min("event_id").alias("incident_id"))
    rows = rows.join(incident, F.col("position_id") == F.col("of"), "left").drop("of")

    def at(day: Column, years: int) -> Column:
        return F.add_months(day, 12 * years).cast("timestamp_ntz") + F.expr("interval 12 hours")

    own = rows.select(F.col("event_id").alias("id"), "label", "position_id", at(F.col("date"), rules.years).alias("at"),
                      at(F.col("date"), 0).alias("source_at"), *PROPERTIES, "deviation_bps", "pct_of_bid_ask")
    more = rows.select("*", F.inline(_by_label(rules.nodes, ("row", "node_label", "node", "days"), F.col("label"), F.col("row_id"))))
    day = F.date_add("date", F.col("days"))
    further = more.select(_filled("node").alias("id"), F.col("node_label").alias("label"), "position_id", at(day, rules.years).alias("at"),
                          at(day, 0).alias("source_at")).where("id is not null")
    links = rows.select("*", F.inline(_by_label(rules.edges, ("row", "src_id", "rel_type", "dst_id"), F.col("label"), F.col("row_id"))))
    edges = links.select(_filled("src_id").alias("src"), "rel_type", _filled("dst_id").alias("dst")).where(
        "src is not null and dst is not null").distinct()
    return own.unionByName(further, allowMissingColumns=True), edges, case.where(~ok)
