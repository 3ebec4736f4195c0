"""The book as nodes and typed edges, and what is asked of them as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Book
from .events import label_edges

SCHEMA_TOP = 30
# Fixed value: labels whose nodes have a name; the caption of every other node is its id.
NAMED = ("Position", "Person", "Desk", "Instrument")


def _edge(df: DataFrame, src: Column, rel: str, dst: Column, a: str | Column, z: str | Column) -> DataFrame:
    def lit(x):
        return F.lit(x) if isinstance(x, str) else x

    return df.select(src.alias("src"), F.lit(rel).alias("rel_type"), dst.alias("dst"), lit(a).alias("from_label"),
                     lit(z).alias("to_label")).where("src is not null and dst is not null")


def edges(b: Book) -> DataFrame:
    """Every typed edge except NEXT: src, rel_type, dst, from_label, to_label."""
    c = F.col
    r, p = b.response, b.position
    evidence = F.concat(F.lit("EVD-"), "response_id")
    parts = [
        label_edges(b.event),
        _edge(b.event, c("event_id"), "PERFORMED_BY", c("performer_id"), c("label"), "Person"),
        _edge(r.where("kind = 'Approval'"), c("source_event_id"), "APPROVED_BY", c("response_id"), c("source_label"), "Approval"),
        _edge(r.where("kind = 'Approval'"), c("response_id"), "APPROVED_BY", c("person_id"), "Approval", "Person"),
        _edge(r.where("kind = 'Escalation' and not of_position"), c("source_event_id"), "ESCALATED_TO", c("response_id"),
              c("source_label"), "Escalation"),
        _edge(r.where("kind = 'Escalation' and of_position"), c("position_id"), "ESCALATED_TO", c("response_id"),
              "Position", "Escalation"),
        _edge(r.where("kind = 'Challenge'"), c("source_event_id"), "CHALLENGED_BY", c("response_id"), c("source_label"), "IPVReview"),
        _edge(r.where("kind = 'Adjustment'"), c("source_event_id"), "EVIDENCED_BY", c("response_id"), c("source_label"), "Evidence"),
        _edge(r.where("kind in ('Approval', 'Escalation') and evidenced"), c("response_id"), "EVIDENCED_BY", evidence,
              c("kind"), "Evidence"),
        _edge(p, c("position_id"), "OF_INSTRUMENT", c("instrument_id"), "Position", "Instrument"),
        _edge(p, c("position_id"), "OWNED_BY", c("owner_id"), "Position", "Person"),
        _edge(p, c("position_id"), "ON_DESK", c("desk_id"), "Position", "Desk"),
        _edge(p, c("position_id"), "VALUED_BY", c("methodology_id"), "Position", "ValuationMethodology"),
        _edge(b.person, c("person_id"), "ON_DESK", c("desk_id"), "Person", "Desk"),
        _edge(b.attribute, c("entity_id"), "HAS_RISK_ATTRIBUTE", F.concat_ws("-", F.lit("RA"), "ra_type", "ra_value"),
              "Position", "RiskAttribute"),
        _edge(b.incident, c("incident_id"), "CAUSED_BY", c("position_id"), "Incident", "Position"),
    ]
    return reduce(DataFrame.unionByName, parts)


def nodes(b: Book) -> DataFrame:
    """id, label, caption of every node."""
    def node(df, i, label, caption=None):
        return df.select(F.col(i).alias("id"), label.alias("label") if isinstance(label, Column) else F.lit(label).alias("label"),
                         F.coalesce(caption if caption is not None else F.col(i), F.col(i)).alias("caption"))

    ra = F.concat_ws("-", F.lit("RA"), "ra_type", "ra_value")
    parts = [
        node(b.event, "event_id", F.col("label")),
        node(b.response, "response_id", F.when(F.col("kind") == "Challenge", "IPVReview")
             .when(F.col("kind") == "Adjustment", "Evidence").otherwise(F.col("kind"))),
        node(b.response.where("kind in ('Approval', 'Escalation') and evidenced").select(
            F.concat(F.lit("EVD-"), "response_id").alias("x")), "x", "Evidence"),
        node(b.position, "position_id", "Position", F.col("name")),
        node(b.person, "person_id", "Person", F.col("name")),
        node(b.desk, "desk_id", "Desk", F.col("name")),
        node(b.instrument, "instrument_id", "Instrument", F.col("name")),
        node(b.position.select("methodology_id").distinct(), "methodology_id", "ValuationMethodology"),
        node(b.attribute.select(ra.alias("x")).distinct(), "x", "RiskAttribute"),
        node(b.incident, "incident_id", "Incident"),
    ]
    return reduce(DataFrame.unionByName, parts)


def gap_edges(gaps: DataFrame) -> DataFrame:
    """Edges of the gap table, which keeps them as columns."""
    c = F.col
    parts = [_edge(gaps, c("gap_id"), "OF_RULE", c("rule_id"), "GovernanceGap", "ControlObligation"),
             _edge(gaps, c("gap_id"), "ON_POSITION", c("position_id"), "GovernanceGap", "Position"),
             _edge(gaps, c("gap_id"), "INSTANCE_OF", F.concat(F.lit("GAPCLASS-"), "rule_id"), "GovernanceGap", "GovernanceGap"),
             _edge(gaps, c("gap_id"), "ON_TRIGGER", c("trigger_event_id"), "GovernanceGap", "Event")]
    return reduce(DataFrame.unionByName, parts)


def check_unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_ids(entities: DataFrame) -> DataFrame:
    """Violations of "an id is unique within its label", for all labels of (label, id) rows in one grouping.

    Rows are counted before they are shuffled, so a label or id with very many rows is one row a task.
    """
    return check_unique(entities, "label", "id").select("label", "id", "n")


def label_counts(b: Book) -> DataFrame:
    return nodes(b).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def schema_triples(e: DataFrame, labels: tuple[str, ...] | None = None, top: int = SCHEMA_TOP) -> DataFrame:
    if labels:
        e = e.where(F.col("from_label").isin(*labels) & F.col("to_label").isin(*labels))
    return (e.groupBy("from_label", "rel_type", "to_label").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "from_label", "rel_type", "to_label").limit(top))


def node_summary(e: DataFrame, n: DataFrame, sample: int = 4) -> DataFrame:
    """Per node, edge type and direction: how many neighbours, and the first few of them by id.

    Counting combines map-side; the sample is a ranked cut, which Spark also prunes before the
    shuffle, so a hub with a huge neighbourhood sends only a few rows per task.  Only samples with a
    neighbour of a label in NAMED are sent on to look up captions; elsewhere the id is the caption.
    """
    def half(this: str, way: str, that: str, label: str) -> DataFrame:
        return e.select(F.col(this).alias("id"), "rel_type", F.lit(way).alias("dir"), F.col(that).alias("other"),
                        F.col(label).isin(*NAMED).alias("named"))

    both = half("src", "out", "dst", "to_label").unionByName(half("dst", "in", "src", "from_label"))
    key = ["id", "rel_type", "dir"]
    counts = both.groupBy(*key).agg(F.count(F.lit(1)).alias("cnt"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("other"))
    few = both.withColumn("rank", rank).where(F.col("rank") <= sample).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("other", "named"))).alias("few"))
    found = counts.join(few, key)
    known = F.exists("few", lambda x: x.named)
    plain = found.where(~known).select(*key, "cnt", F.array_join("few.other", ", ").alias("sample"))
    asked = found.where(known).select(*key, "cnt", F.posexplode("few").alias("at", "x")).select(*key, "cnt", "at", F.col("x.other").alias("other"))
    captions = n.where(F.col("label").isin(*NAMED)).select(F.col("id").alias("other"), "caption")
    names = asked.join(captions, "other", "left").groupBy(*key, "cnt").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("caption", "other").alias("c")))), lambda x: x.c), ", ").alias("sample"))
    return plain.unionByName(names)
