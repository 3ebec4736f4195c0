"""Scenario queries over the whole population: conjunction, chronology, abstraction, read-across."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import elapsed_days
from ..functions.ordered import neighbour, row_numbers
from ..model import Book
from ..session import written
from . import graph

# Edge types shown around a position, attribute types a pattern keeps, caption length.
SHOWN = ("OVERRIDDEN_BY", "GENERATED_SIGNAL", "CHANGED_TO", "REVIEWED_BY", "SUBJECT_TO_CONTROL", "ESCALATED_TO",
         "OWNED_BY", "ON_DESK", "VALUED_BY", "OF_INSTRUMENT")
PATTERN_TYPES = ("methodologyFamily", "liquidityTier", "maturityBucket")
CAPTION = 28
COUNTED = {"signals": "PnLSignal", "overrides": "PriceOverride", "method_changes": "MethodologyChange"}
MAX_HOPS = 10


def _rules_of(gaps: DataFrame) -> DataFrame:
    """Distinct broken rules per position; at most one entry per obligation."""
    return gaps.groupBy("position_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def list_positions(b: Book, gaps: DataFrame) -> DataFrame:
    counts = gaps.groupBy("position_id").agg(F.count(F.lit(1)).alias("gap_count"))
    return (b.position.join(b.desk.select("desk_id", F.col("name").alias("desk_name")), "desk_id")
            .join(b.instrument.select("instrument_id", "sector"), "instrument_id", "left")
            .join(counts, "position_id", "left")
            .select(F.col("position_id").alias("id"), "name", F.col("desk_id").alias("desk"), "desk_name", "sector",
                    F.coalesce("gap_count", F.lit(0)).alias("gap_count"))
            .orderBy(F.desc("gap_count"), "id"))


def conjunction(b: Book, gaps: DataFrame, top: int | None = None) -> DataFrame:
    """Weak signals per position times the number of rules it breaks.

    Each side is aggregated before it meets the positions, so counts do not multiply.
    """
    counts = b.event.where(F.col("label").isin(*COUNTED.values())).groupBy("position_id").agg(
        *[F.count_if(F.col("label") == label).alias(out) for out, label in COUNTED.items()])
    rules = F.coalesce("rules", F.array().cast("array<string>"))
    out = (b.position.select("position_id", "name", "desk_id")
           .join(b.desk.select("desk_id", F.col("name").alias("desk")), "desk_id")
           .join(counts, "position_id", "left").join(_rules_of(gaps), "position_id", "left")
           .select("position_id", "name", "desk", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTED],
                   F.array_join(rules, ",").alias("broken_rules"), F.size(rules).alias("rule_count")))
    out = out.withColumn("conjunction_score", (F.col("signals") + F.col("overrides") + F.col("method_changes"))
                         * F.col("rule_count"))
    return out if top is None else out.orderBy(F.desc("conjunction_score"), "position_id").limit(top)


def neighborhood(b: Book, gaps: DataFrame) -> DataFrame:
    """Distinct edges one hop around every position, two for its approval chains: position_id, f, t, ty."""
    c = F.col
    direct = graph.edges(b).where(c("rel_type").isin(*SHOWN) & (c("from_label") == "Position")).select(
        c("src").alias("position_id"), c("src").alias("f"), c("dst").alias("t"), c("rel_type").alias("ty"))
    chain = b.response.where("kind = 'Approval' and source_label in ('PriceOverride', 'MethodologyChange')").select(
        "position_id", F.inline(F.array(
            F.struct(c("source_event_id").alias("f"), c("response_id").alias("t")),
            F.struct(c("response_id").alias("f"), c("person_id").alias("t")))), F.lit("APPROVED_BY").alias("ty"))
    broken = gaps.select("position_id", c("gap_id").alias("f"), c("position_id").alias("t"), F.lit("ON_POSITION").alias("ty"))
    return reduce(DataFrame.unionByName, [direct, chain, broken]).distinct()


def conjunction_members(b: Book, gaps: DataFrame) -> DataFrame:
    """Ids that make up each position's conjunction: position_id, id."""
    c = F.col
    counted = b.event.where(c("label").isin("PriceOverride", "PnLSignal", "DecorrelationSignal", "MethodologyChange")).select(
        "position_id", c("event_id").alias("id"))
    dated = b.chronology.select(c("event_id").alias("id"))
    triggers = gaps.select("position_id", c("trigger_event_id").alias("id")).distinct().join(dated, "id", "left_semi")
    core = counted.unionByName(triggers.select("position_id", "id")).distinct()
    gap_ids = gaps.select("position_id", c("gap_id").alias("id"))
    performers = core.join(b.event.select(c("event_id").alias("id"), "performer_id"), "id").select(
        "position_id", c("performer_id").alias("id"))
    approvals = core.join(b.response.where("kind = 'Approval'").select(
        c("source_event_id").alias("id"), "response_id", "person_id"), "id").select(
        "position_id", F.explode(F.array("response_id", "person_id")).alias("id"))
    own = b.position.select("position_id", c("position_id").alias("id"))
    return reduce(DataFrame.unionByName, [own, core, gap_ids, performers, approvals]).distinct()


def _captioned(b: Book, gaps: DataFrame) -> DataFrame:
    """Every node that can be shown, concrete gaps among them."""
    return graph.nodes(b).unionByName(gaps.select(F.col("gap_id").alias("id"), F.lit("GovernanceGap").alias("label"),
                                                  F.col("gap_id").alias("caption")))


def neighborhood_nodes(b: Book, gaps: DataFrame) -> DataFrame:
    """The nodes of every neighbourhood: position_id, id, label, caption."""
    ids = neighborhood(b, gaps).select("position_id", F.explode(F.array("f", "t")).alias("id")).distinct()
    return ids.join(_captioned(b, gaps), "id").select("position_id", "id", "label", "caption")


def conjunction_paint(b: Book, gaps: DataFrame) -> DataFrame:
    """Nodes of every neighbourhood, greyed where they are outside the conjunction."""
    members = conjunction_members(b, gaps).withColumn("member", F.lit(True))
    return neighborhood_nodes(b, gaps).join(members, ["position_id", "id"], "left").select(
        "position_id", "id", "label",
        F.when(F.length("caption") > CAPTION, F.concat(F.substring("caption", 1, CAPTION), F.lit("…")))
        .otherwise(F.col("caption")).alias("caption"),
        F.col("member").isNull().alias("grey"))


def conjunction_paint_edges(b: Book, gaps: DataFrame) -> DataFrame:
    """Edges of every neighbourhood between nodes that are shown: position_id, f, t, ty."""
    shown = _captioned(b, gaps).select("id").distinct()
    near = neighborhood(b, gaps)
    return near.join(shown, near.f == shown.id, "left_semi").join(shown, near.t == shown.id, "left_semi")


def chain_events(b: Book) -> DataFrame:
    """Everything in a position's chain: its chronology and its marks."""
    marks = b.mark.select(
        F.concat_ws("-", F.lit("MK"), "position_id", "day").alias("event_id"), F.lit("Mark").alias("label"), "position_id",
        (F.col("day").cast("timestamp_ntz") + F.expr("interval 17 hours")).alias("event_at"))
    return b.chronology.select("event_id", "label", "position_id", "event_at", "source_at", "description").unionByName(
        marks, allowMissingColumns=True)


def timeline(b: Book, pos: str | None = None) -> DataFrame:
    """Chronology without marks; the day delta is to the previous chain event, marks included."""
    rows = chain_events(b)
    if pos is not None:
        rows = rows.where(F.col("position_id") == pos)
    rows = neighbour(rows, ["position_id"], ["event_at", "event_id"], {"prev_at": "event_at"})
    return rows.where("label <> 'Mark'").select(
        "position_id", F.col("event_id").alias("id"), "label", F.col("event_at").alias("at_time"), "source_at", "description",
        elapsed_days(F.col("prev_at"), F.col("event_at")).alias("time_delta_days"))


def chain_paths(b: Book, max_hops: int = MAX_HOPS) -> DataFrame:
    """Override to IPV review pairs at most `max_hops` chain steps apart.

    The chain is a line, so a path is a pair of places in it.  Places are dealt to blocks as long as a path:
    the reviews an override reaches stand in its own block or the next, so the chain is ordered once and a
    block lists few rows.
    """
    kind = F.when(F.col("label") == "PriceOverride", 0).when(F.col("label") == "IPVReview", 1)
    placed = row_numbers(chain_events(b).select("position_id", "event_id", kind.alias("kind"), "event_at"),
                         ["position_id"], ["event_at", "event_id"], "place").where("position_id is not null and kind is not null")
    block = F.floor(F.col("place") / max_hops)
    blocks = F.when(F.col("kind") == 0, F.array(block, block + 1)).otherwise(F.array(block))
    rows = placed.select("position_id", "kind", F.struct("place", "event_id", "event_at").alias("e"),
                         F.explode(blocks).alias("block")).repartition("position_id", "block")
    met = rows.groupBy("position_id", "block").agg(*[
        F.collect_list(F.when(F.col("kind") == k, F.col("e"))).alias(name) for k, name in enumerate(("overrides", "reviews"))])
    pairs = met.select("position_id", F.explode("overrides").alias("a"), "reviews").select(
        "position_id", "a", F.explode("reviews").alias("z"))
    hops = F.col("z.place") - F.col("a.place")
    return pairs.where(hops.between(1, max_hops)).select(
        "position_id", F.col("a.event_id").alias("from_id"), F.col("z.event_id").alias("to_id"), hops.cast("int").alias("hops"),
        elapsed_days(F.col("a.event_at"), F.col("z.event_at")).alias("days_between"))


def who_approved(b: Book, event: str | None = None) -> DataFrame:
    approvals = b.response.where("kind = 'Approval'")
    if event is not None:
        approvals = approvals.where(F.col("source_event_id") == event)
    people = b.person.select("person_id", F.col("name").alias("approver"), F.col("role").alias("approver_role"),
                             F.col("desk_id").alias("approver_desk"))
    return (approvals.join(people, "person_id", "left")
            .join(b.position.select("position_id", F.col("desk_id").alias("position_desk")), "position_id", "left")
            .select("source_event_id", F.col("response_id").alias("approval_id"), F.col("event_at").alias("approved_at"),
                    "approver", "approver_role", "approver_desk", "position_desk",
                    F.coalesce(F.col("approver_desk") == F.col("position_desk"), F.lit(False)).alias("same_desk"), "evidenced"))


def divergence_history(b: Book, observed: DataFrame, compared: DataFrame) -> DataFrame:
    """Observed prices of each position's instrument with the model price paired to them, if any."""
    rows = observed.join(compared.select("instrument_id", "day", "proxy", "divergence_bps"), ["instrument_id", "day"], "left")
    return b.position.select("position_id", "instrument_id").join(rows, "instrument_id").select(
        "position_id", "day", F.col("pr").alias("observed"), "proxy", "divergence_bps")


def near_misses(b: Book, gaps: DataFrame, min_rules: int = 2, top: int = 25) -> DataFrame:
    """The `top` positions breaking most rules among those without a confirmed incident."""
    rules = _rules_of(gaps.join(b.incident.select("position_id"), "position_id", "left_anti"))
    return (rules.where(F.size("rules") >= min_rules).join(b.position.select("position_id", "name", "desk_id"), "position_id")
            .join(b.desk.select("desk_id", F.col("name").alias("desk")), "desk_id")
            .select("position_id", "name", "desk", F.array_join("rules", ",").alias("rules"), F.size("rules").alias("rule_count"))
            .orderBy(F.desc("rule_count"), "position_id").limit(top))


def facts(b: Book, gaps: DataFrame) -> DataFrame:
    """What a position satisfies: attribute links and classes of its concrete gaps."""
    attrs = b.attribute.select(F.col("entity_id").alias("position_id"),
                               F.concat_ws("-", F.lit("RA"), "ra_type", "ra_value").alias("target_id"),
                               F.concat_ws("=", "ra_type", "ra_value").alias("name"), "ra_type", F.lit(False).alias("is_gap"))
    classes = gaps.select("position_id", F.concat(F.lit("GAPCLASS-"), "rule_id").alias("target_id"),
                          F.col("rule_id").alias("name"), F.lit(None).cast("string").alias("ra_type"), F.lit(True).alias("is_gap"))
    return attrs.unionByName(classes).distinct()


def pattern_extract(b: Book, gaps: DataFrame) -> DataFrame:
    """What each confirmed incident abstracts to: incident_id, target_id, name, is_gap."""
    kept = facts(b, gaps).where(F.col("is_gap") | F.col("ra_type").isin(*PATTERN_TYPES))
    return b.incident.join(kept, "position_id").select("incident_id", "target_id", "name", "is_gap").distinct()


def pattern_candidates(b: Book, gaps: DataFrame) -> DataFrame:
    """Everything a pattern may require: all attributes and a class for every obligation."""
    attrs = facts(b, gaps).where("not is_gap").select("target_id", "name", "is_gap").distinct()
    classes = b.spark.range(1).select(F.explode(F.array(*[F.lit(r.rule_id) for r in b.rules])).alias("name")).select(
        F.concat(F.lit("GAPCLASS-"), "name").alias("target_id"), "name", F.lit(True).alias("is_gap"))
    return attrs.unionByName(classes)


def read_across(b: Book, gaps: DataFrame, pattern: DataFrame) -> DataFrame:
    """Share of a pattern each position satisfies.

    Only satisfied facts are joined, on the target; what is missing is the rest of the pattern, which
    is a bounded list.  An empty pattern gives no rows.
    """
    met = facts(b, gaps).join(pattern.select("target_id"), "target_id", "left_semi").groupBy("position_id").agg(
        F.array_sort(F.collect_set("name")).alias("met"))
    wanted = pattern.agg(F.array_sort(F.collect_set("name")).alias("names")).scalar()
    incidents = b.incident.select("position_id").distinct().withColumn("confirmed", F.lit(True))
    rows = (b.position.select("position_id", "name", "desk_id")
            .join(b.desk.select("desk_id", F.col("name").alias("desk")), "desk_id")
            .join(met, "position_id", "left").join(incidents, "position_id", "left")
            .withColumn("wanted", wanted).where(F.size("wanted") > 0)
            .withColumn("met", F.coalesce("met", F.array().cast("array<string>"))))
    return rows.select("position_id", "name", "desk", F.array_join("met", ",").alias("satisfied"),
                       F.array_join(F.array_except("wanted", "met"), ",").alias("missing"),
                       F.round(F.size("met") / F.size("wanted"), 6).alias("score"),
                       F.coalesce("confirmed", F.lit(False)).alias("confirmed_incident"))


def _profile(df: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): md5 of the sorted targets of each key; a key has no more targets than attributes and rules."""
    return df.groupBy(key).agg(F.md5(F.array_join(F.array_sort(F.collect_set("target_id")), ",")).alias(out))


def read_across_all(b: Book, gaps: DataFrame) -> DataFrame:
    """The read-across of every incident: pattern_id, incidents, profile_id, positions, satisfied, total, score.

    Incidents with one pattern and positions with one profile (the same targets among those of any pattern)
    are one row each, so incidents never meet positions: the result grows with the patterns and profiles
    there are.  Profiles that meet no target of a pattern are left out.
    """
    wanted = written(pattern_extract(b, gaps).select("incident_id", "target_id").distinct(), "incident-patterns")
    known = written(facts(b, gaps).select("position_id", "target_id").distinct().join(
        wanted.select("target_id").distinct(), "target_id", "left_semi"), "position-targets")
    of_incident, of_position = _profile(wanted, "incident_id", "pattern_id"), _profile(known, "position_id", "profile_id")
    patterns = wanted.join(of_incident, "incident_id").select("pattern_id", "target_id").distinct()
    profiles = known.join(of_position, "position_id").select("profile_id", "target_id").distinct()
    incidents = of_incident.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("incidents"))
    positions = of_position.groupBy("profile_id").agg(F.count(F.lit(1)).alias("positions"))
    totals = patterns.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("total"))
    met = patterns.join(profiles, "target_id").groupBy("pattern_id", "profile_id").agg(F.count(F.lit(1)).alias("satisfied"))
    return met.join(incidents, "pattern_id").join(positions, "profile_id").join(totals, "pattern_id").select(
        "pattern_id", "incidents", "profile_id", "positions", "satisfied", "total", F.round(F.col("satisfied") / F.col("total"), 6).alias("score"))


def pattern_sweep(b: Book, gaps: DataFrame, pattern: DataFrame, candidates: DataFrame) -> DataFrame:
    """Score distribution of the population under every pattern with one target removed or added.

    A variant moves a position's score only through the changed target, so the population is
    reduced once to (changed target, targets of the base pattern met) counts; positions never meet variants.
    """
    known = facts(b, gaps).select("position_id", "target_id")
    met = known.join(pattern.select("target_id"), "target_id", "left_semi").groupBy("position_id").agg(
        F.count(F.lit(1)).alias("met"))
    level = b.position.select("position_id").join(met, "position_id", "left").select(
        "position_id", F.coalesce("met", F.lit(0)).alias("met"))
    holding = known.join(level, "position_id").groupBy("target_id", "met").agg(F.count(F.lit(1)).alias("holding"))
    # one entry per number of targets met, so never longer than the pattern plus one
    levels = level.groupBy("met").agg(F.count(F.lit(1)).alias("everyone")).agg(
        F.collect_list(F.struct("met", "everyone"))).scalar()
    n = pattern.agg(F.count(F.lit(1))).scalar()
    changes = candidates.select("target_id").join(
        pattern.select("target_id").withColumn("inside", F.lit(True)), "target_id", "left").select(
        "target_id", F.coalesce("inside", F.lit(False)).alias("inside"), F.inline(levels))
    rows = changes.join(holding, ["target_id", "met"], "left").withColumn("holding", F.coalesce("holding", F.lit(0)))
    step = F.when(F.col("inside"), -1).otherwise(1)
    total = n + step
    split = F.array(F.struct((F.col("met") + step).alias("satisfied"), F.col("holding").alias("k")),
                    F.struct(F.col("met").alias("satisfied"), (F.col("everyone") - F.col("holding")).alias("k")))
    return (rows.select(F.concat(F.when(F.col("inside"), "-").otherwise("+"), "target_id").alias("variant_id"),
                        F.col("target_id").alias("changed_target"), total.alias("total"), F.inline(split))
            .where("k > 0").groupBy("variant_id", "changed_target", "satisfied", "total")
            .agg(F.sum("k").alias("positions"))
            .withColumn("score", F.round(F.try_divide(F.col("satisfied"), F.col("total")), 6)))


def price_structure(b: Book) -> DataFrame:
    return (b.position.join(b.instrument.select("instrument_id", F.col("name").alias("instrument")), "instrument_id", "left")
            .join(b.desk.select("desk_id", F.col("name").alias("desk")), "desk_id", "left")
            .join(b.person.select(F.col("person_id").alias("owner_id"), F.col("name").alias("owner")), "owner_id", "left")
            .select("position_id", "instrument_id", "instrument", "desk_id", "desk", "owner_id", "owner", "methodology_id"))


def signal_reveal(b: Book, gaps: DataFrame) -> DataFrame:
    """What is revealed per kind: signals, overrides, changes, reviews, and gaps with their trigger."""
    kinds = {"PnLSignal": "pnl", "PriceOverride": "override", "MethodologyChange": "change", "IPVReview": "review",
             "MAPReview": "review"}
    kind = reduce(lambda acc, kv: acc.when(F.col("label") == kv[0], kv[1]), kinds.items(), F.when(F.lit(False), F.lit("")))
    value = (F.when(F.col("label") == "PnLSignal", F.col("unexplained_pct"))
             .when(F.col("label") == "PriceOverride", F.col("deviation_bps").cast("double"))
             .when(F.col("label") == "IPVReview", F.col("divergence_bps").cast("double")))
    events = b.event.where(F.col("label").isin(*kinds)).select(
        "position_id", kind.alias("kind"), F.col("event_id").alias("id"), F.col("event_at").alias("at_time"), value.alias("value"))
    # trigger times are needed for the triggers that are events; R7 triggers on the position itself
    broken = gaps.join(b.chronology.select(F.col("event_id").alias("trigger_event_id"), "event_at"), "trigger_event_id", "left").select(
        "position_id", F.lit("gap").alias("kind"), F.col("gap_id").alias("id"), F.col("event_at").alias("at_time"),
        F.lit(None).cast("double").alias("value"))
    return events.unionByName(broken)
