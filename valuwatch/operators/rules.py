"""Expected-versus-observed evaluation of the control obligations.

Every branch is built the same way:

* the answers of a trigger are reduced before they meet it (`first_responses`: one row per source
  event, map-side combined), or found by an as-of join when they belong to the position;
* neither depends on the clock or on a threshold.  Because the answer kept is the *earliest* one,
  "some answer by the deadline" equals "the earliest answer is by the deadline", so a branch is a
  table of facts (`settle`) and its status at a clock is a projection (`seen`).

Many clocks and many rule variants do not evaluate facts many times: see `steps`.
Rule values are literals: a rule set is a ten-row control table, held on the driver as `Rule`s.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import days, months, ts
from ..functions.ordered import asof, scan
from ..model import Book, Clocked, Rule

GAP = ("rule_id", "rule_name", "severity", "expected_control", "required_by_role", "position_id",
       "trigger_event_id", "trigger_at", "trigger_label", "due_by", "observed_event_id", "observed_at", "status")

# Review outcomes that count as addressing a divergence.
ADDRESSING_OUTCOMES = ("adjusted", "challenged", "explained")


def base_context(b: Book) -> tuple[Clocked, ...]:
    return (Clocked("base", b.as_of, b.rules),)


def with_rule(df: DataFrame, rule_id: str, contexts: tuple[Clocked, ...], **values: str) -> DataFrame | None:
    """Attach the rule's values to every row, once per context that has the rule.

    `values` maps output columns to fields of `Rule`.  Contexts are literals, so a single context
    adds no operator to the plan and several add one `explode`.
    """
    def lits(c: Clocked, r: Rule) -> list[Column]:
        return [F.lit(c.variant_id).alias("variant_id"), ts(c.as_of).alias("as_of"),
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"),
                F.lit(r.severity).alias("severity"), F.lit(r.required_control).alias("expected_control"),
                F.lit(r.required_by_role).cast("string").alias("required_by_role"),
                *[F.lit(getattr(r, field)).cast(_type(field)).alias(out) for out, field in values.items()]]

    rows = [lits(c, r) for c in contexts if (r := c.rule(rule_id)) is not None]
    if not rows:
        return None
    if len(rows) == 1:
        return df.select("*", *rows[0])
    return df.select("*", F.inline(F.array(*[F.struct(*r) for r in rows])))


def _type(field: str) -> str:
    if field in ("sla_days", "n", "window_days", "consecutive_days", "period_months", "regime_sla_days"):
        return "int"
    if field == "same_desk_allowed":
        return "boolean"
    return "string" if field == "applies_to" else "double"


def shape(df: DataFrame) -> DataFrame:
    """The contract columns plus the context they were evaluated in."""
    return df.select("variant_id", "as_of", *GAP)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def settle(rows: DataFrame, appears: Column | None, final: Column | None = None, final_from: Column | None = None,
           pending_until: Column | None = None) -> DataFrame:
    """Facts whose status follows from four columns, whatever the clock.

    A fact is there from `appears` (null: always).  It has its `final` status, if any, from `final_from`
    (null: from the start), and before that it is pending until `pending_until` and missed from then on.
    """
    return rows.select("*", (_none("timestamp_ntz") if appears is None else appears).alias("appears"),
                       (_none("string") if final is None else final).alias("final"),
                       (_none("timestamp_ntz") if final_from is None else final_from).alias("final_from"),
                       (_none("timestamp_ntz") if pending_until is None else pending_until).alias("pending_until"))


def status_at(clock: Column) -> Column:
    """Status of a settled fact at a clock."""
    known = F.col("final").isNotNull() & (F.col("final_from").isNull() | (F.col("final_from") <= clock))
    return F.when(known, F.col("final")).when(F.col("pending_until") > clock, "PENDING").otherwise("MISSED")


def seen(facts: DataFrame) -> DataFrame:
    """Settled facts at the clock of their context; an answer shows once the clock has reached it."""
    known = F.col("final_from").isNull() | (F.col("final_from") <= F.col("as_of"))
    here = facts.where("appears is null or appears <= as_of").withColumn("status", status_at(F.col("as_of")))
    return shape(here.withColumns({c: F.when(known, F.col(c)) for c in ("observed_event_id", "observed_at")}))


def _unobserved(rows: DataFrame) -> DataFrame:
    return rows.select("*", _none("string").alias("observed_event_id"), _none("timestamp_ntz").alias("observed_at"))


def first_responses(b: Book) -> DataFrame:
    """One row per source event: its earliest approval and escalation, and what evidence exists."""
    of_event = ~F.col("of_position")
    first = F.struct(F.col("event_at").alias("at"), F.col("response_id").alias("id"))
    return b.response.groupBy("source_event_id").agg(
        F.min(F.when(F.col("kind") == "Approval", first)).alias("approval"),
        F.min(F.when((F.col("kind") == "Escalation") & of_event, F.col("event_at"))).alias("escalated_at"),
        F.bool_or(F.col("kind") == "Challenge").alias("challenged"),
        F.bool_or(F.col("kind") == "Adjustment").alias("adjusted"),
    )


def _triggers(b: Book, label: str, *cols: str) -> DataFrame:
    return b.event.where(F.col("label") == label).select(
        "position_id", F.col("event_id").alias("trigger_event_id"), F.col("event_at").alias("trigger_at"),
        F.col("label").alias("trigger_label"), *cols)


def _answered(b: Book, triggers: DataFrame) -> DataFrame:
    return triggers.join(b.answers, F.col("trigger_event_id") == F.col("source_event_id"), "left").drop(
        "source_event_id")


def _effective() -> Column:
    return F.coalesce("effective_at", "event_at")


def facts_r1(b: Book, contexts) -> DataFrame | None:
    changes = _answered(b, _triggers(b, "MethodologyChange", _effective().alias("due_by")))
    rows = with_rule(changes, "R1", contexts)
    if rows is None:
        return None
    rows = rows.select("*", F.col("approval.id").alias("observed_event_id"), F.col("approval.at").alias("observed_at"))
    return settle(rows, F.col("trigger_at"),
                  F.when(F.col("approval.at") <= F.col("due_by"), "MET").when(F.col("approval").isNotNull(), "LATE"))


def _searched(rows: DataFrame) -> DataFrame:
    """Facts answered by a search with a deadline; the answer counts from when it was given."""
    rows = rows.select("*", F.col("found_id").alias("observed_event_id"), F.col("found_at").alias("observed_at"))
    final = F.when(F.col("found_at") <= F.col("due_by"), "MET").when(F.col("found_at").isNotNull(), "LATE")
    return settle(rows, F.col("trigger_at"), final, F.col("found_at"), F.col("due_by"))


def changes_reviewed(b: Book) -> DataFrame:
    """Methodology changes with the first review of the position after they took effect."""
    changes = _triggers(b, "MethodologyChange", _effective().alias("eff"))
    reviews = b.event.where("label = 'IPVReview'").select("position_id", "event_id", "event_at")
    return asof(changes, reviews, ["position_id"], "eff", "event_at",
                {"found_at": "event_at", "found_id": "event_id"}, forward=True, inclusive=False, ties=["event_id"])


def facts_r2(b: Book, contexts) -> DataFrame | None:
    rows = with_rule(changes_reviewed(b), "R2", contexts, sla="sla_days")
    return None if rows is None else _searched(rows.withColumn("due_by", F.col("eff") + days(F.col("sla"))))


def overrides_answered(b: Book) -> DataFrame:
    return _answered(b, _triggers(b, "PriceOverride", "deviation_bps", "pct_of_bid_ask"))


def facts_r3(b: Book, contexts) -> DataFrame | None:
    rows = with_rule(overrides_answered(b), "R3", contexts, sla="sla_days", bps="threshold_bps", pct="pct_of_bid_ask")
    if rows is None:
        return None
    beyond = (F.col("deviation_bps") > F.col("bps")) | (
        F.coalesce("pct_of_bid_ask", F.lit(0)) > F.col("pct"))
    rows = rows.where(beyond).withColumn("due_by", F.col("trigger_at") + days(F.col("sla"))).select(
        "*", F.col("approval.id").alias("observed_event_id"), F.col("approval.at").alias("observed_at"))
    challenged = F.coalesce("challenged", F.lit(False))
    final = (F.when((F.col("approval.at") <= F.col("due_by")) & challenged, "MET")
             .when(F.col("approval").isNotNull() & challenged, "LATE"))
    return settle(rows, F.col("trigger_at"), final, pending_until=F.when(challenged, F.col("due_by")))


def _escalations(b: Book) -> DataFrame:
    """Escalations reached from any override of the position or from the position itself."""
    return b.response.where(
        (F.col("kind") == "Escalation") & (F.col("of_position") | (F.col("source_label") == "PriceOverride"))
    ).select("position_id", F.col("event_at").alias("esc_at"))


def recurring(b: Book, contexts) -> DataFrame | None:
    """Overrides that are the n-th inside the window, with the first escalation from the window's start.

    Neither depends on the clock or on the days allowed.
    """
    values = {"sla": "sla_days", "need": "n", "window": "window_days"}
    overrides = with_rule(_triggers(b, "PriceOverride"), "R4", contexts, **values)
    if overrides is None:
        return None
    # one ordered pass over three kinds of rows: overrides that count (0), the opening of each
    # trigger's window (1), escalations (2).  An override counts up to its own instant, an opening
    # up to and including the excluded lower bound and looks ahead to the first escalation.
    # The values of a single context are attached again afterwards instead of being sent and sorted with the rows.
    single = sum(c.rule("R4") is not None for c in contexts) == 1
    ctx = [] if single else ["variant_id", "as_of"]
    carried = [] if single else ["sla", "need", "rule_id", "rule_name", "severity", "expected_control", "required_by_role"]
    counted = overrides.select("position_id", *ctx, F.col("trigger_at").alias("t"), F.lit(0).alias("side"),
                               F.lit(1).alias("k"), "trigger_event_id")
    openings = overrides.select(
        "position_id", *ctx, *carried, "trigger_event_id", "trigger_at",
        (F.col("trigger_at") - days(F.col("window"))).alias("t"), F.lit(1).alias("side"), F.lit(0).alias("k"))
    escalations = with_rule(_escalations(b), "R4", contexts).select(
        "position_id", *ctx, F.col("esc_at").alias("t"), F.lit(2).alias("side"), F.lit(0).alias("k"), "esc_at")
    rows = openings.unionByName(counted, allowMissingColumns=True).unionByName(escalations, allowMissingColumns=True)
    rows = scan(rows, ["position_id", *ctx], ["t", "side"], sums={"upto": "k"}, first={"next_esc": "esc_at"})
    found = (rows.where("side < 2").groupBy("position_id", *ctx, "trigger_event_id")
             .agg(*[F.max(c).alias(c) for c in ["trigger_at", *carried]],
                  F.max(F.when(F.col("side") == 0, F.col("upto"))).alias("now"),
                  F.max(F.when(F.col("side") == 1, F.col("upto"))).alias("before"),
                  F.max(F.when(F.col("side") == 1, F.col("next_esc"))).alias("next_esc"))
             .withColumn("trigger_label", F.lit("PriceOverride")))
    if single:
        found = with_rule(found, "R4", contexts, **values)
    return found.where("now - before >= need").withColumn("due_by", F.col("trigger_at") + days(F.col("sla")))


def rule_r4(b: Book, contexts) -> DataFrame | None:
    rows = recurring(b, contexts)
    if rows is None:
        return None
    rows = rows.where("trigger_at <= as_of").withColumn(
        "status", F.when(F.col("next_esc") <= F.col("due_by"), "MET")
        .when(F.col("due_by") > F.col("as_of"), "PENDING").otherwise("MISSED"))
    # one row per position: the first missed one, else the first one
    pick = F.min(F.struct((F.col("status") != "MISSED").alias("rank"), F.col("trigger_at").alias("at"),
                          F.col("trigger_event_id").alias("id"), F.col("due_by").alias("due"),
                          F.col("status").alias("st"))).alias("x")
    keep = ["variant_id", "as_of", "rule_id", "rule_name", "severity", "expected_control", "required_by_role",
            "position_id", "trigger_label"]
    return shape(rows.groupBy(*keep).agg(pick).select(
        *keep, F.col("x.id").alias("trigger_event_id"), F.col("x.at").alias("trigger_at"),
        F.col("x.due").alias("due_by"), _none("string").alias("observed_event_id"),
        _none("timestamp_ntz").alias("observed_at"), F.col("x.st").alias("status")))


def reviews_answered(b: Book) -> DataFrame:
    return _answered(b, _triggers(b, "IPVReview", "divergence_bps"))


def facts_r5(b: Book, contexts) -> DataFrame | None:
    rows = with_rule(reviews_answered(b), "R5", contexts, sla="sla_days", bps="divergence_bps")
    if rows is None:
        return None
    rows = rows.where("divergence_bps > bps").withColumn("due_by", F.col("trigger_at") + days(F.col("sla")))
    resolved = (F.coalesce(F.col("escalated_at") <= F.col("due_by"), F.lit(False))
                | F.coalesce("adjusted", F.lit(False)) | F.coalesce("challenged", F.lit(False)))
    return _resolved(rows, F.col("trigger_at"), resolved)


def _resolved(rows: DataFrame, appears: Column | None, resolved: Column) -> DataFrame:
    """Facts that are met from the start if resolved, and pending until they are due otherwise."""
    return settle(_unobserved(rows), appears, F.when(resolved, "MET"), pending_until=F.col("due_by"))


def signals_controlled(b: Book) -> DataFrame:
    """P&L signals with the first attribution control of the position from them on."""
    signals = _triggers(b, "PnLSignal", "unexplained_pct", "consecutive_days")
    controls = b.event.where("label = 'Control' and kind = 'attribution'").select("position_id", "event_id", "event_at")
    return asof(signals, controls, ["position_id"], "trigger_at", "event_at",
                {"found_at": "event_at", "found_id": "event_id"}, forward=True, inclusive=True, ties=["event_id"])


def facts_r6(b: Book, contexts) -> DataFrame | None:
    rows = with_rule(signals_controlled(b), "R6", contexts, sla="sla_days", pct="unexplained_threshold", run="consecutive_days")
    if rows is None:
        return None
    persistent = ((F.coalesce("unexplained_pct", F.lit(0.0)) >= F.col("pct"))
                  & (F.coalesce("consecutive_days", F.lit(0)) >= F.col("run")))
    return _searched(rows.where(persistent).withColumn("due_by", F.col("trigger_at") + days(F.col("sla"))))


def _in_scope(b: Book, contexts, **values: str) -> DataFrame | None:
    """Positions carrying the attribute rule R7 names, with R7's values."""
    held = b.attribute.where(F.col("ra_type").isin(
        sorted({r.applies_to.split("=")[0] for c in contexts if (r := c.rule("R7")) and r.applies_to})))
    rows = with_rule(held, "R7", contexts, scope="applies_to", **values)
    if rows is None:
        return None
    kv = F.split("scope", "=")
    rows = rows.where((F.col("ra_type") == kv[0]) & (F.col("ra_value") == kv[1])).withColumnRenamed(
        "entity_id", "position_id").drop("ra_type", "ra_value", "scope")
    return rows.join(b.position.select("position_id", "opened_at", "valid_to"), "position_id")


def rule_r7a(b: Book, contexts) -> DataFrame | None:
    scope = _in_scope(b, contexts, period="period_months")
    if scope is None:
        return None
    begin = F.col("as_of") - months(F.col("period"))
    scope = scope.where((F.col("valid_to").isNull() | (F.col("valid_to") > F.col("as_of"))) & (F.col("opened_at") <= begin))
    reviews = with_rule(b.event.where("label = 'MAPReview'").select("position_id", "event_id", "event_at"),
                        "R7", contexts, period="period_months")
    latest = (reviews.where((F.col("event_at") <= F.col("as_of")) & (F.col("event_at") > begin))
              .groupBy("position_id", "variant_id", "as_of")
              .agg(F.max(F.struct(F.col("event_at").alias("at"), F.col("event_id").alias("id"))).alias("seen")))
    return shape(scope.join(latest, ["position_id", "variant_id", "as_of"], "left").select(
        "*", F.col("position_id").alias("trigger_event_id"), F.col("opened_at").alias("trigger_at"),
        F.lit("Position").alias("trigger_label"), F.col("as_of").alias("due_by"),
        F.col("seen.id").alias("observed_event_id"), F.col("seen.at").alias("observed_at"),
        F.when(F.col("seen").isNotNull(), "MET").otherwise("MISSED").alias("status")))


def breaks_reviewed(b: Book, scope: DataFrame) -> DataFrame:
    """Positions of `scope` open at a regime break, with their first review after it."""
    breaks = F.array(*[F.struct(F.lit(i).alias("trigger_event_id"), ts(at).alias("trigger_at"))
                       for i, at in b.regime_breaks])
    at_break = scope.select("*", F.inline(breaks)).where(
        "opened_at <= trigger_at and (valid_to is null or valid_to > trigger_at)")
    reviews = b.event.where("label = 'MAPReview'").select("position_id", "event_at")
    return asof(at_break, reviews, ["position_id"], "trigger_at", "event_at", {"reviewed_at": "event_at"},
                forward=True, inclusive=False)


def facts_r7b(b: Book, contexts) -> DataFrame | None:
    scope = _in_scope(b, contexts, sla="regime_sla_days")
    if scope is None or not b.regime_breaks:
        return None
    rows = breaks_reviewed(b, scope).withColumn("due_by", F.col("trigger_at") + days(F.col("sla"))).withColumn(
        "trigger_label", F.lit("RegimeBreak"))
    return _resolved(rows, F.col("trigger_at"), F.col("reviewed_at") <= F.col("due_by"))


def facts_r8(b: Book, contexts) -> DataFrame | None:
    approvals = b.response.where("kind = 'Approval'").select(
        "position_id", F.col("source_event_id").alias("trigger_event_id"), F.col("source_label").alias("trigger_label"),
        F.col("response_id").alias("observed_event_id"), F.col("event_at").alias("observed_at"), "person_id")
    triggers = b.event.select(F.col("event_id").alias("trigger_event_id"), F.col("event_at").alias("trigger_at"))
    people = b.person.select("person_id", F.col("desk_id").alias("approver_desk"))
    books = b.position.select("position_id", "desk_id", "owner_id")
    paths = (approvals.join(people, "person_id").join(books, "position_id")
             .where((F.col("owner_id") == F.col("person_id")) | (F.col("approver_desk") == F.col("desk_id")))
             .join(triggers, "trigger_event_id"))
    rows = with_rule(paths, "R8", contexts, allowed="same_desk_allowed")
    if rows is None:
        return None
    return settle(rows.where("allowed = false").withColumn("due_by", F.col("observed_at")), F.col("observed_at"))


def facts_r9(b: Book, contexts) -> DataFrame | None:
    """Approvals and escalations one or two edges away from the position, without evidence.

    Two edges lead to an answer of one of the position's events, one edge to an escalation of the
    position itself; both carry the position already, so each node is seen once per position.
    """
    nodes = b.response.where("kind in ('Approval', 'Escalation') and not evidenced").select(
        "position_id", F.col("response_id").alias("trigger_event_id"), F.col("event_at").alias("trigger_at"),
        F.col("kind").alias("trigger_label"))
    rows = with_rule(nodes, "R9", contexts)
    if rows is None:
        return None
    return settle(_unobserved(rows.withColumn("due_by", F.col("trigger_at"))), F.col("trigger_at"))


def signals_addressed(b: Book) -> DataFrame:
    """Decorrelation signals with the nearest approved changes before and after, and the first addressing review."""
    answers = b.answers
    acts = (b.event.where("label in ('MethodologyChange', 'IPVReview')")
            .join(answers, F.col("event_id") == F.col("source_event_id"), "left"))
    is_change = F.col("label") == "MethodologyChange"
    approved = is_change & (F.col("approval.at") <= _effective())
    # a challenge of the review by someone is not evidence that the review addressed anything
    addressed = ~is_change & (F.col("outcome").isin(*ADDRESSING_OUTCOMES) | F.col("adjusted"))
    acts = acts.where(approved | addressed).select(
        "position_id", F.when(is_change, "change").otherwise("review").alias("act"),
        F.when(is_change, _effective()).otherwise(F.col("event_at")).alias("act_at"))
    # one ordered pass: acts stand before a signal of their instant to be found backward, after it to be found forward
    signals = _triggers(b, "DecorrelationSignal").withColumns({"t": F.col("trigger_at"), "side": F.lit(1)})
    change = F.col("act") == "change"
    placed = acts.select("position_id", F.col("act_at").alias("t"), "act", "act_at", F.explode(F.array(F.lit(0), F.lit(2))).alias("side")).select(
        "position_id", "t", "side", F.when(change & (F.col("side") == 0), F.col("act_at")).alias("before"),
        F.when(change & (F.col("side") == 2), F.col("act_at")).alias("after"),
        F.when(~change & (F.col("side") == 2), F.col("act_at")).alias("review"))
    found = scan(signals.unionByName(placed, allowMissingColumns=True), ["position_id"], ["t", "side"],
                 last={"changed_before": "before"}, first={"changed_after": "after", "reviewed_after": "review"})
    return found.where("side = 1").drop("t", "side", "before", "after", "review")


def facts_r10(b: Book, contexts) -> DataFrame | None:
    rows = with_rule(signals_addressed(b), "R10", contexts, sla="sla_days")
    if rows is None:
        return None
    rows = rows.withColumn("due_by", F.col("trigger_at") + days(F.col("sla")))
    met = [F.coalesce(c, F.lit(False)) for c in (
        F.col("changed_before") >= F.col("trigger_at") - days(F.col("sla")),
        F.col("changed_after") <= F.col("due_by"), F.col("reviewed_after") <= F.col("due_by"))]
    return _resolved(rows, F.col("trigger_at"), met[0] | met[1] | met[2])


def _branch(facts):
    def rule(b: Book, contexts) -> DataFrame | None:
        rows = facts(b, contexts)
        return None if rows is None else seen(rows)

    return rule


rule_r1, rule_r2, rule_r3, rule_r5, rule_r6, rule_r7b, rule_r8, rule_r9, rule_r10 = map(
    _branch, (facts_r1, facts_r2, facts_r3, facts_r5, facts_r6, facts_r7b, facts_r8, facts_r9, facts_r10))

BRANCHES = {
    "R1": (rule_r1,), "R2": (rule_r2,), "R3": (rule_r3,), "R4": (rule_r4,), "R5": (rule_r5,), "R6": (rule_r6,),
    "R7": (rule_r7a, rule_r7b), "R8": (rule_r8,), "R9": (rule_r9,), "R10": (rule_r10,),
}


def evaluate(b: Book, contexts: tuple[Clocked, ...], rule: str | None = None, pos: str | None = None) -> DataFrame:
    """All branches in all contexts; `rule` and `pos` narrow the inputs, not the result."""
    if pos is not None:
        b = b.with_(event=b.event.where(F.col("position_id") == pos),
                    response=b.response.where(F.col("position_id") == pos),
                    position=b.position.where(F.col("position_id") == pos),
                    attribute=b.attribute.where(F.col("entity_id") == pos))
    chosen = [f for r, fs in BRANCHES.items() if rule in (None, r) for f in fs]
    parts = [p for f in chosen if (p := f(b, contexts)) is not None]
    if not parts:
        raise ValueError("no rule of the set has an evaluation branch")
    return reduce(DataFrame.unionByName, parts)


def expected_controls(b: Book, as_of: str | None = None, pos: str | None = None, rule: str | None = None) -> DataFrame:
    contexts = (Clocked("base", as_of or b.as_of, b.rules),)
    return evaluate(b, contexts, rule, pos).select(*GAP)


def one_rule(b: Book, branch, as_of: str | None = None) -> DataFrame:
    return branch(b, (Clocked("base", as_of or b.as_of, b.rules),)).select(*GAP)


def governance_gaps(controls: DataFrame) -> DataFrame:
    return controls.where(F.col("status").isin("MISSED", "LATE"))


def gap_materialise(b: Book) -> DataFrame:
    """Concrete gaps keyed by rule, position and trigger; several rows of one key collapse."""
    gap_id = F.concat_ws("-", F.lit("GAP"), "rule_id", "position_id", F.coalesce("trigger_event_id", F.lit("x")))
    # a flag and an instant are reduced by hashing, the least of two texts would be by sorting; the id follows from the key
    return (governance_gaps(b.controls)
            .groupBy("rule_id", "position_id", "trigger_event_id", "severity")
            .agg(F.bool_or(F.col("status") == "LATE").alias("late"), F.min("due_by").alias("due_by"))
            .select(gap_id.alias("gap_id"), "rule_id", "position_id", "trigger_event_id",
                    F.when(F.col("late"), "LATE").otherwise("MISSED").alias("status"), "severity", "due_by",
                    ts(b.as_of).alias("computed_at")))


STATUSES = ("MET", "LATE", "MISSED", "PENDING")


def rule_table(b: Book) -> DataFrame:
    """The obligations as rows: inlined literals, so their size is known to the planner."""
    rows = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name")) for r in b.rules]
    return b.spark.range(1).select(F.inline(F.array(*rows)))


def gap_summary(b: Book, controls: DataFrame) -> DataFrame:
    """Counts per rule and status, zero-filled for every obligation."""
    counts = controls.groupBy("rule_id").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    return rule_table(b).join(counts, "rule_id", "left").select(
        "rule_id", "rule_name", *[F.coalesce(s.lower(), F.lit(0)).alias(s.lower()) for s in STATUSES])
