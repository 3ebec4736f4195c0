"""The canonical tables every operator works on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import written

# Event labels, and the edge type that ties a position to each of them.
POSITION_EDGE = {
    "MethodologyChange": "CHANGED_TO",
    "PriceOverride": "OVERRIDDEN_BY",
    "PnLSignal": "GENERATED_SIGNAL",
    "DecorrelationSignal": "GENERATED_SIGNAL",
    "Control": "SUBJECT_TO_CONTROL",
    "IPVReview": "REVIEWED_BY",
    "MAPReview": "REVIEWED_BY",
    "Escalation": "ESCALATED_TO",
    "Approval": "APPROVED_BY",
    "Incident": "CAUSED_BY",
    "CorrectiveAction": "MITIGATED_BY",
}

AS_OF = "2001-01-01"


@dataclass(frozen=True)
class Rule:
    """One control obligation with its thresholds; None where a rule has no such threshold."""

    rule_id: str
    name: str
    timing: str
    sla_days: int
    severity: str
    required_control: str
    required_by_role: str | None
    trigger_event: str
    gap_definition: str
    applies_to: str | None = None
    threshold_bps: float | None = None
    pct_of_bid_ask: float | None = None
    n: int | None = None
    window_days: int | None = None
    divergence_bps: float | None = None
    unexplained_threshold: float | None = None
    consecutive_days: int | None = None
    period_months: int | None = None
    regime_sla_days: int | None = None
    same_desk_allowed: bool | None = None
    provenance: str = "base"

    def params(self) -> dict[str, object]:
        """Thresholds under their public names, absent ones left out."""
        out = {PARAM_NAMES[k]: getattr(self, k) for k in PARAM_NAMES if getattr(self, k) is not None}
        return {**out, "slaDays": self.sla_days} if self.rule_id in SLA_IN_PARAMS else out


# Public parameter names as they appear in params_json.
PARAM_NAMES = {
    "threshold_bps": "thresholdBps",
    "pct_of_bid_ask": "pctOfBidAsk",
    "n": "n",
    "window_days": "windowDays",
    "divergence_bps": "divergenceBps",
    "unexplained_threshold": "unexplainedThreshold",
    "consecutive_days": "consecutiveDays",
    "period_months": "periodMonths",
    "regime_sla_days": "regimeSlaDays",
    "same_desk_allowed": "sameDeskAllowed",
}

# Fixed value: the rule whose SLA is also one of its parameters (so a reset restores it).
SLA_IN_PARAMS = ("R2",)

# The ten obligations with their default thresholds.
DEFAULT_RULES = (
    Rule("R1", "Methodology pre-approval", "BEFORE", 0, "high", "Approval", "Committee (valuation)",
         "MethodologyChange", "change without an approval at or before its effective time"),
    Rule("R2", "Post-change IPV", "AFTER", 30, "medium", "IPVReview", "IPV team",
         "MethodologyChange", "no IPV review of the position within the SLA after the change"),
    Rule("R3", "Override beyond tolerance", "AFTER", 5, "high", "Approval AND IPVReview", "Desk head + IPV",
         "PriceOverride", "override above tolerance not approved in time, or approved unchallenged",
         threshold_bps=25, pct_of_bid_ask=50),
    Rule("R4", "Recurring overrides", "AFTER", 10, "high", "Escalation -> MAPReview", "Risk / MAP",
         "PriceOverride", "n-th override inside the window without an escalation", n=3, window_days=90),
    Rule("R5", "IPV divergence resolution", "AFTER", 10, "high",
         "Escalation AND (Evidence of adjustment OR CHALLENGED_BY)", "IPV -> Risk",
         "IPVReview", "divergent review neither adjusted, challenged nor escalated", divergence_bps=50),
    Rule("R6", "Persistent unexplained P&L", "AFTER", 5, "medium", "Control(attribution) AND Escalation",
         "Finance / Product Control", "PnLSignal", "persistent signal without an attribution control",
         unexplained_threshold=0.02, consecutive_days=5),
    Rule("R7", "Periodic review of illiquids", "PERIODIC", 365, "medium", "MAPReview", "MAP / Model validation",
         "Position", "illiquid position not reviewed in the period or after a regime break",
         applies_to="liquidityTier=illiquid", period_months=12, regime_sla_days=60),
    Rule("R8", "Segregation of duties", "STRUCTURAL", 0, "high",
         "approver <> position owner AND approver.desk <> position.desk", None,
         "Approval", "approver owns the position or sits on its desk", same_desk_allowed=False),
    Rule("R9", "Documentary evidence", "STRUCTURAL", 0, "medium", "EVIDENCED_BY -> Evidence", None,
         "Approval OR Escalation", "approval or escalation without evidence"),
    Rule("R10", "Peer decorrelation resolution", "AFTER", 30, "medium",
         "Approved change or addressing review around the signal", "Desk head + IPV",
         "DecorrelationSignal", "signal that no approved change or review addressed", provenance="discovery"),
)


@dataclass(frozen=True)
class Clocked:
    """One way of evaluating the rules: a rule set (variant) seen at one clock."""

    variant_id: str
    as_of: str
    rules: tuple[Rule, ...]

    def rule(self, rule_id: str) -> Rule | None:
        return next((r for r in self.rules if r.rule_id == rule_id), None)


class Later:
    """A table that is made when something first reads it, once for all books that hold it."""

    def __init__(self, make: Callable[[], DataFrame]):
        self._make, self._table = make, None

    def table(self) -> DataFrame:
        if self._table is None:
            self._table = self._make()
        return self._table


@dataclass
class Book:
    """Canonical DataFrames.  Operators take a Book and return DataFrames."""

    spark: SparkSession
    desk: DataFrame        # desk_id, name, control
    person: DataFrame      # person_id, name, role, desk_id
    instrument: DataFrame  # instrument_id, sector, maturity_years, liquidity_tier, liquidity_source
    position: DataFrame    # position_id, name, desk_id, owner_id, instrument_id, methodology_id, family, opened_at, valid_to
    event: DataFrame       # trigger-side events
    response: DataFrame    # approvals, escalations, challenges, adjustment evidence
    attribute: DataFrame   # entity_id, ra_type, ra_value
    trades: DataFrame      # daily trade panel, read through `trade`
    curve: DataFrame       # day, tenor_years, yield (null where blank)
    incident: DataFrame    # incident_id, position_id
    marks: DataFrame       # position_id, day, clean, read through `mark`
    regime_breaks: tuple[tuple[str, str], ...] = ()  # (id, timestamp text)
    rules: tuple[Rule, ...] = DEFAULT_RULES
    as_of: str = AS_OF
    raw: dict[str, DataFrame] = field(default_factory=dict)
    memo: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __getattribute__(self, name: str):
        value = super().__getattribute__(name)
        return value.table() if isinstance(value, Later) else value

    def with_(self, **changes) -> "Book":
        kept = {k: v for k, v in self.memo.items() if k in ("trades", "marks") and k not in changes}
        if "answers" in self.memo and "response" not in changes:
            kept["answers"] = self.memo["answers"]
        held = {f.name: self.__dict__[f.name] for f in fields(self)}   # without making those for later
        return replace(self, **{**held, "memo": kept, **changes})

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table several queries read: written on first use, then read back."""
        if name not in self.memo:
            self.memo[name] = written(make(), name)
        return self.memo[name]

    @property
    def trade(self) -> DataFrame:
        return self.once("trades", lambda: self.trades)

    @property
    def mark(self) -> DataFrame:
        return self.once("marks", lambda: self.marks)

    @cached_property
    def chronology(self) -> DataFrame:
        """Every dated event of a position: triggers, approvals and escalations."""
        cols = ["event_id", "label", "position_id", "event_at", "source_at", "description", "person_id"]
        own = self.event.withColumnRenamed("performer_id", "person_id").select(
            *cols, "deviation_bps", "side", "divergence_bps", "actor_role")
        answers = self.response.where(F.col("kind").isin("Approval", "Escalation")).select(
            F.col("response_id").alias("event_id"), F.col("kind").alias("label"), "position_id", "event_at",
            F.col("event_at").alias("source_at"),
            F.concat_ws(" ", "kind", F.lit("of"), "source_event_id").alias("description"),
            # an escalation goes to a committee, not to a person
            F.when(F.col("kind") == "Approval", F.col("person_id")).alias("person_id"), F.lit(None).cast("bigint").alias("deviation_bps"), F.lit(None).cast("string").alias("side"),
            F.lit(None).cast("bigint").alias("divergence_bps"), F.lit(None).cast("string").alias("actor_role"))
        return own.unionByName(answers)

    @property
    def answers(self) -> DataFrame:
        """What answered each source event, reduced to a row an event once for all rules."""
        from .operators.rules import first_responses

        return self.once("answers", lambda: first_responses(self))

    @property
    def controls(self) -> DataFrame:
        """All rules at the book's clock."""
        from .operators.rules import expected_controls

        return self.once("controls", lambda: expected_controls(self))

    @property
    def gaps(self) -> DataFrame:
        """Concrete gaps, the table every scenario reads."""
        from .operators.rules import gap_materialise

        return self.once("gaps", lambda: gap_materialise(self))
