"""Many clocks and many thresholds over one pass of the facts.

A fact's status changes at no more than three instants of the clock, and for a given clock at no more than
two values of the days allowed.  So facts are turned into changes (+1 for the status that starts, -1 for
the one that ends), counted per instant or value, and a clock or variant only sums what lies before it.
Facts are never copied per clock or variant, and plans are the same for one and for ten thousand.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import months, ts
from ..functions.ordered import asof, neighbour, scan
from ..functions.prefix import counts_upto
from ..model import PARAM_NAMES, Book, Clocked, Rule
from ..session import written
from . import rules as R

#: Before any clock.
START = "0001-01-01 00:00:00"
#: Before any number of days allowed.
LEAST = -(2 ** 31)
DAY_MICROS = 86_400_000_000
ANY = "any"


def changes(points: Column) -> Column:
    """Changes of status along sorted `points` (at, status): each starts a status and ends the one before."""
    def change(p: Column, k: Column) -> Column:
        start = F.struct(p["at"].alias("at"), p["status"].alias("status"), F.lit(1).alias("n"))
        end = F.struct(p["at"].alias("at"), F.get(points, k - 1)["status"].alias("status"), F.lit(-1).alias("n"))
        return F.when(k == 0, F.array(start)).otherwise(F.array(start, end))

    return F.flatten(F.transform(points, change))


def _sorted(*points: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*points)))


# ---- clocks

def _settled_changes(facts: DataFrame) -> DataFrame:
    """(rule_id, status, class, at, n) of settled facts."""
    appears = F.coalesce("appears", ts(START))
    instants = F.array_sort(F.array_distinct(F.array(
        appears, F.greatest(appears, F.col("final_from")), F.greatest(appears, F.col("pending_until")))))
    points = F.transform(instants, lambda t: F.struct(t.alias("at"), R.status_at(t).alias("status")))
    return facts.select("rule_id", points.alias("points")).select("rule_id", F.inline(changes(F.col("points"))))


def _recurring_changes(b: Book, contexts) -> DataFrame | None:
    """R4 has a row per position: missed from the first unanswered deadline on, before that as its first trigger."""
    rows = R.recurring(b, contexts)
    if rows is None:
        return None
    met = F.coalesce(F.col("next_esc") <= F.col("due_by"), F.lit(False))
    first = F.min(F.struct(F.col("trigger_at").alias("at"), F.col("trigger_event_id").alias("id"), met.alias("met")))
    per = rows.groupBy("rule_id", "position_id").agg(
        first.alias("first"), F.min(F.when(~met, F.greatest("due_by", "trigger_at"))).alias("missed_from"))
    own = F.when(F.col("first.met"), "MET").otherwise("PENDING")
    points = F.array_compact(F.array(
        F.when(F.col("missed_from").isNull() | (F.col("missed_from") > F.col("first.at")),
               F.struct(F.col("first.at").alias("at"), own.alias("status"))),
        F.when(F.col("missed_from").isNotNull(),
               F.struct(F.greatest(F.col("missed_from"), F.col("first.at")).alias("at"), F.lit("MISSED").alias("status")))))
    return per.select("rule_id", F.inline(changes(points)))


def clock_index(b: Book) -> DataFrame:
    """(rule_id, status, at, n): how many facts take or leave a status at an instant.  Written once per book;
    any number of clocks reads it.  The periodic rule is not in it, as it looks back from the clock."""
    def make() -> DataFrame:
        base = R.base_context(b)
        parts = [_settled_changes(f) for facts in (R.facts_r1, R.facts_r2, R.facts_r3, R.facts_r5, R.facts_r6, R.facts_r7b,
                                                    R.facts_r8, R.facts_r9, R.facts_r10) if (f := facts(b, base)) is not None]
        if (recurring := _recurring_changes(b, base)) is not None:
            parts.append(recurring)
        if not parts:
            return b.spark.createDataFrame([], "rule_id string, status string, at timestamp_ntz, n bigint")
        return (reduce(DataFrame.unionByName, parts).groupBy("rule_id", "status", "at").agg(F.sum("n").alias("n"))
                .where("n <> 0"))

    return b.once("clock-index", make)


def _periodic_changes(b: Book, clocks: DataFrame, classes: list[str]) -> DataFrame | None:
    """Changes of the periodic rule at the given clocks, per time of day of the clock.

    Among clocks of one time of day the start of the period moves with the clock, so "the period's start has
    reached x" begins at one clock, which is found by an as-of search among the starts.
    """
    scope = R._in_scope(b, R.base_context(b), period="period_months")
    if scope is None:
        return None
    period = next(r.period_months for r in b.rules if r.rule_id == "R7")
    starts = clocks.select("class", (F.col("as_of") - months(F.lit(period))).alias("start"), "as_of")
    scope = scope.select("position_id", "opened_at", "valid_to")
    reviews = neighbour(b.event.where("label = 'MAPReview'").select("position_id", "event_at", "event_id"), ["position_id"],
                        ["event_at", "event_id"], {"next_at": "event_at"}, step=1).join(scope, "position_id")

    def reached(df: DataFrame, x: str, out: str) -> DataFrame:
        return asof(df, starts, ["class"], x, "start", {out: "as_of"}, forward=True, inclusive=True)

    each = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    held = written(reached(scope.select("*", each), "opened_at", "from"), "periodic-scope").where("from is not null")
    held = held.where("valid_to is null or from < valid_to").select(
        "position_id", "class", "from", F.col("valid_to").alias("until"))
    covered = written(reached(reviews.select("position_id", "event_at", "next_at", each), "event_at", "lapsed"), "periodic-reviews")
    covered = covered.join(held, ["position_id", "class"]).select(
        "class", F.greatest("from", "event_at").alias("from"), F.least("lapsed", "next_at", "until").alias("until")).where(
        "until is null or from < until")

    def both(df: DataFrame, status: str, sign: int) -> DataFrame:
        ends = F.array_compact(F.array(F.struct(F.col("from").alias("at"), F.lit(sign).alias("n")),
                                       F.when(F.col("until").isNotNull(), F.struct(F.col("until").alias("at"), F.lit(-sign).alias("n")))))
        return df.select(F.lit("R7").alias("rule_id"), F.lit(status).alias("status"), "class", F.inline(ends))

    return both(held, "MISSED", 1).unionByName(both(covered, "MISSED", -1)).unionByName(both(covered, "MET", 1))


def early_detection(b: Book, clocks: list[str]) -> DataFrame:
    """(as_of, rule_id, status, n): the same population seen at each of the clocks; counts of 0 are left out."""
    at = b.spark.createDataFrame([(c,) for c in sorted(set(clocks))], "c string").select(F.col("c").cast("timestamp_ntz").alias("as_of"))
    at = at.select("as_of", F.date_format("as_of", "HH:mm:ss.SSSSSS").alias("class"))
    classes = [r[0] for r in at.select("class").distinct().collect()]        # times of day of the clocks
    all_changes = clock_index(b).select("rule_id", "status", F.lit(ANY).alias("class"), "at", "n")
    periodic = _periodic_changes(b, at, classes)
    if periodic is not None:
        all_changes = all_changes.unionByName(periodic)
    counted = all_changes.groupBy("rule_id", "status", "class", "at").agg(F.sum("n").alias("n"))
    # clocks take part as rows of every rule and status: forty a clock at most
    pairs = F.explode(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(s).alias("status")) for r in b.rules for s in R.STATUSES]))
    asked = at.select("as_of", F.explode(F.array(F.lit(ANY), F.col("class"))).alias("class"), pairs.alias("p")).select(
        "p.rule_id", "p.status", "class", F.col("as_of").alias("at"), F.lit(0).cast("long").alias("n"), "as_of")
    rows = written(counted.withColumn("as_of", F.lit(None).cast("timestamp_ntz")).unionByName(asked), "clock-rows")
    summed = scan(rows, ["rule_id", "status", "class"], ["at"], sums={"total": "n"})
    return summed.where("as_of is not null").groupBy("as_of", "rule_id", "status").agg(F.sum("total").alias("n")).where("n > 0")


# ---- thresholds

#: Thresholds a sweep may change, by rule.
SWEPT = {"R1": (), "R2": ("sla_days",), "R3": ("sla_days", "threshold_bps", "pct_of_bid_ask"), "R4": ("sla_days", "n", "window_days"),
         "R5": ("sla_days", "divergence_bps"), "R6": ("sla_days", "unexplained_threshold", "consecutive_days"),
         "R7": ("period_months", "regime_sla_days"), "R8": ("same_desk_allowed",), "R9": (), "R10": ("sla_days",)}

FIELDS = sorted({f for some in SWEPT.values() for f in some})
KINDS = {"unexplained_threshold": "double", "threshold_bps": "double", "pct_of_bid_ask": "double", "divergence_bps": "double",
         "same_desk_allowed": "boolean"}


def _micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def days_to(start: Column, end: Column) -> Column:
    """Fewest whole days after `start` that reach `end`."""
    d = _micros(start, end)
    return ((d + F.pmod(-d, F.lit(DAY_MICROS))) / DAY_MICROS).cast("long")


def days_past(start: Column, end: Column) -> Column:
    """Fewest whole days after `start` that go beyond `end`."""
    d = _micros(start, end)
    return ((d - F.pmod(d, F.lit(DAY_MICROS))) / DAY_MICROS).cast("long") + 1


def _by_days(facts: DataFrame, met_from: Column, pending_from: Column, before: Column | None = None) -> DataFrame:
    """Changes along the days allowed: `before` (missed if not given), pending, met."""
    base = F.coalesce(before, F.lit("MISSED")) if before is not None else F.lit("MISSED")
    x, y = met_from.cast("long"), pending_from.cast("long")
    points = F.array_compact(F.array(
        F.struct(F.lit(LEAST).cast("long").alias("at"), base.alias("status")),
        F.when(y.isNotNull() & (x.isNull() | (y < x)), F.struct(y.alias("at"), F.lit("PENDING").alias("status"))),
        F.when(x.isNotNull(), F.struct(x.alias("at"), F.lit("MET").alias("status")))))
    return facts.select("*", F.inline(changes(points)))


def _searched_changes(b: Book, found: DataFrame, start: Column) -> DataFrame:
    """Facts of a search: late or met once the clock has seen the answer, else missed or pending."""
    seen = F.col("found_at") <= ts(b.as_of)
    return _by_days(found.where(F.col("trigger_at") <= ts(b.as_of)), F.when(seen, days_to(start, F.col("found_at"))),
                    F.when(~F.coalesce(seen, F.lit(False)), days_past(start, ts(b.as_of))), F.when(seen, "LATE"))


def _gates(df: DataFrame, *values: Column) -> DataFrame:
    """Counted changes: status, at, n and the gate values g0, g1."""
    gates = [v.alias(f"g{k}") for k, v in enumerate(values)]
    names = [f"g{k}" for k in range(len(values))]
    return df.select("status", "at", "n", *gates).groupBy("status", "at", *names).agg(F.sum("n").alias("n"))


def _sweep_r4(b: Book, pairs: list[tuple[int, int]]) -> DataFrame | None:
    """Changes along the days allowed, per (n, window_days): each such pair is an evaluation of its own."""
    rule = next((r for r in b.rules if r.rule_id == "R4"), None)
    if rule is None or not pairs:
        return None
    contexts = tuple(Clocked(f"{n}/{w}", b.as_of, (replace(rule, n=n, window_days=w),)) for n, w in pairs)
    rows = R.recurring(b, contexts).where("trigger_at <= as_of")
    x, y = days_to(F.col("trigger_at"), F.col("next_esc")), days_past(F.col("trigger_at"), ts(b.as_of))
    first = F.min(F.struct(F.col("trigger_at").alias("at"), F.col("trigger_event_id").alias("id"), x.alias("x")))
    per = rows.groupBy("variant_id", "position_id").agg(first.alias("first"), F.max(F.least(x, y)).alias("z"))
    # missed while any trigger is, then as the first trigger
    met_from = F.greatest(F.col("first.x"), F.when(F.col("first.x").isNotNull(), F.col("z")))
    points = _by_days(per, met_from, F.col("z"))
    pair = F.split("variant_id", "/")
    return points.select(F.get(pair, F.lit(0)).cast("int").alias("n_"), F.get(pair, F.lit(1)).cast("int").alias("window_"), "status", "at", "n")


def _sweep_changes(b: Book, rule_id: str) -> DataFrame | None:
    """Counted changes of a rule along its days (or months), with the values its gates test."""
    clock = ts(b.as_of)
    trigger = F.col("trigger_at")
    if rule_id == "R2":
        return _gates(_searched_changes(b, R.changes_reviewed(b), F.col("eff")))
    if rule_id == "R3":
        rows = R.overrides_answered(b).where(trigger <= clock)
        challenged, approved = F.coalesce("challenged", F.lit(False)), F.col("approval").isNotNull()
        moved = _by_days(rows, F.when(challenged, days_to(trigger, F.col("approval.at"))),
                         F.when(challenged & ~approved, days_past(trigger, clock)), F.when(challenged & approved, "LATE"))
        # an override that has no deviation is not beyond it
        return _gates(moved, F.coalesce(F.col("deviation_bps").cast("double"), F.lit(float("-inf"))),
                      F.coalesce(F.col("pct_of_bid_ask").cast("double"), F.lit(0.0)))
    if rule_id == "R5":
        rows = R.reviews_answered(b).where((trigger <= clock) & F.col("divergence_bps").isNotNull())
        always = F.coalesce("adjusted", F.lit(False)) | F.coalesce("challenged", F.lit(False))
        moved = _by_days(rows, F.when(always, F.lit(LEAST + 1)).otherwise(days_to(trigger, F.col("escalated_at"))), days_past(trigger, clock))
        return _gates(moved, F.col("divergence_bps").cast("double"))
    if rule_id == "R6":
        moved = _searched_changes(b, R.signals_controlled(b), trigger)
        return _gates(moved, -F.coalesce("unexplained_pct", F.lit(0.0)).cast("double"), -F.coalesce("consecutive_days", F.lit(0)).cast("double"))
    if rule_id == "R10":
        rows = R.signals_addressed(b).where(trigger <= clock)
        near = F.least(days_to(F.col("changed_before"), trigger), days_to(trigger, F.col("changed_after")), days_to(trigger, F.col("reviewed_after")))
        return _gates(_by_days(rows, near, days_past(trigger, clock)))
    raise KeyError(rule_id)


def _periodic_by_months(b: Book) -> DataFrame | None:
    """Changes of the periodic rule along its months: met from the fewest that reach back beyond the latest
    review, in scope up to the most that a position has been open."""
    scope = R._in_scope(b, R.base_context(b))
    if scope is None:
        return None
    clock = ts(b.as_of)
    scope = scope.where(F.col("valid_to").isNull() | (F.col("valid_to") > clock)).where(F.col("opened_at") <= clock)
    latest = b.event.where("label = 'MAPReview'").where(F.col("event_at") <= clock).groupBy("position_id").agg(F.max("event_at").alias("seen"))

    def most(at: Column) -> Column:
        """Most months before the clock that do not go below `at`."""
        guess = F.floor(F.months_between(clock.cast("timestamp"), at.cast("timestamp"))).cast("int")
        tried = F.transform(F.array(F.lit(1), F.lit(0), F.lit(-1)), lambda d: F.when(clock - months(guess + d) >= at, guess + d))
        return F.array_max(tried)

    rows = scope.join(latest, "position_id", "left").select(most(F.col("opened_at")).alias("last"), (most(F.col("seen")) + 1).alias("met"))
    points = F.array_compact(F.array(
        F.struct(F.lit(LEAST).cast("long").alias("at"), F.lit("MISSED").alias("status")),
        F.when(F.col("met") <= F.col("last"), F.struct(F.col("met").cast("long").alias("at"), F.lit("MET").alias("status"))),
        F.struct((F.col("last") + 1).cast("long").alias("at"), F.lit("OUT").alias("status"))))
    return rows.where("last is not null").select(F.inline(changes(points))).where("status <> 'OUT'").groupBy("status", "at").agg(F.sum("n").alias("n"))


def _regime_by_days(b: Book) -> DataFrame | None:
    scope = R._in_scope(b, R.base_context(b))
    if scope is None or not b.regime_breaks:
        return None
    rows = R.breaks_reviewed(b, scope).where(F.col("trigger_at") <= ts(b.as_of))
    return _gates(_by_days(rows, days_to(F.col("trigger_at"), F.col("reviewed_at")), days_past(F.col("trigger_at"), ts(b.as_of))))


def versions(b: Book, overlays: DataFrame) -> DataFrame:
    """(variant_id, rule_id, one column a threshold): the rules of every variant of `overlays`.

    `overlays` has (variant_id, rule_id, param, value) rows; the greatest value counts where a parameter of a
    rule is given twice.  They are only joined and grouped, so there may be any number of them.
    """
    public = {**PARAM_NAMES, "sla_days": "slaDays"}
    fields, kinds = FIELDS, KINDS
    edits = overlays.groupBy("variant_id", "rule_id").agg(
        *[F.max(F.when(F.col("param") == public[f], F.col("value"))).alias(f"e_{f}") for f in fields])
    base = F.inline(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), *[
        F.lit(getattr(r, f) if f in SWEPT.get(r.rule_id, ()) else None).cast(kinds.get(f, "int")).alias(f) for f in fields]) for r in b.rules]))
    every = overlays.select("variant_id").distinct().select("variant_id", base)
    return every.join(edits, ["variant_id", "rule_id"], "left").select(
        "variant_id", "rule_id", *[F.when(F.col(f).isNotNull(), F.coalesce(F.col(f"e_{f}").cast(kinds.get(f, "int")), F.col(f))).alias(f) for f in fields])


def versions_of(b: Book, variants: tuple[Clocked, ...]) -> DataFrame:
    """The same table from rule sets held on the driver."""
    fields, kinds = FIELDS, KINDS

    def value(r: Rule, f: str):
        v = getattr(r, f) if f in SWEPT.get(r.rule_id, ()) else None
        return float(v) if v is not None and kinds.get(f) == "double" else v

    rows = [(v.variant_id, r.rule_id, *[value(r, f) for f in fields]) for v in variants for r in v.rules]
    return b.spark.createDataFrame(rows, ", ".join(["variant_id string", "rule_id string", *[f"{f} {kinds.get(f, 'int')}" for f in fields]]))


def policy_sweep(b: Book, variants: DataFrame | tuple[Clocked, ...]) -> DataFrame:
    """(variant_id, rule_id, status, n): outcome counts of every variant over the whole population.

    `variants` are overlay rows, or rule sets.  Facts are counted once by the values their rule tests and the
    days at which their status changes; a variant sums the counts its thresholds reach.  The distinct values
    of each threshold are gathered to place facts among them; the variants themselves stay a table.
    """
    table = written(versions(b, variants) if isinstance(variants, DataFrame) else versions_of(b, variants), "sweep-versions")
    held = {r["rule_id"]: {f: sorted(r[f]) for f in FIELDS}
            for r in table.groupBy("rule_id").agg(*[F.collect_set(f).alias(f) for f in FIELDS]).collect()}
    have = {r.rule_id for r in b.rules} & set(held)
    parts = []

    def limits(rule_id: str, fields: tuple[str, ...]) -> tuple[DataFrame, dict[str, list]]:
        return table.where(F.col("rule_id") == rule_id).select(*fields).distinct(), held[rule_id]

    def spread(rule_id: str, counts: DataFrame, fields: tuple[str, ...]) -> None:
        own = table.where(F.col("rule_id") == rule_id).select("variant_id", "rule_id", *fields)
        parts.append(own.join(counts, list(fields)).select("variant_id", "rule_id", "status", "n"))

    def swept(rule_id: str, fields: tuple[str, ...], cells: DataFrame, gates: dict[str, str], negate: bool = False, outside: bool = False) -> None:
        """Totals per version; `outside` counts what is not within all gates, `negate` takes gates from below."""
        some, values = limits(rule_id, fields)
        axis = {"at": (fields[0], [int(v) for v in values[fields[0]]])}
        sign = -1 if negate else 1
        bounds = some.withColumns({f"b_{f}": sign * F.col(f).cast("double") for f in gates.values()})
        dims = {g: (f"b_{f}", sorted(sign * float(v) for v in values[f])) for g, f in gates.items()}
        inner = counts_upto(cells, bounds, {**axis, **dims}, ["status"]).select(*fields, "status", "n")
        if outside:
            everything = counts_upto(cells.groupBy("status", "at").agg(F.sum("n").alias("n")), some, axis, ["status"])
            inner = everything.unionByName(inner.withColumn("n", -F.col("n"))).groupBy(*fields, "status").agg(F.sum("n").alias("n"))
        spread(rule_id, inner.where("n > 0"), fields)

    if "R2" in have:
        swept("R2", ("sla_days",), _sweep_changes(b, "R2"), {})
    if "R3" in have:
        swept("R3", SWEPT["R3"], _sweep_changes(b, "R3"), {"g0": "threshold_bps", "g1": "pct_of_bid_ask"}, outside=True)
    if "R5" in have:
        swept("R5", SWEPT["R5"], _sweep_changes(b, "R5"), {"g0": "divergence_bps"}, outside=True)
    if "R6" in have:
        swept("R6", SWEPT["R6"], _sweep_changes(b, "R6"), {"g0": "unexplained_threshold", "g1": "consecutive_days"}, negate=True)
    if "R10" in have:
        swept("R10", ("sla_days",), _sweep_changes(b, "R10"), {})
    if "R4" in have:
        some, values = limits("R4", SWEPT["R4"])
        pairs = sorted({(r[0], r[1]) for r in some.select("n", "window_days").distinct().collect()})
        moved = _sweep_r4(b, pairs).groupBy("n_", "window_", "status", "at").agg(F.sum("n").alias("n"))
        counted = counts_upto(moved, some.select("sla_days").distinct(), {"at": ("sla_days", values["sla_days"])}, ["n_", "window_", "status"])
        counted = counted.withColumnRenamed("n", "total").selectExpr("n_ as n", "window_ as window_days", "sla_days", "status", "total").where("total > 0")
        own = table.where("rule_id = 'R4'").select("variant_id", "rule_id", *SWEPT["R4"])
        parts.append(own.join(counted, list(SWEPT["R4"])).select("variant_id", "rule_id", "status", F.col("total").alias("n")))
    if "R7" in have:
        both = []
        for field, moved in (("period_months", _periodic_by_months(b)), ("regime_sla_days", _regime_by_days(b))):
            if moved is not None:
                some, values = limits("R7", (field,))
                counted = counts_upto(moved, some, {"at": (field, values[field])}, ["status"])
                both.append(table.where("rule_id = 'R7'").select("variant_id", "rule_id", field).join(counted, field).select("variant_id", "rule_id", "status", "n"))
        if both:
            parts.append(reduce(DataFrame.unionByName, both).groupBy("variant_id", "rule_id", "status").agg(F.sum("n").alias("n")).where("n > 0"))
    plain = [p for f in (R.rule_r1, R.rule_r9) if (p := f(b, R.base_context(b))) is not None]
    if "R8" in have:
        strict = b.with_(rules=tuple(replace(r, same_desk_allowed=False) for r in b.rules if r.rule_id == "R8"))
        plain.append(R.rule_r8(strict, R.base_context(strict)))
    if plain:
        counts = reduce(DataFrame.unionByName, plain).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"))
        asked = table.where("rule_id in ('R1', 'R9') or (rule_id = 'R8' and not same_desk_allowed)").select("variant_id", "rule_id")
        parts.append(asked.join(counts, "rule_id").select("variant_id", "rule_id", "status", "n"))
    return reduce(DataFrame.unionByName, parts)
