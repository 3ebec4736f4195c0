"""Answers that were wrong once: evidence of a review, members of a conjunction, the role of an escalation."""

from __future__ import annotations

from books import book, event, response

from valuwatch.operators import rules, scenarios


def outcome(spark, kind):
    b = book(spark, [event("DS", "DecorrelationSignal", "2022-03-01"), event("RV", "IPVReview", "2022-03-10", outcome="upheld")],
             [response("A", kind, "RV", "2022-03-11", label="IPVReview")])
    return [r["status"] for r in rules.expected_controls(b, as_of="2023-01-01", rule="R10").collect()]


def test_only_an_adjustment_shows_that_a_review_addressed_the_signal(spark):
    assert outcome(spark, "Adjustment") == ["MET"] and outcome(spark, "Challenge") == ["MISSED"]


def test_an_approval_in_the_core_brings_no_approver(spark):
    b = book(spark, [event("X", "PositionNote", "2022-03-01")],
             [response("A", "Approval", "X", "2022-03-02", person="OUT", label="PositionNote")])
    gaps = spark.createDataFrame([("G", "P", "A")], "gap_id string, position_id string, trigger_event_id string")
    members = {r["id"] for r in scenarios.conjunction_members(b, gaps).collect()}
    assert {"P", "A", "G"} <= members and "OUT" not in members


def test_an_escalation_has_no_person(spark):
    b = book(spark, [event("X", "PriceOverride", "2022-03-01")],
             [response("E", "Escalation", "X", "2022-03-02"), response("A", "Approval", "X", "2022-03-03")])
    person = {r["event_id"]: r["person_id"] for r in b.chronology.collect()}
    assert person["E"] is None and person["A"] == "OUT"
