"""Hand-written books: a builder that fills in whatever a test does not care about."""

from __future__ import annotations

from datetime import datetime

from valuwatch.model import DEFAULT_RULES, Book

EVENT = ("event_id string, label string, position_id string, event_at timestamp_ntz, source_at timestamp_ntz, "
         "effective_at timestamp_ntz, deviation_bps bigint, side string, pct_of_bid_ask bigint, divergence_bps bigint, "
         "unexplained_pct double, consecutive_days bigint, outcome string, performer_id string, actor_role string, "
         "kind string, description string")
RESPONSE = ("response_id string, kind string, source_event_id string, event_at timestamp_ntz, person_id string, "
            "evidenced boolean, of_position boolean, source_label string, position_id string")


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def table(spark, schema: str, rows: list[dict]):
    return spark.createDataFrame([tuple(r.get(c) for c in _names(schema)) for r in rows], schema)


def event(i, label, when, pos="P", **more) -> dict:
    return {"event_id": i, "label": label, "position_id": pos, "event_at": at(when), "source_at": at(when),
            "kind": "attribution" if label == "Control" else None,
            **{k: at(v) if k == "effective_at" and v else v for k, v in more.items()}}


def response(i, kind, source, when, person="OUT", evidenced=True, of_position=False, label="PriceOverride", pos="P") -> dict:
    return {"response_id": i, "kind": kind, "source_event_id": source, "event_at": at(when), "person_id": person,
            "evidenced": evidenced, "of_position": of_position, "source_label": label, "position_id": pos}


def book(spark, events=(), responses=(), as_of="2023-01-01", positions=None, attributes=(("P", "liquidityTier", "illiquid"),),
         regime=(), marks=(), rules=DEFAULT_RULES) -> Book:
    positions = positions or [{"position_id": "P", "opened_at": at("2019-01-01")}]
    return Book(
        spark=spark,
        desk=table(spark, "desk_id string, name string, control boolean", [
            {"desk_id": "D", "name": "Desk", "control": False}, {"desk_id": "C", "name": "Control", "control": True}]),
        person=table(spark, "person_id string, name string, role string, desk_id string", [
            {"person_id": "OWN", "name": "Owner", "role": "Trader", "desk_id": "D"},
            {"person_id": "MATE", "name": "Mate", "role": "Desk head", "desk_id": "D"},
            {"person_id": "OUT", "name": "Outsider", "role": "IPV analyst", "desk_id": "C"}]),
        instrument=None,
        position=table(spark, "position_id string, name string, desk_id string, owner_id string, instrument_id string, "
                              "methodology_id string, family string, opened_at timestamp_ntz, valid_to timestamp_ntz",
                       [{"name": p["position_id"], "desk_id": "D", "owner_id": "OWN", "instrument_id": "I", **p} for p in positions]),
        event=table(spark, EVENT, list(events)), response=table(spark, RESPONSE, list(responses)),
        attribute=table(spark, "entity_id string, ra_type string, ra_value string",
                        [{"entity_id": e, "ra_type": t, "ra_value": v} for e, t, v in attributes]),
        trades=None, curve=None, incident=table(spark, "incident_id string, position_id string", []),
        marks=table(spark, "position_id string, day date, clean double", list(marks)),
        regime_breaks=tuple(regime), rules=rules, as_of=as_of)
