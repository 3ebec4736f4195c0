"""The published case as a graph, cases of other shape, and books and bridges without their holdouts."""

from datetime import date

from books import at, book, event, response, table

from valuwatch.operators import events as E
from valuwatch.operators.cases import LABEL_RULES, PUBLISHED, encode_case
from valuwatch.sources.files import CASE_SCHEMA

# Rows of the published case, with the review that precedes it.
ROWS = """0 2011-08-20 day MAPReview MAP-TP-2011Q3
1 2011-12-31 month MarketPrice MP-2011Q4
2 2012-01-27 day MethodologyChange MC-VAR-2012
3 2012-01-31 month MethodologyChange MC-MARK-2012
4 2012-02-29 month PnLSignal PNL-FEB
5 2012-03-16 day Evidence EV-SPREADSHEET
6 2012-03-20 day PriceOverride PO-DAILY-SERIES
7 2012-03-23 day PnLSignal PNL-0323
8 2012-03-30 day IPVReview IPV-Q1
9 2012-04-06 day Escalation ESC-MEDIA
10 2012-04-10 day PnLSignal PNL-0410
11 2012-04-13 day Evidence EV-PUBLIC-0413
12 2012-04-30 month IPVReview IPV-COLLATERAL
13 2012-05-10 day Incident INC-SCP
14 2012-05-31 month CorrectiveAction CA-METHOD
15 2012-07-02 day CorrectiveAction CA-TRANSFER
16 2012-07-13 day RootCause RC-REVIEW
17 2013-01-16 day CorrectiveAction CA-TASKFORCE
18 2013-03-15 day Evidence EV-PSI
19 2013-08-14 day Evidence EV-SEC"""
SCHEMA = CASE_SCHEMA + ", position_id string, instrument_id string"


def case(spark, lines, position="POS-TP", instrument="INSTR-TP"):
    rows = [line.split() for line in lines.splitlines()]
    return table(spark, SCHEMA, [
        {"seq": int(r[0]), "date": date.fromisoformat(r[1]), "date_precision": r[2], "event_label": r[3], "event_id": r[4],
         "position_id": position, "instrument_id": instrument} for r in rows])


def test_published_case(spark):
    nodes, edges, bad = encode_case(case(spark, ROWS), LABEL_RULES + PUBLISHED)
    found = {r.id: r for r in nodes.collect()}
    assert len(found) == nodes.count() and bad.count() == 0
    # 20 rows, of which the series is 12 overrides and one row three root causes, and 13 - 1 + 12 further nodes
    assert len(found) == 20 + 11 + 2 + 12 + 12
    assert (found["PNL-FEB"].at, found["PNL-FEB"].source_at) == (at("2022-02-21 12:00:00"), at("2012-02-21 12:00:00"))
    assert found["APR-MC-VAR-2012"].source_at == at("2012-01-30 12:00:00") and found["IPV-MC-IPS-2012"].at == at("2022-06-05 12:00:00")
    assert [(found[f"PO-TP-{w}"].source_at, found[f"PO-TP-{w}"].deviation_bps, found[f"PO-TP-{w}"].pct_of_bid_ask) for w in ("01", "12")] == [
        (at("2012-01-06 12:00:00"), 30, 30), (at("2012-03-23 12:00:00"), 140, 95)]
    links = {tuple(r) for r in edges.select("src", "rel_type", "dst").collect()}
    assert {(s, d) for s, t, d in links if t == "COMPARED_WITH"} == {("MP-2011Q4", "POS-TP")}
    assert {(s, d) for s, t, d in links if t == "CAUSED_BY"} == {("INC-TP", "POS-TP"), *(("INC-TP", f"RC-TP-{k}") for k in (1, 2, 3))}
    assert {d for s, t, d in links if t == "MITIGATED_BY" and s == "INC-TP"} == {"CA-METHOD", "CA-TRANSFER", "CA-TASKFORCE"}
    assert {d for s, t, d in links if s == "INC-TP" and t == "EVIDENCED_BY"} == {"EV-PSI", "EV-SEC"}
    assert ("PO-TP-10", "EVIDENCED_BY", "EV-SPREADSHEET") in links and ("PNL-0410", "CHALLENGED_BY", "PNL-0410-REISSUE") in links
    assert not [x for x in links if "EV-PUBLIC-0413" in x] and not [x for x in links if x[0] == "MC-MARK-2012"]
    outside = {x for s, _, d in links for x in (s, d)} - set(found)
    assert outside == {"POS-TP", "INSTR-TP", "TP-MODEL-OWNER", "TP-TRADER-A", "TP-DESKHEAD", "TP-VCG", "TP-CONTROLLER", "TP-DEP-CRO",
                       "COM-VAL", "DESK-IB"}


def test_other_cases_side_by_side(spark):
    rows = case(spark, "1 2012-01-05 day RootCause R\n2 2012-01-06 day MarketPrice M\n3 2012-01-07 day Gossip X", "A", None).unionByName(
        case(spark, "1 2012-02-29 day Incident I\n2 2012-03-01 day RootCause S", "B"))
    nodes, edges, bad = encode_case(rows)
    assert {(r.id, r.position_id) for r in nodes.collect()} == {("R", "A"), ("M", "A"), ("I", "B"), ("S", "B")}
    assert nodes.where("id = 'I'").first().at == at("2022-02-28 12:00:00")
    # no incident, no instrument: no edge to them
    assert {tuple(r) for r in edges.collect()} == {("M", "COMPARED_WITH", "A"), ("I", "CAUSED_BY", "B"), ("I", "CAUSED_BY", "S")}
    assert [r.event_id for r in bad.collect()] == ["X"]


def test_awkward_rows(spark):
    empty = encode_case(table(spark, SCHEMA, []))
    assert [df.count() for df in empty] == [0, 0, 0]
    rows = table(spark, SCHEMA + ", series_start date, series_end date", [
        {"event_label": None, "event_id": "N"}, {"event_label": "Control", "event_id": "C", "position_id": None},
        {"event_label": "PriceOverride", "event_id": "P", "position_id": "A", "series_start": date(2012, 3, 9), "series_end": date(2012, 3, 1)},
        {"event_label": "PriceOverride", "event_id": "Q", "position_id": "A", "series_start": date(2012, 3, 1), "series_end": date(2014, 3, 1)}])
    nodes, edges, bad = encode_case(rows)
    ids = [r.id for r in nodes.collect()]
    assert "N" not in ids and "C" in ids and [r.event_id for r in bad.collect()] == ["N"]
    assert "Q-01" in ids and "Q-105" in ids and "Q-106" not in ids       # two years of weeks, no end before its time
    assert edges.where("dst = 'C'").count() == 0


def test_loaded_labels_and_edges(spark):
    rows = case(spark, "1 2012-01-05 month RootCause R\n2 2012-01-06 day MarketPrice M\n3 2012-01-07 day Approval A\n4 2012-01-08 day Escalation E")
    events, _, bad = E.load_case(rows)
    assert [r.event_id for r in bad.collect()] == ["M"]
    assert [(r.rel_type, r.dst) for r in E.label_edges(events, E.CASE_EDGE).collect()] == [("ESCALATED_TO", "E")]


def test_holdout_leaves_no_trace(spark):
    b = book(spark, [event("PO1", "PriceOverride", "2022-01-05", deviation_bps=40), event("I1", "IPVReview", "2022-01-06", divergence_bps=10),
                     event("I2", "IPVReview", "2022-01-07", divergence_bps=90)],
             [response("A1", "Approval", "PO1", "2022-01-06"), response("A2", "Approval", "I1", "2022-01-07")])
    one = b.event.first().position_id
    held = spark.createDataFrame([(one, "PriceOverride"), (one, "IPVReview")], "position_id string, label string")
    rest = E.without_holdout(b, held)
    assert [r.event_id for r in rest.event.collect()] == ["I1"]          # a review within the limit is not held out
    assert {(r.response_id, r.source_event_id) for r in rest.response.collect()} == {("A1", None), ("A2", "I1")}
    bridge = spark.createDataFrame([("E", "t", "v"), ("E", "t", None), ("F", "t", "v")], "entity_id string, ra_type string, ra_value string")
    left = E.without_links(bridge, bridge.where("ra_value is null"))
    assert {tuple(r) for r in left.collect()} == {("E", "t", "v"), ("F", "t", "v")}
