"""Versions of a stored layer, and gaps that are recomputed only where a rule changed."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path


from books import at, book, event, response
from pyspark.sql import functions as F
from valuwatch.operators import refresh
from valuwatch.operators import rules as R
from valuwatch.sources import files


def layer(spark, n):
    nodes = spark.createDataFrame([(f"E{k}", "PriceOverride", f"cap {k}", at("2022-01-01 10:30:00.250000"), 5 + k) for k in range(n)] + [("P", "Position", "x, \"y\"\n", None, None)],
                                  "id string, label string, caption string, at timestamp_ntz, deviationBps bigint")
    edges = spark.createDataFrame([("P", f"E{k}", "OVERRIDDEN_BY", "Position", "PriceOverride") for k in range(n)],
                                  "src string, dst string, rel_type string, from_label string, to_label string")
    return nodes, edges


def test_versions_live_side_by_side(spark, tmp_path):
    folder = str(tmp_path / "layer")
    files.write_layer(*layer(spark, 2), folder)
    first, first_edges = files.read_layer(spark, folder)
    files.write_layer(*layer(spark, 3), folder)
    second, _ = files.read_layer(spark, folder)
    assert (first.count(), first_edges.count(), second.count()) == (3, 2, 4)         # the first is still whole
    rows = {r.id: r for r in second.collect()}
    assert rows["E1"].at == at("2022-01-01 10:30:00.250000") and rows["E1"].deviationBps == 6 and rows["P"].caption == 'x, "y"\n'
    assert second.schema["at"].dataType.simpleString() == "timestamp_ntz" and rows["P"].at is None


def test_an_edit_recomputes_one_rule(spark, tmp_path):
    folder = str(tmp_path / "gaps")
    events = [event(f"O{k}", "PriceOverride", f"2022-0{1 + k}-01", deviation_bps=20 + 5 * k) for k in range(4)]
    events += [event("I", "IPVReview", "2022-06-01", divergence_bps=60), event("M", "MethodologyChange", "2022-02-01")]
    b = book(spark, events, [response("A", "Approval", "O1", "2022-03-01", evidenced=False)])

    def whole(b):
        b = b.with_()
        b.memo["controls"] = R.expected_controls(b)
        return sorted(map(str, R.gap_materialise(b).collect()))

    gaps, stale = refresh.refresh_gaps(b, folder)
    assert stale == [f"R{k}" for k in range(1, 11)] and sorted(map(str, gaps.collect())) == whole(b)
    again, stale = refresh.refresh_gaps(b, folder)
    assert stale == [] and sorted(map(str, again.collect())) == whole(b)
    before = {str(p) for p in Path(folder, "gaps").rglob("*.parquet")}
    edited = b.with_(rules=tuple(replace(r, threshold_bps=31) if r.rule_id == "R3" else r for r in b.rules))
    gaps, stale = refresh.refresh_gaps(edited, folder)
    after = {str(p) for p in Path(folder, "gaps").rglob("*.parquet")}
    assert stale == ["R3"] and sorted(map(str, gaps.collect())) == whole(edited) != whole(b)
    assert before < after and all("rule_id=R3" in p for p in after - before)         # one partition written, none touched
    none = b.with_(rules=tuple(replace(r, threshold_bps=1000, pct_of_bid_ask=1000) if r.rule_id == "R3" else r for r in b.rules))
    assert refresh.refresh_gaps(none, folder)[0].where("rule_id = 'R3'").count() == 0
    assert refresh.refresh_gaps(none, folder)[1] == []                                # a rule without gaps is complete too
    assert refresh.refresh_gaps(b, folder)[1] == [] and len(refresh.refresh_gaps(b, folder, "facts 2")[1]) == 10


def test_gaps_of_one_rule_are_not_sent_to_one_task(spark, tmp_path):
    gaps = spark.range(4000).selectExpr("concat('G', id) as gap_id", "'R9' as rule_id").repartition(4, "gap_id")
    got = refresh.marked(gaps, {"R9": "f9", "R5": "f5"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan and "rule_id#" in plan
    assert got.select(F.spark_partition_id()).distinct().count() == 4
    assert {tuple(r) for r in got.select("rule_id", "fingerprint").distinct().collect()} == {("R9", "f9")} and got.count() == 4000
    assert refresh.marked(gaps, {"R5": "f5"}).count() == 0


def test_an_edit_of_a_rule_keeps_what_answered_the_events(spark, tmp_path):
    b = book(spark, [event("O", "PriceOverride", "2020-01-01", deviation_bps=99), event("V", "IPVReview", "2020-02-01", divergence_bps=70)],
             [response("A", "Approval", "O", "2020-01-02")])
    refresh.refresh_gaps(b, str(tmp_path / "store"))
    first = b.answers
    edited = b.with_(rules=tuple(replace(r, divergence_bps=60) if r.rule_id == "R5" else r for r in b.rules))
    assert edited.answers is first and b.with_(response=b.response.limit(0)).memo.get("answers") is None
    gaps, stale = refresh.refresh_gaps(edited, str(tmp_path / "store"))
    assert stale == ["R5"] and sorted(r.rule_id for r in gaps.collect() if r.trigger_event_id == "V") == ["R5"]
