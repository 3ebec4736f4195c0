"""What queries on large tables must not make, store or send twice."""

from __future__ import annotations

from valuwatch import session
from valuwatch.operators import graph as G
from valuwatch.operators import market as M
from valuwatch.operators import timeline as TL
from valuwatch.plans import CATALOG
from valuwatch.sources import tables as T

DIR = "/root/testdata/sf0.001"


def shuffled(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


def test_a_query_makes_only_the_tables_it_reads(spark, monkeypatch):
    made = []
    monkeypatch.setattr(T, "written", lambda df, name, by=None: made.append(name) or session.written(df, name, by))
    b = T.canonical(T.bind(spark, DIR))
    CATALOG["divergence_bps"].run(b).count()
    assert made == []
    other = b.with_(as_of="2000-01-01")
    assert made == [] and other.response.count() == b.response.count() and b.event.count() > 0
    assert made == ["event", "response"]                                   # one table for both books


def test_lines_and_month_ends_are_sent_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = T.bind(spark, DIR)
        assert len([x for x in shuffled(t.trades) if "l_partkey" in x]) == 1
        assert len(shuffled(M.month_end(session.written(t.trades, "trades")))) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_named_neighbours_are_looked_up(spark):
    e = spark.createDataFrame([("P1", "HAS", f"E{k}", "Position", "Event") for k in range(6)] + [("E0", "BY", "W", "Event", "Person")],
                              "src string, rel_type string, dst string, from_label string, to_label string")
    n = spark.createDataFrame([("P1", "Position", "Book 1"), ("W", "Person", "Wim")] + 2 * [(f"E{k}", "Event", f"E{k}") for k in range(6)],
                              "id string, label string, caption string")
    got = {(r.id, r.rel_type, r.dir): (r.cnt, r.sample) for r in G.node_summary(e, n).collect()}
    assert got == {("P1", "HAS", "out"): (6, "E0, E1, E2, E3"), ("E0", "BY", "out"): (1, "Wim"), ("W", "BY", "in"): (1, "E0"),
                   **{(f"E{k}", "HAS", "in"): (1, "Book 1") for k in range(6)}}   # an event stored twice is named once


def test_prices_are_reduced_before_they_meet_positions(spark):
    b = T.canonical(T.bind(spark, DIR))
    days = spark.createDataFrame([(f"INS-{i}", d) for i in range(9) for d in ("1992-01-01", "1995-05-05", "2002-02-02")],
                                 "instrument_id string, day string").selectExpr("instrument_id", "'observed' as side", "cast(day as date) as day", "1.0 as price")
    gaps = spark.createDataFrame([], "position_id string, due_by timestamp")
    df = TL.day_span(b, days, gaps)
    held = {r.position_id for r in b.position.collect() if r.instrument_id in {f"INS-{i}" for i in range(9)}}
    got = {r.position_id: (str(r.start), str(r.end)) for r in df.collect()}
    assert held and all(got[p] == ("1992-01-01", "2002-02-02") for p in held)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    join, first = plan.index("Join Inner"), plan.index("Aggregate [instrument_id")
    assert join < first                                                      # the grouping lies below the join
