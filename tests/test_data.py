"""Sources, market ETL, event modelling, policy and text on small inputs."""

import random
from datetime import date

import pytest
from books import at, book, event, response, table
from pyspark.sql import functions as F

from valuwatch.model import DEFAULT_RULES
from valuwatch.operators import events as E
from valuwatch.operators import market as M
from valuwatch.operators import policy as P
from valuwatch.operators import scenarios as S
from valuwatch.operators import text as T
from valuwatch.sources import files, tables


def test_obligations_csv(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text(
        "id,name,trigger_event,trigger_condition,required_control,required_by_role,timing,sla_days,params_json,"
        "applies_to_attribute,severity,gap_definition,default_broken_by_TP,default_broken_by_FP\n"
        'R2,Post,MC,any,IPV,team,AFTER,30,"{""slaDays"":45}",,medium,"late, or never",true,true\n'
        'R3,Over,PO,any,A,team,AFTER,5,"{""thresholdBps"":25,""pctOfBidAsk"":50}",,high,g,true,false\n'
        "R8,Seg,A,any,x,,STRUCTURAL,0,{},,high,g,true,false\n")
    rules = {r.rule_id: r for r in files.rules_from(files.load_obligations(spark, str(path)))}
    assert rules["R2"].sla_days == 45 and rules["R2"].gap_definition == "late, or never"
    assert (rules["R3"].threshold_bps, rules["R3"].pct_of_bid_ask, rules["R3"].applies_to) == (25.0, 50.0, None)
    assert rules["R8"].same_desk_allowed is False and rules["R3"].same_desk_allowed is None


def test_liquidity_register_later_file_wins(spark, tmp_path):
    def record(i, kind, flag):
        return f"<RefData><Id>{i}</Id><FinInstrmClssfctn>{kind}</FinInstrmClssfctn><Lqdty>{flag}</Lqdty></RefData>"

    (tmp_path / "2022-01.xml").write_text("<R>" + record("US1234567890", "BOND", "false") + record("US1111111110", "SHRS", "true") + "</R>")
    (tmp_path / "2022-02.xml").write_text("<R>" + record("US1234567890", "BOND", "true") + record("DE1234567890", "BOND", "true") + "</R>")
    got = files.liquidity_flags(spark, str(tmp_path)).collect()
    assert [(r.cusip, r.liquid) for r in got] == [("123456789", True)]


def test_curve_csv_keeps_blank_last_day(spark, tmp_path):
    names = list(files.CURVE_COLUMNS)
    path = tmp_path / "curve.csv"
    path.write_text("observation_date," + ",".join(names) + "\n2022-01-28," + ",".join(["1.0"] * 11) + "\n2022-01-31," + "," * 10
                    + "\n2022-02-01,2.0" + "," * 10 + "\n")
    curve = M.curve_month_end(files.read_curve(spark, str(path), "2022-01-01", "2022-12-31"))
    days = {r.day for r in curve.collect()}
    assert days == {date(2022, 1, 31), date(2022, 2, 1)}
    d = spark.createDataFrame([(date(2022, 1, 1), 5.0), (date(2022, 2, 1), 5.0)], "month date, duration double")
    assert [(r.month, r.treasury) for r in M.curve_yield(curve, d).collect()] == [(date(2022, 2, 1), 2.0)]


def test_sparse_curve_interpolates_and_clamps(spark):
    m = date(2022, 1, 1)
    points = spark.createDataFrame([(m, 1.0, 1.0), (m, 2.0, None), (m, 5.0, 3.0)], "month date, tenor_years double, yield double")
    d = spark.createDataFrame([(m, x) for x in (0.5, 1.0, 3.0, 5.0, 9.0)], "month date, duration double")
    got = {r.duration: r.treasury for r in M.curve_yield(points, d).collect()}
    assert got == {0.5: 1.0, 1.0: 1.0, 3.0: 2.0, 5.0: 3.0, 9.0: 3.0}


def test_average_rank_matches_pandas(spark):
    import pandas as pd

    values = [5.0, 1.0, 5.0, 2.25, 2.251, 5.0, 0.0, 9.5]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r.i: r.r for r in M.average_rank_pct(df, "v", "r", 0.5).collect()}
    assert [got[i] for i in range(len(values))] == pytest.approx(pd.Series(values).rank(pct=True).tolist())


def test_month_end_takes_last_value_per_column(spark):
    rows = [("I", date(2022, 1, 3), 10.0, 0.02, 4.0, None, 11.0), ("I", date(2022, 1, 9), None, 0.03, None, None, None)]
    df = spark.createDataFrame(rows, "instrument_id string, day date, pr double, ytm double, mod_dur double, prc_bid double, prc_ask double")
    r = M.month_end(df).first()
    assert (r.day, r.pr, r.ytm, r.mod_dur, r.bid, r.ask) == (date(2022, 1, 9), 10.0, 0.03, 4.0, None, 11.0)


def test_event_prices_fall_back_and_shift(spark):
    b = book(spark, [event("M", "MethodologyChange", "2022-01-01 23:00"), event("PO", "PriceOverride", "2022-01-05", deviation_bps=100, side="favourable"),
                     event("I", "IPVReview", "2022-01-05", divergence_bps=200), event("S", "PnLSignal", "2022-01-05")])
    schema = "instrument_id string, side string, day date, price double"
    prices = [("I", "observed", date(2022, 1, 3), 100.0), ("I", "observed", date(2022, 1, 5), 50.0), ("I", "observed", date(2022, 1, 5), 60.0)]
    got = {r.event_id: (r.trader_mark, r.model_price, r.ipv_price)
           for r in E.annotate_event_prices(b, spark.createDataFrame(prices, schema)).collect()}
    assert got == {"M": (100.0, None, None), "PO": (60.6, None, None), "I": (60.0, None, 58.8)}
    model = spark.createDataFrame([("I", "model", date(2022, 1, 1), 80.0)], schema)
    assert {r.trader_mark for r in E.annotate_event_prices(b, model).where("label = 'IPVReview'").collect()} == {80.0}


def test_leap_day_shift_and_case_intake(spark):
    d = spark.createDataFrame([(date(2012, 2, 29),)], "d date")
    assert E.shift_years(d, "d", 1, "s").first().s == date(2013, 2, 28)
    schema = files.CASE_SCHEMA + ", position_id string"
    rows = [{"seq": 2, "date": date(2012, 2, 1), "date_precision": "month", "event_label": "PnLSignal", "event_id": "PNL-FEB", "position_id": "C"},
            {"seq": 1, "date": date(2012, 1, 5), "date_precision": "day", "event_label": "PriceOverride", "event_id": "PO", "position_id": "C"},
            {"seq": 3, "date": date(2012, 3, 1), "date_precision": "day", "event_label": "Gossip", "event_id": "X", "position_id": "C"}]
    events, chain, bad = E.load_case(table(spark, schema, rows))
    assert {r.event_id: r.event_at for r in events.collect()}["PNL-FEB"] == at("2012-02-21 12:00:00")
    assert [(r.src, r.dst) for r in chain.collect()] == [("PO", "PNL-FEB")] and [r.event_id for r in bad.collect()] == ["X"]


def test_policy_edit_and_reset(spark):
    b = book(spark)
    overlays = spark.createDataFrame([("V", "R2", "slaDays", "15"), ("V", "R3", "slaDays", "9"), ("V", "R3", "thresholdBps", "40")],
                                     "variant_id string, rule_id string, param string, value string")
    got = {(r.variant_id, r.rule_id): (r.sla_days, r.params) for r in P.policy_overlay(b, overlays).collect()}
    assert got["V/edit", "R2"] == (15, "slaDays=15") and got["V/reset", "R2"] == (30, "slaDays=30")
    assert got["V/edit", "R3"] == (9, "pctOfBidAsk=50,thresholdBps=40")
    assert got["V/reset", "R3"] == (9, "pctOfBidAsk=50,thresholdBps=25")  # an SLA outside the parameters stays edited
    (variant,) = P.variants_of(b, overlays)
    assert (variant.rule("R3").threshold_bps, variant.rule("R3").sla_days, variant.rule("R1")) == (40.0, 9, DEFAULT_RULES[0])


def test_lower_threshold_never_removes_a_trigger(spark):
    b = book(spark, [event(f"PO{i}", "PriceOverride", f"2022-0{i + 1}-01", deviation_bps=10 * i) for i in range(6)])
    overlays = spark.createDataFrame([(f"T{t:02d}", "R3", "thresholdBps", str(t)) for t in (5, 25, 45)],
                                     "variant_id string, rule_id string, param string, value string")
    counts = {r.variant_id: r.n for r in P.policy_sweep(b, P.variants_of(b, overlays)).where("rule_id = 'R3'").collect()}
    assert counts == {"T05": 5, "T25": 3, "T45": 1}


def test_read_across_scores(spark):
    b = book(spark, positions=[{"position_id": p, "opened_at": at("2019-01-01")} for p in ("P", "Q")])
    b = b.with_(incident=spark.createDataFrame([("INC", "P")], "incident_id string, position_id string"))
    gaps = spark.createDataFrame([("P", "R3"), ("P", "R3"), ("Q", "R3"), ("P", "R8")], "position_id string, rule_id string")
    pattern = S.pattern_extract(b, gaps)
    got = {r.position_id: (r.satisfied, r.missing, r.score, r.confirmed_incident) for r in S.read_across(b, gaps, pattern).collect()}
    assert got == {"P": ("R3,R8,liquidityTier=illiquid", "", 1.0, True), "Q": ("R3", "R8,liquidityTier=illiquid", 0.333333, False)}
    assert S.read_across(b, gaps, pattern.where(F.lit(False))).isEmpty()


def test_conjunction_counts_do_not_multiply(spark):
    b = book(spark, [event(f"PO{i}", "PriceOverride", "2022-01-01") for i in range(3)] + [event("S", "PnLSignal", "2022-01-01")],
             [response("A", "Approval", "PO0", "2022-01-02")])
    gaps = spark.createDataFrame([("P", r) for r in ("R3", "R3", "R9")], "position_id string, rule_id string")
    r = S.conjunction(b, gaps).first()
    assert (r.signals, r.overrides, r.method_changes, r.broken_rules, r.conjunction_score) == (1, 3, 0, "R3,R9", 8)


def test_text_helpers(spark):
    terms = spark.createDataFrame([(t,) for t in ("IPV", "IPV review", "P&L", "L")], "term string")
    said = spark.createDataFrame([(1, "An ipv review, then IPV.\nP&L and IPV")], "text_id int, text string")
    assert sorted(tuple(r)[1:] for r in T.glossary_tag(said, terms).collect()) == [
        (0, "IPV", 20, 3), (0, "IPV review", 3, 10), (1, "P&L", 0, 3)]
    texts = spark.createDataFrame([(1, "see PO-TP-03, POS-TP. Then PO-TP-03 and XPO-1")], "text_id int, text string")
    assert [(r.pos, r.id) for r in T.mention_ids(texts).collect()] == [(0, "PO-TP-03"), (1, "POS-TP")]
    docs = spark.createDataFrame([(1, "mc-mark, override, ipv-q1 r1 r3"), (2, "override, ipv-q1, mc-mark r1 r2"), (3, "nothing")],
                                 "text_id int, text string")
    got = T.chronology_grade(docs, (("mc-mark",),), (("override",),), (("ipv-q1",), ("ipv",)), ("r1", "r2", "r3", "r5"))
    assert {r.text_id: r.reason for r in got.collect()} == {1: "ok", 2: "order", 3: "no change"}


def test_detach_removes_touching_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    n, e = E.detach(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert {r.id for r in n.collect()} == {"b", "c"} and [tuple(r) for r in e.collect()] == [("b", "c")]


def test_lines_are_sent_once_before_days_are_made(spark):
    from valuwatch.sources.tables import bind

    plan = bind(spark, "/root/testdata/sf0.001").trades._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("REPARTITION_BY_COL", 1)[1].split("Scan parquet")[0]


def test_lines_are_sent_once_to_their_events(spark):
    line = spark.createDataFrame([(7, 1, at("2000-01-03"), 5, "A", "F"), (7, 1, at("2000-01-02"), 9, "R", "O"), (7, 2, at("2000-01-05"), 3, "N", "O"),
                                  (8, 7, at("2000-01-01"), 4, "R", "F"), (9, 1, at("2000-01-01"), 4, "R", "F")],
                                 "l_orderkey bigint, l_linenumber int, l_shipdate timestamp_ntz, l_suppkey bigint, l_returnflag string, l_linestatus string")
    events = spark.createDataFrame([("EV-7", "PriceOverride", "P"), ("EV-8", "IPVReview", "Q")], "event_id string, label string, position_id string")
    for parts in (None, 5):
        got = tables._response(line, events, parts)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = {r.response_id: (r.kind, r.source_event_id, r.event_at, r.person_id, r.evidenced, r.of_position, r.source_label, r.position_id)
                for r in got.collect()}
        assert rows == {"RS-7-1": ("Approval", "EV-7", at("2000-01-02 01:00"), "PER-5", True, False, "PriceOverride", "P"),
                        "RS-7-2": ("Challenge", "EV-7", at("2000-01-05 02:00"), "PER-3", True, False, "PriceOverride", "P"),
                        "RS-8-7": ("Escalation", "EV-8", at("2000-01-01 07:00"), "PER-4", False, True, "IPVReview", "Q")}
        assert plan.count("Exchange hashpartitioning") <= 2  # lines, and events unless they are few
        assert plan.count("hashpartitioning(l_orderkey") == 0
    assert "hashpartitioning(source_event_id" in plan and ", 5)" in plan


def test_chain_paths_order_the_chain_once(spark):
    draw = random.Random(5)
    events = [event(f"E{k:03}", draw.choice(["PriceOverride", "IPVReview", "PnLSignal"]), f"2020-01-{draw.randint(1, 28):02} {draw.randint(0, 3):02}:00",
                    pos=draw.choice("PQ")) for k in range(120)]
    b = book(spark, events, [response("A", "Approval", "E001", "2020-01-09")], marks=[{"position_id": "P", "day": date(2020, 1, 31), "clean": 1.0}])
    chain = sorted([(e["position_id"], e["event_at"], e["event_id"], e["label"]) for e in events] + [("P", at("2020-01-09"), "A", "Approval"), ("P", at("2020-01-31 17:00"), "MK-P-2020-01-31", "Mark")])
    for most in (1, 3, 10):
        want = {(x[0], x[2], z[2], h, (z[1] - x[1]).days) for i, x in enumerate(chain) if x[3] == "PriceOverride"
                for h, z in enumerate(chain[i + 1:i + 1 + most], 1) if z[0] == x[0] and z[3] == "IPVReview"}
        got = S.chain_paths(b, most)
        assert str(got._jdf.queryExecution().optimizedPlan()).count("Window [") == 2  # within a day, and over the days
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want) > 10
    assert got.schema["hops"].dataType.simpleString() == "int"
