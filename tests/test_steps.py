"""The clock and threshold index against evaluating every clock and every variant on its own."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from books import book, event, response
from valuwatch.functions.prefix import counts_upto
from valuwatch.model import DEFAULT_RULES, Clocked
from valuwatch.operators import policy as P
from valuwatch.operators import rules as R
from valuwatch.operators import steps as S

T0 = datetime(2020, 1, 1)


def when(r, span=900):
    return str(T0 + timedelta(days=r.randrange(span), hours=r.choice([0, 0, 10])))


@pytest.fixture(scope="module")
def busy(spark):
    """A random population of three positions with every kind of trigger and answer."""
    r = random.Random(21)
    labels = ["MethodologyChange", "PriceOverride", "PriceOverride", "IPVReview", "PnLSignal", "Control", "MAPReview", "DecorrelationSignal"]
    events, answers = [], []
    for k in range(240):
        pos, label = r.choice("PQR"), r.choice(labels)
        events.append(event(f"E{k}", label, when(r), pos, effective_at=when(r) if r.random() < 0.5 else None, deviation_bps=r.choice([None, 5, 25, 26, 40]),
                            pct_of_bid_ask=r.choice([None, 10, 50, 51]), divergence_bps=r.choice([None, 40, 50, 51, 70]),
                            unexplained_pct=r.choice([None, 0.01, 0.02, 0.03]), consecutive_days=r.choice([None, 4, 5, 9]),
                            outcome=r.choice([None, "upheld", "explained"])))
        for j in range(r.choice([0, 0, 1, 2])):
            answers.append(response(f"A{k}.{j}", r.choice(["Approval", "Escalation", "Challenge", "Adjustment"]), f"E{k}", when(r),
                                    person=r.choice(["OUT", "MATE"]), evidenced=r.random() < 0.5, of_position=r.random() < 0.2, label=label, pos=pos))
    positions = [{"position_id": "P", "opened_at": T0}, {"position_id": "Q", "opened_at": T0 + timedelta(days=200), "valid_to": T0 + timedelta(days=800)},
                 {"position_id": "R", "opened_at": T0 + timedelta(days=31)}]
    b = book(spark, events, answers, as_of="2021-09-15", positions=positions,
             attributes=[(p, "liquidityTier", "illiquid") for p in "PQR"], regime=[("RB", "2021-03-31 00:00:00")])
    return b.with_(event=b.event.cache(), response=b.response.cache(), position=b.position.cache())


def counted(rows, *keys):
    return {tuple(x[k] for k in keys): x["n"] for x in rows}


def test_clocks_equal_single_evaluations(busy):
    clocks = ["2019-06-01", "2020-06-30 10:00:00", "2021-03-31", "2021-05-30 10:00:00", "2022-12-31"]
    got = counted(S.early_detection(busy, clocks).collect(), "as_of", "rule_id", "status")
    want = {}
    for c in clocks:
        rows = R.expected_controls(busy, as_of=c).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n")).collect()
        want |= {(datetime.fromisoformat(c), x["rule_id"], x["status"]): x["n"] for x in rows}
    assert got == want and {k[1] for k in want} == {f"R{k}" for k in range(1, 11)}


def test_a_thousand_clocks_need_no_larger_plan(busy):
    def plan(clocks):
        return S.early_detection(busy, clocks)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    many = [str((T0 + timedelta(days=k)).date()) for k in range(1000)]
    assert plan(many) == plan(many[:2])
    got = counted(S.early_detection(busy, many).collect(), "as_of", "rule_id", "status")
    assert len({k[0] for k in got}) > 900
    for k in (333, 999):
        rows = R.expected_controls(busy, as_of=many[k]).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n")).collect()
        at = datetime.fromisoformat(many[k])
        assert {(x["rule_id"], x["status"]): x["n"] for x in rows} == {(a, s): n for (t, a, s), n in got.items() if t == at}


def overlay(spark, rows):
    return spark.createDataFrame(rows, "variant_id string, rule_id string, param string, value string")


def single(b, variant):
    rows = R.evaluate(b, (variant,)).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n")).collect()
    return {(x["rule_id"], x["status"]): x["n"] for x in rows}


def test_sweep_equals_single_evaluations(spark, busy):
    choices = {("R2", "slaDays"): [0, 7, 30, 400], ("R3", "slaDays"): [0, 5, 200], ("R3", "thresholdBps"): [4.5, 25, 100], ("R3", "pctOfBidAsk"): [0, 10, 50],
               ("R4", "n"): [1, 2, 3], ("R4", "windowDays"): [30, 90, 300], ("R4", "slaDays"): [0, 10, 60], ("R5", "divergenceBps"): [0, 50, 69],
               ("R5", "slaDays"): [0, 30, 300], ("R6", "unexplainedThreshold"): [0.0, 0.015, 0.02], ("R6", "consecutiveDays"): [0, 5, 6], ("R6", "slaDays"): [1, 90],
               ("R7", "periodMonths"): [1, 6, 12], ("R7", "regimeSlaDays"): [0, 30, 365], ("R8", "sameDeskAllowed"): ["true", "false"], ("R10", "slaDays"): [0, 20, 90]}
    r = random.Random(5)
    rows = []
    for v in range(5):
        for (rule, param), values in choices.items():
            if r.random() < 0.7:
                rows.append((f"V{v:02}", rule, param, str(r.choice(values))))
    overlays = overlay(spark, rows)
    got = {}
    for x in S.policy_sweep(busy, overlays).collect():
        got.setdefault(x["variant_id"], {})[x["rule_id"], x["status"]] = x["n"]
    variants = P.variants_of(busy, overlays)
    for v in variants:
        assert got[v.variant_id] == single(busy, v), v
    again = S.policy_sweep(busy, variants).collect()
    assert sorted(map(tuple, again)) == sorted((v, r_, s, n) for v, some in got.items() for (r_, s), n in some.items())


def test_ten_thousand_variants(spark, busy):
    edits = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(p).alias("param"), v.cast("string").alias("value")) for r, p, v in (
        ("R3", "thresholdBps", F.col("id") % 100), ("R3", "slaDays", (F.col("id") / 100).cast("int")), ("R2", "slaDays", F.col("id") % 977),
        ("R6", "consecutiveDays", F.col("id") % 11))])
    overlays = spark.range(10_000).select(F.format_string("V%05d", "id").alias("variant_id"), F.inline(edits))

    def lines(some):
        return S.policy_sweep(busy, some)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    done = S.policy_sweep(busy, overlays)
    assert lines(overlays.where("variant_id <= 'V00001'")) == done._jdf.queryExecution().optimizedPlan().toString().count("\n")
    asked = ("V00000", "V04321")
    rows = done.where(F.col("variant_id").isin(*asked)).collect()
    for k in asked:
        (v,) = P.variants_of(busy, overlays.where(F.col("variant_id") == k))
        assert {(x["rule_id"], x["status"]): x["n"] for x in rows if x["variant_id"] == k} == single(busy, v)
    assert done.select("variant_id").distinct().count() == 10_000


def test_rules_without_facts(spark):
    b = book(spark, [event("E", "Incident", "2021-01-01")], attributes=(("P", "liquidityTier", "liquid"),))
    assert S.early_detection(b, ["2022-01-01"]).count() == 0
    assert S.policy_sweep(b, overlay(spark, [("V", "R2", "slaDays", "3")])).count() == 0
    assert S.policy_sweep(b, (Clocked("V", b.as_of, DEFAULT_RULES),)).count() == 0


def test_counts_upto_is_a_dominance_count(spark):
    r = random.Random(8)
    facts = [(r.choice("xy"), r.choice([None, *range(-5, 6)]), r.randrange(-5, 6) / 2, r.randrange(1, 4)) for _ in range(300)]
    limits = [(r.randrange(-6, 7), r.randrange(-6, 7) / 2) for _ in range(40)]
    a = spark.createDataFrame(facts, "g string, p int, q double, n bigint")
    z = spark.createDataFrame(limits, "lp int, lq double").distinct()
    got = counts_upto(a, z, {"p": ("lp", sorted({x for x, _ in limits})), "q": ("lq", sorted({y for _, y in limits}))}, ["g"])
    want = {(x, y, g): sum(n for h, p, q, n in facts if h == g and p is not None and p <= x and q <= y) for x, y in limits for g in "xy"}
    assert {(x["lp"], x["lq"], x["g"]): x["n"] for x in got.collect()} == {k: n for k, n in want.items() if n}
