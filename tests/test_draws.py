"""Seeded draws and the derived attributes that SQL cannot restate."""

from valuwatch.operators import decorrelation as D
from valuwatch.operators import events as E
from valuwatch.operators import fastpath as FP
from valuwatch.sources import files


def test_link_holdout_spares_cases_and_tiers(spark):
    rows = [(f"P{i}", t, "v") for i in range(10) for t in ("deskId", "liquidityTier")]
    bridge = spark.createDataFrame(rows, "entity_id string, ra_type string, ra_value string")
    cases = spark.createDataFrame([("P0",)], "position_id string")
    held = [tuple(r) for r in E.link_holdout(bridge, cases, 6, 42).collect()]
    assert len(set(held)) == 6 and all(e != "P0" and t != "liquidityTier" for e, t, _ in held)
    assert held == [tuple(r) for r in E.link_holdout(bridge.repartition(7), cases, 6, 42).collect()]


def test_random_basis_is_stable_and_sparse(spark):
    atoms = spark.createDataFrame([(f"a{i}", i) for i in range(20)], "atom string, atom_no int")
    draw = lambda seed: {(r.atom, r.gi, r.k): r.v for r in FP.fp_random_basis(atoms, 32, seed).collect()}
    one = draw(1)
    assert one == draw(1) != draw(2) and len(one) == 20 * 5 * 32
    for value, share in ((1.0, 1 / 6), (-1.0, 1 / 6), (0.0, 2 / 3)):
        assert abs(sum(v == value for v in one.values()) / len(one) - share) < 0.03


def test_clusters_become_attributes(spark):
    labels = spark.createDataFrame([("P1", "P1"), ("P2", "P1"), ("P3", "P3")], "node string, community string")
    clusters = D.behaviour_clusters(labels)
    bridge = spark.createDataFrame([("P1", "deskId", "D")], "entity_id string, ra_type string, ra_value string")
    got = {tuple(r) for r in D.cluster_attributes(bridge, clusters).collect()}
    assert got == {("P1", "deskId", "D"), ("P1", "behaviourCluster", "cluster-P1"), ("P2", "behaviourCluster", "cluster-P1")}


def test_case_csv(spark, tmp_path):
    path = tmp_path / "case.csv"
    path.write_text("seq,date,date_precision,event_label,event_id,description,actor_role,amount_usd_m,graph_pattern,rules_broken,"
                    'source,confidence\n1,2012-01-05,day,PriceOverride,PO,"one, two",Trader,,x,R3;R9,S,high\n')
    r = files.load_case_events(spark, str(path)).first()
    assert (r.seq, r.event_id, r.description, r.amount_usd_m, r.rules_broken) == (1, "PO", "one, two", None, "R3;R9")


def test_unique_ids_over_all_labels(spark):
    from valuwatch.operators import graph as G

    rows = [("Desk", "D1"), ("Desk", "D1"), ("Person", "D1"), ("Person", "P"), ("Evidence", "E"), ("Evidence", "E"), ("Evidence", "E"), ("Desk", None)]
    got = G.unique_ids(spark.createDataFrame(rows, "label string, id string")).collect()
    assert {tuple(x) for x in got} == {("Desk", "D1", 2), ("Evidence", "E", 3)}


def test_broken_obligation_parameters_are_kept_apart(spark, tmp_path):
    path = tmp_path / "obligations.csv"
    head = files.OBLIGATION_SCHEMA.replace(" string", "").replace(" int", "").replace(" boolean", "").replace(", ", ",")
    path.write_text(head + '\nR3,n,t,"a, b",c,r,AFTER,5,"{""thresholdBps"":30}",,high,g,true,false\nR4,n,t,x,c,r,AFTER,5,{oops,,high,g,true,false\n')
    rows = {r.rule_id: r for r in files.load_obligations(spark, str(path)).collect()}
    assert rows["R3"].threshold_bps == 30 and rows["R4"].n is None and rows["R4"].sla_days == 5
    assert [tuple(r) for r in files.obligation_faults(spark, str(path)).collect()] == [("R4", "{oops")]
