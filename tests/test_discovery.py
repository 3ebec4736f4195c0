"""Discovery operators against published numbers, brute force and small graphs."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from valuwatch.operators import communities as C
from valuwatch.operators import decorrelation as D
from valuwatch.operators import fastpath as FP
from valuwatch.operators import knn as K

WORKED = FP.Params(grid_points=4, theta=9.0, window=1, smoothing=0.5, decay=0.1)
BASIS = {0: (1, -1, 1, 1), 1: (1, 1, -1, 1), 2: (-1, 1, 1, -1), 3: (1, 1, 1, -1)}


def worked_events(spark, shift=0):
    rows = [("Joe", f"e{i}", float(10 + shift - (t + shift)), ["checkup" if i == 3 else "aspirin"]) for i, t in enumerate((10, 3, 9, 0))]
    return spark.createDataFrame(rows, "position_id string, event_id string, elapsed double, atoms array<string>")


def worked_basis(spark):
    return spark.createDataFrame([("aspirin", gi, k, float(v)) for gi, vec in BASIS.items() for k, v in enumerate(vec)],
                                 "atom string, gi int, k int, v double")


def test_worked_example(spark):
    events, basis = worked_events(spark), worked_basis(spark)
    got = {r.k: r.v for r in FP.fp_given_basis(FP.fp_embedding(events, WORKED), basis).collect()}
    assert [round(got[k], 4) for k in range(4)] == [0.8586, 0.2750, 0.5971, 0.5294]
    cells = {}
    for r in FP.fp_event_embedding(events, WORKED).where("event_id in ('e1', 'e2')").collect():
        for k, v in enumerate(BASIS[r.gi]):
            cells[r.event_id, k] = cells.get((r.event_id, k), 0) + r.v * v
    assert [round(cells["e1", k], 4) for k in range(4)] == [-0.0931, 1.0, 0.7561, -0.7561]
    assert [round(cells["e2", k], 4) for k in range(4)] == [1.0, -0.2449, 0.2449, 1.0]
    assert FP.basis_faults(FP.fp_embedding(events, WORKED), basis).isEmpty()
    assert FP.basis_faults(FP.fp_embedding(events, WORKED), basis.where("gi < 2")).count() == 2
    assert FP.basis_faults(FP.fp_embedding(events, WORKED), basis.where("gi > 0 or k > 0")).first().fault == "mixed dimensions"


def test_weights_sum_to_one_and_ties_take_the_lower_point(spark):
    events = spark.createDataFrame([("p", f"e{i}", float(t), ["x"]) for i, t in enumerate((0, 1.5, 4.5, 9))],
                                   "position_id string, event_id string, elapsed double, atoms array<string>")
    rows = FP.fp_smoothing(events, WORKED).collect()
    for i in range(4):
        assert math.isclose(sum(r.w for r in rows if r.event_id == f"e{i}"), 1.0)
    assert sorted(r.gi for r in rows if r.event_id == "e1") == [0, 1]     # 1.5 is as near to 0 as to 3
    assert sorted(r.gi for r in rows if r.event_id == "e2") == [0, 1, 2]  # 4.5 goes to 3


def brute(vectors, k):
    ids = [i for i, _ in vectors]
    m = np.array([v for _, v in vectors], dtype=float)
    m = m / np.linalg.norm(m, axis=1)[:, None]
    sim = np.round(m @ m.T, K.DIGITS)
    return {(a, ids[j]) for i, a in enumerate(ids)
            for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sim[i, j], ids[j]))[:k]}


@pytest.mark.parametrize("clustered", [True, False])
def test_knn_is_exact_with_copies_and_many_cells(spark, clustered, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(K, "BLOCK", 16)
    centres = rng.normal(size=(6, 8)) * (10 if clustered else 0)
    vectors = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(150)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(40)]  # copies of one vector
    df = spark.createDataFrame(vectors, "id bigint, v array<double>")
    got = {(r.a, r.b) for r in K.knn(df, 5).collect()}
    assert got == brute(vectors, 5)


def test_pearson_ignores_level_and_flat_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [11.0, 12.0, 13.0]), (3, [3.0, 2.0, 1.0]), (4, [5.0, 5.0, 5.0])],
                               "id bigint, v array<double>")
    got = {(r.a, r.b): round(r.similarity, 6) for r in K.knn(df, 1, "pearson").collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (3, 1): -1.0}


def test_two_cliques_and_a_bridge(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0)]
    edges = spark.createDataFrame(pairs, "a string, b string, w double")
    labels = C.louvain(edges)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert groups == {"a0": {f"a{i}" for i in range(5)}, "b0": {f"b{i}" for i in range(5)}}
    assert C.modularity(edges, labels).first().q == pytest.approx(2 * (20 / 42 - (21 / 42) ** 2), abs=1e-6)


def marks_frame(spark, series):
    start = date(2022, 1, 7)
    return spark.createDataFrame([(p, start + timedelta(days=7 * i), v) for p, vs in series.items() for i, v in enumerate(vs) if v],
                                 "position_id string, day date, clean double")


def walk(seed, n, scale=0.01):
    rng = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * (1 + rng.gauss(0, scale)))
    return out


def signals(spark, series, **kw):
    groups = spark.createDataFrame([(p, "|g") for p in series], "position_id string, grp string")
    return D.decorr_signals(D.rolling_pearson(D.peer_mean(D.mark_returns(marks_frame(spark, series)), groups)), **kw)


def test_frozen_marks_count_as_a_breach(spark):
    base = walk(1, 20)
    series = {f"p{i}": [v * (1 + 0.0001 * i) for v in base] for i in range(5)}
    series["frozen"] = [100.0] * 20
    rows = signals(spark, series).collect()
    assert [(r.position_id, r.correlation) for r in rows] == [("frozen", 0.0)]
    assert rows[0].day == date(2022, 1, 7) + timedelta(days=7 * 8)  # the eighth return


def test_a_row_without_peers_breaks_the_streak(spark):
    base = walk(2, 11)
    series = {f"p{i}": list(base) for i in range(3)}
    series["frozen"] = [100.0] * 11
    assert signals(spark, series, periods=3).count() == 1
    for i in range(2):
        series[f"p{i}"][9] = None  # too few peers in the second evaluated window
    assert signals(spark, series, periods=2).isEmpty()


def test_independence_is_three_valued(spark):
    from books import book

    b = book(spark)
    people = b.person.unionByName(spark.createDataFrame(
        [("X", "x", None, "C"), ("Y", "y", None, "D"), ("Z", "z", "Model risk", "NOWHERE"), ("W", "w", "Trader", "NOWHERE")],
        "person_id string, name string, role string, desk_id string"))
    got = {r.person_id: r.independent for r in C.independence_flag(b.with_(person=people)).collect()}
    assert got == {"OWN": False, "MATE": False, "OUT": True, "X": True, "Y": None, "Z": True, "W": None}


def test_pairs_meet_vectors_and_not_rows_of_cells(spark):
    rows = [("p", "x", 0, 3.0), ("p", "y", 1, 4.0), ("q", "x", 0, 1.0), ("q", "z", 2, 2.0), ("r", "x", 0, 2.0), ("r", "y", 1, 2.0)]
    cells = spark.createDataFrame(rows, "position_id string, atom string, gi int, v double")
    pairs = spark.createDataFrame([("p", "q", 0.5), ("p", "r", 0.25), ("r", "none", 0.0), ("none", "nil", 0.0)], "a string, b string, similarity double")
    near = FP.euclid_rerank(pairs, cells)
    assert {(x.a, x.b): x.euclid for x in near.collect()} == {
        ("p", "q"): 4.899, ("p", "r"): 2.2361, ("r", "none"): 2.8284}
    top = FP.top_dimensions(pairs, cells)
    assert sorted(tuple(x) for x in top.collect()) == [("p", "q", 1, "x", 0, 1.0), ("p", "r", 1, "y", 1, 2.0), ("p", "r", 2, "x", 0, 2.0)]
    for df in (near, top):                                                   # no pair is shuffled once a cell
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "hashpartitioning(a#" in x and "atom#" in x], plan
