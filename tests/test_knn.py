"""Two-round neighbour search: exact on spread, clustered and awkward vectors, few rows sent on clustered ones."""

import re

import numpy as np
import pandas as pd
import pytest

from valuwatch.operators import knn as K


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, v array<double>")


def brute(v, k):
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sim = np.round(unit @ unit.T, K.DIGITS)
    np.fill_diagonal(sim, -np.inf)
    return {(a, b) for a in range(len(v)) for b in sorted(range(len(v)), key=lambda b: (-sim[a, b], b))[:k]}


def clustered(n, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16))
    return centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, 16))


@pytest.mark.parametrize("shape", ["spread", "clustered", "lonely", "copies"])
def test_equals_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(K, "CELL", 12)
    monkeypatch.setattr(K, "BLOCK", 16)
    rng = np.random.default_rng(5)
    v = {"spread": rng.normal(size=(220, 3)), "clustered": clustered(220, 9, 1),
         # one dense group and vectors on their own, whose cells hold fewer than k others
         "lonely": np.vstack([np.ones((150, 8)) + 0.01 * rng.normal(size=(150, 8)), 5 * np.eye(8), -5 * np.eye(8)]),
         "copies": np.repeat(rng.normal(size=(60, 4)), 4, axis=0)}[shape]
    got = {(r.a, r.b) for r in K.knn(frame(spark, v), 6).collect()}
    assert got == brute(v, 6)


def test_bounds_hold(monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    tree = K.PivotTree(v[:37])
    leaf, near, far = tree.place(v)
    branch = np.searchsorted(tree.edges, leaf, side="right") - 1
    size = np.bincount(leaf, minlength=37)
    radius = np.array([near[leaf == c].max(initial=-np.inf) for c in range(37)])
    spread = np.array([far[branch == t].max(initial=-np.inf) for t in range(len(tree.branches))])
    d = np.sort(np.linalg.norm(v[:, None] - v[None], axis=2), axis=1)
    assert (K.Cells(tree, size, radius, spread).bound(v, leaf, 7) >= d[:, 7] - 1e-9).all()


def test_rows_sent_grow_with_the_input_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL", 32)
    sent = []
    for n in (800, 3200):
        unit = K.unit_vectors(frame(spark, clustered(n, n // 40, 3)), centre=False).cache()
        placed, tree = K.place(unit)
        home = K.top_k(K.meet(placed.select("id", "v", "cell"), placed, 5), 5)
        sent.append(K.sent_away(placed, tree, home, 5).count() / n)
    assert sent[1] < 1.5 * sent[0] + 0.5


def test_spread_vectors_go_to_groups_not_to_every_cell(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL", 16)
    monkeypatch.setattr(K, "SLICE", 32)
    monkeypatch.setattr(K, "TASK", 100)
    v = np.random.default_rng(4).normal(size=(1000, 24))    # 63 cells, none excluded
    unit = K.unit_vectors(frame(spark, v), centre=False).cache()
    placed, tree = K.place(unit)
    home = K.top_k(K.meet(placed.select("id", "v", "cell"), placed, 5), 5)
    sent = K.sent_away(placed, tree, home, 5)
    assert sent.count() <= (K.PARTS + 1) * len(v)
    assert sent.rdd.getNumPartitions() == 10


@pytest.mark.parametrize("centre", [False, True])
def test_the_length_is_taken_once_a_vector(spark, centre):
    """Not once for each of its elements, which costs the square of the dimension."""
    rows = frame(spark, np.arange(8.0).reshape(2, 4))
    plan = K.unit_vectors(rows, centre)._jdf.queryExecution().optimizedPlan().toString()
    divided = [re.split(r"[/-] ", part)[1] for part in re.findall(r"lambda x_\d+#\d+ [/-] .{12}", plan)]
    assert divided and all(by.startswith("lambda x_") for by in divided)


def test_a_block_keeps_few_candidates_at_a_time(monkeypatch):
    """Whatever a block holds, the best list is cut back to k a query as it grows."""
    monkeypatch.setattr(K, "SLICE", 16)
    seen, merged = [], K._merged
    monkeypatch.setattr(K, "_merged", lambda parts, *rest: (seen.append(sum(len(p[0]) for p in parts)), merged(parts, *rest))[1])
    v = np.random.default_rng(6).normal(size=(300, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = pd.DataFrame({"id": np.arange(300), "v": list(v), "cell": 0})
    got = {(a, b) for x in K._search(rows, rows, 5, None) for a, b in zip(x[0], x[1])}
    assert got == brute(v, 5) and max(seen) <= 5 * 16 + 4 * 5 * 16 + 16 * 16


def test_empty_and_short(spark):
    assert K.knn(frame(spark, np.zeros((0, 3))), 3).count() == 0
    assert K.knn(frame(spark, np.eye(3)[:1]), 3).count() == 0
    assert {(r.a, r.b) for r in K.knn(frame(spark, np.eye(3)), 9).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}


def test_pivots_are_drawn_by_ids_and_not_by_sending_vectors(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL", 8)
    drawn, keep = [], K.written
    monkeypatch.setattr(K, "written", lambda df, name, *more: drawn.append((name, df.columns)) or keep(df, name, *more))
    _, tree = K.place(K.unit_vectors(frame(spark, clustered(200, 9, 1)), centre=False).cache())
    assert len(tree.leaves) == 25 and [c for name, c in drawn if name == "knn-drawn"] == [["id", "key"]] * 2
