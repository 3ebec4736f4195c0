"""Communities on small graphs against all partitions, and what every result must satisfy."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from valuwatch.operators import communities as C


def quality(edges, label, resolution=1.0):
    k, inside, two_m = defaultdict(float), defaultdict(float), 0.0
    for a, b, w in edges:
        if a != b:
            two_m += 2 * w
            for x in (a, b):
                k[label[x]] += w
            if label[a] == label[b]:
                inside[label[a]] += 2 * w
    return sum(inside[c] / two_m - resolution * (k[c] / two_m) ** 2 for c in k)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1:]]


def run(spark, edges, **more):
    df = spark.createDataFrame(edges, "a string, b string, w double")
    return {x["node"]: x["community"] for x in C.louvain(df, **more).collect()}


def settled(edges, label, resolution=1.0):
    """No single move improves, communities are connected and lie in one component."""
    best = quality(edges, label, resolution)
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for x in label:
        for c in {label[y] for y in near[x]} | {"alone"}:
            assert quality(edges, {**label, x: c}, resolution) <= best + 1e-9, (x, c)
    for c in set(label.values()):
        some = {x for x in label if label[x] == c}
        reached, todo = set(), [min(some)]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += near[x] & some
        assert reached == some and c == min(some)


@pytest.mark.parametrize("seed", [1, 2])
def test_small_graphs(spark, seed):
    r = random.Random(seed)
    names = "abcdefgh"
    edges = [(a, b, float(r.choice([1, 1, 2, 5]))) for k, a in enumerate(names) for b in names[k + 1:] if r.random() < 0.4] + [("a", "a", 3.0)]
    label = run(spark, edges)
    assert set(label) == {x for a, b, _ in edges if a != b for x in (a, b)}
    settled(edges, label)
    top = max(quality(edges, {x: k for k, some in enumerate(p) for x in some}) for p in partitions(sorted(label)))
    assert quality(edges, label) >= top - 0.05


def test_cliques_a_star_and_components(spark):
    def clique(p, n):
        return [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(n) for j in range(i)]

    edges = clique("a", 6) + clique("b", 6) + [("a0", "b0", 1.0)] + [("hub", f"leaf{k}", 1.0) for k in range(40)] + [("z1", "z2", 1.0)]
    label = run(spark, edges)
    settled(edges, label)
    groups = defaultdict(set)
    for x, c in label.items():
        groups[c].add(x)
    assert groups["a0"] == {f"a{k}" for k in range(6)} and groups["b0"] == {f"b{k}" for k in range(6)}
    assert groups["z1"] == {"z1", "z2"} and label["hub"] == label["leaf0"]
    assert run(spark, edges) == label                                   # a rerun agrees


def test_no_edges(spark):
    assert run(spark, []) == {} and run(spark, [("a", "a", 1.0)]) == {}


def test_few_rounds_and_small_blocks(spark, monkeypatch):
    r = random.Random(5)
    edges = [(f"n{r.randrange(80):02}", f"n{r.randrange(80):02}", 1.0) for _ in range(500)]
    made, keep = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name, *more: made.append(name) or keep(df, name, *more))
    settled(edges, run(spark, edges))
    assert made.count("louvain-labels") <= 8
    monkeypatch.setattr(C, "BLOCK_LINKS", 100)                           # several blocks, joint moves may lose
    some = edges[:150]
    settled(some, run(spark, some))


def test_nodes_near_the_last_moves_get_turns_of_their_own(spark, monkeypatch):
    r = random.Random(7)
    edges = [(f"n{k:03}", f"n{(k + step) % 200:03}", r.choice([1.0, 1.5, 2.0])) for k in range(200) for step in (1, 2, 3)]
    dealt, keep = [], C._block_moves

    def moves(*args):
        dealt.append(args[5])
        return keep(*args)

    monkeypatch.setattr(C, "_block_moves", moves)
    monkeypatch.setattr(C, "BLOCK_LINKS", 150)
    graph = C.written(C._both_ways(spark.createDataFrame(edges, "a string, b string, w double")), "graph").cache()
    labels = graph.selectExpr("src as node", "src as community").distinct().cache()
    label, moved = C._local_moves(graph, labels, sum(2 * w for _, _, w in edges) * C.SCALE, 1.0)
    assert moved and dealt[0] == dealt[-1] == 8 and min(dealt) < 8, dealt   # the last turn asks all nodes
    label = {x["node"]: x["community"] for x in label.collect()}
    best = quality(edges, label)
    for x in label:
        assert all(quality(edges, {**label, x: c}) <= best + 1e-9 for c in set(label.values())), x


def test_one_block_settles_in_one_turn_and_is_not_measured(spark, monkeypatch):
    edges = [(f"n{k:03}", f"n{(k + step) % 200:03}", 1.0 + (k * step) % 3 / 2) for k in range(200) for step in (1, 2, 3)]
    dealt, keep = [], C._block_moves
    monkeypatch.setattr(C, "_block_moves", lambda *args: dealt.append(args[6]) or keep(*args))
    monkeypatch.setattr(C, "_quality", lambda *args: pytest.fail("modularity of moves that surely raise it"))
    settled(edges, run(spark, edges))
    assert max(dealt) == 1                                                # moves, and a turn that finds none


def test_numbers_sent_for_names_keep_their_order(spark):
    edges = [(10, 9, 1.0), (9, 2, 1.0), (2, 10, 1.0), (100, 11, 2.0)]       # as text, 10 comes before 9
    named = run(spark, [(f"n{a}", f"n{b}", w) for a, b, w in edges])
    assert named == {"n10": "n10", "n9": "n10", "n2": "n10", "n100": "n100", "n11": "n100"}
