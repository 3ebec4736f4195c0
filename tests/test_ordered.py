"""Two-level ordered operators against brute force, with ties and one hot key."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from valuwatch.functions.ordered import asof, neighbour, row_numbers, running_sum

T0 = datetime(2020, 1, 1)


def make(n, seed, hot=0.5):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"k{rng.randrange(4)}", T0 + timedelta(hours=rng.randrange(400)), i, rng.randrange(5))
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, id int, x int")


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof(spark, forward, inclusive):
    left, right = make(150, 1), make(120, 2)
    got = {r.id: r.hit for r in asof(frame(spark, left), frame(spark, right).withColumnRenamed("id", "rid"), ["k"], "t", "t",
                                     {"hit": "rid"}, forward, inclusive, ties=["rid"]).collect()}
    for k, t, i, _ in left:
        if forward:
            near = [(rt, ri) for rk, rt, ri, _ in right if rk == k and (rt >= t if inclusive else rt > t)]
            want = min(near)[1] if near else None
        else:
            near = [(rt, ri) for rk, rt, ri, _ in right if rk == k and (rt <= t if inclusive else rt < t)]
            want = max(near)[1] if near else None
        assert got[i] == want


def test_asof_falls_back_to_the_first(spark):
    left = frame(spark, [("a", T0, 1, 0), ("b", T0, 2, 0)])
    right = frame(spark, [("a", T0 + timedelta(days=3), 7, 0), ("a", T0 + timedelta(days=9), 8, 0)]).withColumnRenamed("id", "rid")
    got = {r.id: r.hit for r in asof(left, right, ["k"], "t", "t", {"hit": "rid"}, False, True, else_first=True).collect()}
    assert got == {1: 7, 2: None}


def test_prefix_sums_places_and_neighbours(spark):
    rows = make(200, 3)
    df = frame(spark, rows)
    order = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        order.setdefault(r[0], []).append(r)
    sums = {r.id: r.s for r in running_sum(df, ["k"], ["t", "id"], "x", "s").collect()}
    places = {r.id: r.n for r in row_numbers(df, ["k"], ["t", "id"], "n").collect()}
    prev = {r.id: r.p for r in neighbour(df, ["k"], ["t", "id"], {"p": "id"}).collect()}
    nxt = {r.id: r.p for r in neighbour(df, ["k"], ["t", "id"], {"p": "id"}, step=1).collect()}
    for line in order.values():
        total = 0
        for i, r in enumerate(line):
            total += r[3]
            assert sums[r[2]] == total and places[r[2]] == i + 1
            assert prev[r[2]] == (line[i - 1][2] if i else None)
            assert nxt[r[2]] == (line[i + 1][2] if i + 1 < len(line) else None)


def test_nothing_runs_a_frame_to_the_end_of_its_group(spark):
    """Spark starts such a frame over at every row, so a key with many days would cost their square."""
    from valuwatch.operators import market as M

    left = spark.createDataFrame([("a", date(2000, 1, 2))], "k string, day date")
    right = spark.createDataFrame([("a", date(2000, 1, 3), 1.0)], "k string, day date, price double")
    prints = right.select(F.col("k").alias("instrument_id"), "day", F.col("price").alias("pr"))
    grid = left.select(F.col("k").alias("instrument_id"), F.col("day").alias("week"))
    found = [asof(left, right, ["k"], "day", "day", {"price": "price"}, forward=fwd, inclusive=True, else_first=not fwd)
             for fwd in (True, False)]
    assert [r.price for f in found for r in f.collect()] == [1.0, 1.0]
    for df in (*found, M.interp_on_grid(prints, grid)):
        plan = df._jdf.queryExecution().analyzed().toString().lower()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
