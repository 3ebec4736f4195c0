"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words.  Among all document rates that meet the targets and stay
within the largest allowed number of repeats, the ones closest to "every document once" in relative
entropy have the form rate = min(cap, exp(lambda_source * size)).  The multipliers solve the convex dual
by safeguarded Newton steps.  Rates depend on a document only through its source and size, so the
steps run on a histogram; documents are read once for it and once to hand out the copies.

Rates become whole copies in two moves: running totals within a source, in order of size, decide how
many copies a histogram cell gets (systematic rounding), then single copies are added or taken where
that brings a source closer to its target.  A cell's copies are dealt to its documents in hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written
from .common import n_words, pack, unpack

WEIGHTS = (1, 2, 3)
CAP = 3
TOLERANCE = 1e-9
MAX_STEPS = 80
#: A source this near its target, relatively, is left as it is.
NEAR = 2e-4
#: Groups a (source, size) cell is dealt in; a cell may hold a third of all documents.
DEALT = 1024


def source_key(source: Column) -> Column:
    """A key that is never null: sources with a name sort by code point, the missing one last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(histogram: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source_key, source_size, n_docs, target) for each source of a (source_key, size, n) histogram.

    Weights repeat along the sources in order of key.  Shares of all words stop at `cap` times a
    source's words and the excess goes to the others by weight until none is above.  The windows here
    run over one row per source; sources are names of data sets, not data.
    """
    sources = histogram.groupBy("source_key").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"),
        F.max("size").alias("largest"))
    rank = F.row_number().over(Window.orderBy("source_key"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key").rowsBetween(
        Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # The water level t solves sum(min(cap * size, weight * t)) = total: the largest of the levels at
    # which the k sources that fill first are full.
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(by_level), zero)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), zero))
    return (sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1))
            .withColumn("t", level).withColumn("t", F.max("t").over(everything))
            .withColumn("target", F.least(cap * F.col("source_size").cast("double"), F.col("weight") * F.col("t")))
            .drop("t", "weight"))


def _rate(lam: Column, x: Column, cap: int) -> Column:
    return F.exp(F.least(lam * x, F.lit(math.log(cap))))


def solve_rates(histogram: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """(source_key, lam, scale): the multiplier of each source on sizes divided by `scale`.

    The dual of a source is convex in its multiplier; its slope is the words taken less the target.  A
    Newton step that leaves the bracket found so far is replaced by halving the bracket.
    """
    state = written(goals.where("source_size > 0").select(
        "source_key", "target", (F.col("source_size") / F.col("n_docs")).alias("scale"),
        F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"),
        # at its upper limit a source is taken `cap` times as it is
        (F.col("target") >= cap * F.col("source_size").cast("double")).alias("full"),
        F.lit(False).alias("settled")).coalesce(1), "mix-state")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("lam"), x, cap)
        sums = histogram.join(state.where("not full and not settled"), "source_key").groupBy("source_key").agg(
            F.sum(F.col("n") * x * rate).alias("taken"),
            F.sum(F.when(F.col("lam") * x < math.log(cap), F.col("n") * x * x * rate).otherwise(0.0)).alias("bend"))
        lam, goal = F.col("lam"), F.col("target") / F.col("scale")
        off = F.col("taken") - goal
        lo = F.when(off < 0, lam).otherwise(F.col("lo"))
        hi = F.when(off > 0, lam).otherwise(F.col("hi"))
        # a step is limited, as the slope tells little far away; the limit grows with the multiplier
        far = F.greatest(F.lit(2.0), F.abs(lam))
        step = F.when(F.col("bend") > 0, lam - F.greatest(-far, F.least(far, off / F.col("bend")))).otherwise(
            lam + F.when(off < 0, far).otherwise(-far))
        inside = (step > lo) & (step < hi)
        new = F.when(F.col("taken").isNull(), lam).otherwise(F.when(inside, step).otherwise((lo + hi) / 2))
        moved = state.join(sums, "source_key", "left").select(
            "source_key", "target", "scale", new.alias("lam"),
            F.coalesce(lo, F.col("lo")).alias("lo"), F.coalesce(hi, F.col("hi")).alias("hi"), "full",
            (F.col("settled") | F.coalesce(F.abs(off) <= TOLERANCE * goal, F.lit(False))
             | F.coalesce((hi - lo) <= 1e-15 * F.abs(lam), F.lit(False))).alias("settled"))
        moved = written(moved.coalesce(1), "mix-state")
        discard(state)
        state = moved
        if not state.where("not full and not settled").head(1):
            return state.select("source_key", "scale", F.when(F.col("full"), F.lit(1e9)).otherwise(F.col("lam")).alias("lam"))
    raise RuntimeError(f"mixing rates not settled after {MAX_STEPS} steps")


def round_copies(histogram: DataFrame, goals: DataFrame, rates: DataFrame, cap: int = CAP, repairs: int = 12) -> DataFrame:
    """(source_key, size, n, copies): whole copies per histogram cell, `cap * n` at most.

    The window runs over the distinct sizes of one source.
    """
    cells = histogram.join(rates, "source_key", "left").withColumn(
        "due", F.when(F.col("size") == 0, F.col("n").cast("double")).otherwise(
            F.col("n") * _rate(F.col("lam"), F.col("size") / F.col("scale"), cap)))
    total = F.sum("due").over(Window.partitionBy("source_key").orderBy("size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    cells = written(cells.withColumn("total", total).select(
        "source_key", "size", "n", F.least(
            (F.floor(F.col("total") + 0.5) - F.floor(F.greatest(F.col("total") - F.col("due"), F.lit(0.0)) + 0.5)),
            cap * F.col("n")).alias("copies")), "mix-cells")
    for _ in range(repairs):
        # the one copy more or less that brings a source nearest to its target, if any does
        short = cells.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).join(
            goals.select("source_key", "target"), "source_key").select(
            "source_key", "target", (F.col("target") - F.col("taken")).alias("short"))
        room = F.when(F.col("short") > 0, F.col("copies") < cap * F.col("n")).otherwise(F.col("copies") > 0)
        left = F.abs(F.abs("short") - F.col("size"))
        far_off = F.abs("short") > NEAR * F.col("target")
        best = cells.join(short, "source_key").where(far_off & room & (F.col("size") > 0) & (left < F.abs("short"))).groupBy(
            "source_key").agg(F.min(F.struct(left, F.col("size"), F.signum("short").cast("long").alias("by"))).alias("b"))
        best = written(best.select("source_key", F.col("b.size").alias("size"), F.col("b.by").alias("by")).coalesce(1), "mix-repair")
        if not best.head(1):
            discard(best)
            break
        better = written(cells.join(best, ["source_key", "size"], "left").select(
            "source_key", "size", "n", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies")), "mix-cells")
        discard(cells, best)
        cells = better
    return cells


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """`docs` with mix_size (words), mix_source_size, mix_target (words) and mix_copies (0 to `cap`).

    A null source is a source of its own, last in order.  Null and empty texts have size 0 and are taken
    once.  Documents of one source and size share their copies in order of a hash of the id, so reruns
    agree; repeated rows count each for itself and are interchangeable.  Columns of `docs` with the names
    of new ones are replaced.  An empty table gives an empty result.
    """
    row = docs.select(pack(docs), F.col(id).alias("id"), source_key(F.col(source)).alias("source_key"),
                      n_words(F.col(text)).alias("size"))
    histogram = written(row.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    goals = written(targets(histogram, weights, cap).coalesce(1), "mix-targets")
    cells = round_copies(histogram, goals, solve_rates(histogram, goals, cap), cap)

    order = F.xxhash64(F.col("id").cast("string"))
    row = row.withColumn("order", order).withColumn("part", F.pmod("order", F.lit(DEALT)))
    parts = row.groupBy("source_key", "size", "part").agg(F.count(F.lit(1)).alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    more = F.greatest(F.lit(0), F.least(F.col("copies") % F.col("n") - before, F.col("in_part")))
    dealt = parts.join(cells, ["source_key", "size"]).select(
        "source_key", "size", "part", F.floor(F.col("copies") / F.col("n")).alias("each"), more.alias("more"))
    place = F.row_number().over(Window.partitionBy("source_key", "size", "part").orderBy("order", "id"))
    out = row.join(dealt, ["source_key", "size", "part"]).withColumn("place", place).join(
        F.broadcast(goals) if _few(goals) else goals, "source_key")
    return unpack(out, docs, mix_size=F.col("size"), mix_source_size=F.col("source_size"), mix_target=F.col("target"),
                  mix_copies=(F.col("each") + (F.col("place") <= F.col("more")).cast("int")).cast("long"))


def _few(goals: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of sources is small enough to go to every task."""
    return goals.limit(most + 1).count() <= most


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixed.where("mix_copies > 0").select(*[F.col(f"`{c}`") for c in columns], F.explode(
        F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_copy")).drop("mix_copy")
