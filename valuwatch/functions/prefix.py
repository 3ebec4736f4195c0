"""Counts below several thresholds at once, for many threshold rows, by equality joins only.

Values are first replaced by their slot, the number of thresholds below them, and counted per slot.  A
slot then stands in one block of every power of two, and "all slots up to j" is a union of at most one
block a power, so a threshold row meets the counts it needs by equal block numbers.  No row meets another
by an inequality, and what a threshold row meets is logarithmic in the number of thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot(value: Column, thresholds: list) -> Column:
    """How many of the sorted, distinct `thresholds` lie below `value`, by binary search on a literal array."""
    steps = [1 << k for k in range(len(thresholds).bit_length() - 1, -1, -1)]
    if not thresholds:
        return F.when(value.isNotNull(), F.lit(0))
    table = F.array(*[F.lit(t) for t in thresholds]) if len(thresholds) < 64 else F.lit(thresholds)

    def step(at: Column, width: Column) -> Column:
        return F.when((at + width <= len(thresholds)) & (F.get(table, at + width - 1) < value), at + width).otherwise(at)

    return F.when(value.isNotNull(), F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), step))


def blocks(at: Column, n: int) -> Column:
    """The blocks that hold slot `at` out of `n`, one a power of two."""
    return F.transform(F.array(*[F.lit(k) for k in range(n.bit_length())]),
                       lambda k: F.struct(k.alias("power"), F.call_function("shiftright", at, k).alias("no")))


def blocks_upto(count: Column, n: int) -> Column:
    """The blocks that make up the first `count` slots out of `n`: one for every bit of `count`."""
    bits = F.filter(F.array(*[F.lit(k) for k in range(n.bit_length())]),
                    lambda k: F.call_function("shiftright", count, k) % 2 == 1)
    return F.transform(bits, lambda k: F.struct(k.alias("power"), (F.call_function("shiftright", count, k) - 1).alias("no")))


def counts_upto(facts: DataFrame, limits: DataFrame, dims: dict[str, tuple[str, list]], by: list[str], n: str = "n") -> DataFrame:
    """For each row of `limits` and group `by`, the total of `n` over facts at or below all its limits.

    `dims` maps a column of `facts` to the column of `limits` that bounds it and the sorted distinct values
    of that column.  Facts with a null value are below no limit.  Groups without facts are left out; the
    result has the columns of `limits`, `by` and `n`.
    """
    cells = facts.select(*by, *[slot(F.col(d), values).alias(f"__{k}") for k, (d, (_, values)) in enumerate(dims.items())], n)
    keys = [f"__{k}" for k in range(len(dims))]
    cells = cells.where(F.greatest(*keys, F.lit(0)).isNotNull()).groupBy(*by, *keys).agg(F.sum(n).alias(n))
    wanted = limits
    for k, (limit, values) in enumerate(dims.values()):
        cells = cells.where(F.col(f"__{k}") < len(values)).withColumn(f"__{k}", F.explode(blocks(F.col(f"__{k}"), len(values))))
        # a limit is the threshold with as many others below it, so it takes one slot more than that
        upto = slot(F.col(limit), values) + 1
        wanted = wanted.withColumn(f"__{k}", F.explode(blocks_upto(upto, len(values))))
    cells = cells.groupBy(*by, *keys).agg(F.sum(n).alias(n))
    return wanted.join(cells, keys).groupBy(*limits.columns, *by).agg(F.sum(n).alias(n))
