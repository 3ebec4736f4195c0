"""Order-dependent operators that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so one position holding
a third of the events would decide the run time.  Everything here works in two levels:

1. rows are windowed per (key, calendar day): the group that reaches a task is one day of a key;
2. one edge row per (key, day) is windowed per key.  That table holds at most one row per day of
   the calendar for a key, whatever the number of events, and its result is joined back on
   (key, day).

Results are exact: the second level carries whatever the first level could not see.
Inputs are read twice (rows and edges), so feed these operators tables, not long chains of each
other; several lookups of one row go into one pass (see `scan`).
Rows with a null key or a null time belong to no order and come back with null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = "__day"


def day_of(t: Column) -> Column:
    return F.unix_date(t.cast("date"))


def scan(
    rows: DataFrame,
    on: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str] | None = None,
    last: dict[str, str] | None = None,
    first: dict[str, str] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """One ordered pass; `order[0]` is the timestamp, the rest break ties.

    `bucket` replaces the calendar day where `order[0]` is not a time, and must not decrease along the order.

    sums:  output -> column, total of the column up to the row, peers of equal order included;
    last:  output -> column, latest non-null value at or before the row;
    first: output -> column, earliest non-null value at or after the row.
    Columns of `last` and `first` must sort in the same order as the rows (struct(time, ...)).
    """
    sums, last, first = sums or {}, last or {}, first or {}
    same = [*on, DAY]
    rows = rows.withColumn(DAY, day_of(F.col(order[0])) if bucket is None else bucket)
    w = Window.partitionBy(*same).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # what follows is read in the reverse order: a frame that runs to the end starts over at every row
    onward = Window.partitionBy(*same).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    peers = w.rangeBetween(Window.unboundedPreceding, 0)
    days = Window.partitionBy(*on).orderBy(DAY)
    earlier = days.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*on).orderBy(F.desc(DAY)).rowsBetween(Window.unboundedPreceding, -1)

    local = ([F.sum(c).over(peers).alias(f"__l_{o}") for o, c in sums.items()]
             + [F.last(c, True).over(upto).alias(f"__l_{o}") for o, c in last.items()]
             + [F.last(c, True).over(onward).alias(f"__l_{o}") for o, c in first.items()])
    edges = ([F.sum(c).alias(f"__e_{o}") for o, c in sums.items()]
             + [F.max(c).alias(f"__e_{o}") for o, c in last.items()]
             + [F.min(c).alias(f"__e_{o}") for o, c in first.items()])
    carried = ([F.sum(f"__e_{o}").over(earlier).alias(f"__c_{o}") for o in sums]
               + [F.last(f"__e_{o}", True).over(earlier).alias(f"__c_{o}") for o in last]
               + [F.last(f"__e_{o}", True).over(later).alias(f"__c_{o}") for o in first])
    carry = rows.groupBy(*same).agg(*edges).select(*same, *carried)
    outs = ([(F.coalesce(f"__l_{o}", F.lit(0)) + F.coalesce(f"__c_{o}", F.lit(0))).alias(o) for o in sums]
            + [F.coalesce(f"__l_{o}", f"__c_{o}").alias(o) for o in [*last, *first]])
    kept = [c for c in rows.columns if c != DAY]
    return rows.select("*", *local).join(carry, same, "left").select(*kept, *outs)


def running_sum(df: DataFrame, on: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Prefix sum of `value` per key, rows of equal order included."""
    return scan(df, on, order, sums={out: value})


def row_numbers(df: DataFrame, on: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position of each row in its key's order; the order must be unique."""
    return running_sum(df.withColumn("__one", F.lit(1)), on, order, "__one", out).drop("__one")


def neighbour(
    df: DataFrame, on: Sequence[str], order: Sequence[str], take: dict[str, str], step: int = -1,
    bucket: Column | None = None,
) -> DataFrame:
    """Values of the previous (`step=-1`) or following (`step=1`) row of the key.

    `take` maps output names to the columns of the neighbouring row; `bucket` replaces the calendar
    day where `order[0]` is not a time, and must not decrease along the order.
    """
    payload = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)],
                       *[F.col(c).alias(f"v{i}") for i, c in enumerate(take.values())])
    same = [*on, DAY]
    rows = df.withColumn(DAY, day_of(F.col(order[0])) if bucket is None else bucket).withColumn("__row", payload)
    local = Window.partitionBy(*same).orderBy(*order)
    by_day = Window.partitionBy(*on).orderBy(DAY)
    if step < 0:
        edge, shift_row, shift_day = F.max("__row"), F.lag("__row").over(local), F.lag("__edge").over(by_day)
    else:
        edge, shift_row, shift_day = F.min("__row"), F.lead("__row").over(local), F.lead("__edge").over(by_day)
    carry = rows.groupBy(*same).agg(edge.alias("__edge")).select(*same, shift_day.alias("__carry"))
    found = F.coalesce(F.col("__near"), F.col("__carry"))
    return (
        rows.withColumn("__near", shift_row)
        .join(carry, same, "left")
        .select(*df.columns, *[found[f"v{i}"].alias(name) for i, name in enumerate(take)])
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    take: dict[str, str],
    forward: bool,
    inclusive: bool,
    ties: Sequence[str] = (),
    else_first: bool = False,
) -> DataFrame:
    """As-of join: every left row with the nearest right row of its key in one direction.

    `forward` looks for the first right row after the left time, otherwise for the last one before
    it; `inclusive` lets equal times match.  `ties` orders right rows of one instant (the first of
    them wins going forward, the last going backward).  `take` maps output names to right columns.
    `else_first` lets a backward search that finds nothing take the first right row of the key.
    No left row meets more than one right row.
    """
    keys = [right_time, *ties]
    payload = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)],
                       *[F.col(c).alias(f"v{i}") for i, c in enumerate(take.values())])
    facts = right.where(F.col(right_time).isNotNull()).select(
        *on, F.col(right_time).alias("__at"), payload.alias("__hit"))
    left_side, right_side = (0, 1) if forward == inclusive else (1, 0)
    rows = (
        left.withColumn("__at", F.col(left_time).cast(facts.schema["__at"].dataType))
        .withColumn("__hit", F.lit(None).cast(facts.schema["__hit"].dataType))
        .withColumn("__side", F.lit(left_side))
        .unionByName(facts.withColumn("__side", F.lit(right_side)), allowMissingColumns=True)
    )
    order = ["__at", "__side", "__hit"]
    back = {} if forward else {"__found": "__hit"}
    ahead = {"__found": "__hit"} if forward else {"__next": "__hit"} if else_first else {}
    done = scan(rows, on, order, last=back, first=ahead).where(F.col("__side") == left_side)
    found = F.coalesce("__found", "__next") if else_first and not forward else F.col("__found")
    return done.select(*left.columns, *[found[f"v{i}"].alias(name) for i, name in enumerate(take)])
