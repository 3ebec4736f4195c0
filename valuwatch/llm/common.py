"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack(df: DataFrame, row: str = "row") -> Column:
    """All columns of `df` as one struct, so that whatever they are called, no working column clashes."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row)


def unpack(df: DataFrame, like: DataFrame, row: str = "row", **new: Column) -> DataFrame:
    """The packed columns again, with `new` ones added; a new column replaces one of its name."""
    kept = [F.col(row)[c].alias(c) for c in like.columns if c not in new]
    return df.select(*kept, *[v.alias(k) for k, v in new.items()])
