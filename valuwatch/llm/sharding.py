"""Shards of bounded size by extendible hashing.

The key of a row is a string of hash bits.  The directory starts as one bucket; a bucket above the byte
limit is split on one more bit, all others stay as they are.  Sizes per bit prefix come from
pre-aggregated cells of a few bits at a time, so each pass settles many splits and later passes only
read the rows whose bucket is still too large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written
from .common import pack, unpack

#: Bits looked at per pass, and bits of the key.
STEP, BITS = 10, 60
#: Groups in which the rows of one key are dealt to pages.
PARTS = 1024


def key_bits(id: Column) -> Column:
    """The first 60 bits of the md5 of the id, as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("null"))), 1, 15), 16, 2), BITS, "0")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(prefix, bytes, n) of the buckets of a (bits, bytes) table; prefixes are leaves of one binary tree.

    A bucket is settled when it is within the limit or holds one row.  Rows whose bits are all equal
    stay one bucket whatever its size; `shards` deals them to numbered pages.
    """
    settled, active = [], rows.select("bits", "bytes")
    for base in range(0, BITS, STEP):
        cells = written(active.groupBy(F.substring("bits", 1, base + STEP).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-cells")
        depths = range(base if base == 0 else base + 1, base + STEP + 1)
        levels = cells.select("cell", "bytes", "n", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
        sizes = levels.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        fit = sizes.where((F.col("bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == BITS))
        # the bucket is the shortest prefix that fits: none of its prefixes does
        mine = levels.select("cell", "depth", F.expr("substring(cell, 1, depth)").alias("prefix")).join(
            fit, ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.struct("depth", "prefix", fit["bytes"], fit["n"])).alias("leaf"))
        found = written(cells.select("cell").join(mine, "cell", "left"), "shard-leaves")
        discard(cells)
        settled.append(found.where("leaf is not null").select("leaf.prefix", "leaf.bytes", "leaf.n").distinct())
        open_cells = found.where("leaf is null").select("cell")
        if not open_cells.head(1):
            break
        active = active.join(open_cells, F.substring("bits", 1, base + STEP) == F.col("cell"), "left_semi")
    return reduce(DataFrame.unionByName, settled)


def shards(docs: DataFrame, limit: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with shard (bit prefix, then a page number where one key alone is too large), shard_depth,
    shard_row_bytes and shard_bytes (of the whole shard).

    The size of a row is its text in UTF-8 bytes; null and empty texts have none.  A row larger than the
    limit is a shard of its own.  Rows of equal id (null is an id) share a key; where they exceed the
    limit together they are dealt to pages of the shard that keep it.  Repeated rows and ties are
    interchangeable.  Columns with the new names are replaced; an empty table stays empty.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    keyed = docs.select(pack(docs), key_bits(F.col(id)).alias("bits"), size.alias("bytes"))
    leaves = written(directory(keyed, limit).select("prefix", F.col("bytes").alias("bucket_bytes"), "n",
                                                    F.length("prefix").alias("depth")), "shard-directory")
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())      # at most BITS + 1
    tries = F.array(*[F.expr(f"substring(bits, 1, {d})") for d in depths or [0]])
    # the tree is prefix-free: one try of each key is a leaf
    key = keyed.select("bits").distinct().select("bits", F.explode(tries).alias("prefix")).join(leaves, "prefix")
    placed = keyed.join(key, "bits")
    # pages: every row of such a key gets as much room as the largest, so equal rows are dealt evenly
    heavy = leaves.where((F.col("depth") == BITS) & (F.col("bucket_bytes") > limit) & (F.col("n") > 1)).select("prefix")
    return _paged(placed, heavy, docs, limit)


def _paged(placed: DataFrame, heavy: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    def out(df: DataFrame, page: Column, total: Column) -> DataFrame:
        return unpack(df, docs, shard=F.concat("prefix", page), shard_depth=F.col("depth"),
                      shard_row_bytes=F.col("bytes"), shard_bytes=total)

    plain = out(placed, F.lit(""), F.col("bucket_bytes"))
    if not heavy.head(1):
        return plain
    plain = out(placed.join(heavy, "prefix", "left_anti"), F.lit(""), F.col("bucket_bytes"))
    many = written(placed.join(heavy, "prefix", "left_semi").withColumn(
        "part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "shard-pages")
    # rows of one key, part by part: a part's pages start after those of the parts before it
    in_part = Window.partitionBy("prefix", "part").orderBy(F.desc("bytes")).rowsBetween(Window.unboundedPreceding, -1)
    page = F.floor(F.coalesce(F.sum("bytes").over(in_part), F.lit(0)) / F.greatest(F.lit(1), F.lit(limit) - F.max("bytes").over(
        Window.partitionBy("prefix", "part"))))
    paged = many.withColumn("page", page)
    totals = paged.groupBy("prefix", "part", "page").agg(F.sum("bytes").alias("page_bytes"))
    return plain.unionByName(out(paged.join(totals, ["prefix", "part", "page"]),
                                 F.format_string("-%d-%d", "part", "page"), F.col("page_bytes")))
