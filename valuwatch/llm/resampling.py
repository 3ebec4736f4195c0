"""Importance resampling of documents towards a target distribution.

Documents and target texts are counted as bags of hashed word runs.  A bucket that is more frequent in
the target than in the documents gains, a document's weight is the mean gain of its runs, and documents
are drawn without replacement by adding Gumbel noise to the weights and taking the highest.

Texts are handled some at a time: joined with a separator that no word holds, one regular expression
finds the words of all of them, a search among the texts' offsets tells each word's owner and masks runs
that cross from one text into the next, and one bincount sums buckets or gains.

What leaves the tasks is one count a bucket and one row a document.  Ranks come from ranges of the sorted
scores and the sizes of these ranges, so no task sees all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BUCKETS, SEED = 10_000, 2024
#: Per cent of the documents with MIN_WORDS words that are drawn.
SHARE, MIN_WORDS = 10, 20
#: Bytes of text handled at a time (a longer text is handled alone).
AT_ONCE = 2_000_000
#: Scores a coarse bin, when the lowest drawn score is looked for.
BIN = 256

#: Words of lower-cased UTF-8: ASCII digits and letters, and whatever is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\n"
_IN_WORD = np.array([bool(WORD.fullmatch(bytes([b]))) for b in range(256)])


def hashed_runs(texts: list[bytes], runs: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of every run of 1 to `runs` consecutive words of a text, and the words each text has."""
    joined = SEPARATOR.join(texts).lower()                  # of bytes: A-Z only
    found = WORD.findall(joined)
    inside = _IN_WORD[np.frombuffer(joined, dtype=np.uint8)]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(inside) else np.zeros(0, dtype=np.int64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.cumsum(lengths + len(SEPARATOR)) - lengths - len(SEPARATOR)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    crc = list(map(crc32, found))
    owners, values = [owner], [np.array(crc, dtype=np.int64)]
    for n in range(2, runs + 1):
        crc = list(map(crc32, [b" " + w for w in found[n - 1:]], crc))
        first = owner[:max(0, len(owner) - n + 1)]
        same = first == owner[n - 1:]
        owners.append(first[same])
        values.append(np.array(crc, dtype=np.int64)[same])
    return np.concatenate(owners), np.concatenate(values) % buckets, np.bincount(owner, minlength=len(texts))


def _portions(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about AT_ONCE bytes together, with the place of the first."""
    some: list[bytes] = []
    held, first = 0, 0
    for k, t in enumerate(texts):
        if some and held + len(t or b"") > AT_ONCE:
            yield first, some
            some, held, first = [], 0, k
        some.append(t or b"")
        held += len(some[-1])
    if some:
        yield first, some


def bucket_counts(docs: DataFrame, text: str = "text", runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Runs by bucket over all rows; a task hands on one row a bucket, and so does the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, texts in _portions(b.column(0).cast(pa.large_binary()).to_pylist()):
                total += np.bincount(hashed_runs(texts, runs, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():       # `buckets` rows at most
        out[bucket] = n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's smoothed share of a bucket to the documents', rounded down."""
    k, s_all, t_all = len(docs), int(docs.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(docs.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", runs: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) per row; the weight is the mean gain rounded down, 0 without features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)                     # one integer a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            out = np.zeros((3, b.num_rows), dtype=np.int64)
            for first, texts in _portions(b.column(1).cast(pa.large_binary()).to_pylist()):
                owner, bucket, n_words = hashed_runs(texts, runs, len(gain))
                n = np.bincount(owner, minlength=len(texts))
                total = np.bincount(owner, weights=gain[bucket], minlength=len(texts)).astype(np.int64)
                out[:, first:first + len(texts)] = n_words, n, total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id, so that reruns draw alike."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def _lowest(scored: DataFrame, n: int) -> int:
    """The n-th highest score: by bins first, then inside the one bin that holds it.  A score is the log of
    a ratio of counts plus noise of a 32-bit hash, so there are a few hundred bins at any size."""
    low, of = 0, scored.withColumn("bin", F.floor(F.col("score") / BIN))
    left = n
    for k, c in sorted(map(tuple, of.groupBy("bin").count().collect()), reverse=True):
        if c >= left:
            low = k
            break
        left -= c
    for score, c in sorted(map(tuple, of.where(F.col("bin") == low).groupBy("score").count().collect()), reverse=True):
        if c >= left:
            return score
        left -= c
    raise AssertionError("fewer scores than rows asked for")


def ranked(scored: DataFrame) -> DataFrame:
    """`scored` (id, n_words, n_features, weight, score) with its rank by falling score, then id, nulls last.

    Equal rows are one class with a count, so a row repeated at any frequency is one row until the end.
    Classes are dealt by ranges of the order; a class's first rank is the number of rows in the ranges
    before (one figure a range) and before it in its own.
    """
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("n_words")]
    same = ["id", "n_words", "n_features", "weight", "score"]
    classes = scored.groupBy(*same).agg(F.count(F.lit(1)).alias("c")).repartitionByRange(*order)
    dealt = written(classes.withColumn("range", F.spark_partition_id()), "draw-ranges")
    before, rows = 0, []
    for k, c in sorted(map(tuple, dealt.groupBy("range").agg(F.sum("c")).collect())):      # a row a range
        rows.append((k, before))
        before += c
    offsets = scored.sparkSession.createDataFrame(rows, "range int, before bigint")
    upto = F.sum("c").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    first = dealt.withColumn("upto", F.coalesce(upto, F.lit(0))).join(F.broadcast(offsets), "range")
    first = first.withColumn("first", F.col("before") + F.col("upto") + 1)
    # the rows of a class again, some thousand at a time
    blocks = first.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(4096))))
    place = F.explode(F.sequence("block", F.least(F.col("block") + 4095, F.col("c") - 1)))
    return blocks.withColumn("place", place).select(*same, (F.col("first") + F.col("place")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text",
             runs: int = 1, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) per row of `docs`; rank is null for rows not drawn.

    Drawn are the `share` per cent (rounded down) with the highest scores among rows with `min_words`
    words; ties go to the smaller id, null ids last, then to fewer features.  Null and empty texts have
    no words, a weight of 0 and are never drawn.  Repeated rows are rows of their own with the same
    score; a null id draws the noise of an empty one.  Without target texts every bucket counts as one
    run.  An empty table gives an empty result; other columns are not carried.
    """
    gain = gains(bucket_counts(docs, text, runs, buckets), bucket_counts(target, target_text, runs, buckets))
    base = weights(docs, gain, id, text, runs).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = written(base, "draw-scores")
    enough = scored.where(F.col("n_words") >= min_words)
    n = enough.count() * share // 100
    none = F.lit(None).cast("long").alias("rank")
    out = scored.select("*", none)
    if n:
        low = _lowest(enough, n)
        top = (F.col("n_words") >= min_words) & (F.col("score") >= low)
        places = ranked(scored.where(top)).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
        out = scored.where(~top).select("*", none).unionByName(places)
    return out.withColumnRenamed("id", id)
