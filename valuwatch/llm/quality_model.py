"""Quality classifier: an interpolated modified Kneser-Ney model of the words of trusted text.

Texts are sequences of words between a start and an end mark.  N-grams are known by 64-bit hashes; their
counts, continuation counts, discounts and context totals are tables sharded by n-gram, made by joins and
groupings, and grow with the trusted text.

The log probability of a word under interpolation is that of the shorter n-gram, plus the log of the share
the context hands on, plus a correction if the n-gram was seen.  So the logarithm of a text's probability
is a sum of one value for every n-gram in it that the model holds: the joins are between the distinct
n-grams of each document, with counts, and one table of values, summed per document.

Two things spare that join rows without changing its result: a bit filter of fixed size drops n-grams the
model cannot hold, and the values of the TOP most frequent n-grams go to every task, which also keeps hot
keys out of the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, written

ORDER = 2
#: A document passes up to this quantile of its language's held-out trusted documents, plus a margin in bits a word.
QUANTILE, MARGIN = 0.99, 0.1
#: One trusted document in so many is held out of the model and sets the limits.
HELD = 5
#: Short texts are drawn towards their language's mean: it counts like so many words.
PRIOR = 50
#: Most frequent n-grams whose values every task holds, and bits of the filters (documented bounds; 9 MB and 8 MB).
TOP, BITS = 1 << 19, 1 << 26
#: Bytes of text handled at a time, and n-grams counted together before they leave a task.
AT_ONCE, TOGETHER = 2_000_000, 4_000_000

_POWER = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
START, END = np.uint64(1), np.uint64(2)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word, in order."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])[:len(blank)])
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(spans.max()), _POWER)]))
    value = np.where(blank[starts[0]:], np.uint64(0), data[starts[0]:].astype(np.uint64) + np.uint64(1))
    return np.searchsorted(first, starts, side="right") - 1, _mix(np.add.reduceat(value * power[place], starts - starts[0]))


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, the owner of each place of the marked sequences, and per length (places, hashes).

    A text without a word has no sequence.
    """
    owner, word = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    size = np.where(n > 0, n + 2, 0)
    ends = np.cumsum(size)
    seq = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    some = n > 0
    seq[(ends - size)[some]], seq[(ends - 1)[some]] = START, END
    # a word stands after the start marks of its text and those before, and the end marks of those before
    seq[np.arange(len(word)) + 2 * (np.cumsum(some)[owner] - 1) + 1] = word
    of = np.repeat(np.arange(len(texts)), size)
    mixed, grams = _mix(seq), []
    total = np.zeros(len(seq), dtype=np.uint64)
    for k in range(order):
        total = total[:max(0, len(seq) - k)] + mixed[k:] * _ODD[k]
        same = np.flatnonzero(of[:len(seq) - k] == of[k:]) if k < len(seq) else np.zeros(0, dtype=np.int64)
        grams.append((same, _mix(total[same] + np.uint64(k + 1))))
    return n, of, grams


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


def _count(order: int):
    """(length, hash, context, suffix, head, n) of the n-grams of (text) rows, counted some millions together."""
    def added(parts: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        _, at, inverse = np.unique(cols[1], return_index=True, return_inverse=True)
        n = np.bincount(inverse, minlength=len(at))
        return pa.RecordBatch.from_arrays([pa.array(cols[0][at]), *(pa.array(c[at].view(np.int64)) for c in cols[1:4]),
                                           pa.array(cols[4][at]), pa.array(n)], names=["length", "hash", "context", "suffix", "head", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for _, texts in _portions(b.column(0).cast(pa.large_binary()).to_pylist()):
                _, of, grams = ngrams(texts, order)
                head = np.concatenate([[True], of[1:] != of[:-1]])[:len(of)]
                at = [np.zeros(len(of), dtype=np.uint64) for _ in range(order + 1)]
                for k, (places, h) in enumerate(grams, 1):
                    at[k][places] = h
                    parts.append((np.full(len(h), k, dtype=np.int32), h, at[k - 1][places] if k > 1 else np.zeros(len(h), dtype=np.uint64),
                                  at[k - 1][places + 1] if k > 1 else np.zeros(len(h), dtype=np.uint64), head[places]))
                    held += len(h)
                if held > TOGETHER:
                    yield added(parts)
                    parts, held = [], 0
        if held:
            yield added(parts)
    return run





def train(trusted: DataFrame, order: int = ORDER, text: str = "text") -> tuple[DataFrame, float]:
    """(values, unknown): (hash, value, word, n) of every n-gram that adds to a log probability, in bits, and
    the log probability of a word never seen.  `word` tells single words, `n` how often the n-gram occurs."""
    kind = "length int, hash bigint, context bigint, suffix bigint, head boolean, n bigint"
    raw = trusted.select(F.col(text).alias("text")).mapInArrow(_count(order), kind)
    counts = written(raw.groupBy("length", "hash").agg(F.sum("n").alias("n"), F.max("context").alias("context"), F.max("suffix").alias("suffix"),
                                                       F.bool_or("head").alias("head")), "lm-counts", by="length")
    end = _hash_of(END)
    # a shorter n-gram counts by the different words before it, unless it begins a text and has none
    left = counts.where("length > 1").groupBy((F.col("length") - 1).alias("length"), F.col("suffix").alias("hash")).agg(
        F.count(F.lit(1)).alias("left"))
    adjusted = counts.join(left, ["length", "hash"], "left").where("not (length = 1 and head)").withColumn(
        "a", F.when((F.col("length") == order) | F.col("head"), F.col("n")).otherwise(F.col("left")))
    adjusted = written(adjusted.select("length", "hash", "context", "suffix", "a", "n"), "lm-adjusted", by="length")
    seen = {r["length"]: r for r in adjusted.groupBy("length").agg(
        F.count(F.lit(1)).alias("all"), *[F.count(F.when(F.col("a") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).collect()}
    if not seen:
        return trusted.sparkSession.createDataFrame([], "hash bigint, value double, word boolean, n bigint"), 0.0
    values, below, unknown = [], None, 0.0
    for k in range(1, order + 1):
        d = discounts([seen[k][f"n{j}"] for j in range(1, 5)]) if k in seen else (0.5, 0.75, 0.9)
        cut = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        own = adjusted.where(F.col("length") == k).withColumn("cut", cut)
        contexts = own.groupBy("context").agg(F.sum("a").alias("total"), F.sum("cut").alias("saved")).select(
            "context", "total", (F.col("saved") / F.col("total")).alias("gamma"))
        if k == 1:
            total, gamma = contexts.select("total", "gamma").first()
            flat = gamma / (seen[1]["all"] + 1)                     # one place for all words never seen
            unknown = math.log2(flat)
            own = own.withColumn("p", (F.col("a") - F.col("cut")) / F.lit(float(total)) + F.lit(flat))
            below = written(own.select("hash", "p", "n"), "lm-below")
            values.append(below.select("hash", F.log2("p").alias("value"), (F.col("hash") != F.lit(end)).alias("word"), "n"))
            continue
        joined = own.join(contexts, "context").join(below.select(F.col("hash").alias("suffix"), F.col("p").alias("low")), "suffix")
        joined = joined.withColumn("p", (F.col("a") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("low"))
        below = written(joined.select("hash", "p", "n", F.log2(F.col("p") / (F.col("gamma") * F.col("low"))).alias("value")), "lm-below")
        values.append(below.select("hash", "value", F.lit(False).alias("word"), "n"))
        values.append(contexts.select(F.col("context").alias("hash"), F.log2("gamma").alias("value"), F.lit(False).alias("word"),
                                      F.col("total").alias("n")))
    every = values[0]
    for v in values[1:]:
        every = every.unionByName(v)
    table = every.groupBy("hash").agg(F.sum("value").alias("value"), F.bool_or("word").alias("word"), F.max("n").alias("n"))
    out = written(table, "lm-values")
    discard(counts, adjusted)
    return out, unknown


def _hash_of(mark: np.uint64) -> int:
    """Hash of a mark as a single word, as a signed number."""
    one = np.array([mark], dtype=np.uint64)
    return int(_mix(_mix(one) * _ODD[0] + np.uint64(1)).view(np.int64)[0])


def discounts(n: list[int]) -> tuple[float, float, float]:
    if min(n) == 0:
        return 0.5, 0.75, 0.9                                       # too little text for estimates
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """BITS bits, as 64-bit words, with those of the hashes set; at most BITS / 64 rows reach the driver."""
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1))
    words = hashes.select(F.call_function("shiftright", bit, F.lit(6)).alias("at"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("at").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("word")).toPandas()
    out = np.zeros(BITS // 64, dtype=np.uint64)
    out[words["at"].to_numpy(dtype=np.int64)] = words["word"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def score(docs: DataFrame, values: DataFrame, unknown: float, order: int = ORDER) -> DataFrame:
    """(key, lm_words, lm_bits) per key of (key, text) rows: words, and bits of the whole text with its end.

    Rows of one key are equal texts; each counts for itself and the sums are divided by their number.
    """
    spark = docs.sparkSession
    top = values.orderBy(F.desc("n"), "hash").limit(TOP).select("hash", "value", "word").toPandas().sort_values("hash")
    shared = spark.sparkContext.broadcast((top["hash"].to_numpy(dtype=np.int64), top["value"].to_numpy(dtype=float),
                                           top["word"].to_numpy(dtype=bool), bit_filter(values, "hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value, is_word, bits = shared.value
        for b in batches:
            for first, texts in _portions(b.column(1).cast(pa.large_binary()).to_pylist()):
                n, of, grams = ngrams(texts, order)
                owner = np.concatenate([of[p] for p, _ in grams])
                h = np.concatenate([x for _, x in grams])
                some = may_hold(bits, h)
                owner, h = owner[some], h[some].view(np.int64)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
                total = np.bincount(owner[hit], weights=value[at[hit]], minlength=len(texts))
                found = np.bincount(owner[hit], weights=is_word[at[hit]], minlength=len(texts))
                key = b.column(0).slice(first, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64)
                # one row a document for what is known here, under a hash that spreads, and the rest to be joined
                yield _rows(key, key, np.zeros(len(key), dtype=np.int32), n, found, total)
                owner, h = owner[~hit], h[~hit]
                sort = np.lexsort((h, owner))
                owner, h = owner[sort], h[sort]
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])[:len(h)])
                yield _rows(key[owner[new]], h[new], np.diff(np.append(new, len(h))).astype(np.int32))

    rows = docs.select("key", "text").mapInArrow(run, "key bigint, hash bigint, c int, words bigint, found bigint, bits double")
    joined = rows.join(values.select("hash", "value", "word"), "hash", "left")
    mine = F.col("c") > 0
    sums = joined.groupBy("key").agg(
        F.count(F.when(~mine, 1)).alias("copies"), F.sum("words").alias("words"),
        (F.sum("found") + F.coalesce(F.sum(F.when(mine & F.col("word"), F.col("c"))), F.lit(0))).alias("found"),
        (F.sum("bits") + F.coalesce(F.sum(F.when(mine, F.col("c") * F.col("value"))), F.lit(0.0))).alias("bits"))
    unseen = F.col("words") - F.col("found")
    return sums.select("key", (F.col("words") / F.col("copies")).cast("long").alias("lm_words"),
                       (-(F.col("bits") + unseen * F.lit(unknown)) / F.col("copies")).alias("lm_bits"))


def _rows(key: np.ndarray, h: np.ndarray, c: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
    n, found, total = sums or (pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.float64()))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
    columns = [x if isinstance(x, pa.Array) else pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip((key, h, c, n, found, total), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "hash", "c", "words", "found", "bits"])


def _candidates(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `base` whose id may be among `ids`, so that the join with them moves no other text."""
    hashed = ids.select(F.xxhash64("id").alias("h"))
    shared = base.sparkSession.sparkContext.broadcast(bit_filter(hashed, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = may_hold(shared.value, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            some = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(some.columns[1:], names=["id", "text"])

    kind = base.schema["id"].dataType.simpleString()
    return base.select(F.xxhash64("id").alias("h"), "id", "text").where("id is not null").mapInArrow(run, f"id {kind}, text string")


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", lang: str = "lang", text: str = "text",
             order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Per document: its id and language, lm_words, perplexity (per word, the end of the text being one),
    limit (bits a word) and lm_kept.

    Trusted are the documents whose id has a label of quality 1.  One in HELD of them, by a hash of the id,
    is held out of the model.  A document is kept if its bits per word, drawn towards the mean of its
    language by PRIOR words, stay within the language's quantile of held-out documents and the margin.  A
    language without any, null included, takes the limit of all; without any held-out text every document
    with a word is kept.  Texts without a word score nothing and are not kept; rows of equal id and text are
    scored alike, and so are rows that differ in language only.  Ids pass as they are, null ids among them.
    An empty table stays empty.  Other columns are not carried.
    """
    ids = labels.where("quality = 1").select(F.col(id).alias("id")).where("id is not null").distinct()
    base = docs.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    out = F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(HELD)) == 0
    trusted = _candidates(base, ids).join(ids, "id", "left_semi")
    values, unknown = train(trusted.where(~out), order)
    keyed = base.select(F.xxhash64("id", "text").alias("key"), "id", "lang", "text")
    bits = written(score(keyed, values, unknown, order), "lm-bits")
    group = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("lang").cast("string")))
    scored = written(keyed.select("key", "id", "lang", group.alias("group")).join(bits, "key"), "lm-scores")

    held = scored.where(out & (F.col("lm_words") > 0)).join(ids, "id", "left_semi")
    n = F.col("lm_words") + 1
    by_lang = written(held.groupBy("group").agg((F.sum("lm_bits") / F.sum(n)).alias("mean")), "lm-means")       # a row per language
    drawn = (F.col("lm_bits") + PRIOR * F.col("mean")) / (n + PRIOR)
    rates = written(held.join(by_lang, "group").select("group", drawn.alias("rate")), "lm-trusted")
    limits = by_lang.join(rates.groupBy("group").agg(F.percentile_approx("rate", quantile, 10_000).alias("own")), "group")
    all_mean = held.agg(F.sum("lm_bits") / F.sum(n)).first()[0]
    all_limit = rates.agg(F.percentile_approx("rate", quantile, 10_000)).first()[0]
    limit = F.coalesce(F.col("own"), F.lit(all_limit).cast("double")) + margin
    rate = (F.col("lm_bits") + PRIOR * F.coalesce(F.col("mean"), F.lit(all_mean).cast("double"), F.lit(0.0))) / (n + PRIOR)
    return scored.join(limits, "group", "left").select(
        F.col("id").alias(id), F.col("lang").alias(lang), "lm_words",
        F.when(F.col("lm_words") > 0, F.pow(F.lit(2.0), F.col("lm_bits") / n)).alias("perplexity"),
        limit.alias("limit"), ((F.col("lm_words") > 0) & F.coalesce(rate <= limit, F.lit(True))).alias("lm_kept"))
