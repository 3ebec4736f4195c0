"""Line dedup by pairwise alignment.

Documents overlap where they share lines in sequence.  The keys of a document are its shortest runs of
consecutive lines with enough words, one from every line; a key links a document to the first document
that holds it.  Every common block is covered by such runs, and the first holder of a run has all of it,
so one partner a key finds every block, however many documents hold it.  A pair is aligned by patience
diff on line hashes; common blocks with enough words are deleted from the later document, and so are
common runs that cross what was aligned.

Only line hashes travel with the pairs; texts are read again once to cut the deleted lines out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import WORD, let, pack, unpack

#: A common block is deleted from the later document if it has this many words.
MIN_WORDS = 20


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment of two sequences: matched places in order.

    Lines that occur once in both are anchors; the longest increasing run of anchors is kept, anchors
    grow over equal neighbours, and the gaps between are aligned the same way.  Where a gap has no such
    line, the k-th occurrence of a line in one stands against the k-th in the other.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), False)]
    while todo:
        a0, a1, b0, b1, counted = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        if not counted:
            in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
            at = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
            anchors = [(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at]
        else:
            seen: Counter = Counter()
            nth = {}
            for j in range(b0, b1):
                nth[b[j], seen[b[j]]] = j
                seen[b[j]] += 1
            seen = Counter()
            anchors = []
            for i in range(a0, a1):
                if (j := nth.get((a[i], seen[a[i]]))) is not None:
                    anchors.append((i, j))
                seen[a[i]] += 1
        chain = _increasing(anchors)
        if not chain:
            if not counted:
                todo.append((a0, a1, b0, b1, True))
            continue
        grown: list[tuple[int, int]] = []
        low_a, low_b = a0, b0
        for i, j in chain:
            if i < low_a or j < low_b:
                continue
            up = 0
            while i - up > low_a and j - up > low_b and a[i - up - 1] == b[j - up - 1]:
                up += 1
            down = 1
            while i + down < a1 and j + down < b1 and a[i + down] == b[j + down]:
                down += 1
            run = [(i + d, j + d) for d in range(-up, down)]
            if not counted:
                todo.append((low_a, run[0][0], low_b, run[0][1], False))
            grown += run
            low_a, low_b = run[-1][0] + 1, run[-1][1] + 1
        if not counted:
            todo.append((low_a, a1, low_b, b1, False))
        out += grown
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence increasing in both places; `pairs` increase in the first."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(last[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[p], last[p] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_blocks(first: list[int], later: list[int], n_words: list[int], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Blocks [start, end) of `later` that stand in `first` too and have `least` words.

    What is left after an alignment is aligned again until nothing of that size is found, so blocks in
    another order are found as well.  Runs that an alignment passes over, or that share lines with a block
    found before, are looked up at last.
    """
    live = list(range(len(later)))
    blocks: list[tuple[int, int]] = []
    while live:
        found: list[tuple[int, int]] = []
        matched = aligned(first, [later[k] for k in live])
        run: list[tuple[int, int]] = []
        for i, j in [*matched, (-2, -2)]:
            if run and (i != run[-1][0] + 1 or live[j] != live[run[-1][1]] + 1 or j != run[-1][1] + 1):
                places = [live[y] for _, y in run]
                if sum(n_words[p] for p in places) >= least:
                    found.append((places[0], places[-1] + 1))
                run = []
            if i >= 0:
                run.append((i, j))
        if not found:
            break
        blocks += found
        gone = {k for s, e in found for k in range(s, e)}
        live = [k for k in live if k not in gone]
    left, grams = set(live), {}
    for start, end in _runs(n_words, least):
        if left.isdisjoint(range(start, end)):
            continue
        size = end - start
        if size not in grams:
            grams[size] = {tuple(first[k:k + size]) for k in range(len(first) - size + 1)}
        if tuple(later[start:end]) in grams[size]:
            blocks.append((start, end))
            left.difference_update(range(start, end))
    return blocks


def _runs(n_words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """The shortest run [start, end) with `least` words from every line that has one."""
    end, held = 0, 0
    for start, n in enumerate(n_words):
        while held < least and end < len(n_words):
            held += n_words[end]
            end += 1
        if held < least:
            return
        yield start, end
        held -= n


def _span(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.int32()) for n in names]))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """(key, pos, hash, words) arrays per document: its lines that hold a word, in order."""
    line = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    judged = F.transform(line, lambda x, i: F.struct(
        i.alias("pos"), F.xxhash64(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))).alias("hash"),
        F.regexp_count(x, F.lit(WORD)).alias("words")))
    return docs.select("key", F.size(line).alias("n_lines"), F.filter(judged, lambda x: x["words"] > 0).alias("lines"))


def _run_keys(least: int) -> Column:
    """Hashes of the shortest runs with `least` words, null from lines after which too few follow."""
    def key(x: Column, i: Column) -> Column:
        second = F.get("lines", i + 1)
        two = F.struct((x["words"] + second["words"]).alias("words"), F.xxhash64(x["hash"], second["hash"]).alias("hash"))
        more = F.aggregate(F.slice("lines", i + 3, max(1, least - 2)), two, lambda t, y: F.when(t["words"] >= least, t).otherwise(
            F.struct((t["words"] + y["words"]).alias("words"), F.xxhash64(t["hash"], y["hash"]).alias("hash"))))
        return F.when(x["words"] >= least, x["hash"]).when(two["words"] >= least, two["hash"]).when(
            second.isNotNull(), let(more, lambda t: F.when(t["words"] >= least, t["hash"])))
    return F.transform("lines", key)


def _pairs(lines: DataFrame, least: int) -> DataFrame:
    """(first, later) document keys that share a block of `least` words: each with the first holder of each run."""
    held = lines.select("key", F.explode(F.array_distinct(F.filter(_run_keys(least), lambda h: h.isNotNull()))).alias("h"))
    shared = held.groupBy("h").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    return held.join(shared.drop("last"), "h").where("key > first").select("first", F.col("key").alias("later")).distinct()


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """`docs` with the text cut in `text`, and n_lines, n_cut (lines cut) and cuts (spans of lines, end exclusive).

    Order is by id, nulls first, then by a hash of the text; rows equal in both are one document, cut
    alike.  Blank lines belong to no block and stay, except between lines of one block.  Null and empty
    texts stay as they are, with no line cut.  Columns with the new names are replaced; an empty table
    stays empty.
    """
    key = F.struct(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash")).alias("key")
    keyed = docs.select(pack(docs), F.col(text).alias("text"), key)
    lines = written(_lines(keyed, "text").dropDuplicates(["key"]), "line-hashes")
    pairs = _pairs(lines, least)
    some = lines.select("key", F.col("lines.hash").alias("hash"), F.col("lines.words").alias("words"), F.col("lines.pos").alias("pos"))
    sides = pairs.join(some.select(F.col("key").alias("first"), F.col("hash").alias("a")), "first").join(
        some.select(F.col("key").alias("later"), F.col("hash").alias("b"), "words", "pos"), "later")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = []
            for a, b, words, pos in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                cuts.append([{"start": pos[s], "end": pos[e - 1] + 1} for s, e in common_blocks(a, b, words, least)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cuts, _span("start", "end"))], names=["id", "hash", "cuts"])

    kind = docs.schema[id].dataType.simpleString()
    found = sides.select("later.id", "later.hash", "a", "b", "words", "pos").mapInArrow(
        align, f"id {kind}, hash bigint, cuts array<struct<start:int,end:int>>")
    # a document meets at most one partner a key, so its cuts are bounded by its lines
    cuts = found.where(F.size("cuts") > 0).groupBy("id", "hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("cuts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, kept = [], []
            for some, n in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                spans: list[list[int]] = []
                for c in some:
                    if spans and c["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], c["end"])
                    else:
                        spans.append([c["start"], c["end"]])
                ends = [0, *(e for _, e in spans)]
                starts = [*(s for s, _ in spans), n]
                merged.append([{"start": s, "end": e} for s, e in spans])
                kept.append([{"start": e, "n": s - e} for e, s in zip(ends, starts, strict=True) if s > e])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(merged, _span("start", "end")), pa.array(kept, _span("start", "n"))],
                                             names=["id", "hash", "cuts", "kept"])

    sized = cuts.withColumn("key", F.struct("id", "hash")).join(lines.select("key", "n_lines"), "key")
    final = written(sized.select("id", "hash", "cuts", "n_lines").mapInArrow(
        merge, f"id {kind}, hash bigint, cuts array<struct<start:int,end:int>>, kept array<struct<start:int,n:int>>"), "line-cuts")
    # the cuts grow with the documents, so they are dealt by key at any size and not broadcast while small
    spans = final.select(F.struct("id", "hash").alias("key"), "cuts", "kept").hint("shuffle_hash")
    out = keyed.join(spans, "key", "left")
    line = F.split("text", "\n")
    cut = let(line, lambda x: F.array_join(F.flatten(F.transform("kept", lambda k: F.slice(x, k["start"] + 1, k["n"]))), "\n"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return unpack(out, docs, **{
        text: F.when(F.col("kept").isNull(), F.col("text")).otherwise(cut),
        "n_lines": F.coalesce(F.size(line), F.lit(0)).cast("long"),
        "n_cut": F.coalesce(F.aggregate("cuts", F.lit(0), lambda t, c: t + c["end"] - c["start"]), F.lit(0)).cast("long"),
        "cuts": F.coalesce("cuts", none)})
