"""Repair of conversation structure by cheapest edits, with block tables.

A conversation is a sequence of symbols, one a row: the role's initial and the row's fault.  An automaton
of four states accepts an optional system turn and pairs of user and assistant; the cheapest edits are a
shortest path through it.  The cost of finishing from each state is a vector of four numbers, which is one
of a few dozen once its smallest is subtracted.  For each of these and each block of symbols a table has
the vector before the block and what to add (the Four-Russians method), so a conversation is swept from
its end by one lookup a block.

The sweep leaves the vector at each block's edge.  Blocks are then expanded one by one against the
direction of the sweep: inside a block the vectors are looked up again, and at each row the least letters
are taken whose cost is part of a cheapest whole.  That is safe for ties, as the costs are those of finishing.

Rows of one conversation meet in one task, as their repaired text is one hash; what that task holds is
one symbol and one letter a row, never texts.  Texts are merged with the letters in a second pass, as a
stream in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import BLANKS

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Symbols: initials s, u, a or another, plus 4 where the row is truncated; 8 must be deleted.
INITIALS, MUST_GO, SYMBOLS = "sua", 8, 9
#: Symbols a block.
BLOCK = 4
#: States: nothing yet, after s, after u, after ua; where a letter leads from each, by initial.
START, ENDS = 0, (0, 3)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {"u": "user", "a": "assistant"}
#: Where adding or renaming leads from each state: the only letter of ROLE that may follow.
ADDED = tuple(next((c, to) for c, to in n.items() if c in ROLE) for n in NEXT)
#: Where keeping a row of each initial leads from each state, if it may follow.
KEPT = tuple({INITIALS.index(c): to for c, to in n.items()} for n in NEXT)

Vector = tuple[int, ...]


def _closed(costs: list[int]) -> Vector:
    """Costs of finishing when rows may be added before anything else."""
    for _ in NEXT:
        for s, (_, to) in enumerate(ADDED):
            costs[s] = min(costs[s], INSERT + costs[to])
    return tuple(costs)


def _steps(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done to a row."""
    yield "D", DELETE, state
    if symbol != MUST_GO:
        more = TRUNCATED if symbol >= 4 else 0
        if (to := KEPT[state].get(symbol % 4)) is not None:
            yield "K", KEEP + more, to
        yield "R", REROLE + more, ADDED[state][1]


def before(symbol: int, after: Vector) -> Vector:
    """Costs of finishing from before a symbol, given those after it."""
    return _closed([min(cost + after[to] for _, cost, to in _steps(symbol, s)) for s in range(len(NEXT))])


class Tables:
    """Normalised vectors, and for each vector and each block the vector before the block and the cost to add."""

    def __init__(self) -> None:
        end = _closed([0 if s in ENDS else 1_000 for s in range(len(NEXT))])
        self.vectors, self.number = [end], {end: 0}
        step, add = [], []
        for v in self.vectors:                              # grows until no step leads to a new one
            for symbol in range(SYMBOLS):
                costs = before(symbol, v)
                low = min(costs)
                to = tuple(c - low for c in costs)
                if to not in self.number:
                    self.number[to] = len(self.vectors)
                    self.vectors.append(to)
                step.append(self.number[to])
                add.append(low)
        self.step = np.array(step).reshape(-1, SYMBOLS)
        one = np.array(add).reshape(-1, SYMBOLS)
        block, cost = self.step, one
        for _ in range(BLOCK - 1):                          # a further symbol in front
            block, cost = (np.stack([self.step[block, x] for x in range(SYMBOLS)], 1).reshape(len(block), -1),
                           np.stack([cost + one[block, x] for x in range(SYMBOLS)], 1).reshape(len(cost), -1))
        self.block, self.cost, self.one = block.tolist(), cost.tolist(), one.tolist()
        self.single = self.step.tolist()
        self.choice = [[[self._choice(v, x, s) for s in range(len(NEXT))] for x in range(SYMBOLS)] for v in range(len(self.vectors))]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """(cost, letters) of the cheapest edits; of those that cost the same, the ASCII-least."""
        whole = len(symbols) - len(symbols) % BLOCK
        v, total = 0, 0
        for x in reversed(symbols[whole:]):                 # the end that fills no block
            v, total = self.single[v][x], total + self.one[v][x]
        edges = [v]
        for k in range(whole - BLOCK, -1, -BLOCK):
            code = 0
            for x in symbols[k:k + BLOCK]:
                code = code * SYMBOLS + x
            v, total = self.block[v][code], total + self.cost[v][code]
            edges.append(v)
        out: list[str] = []
        state = START
        cost = total + self.vectors[v][START]
        for k in range(0, whole, BLOCK):                    # edges[-1] is the vector before the first block
            edges.pop()
            state = self._expand(symbols[k:k + BLOCK], edges[-1], state, out)
        state = self._expand(symbols[whole:], 0, state, out)
        while state not in ENDS:
            out.append("I")
            state = ADDED[state][1]
        return cost, "".join(out)

    def _expand(self, symbols: bytes, after: int, state: int, out: list[str]) -> int:
        """Letters for a block's rows, given the vector after it; the state that follows."""
        vectors = [after]
        for x in reversed(symbols):
            vectors.append(self.single[vectors[-1]][x])
        for x in symbols:
            vectors.pop()
            letters, state = self.choice[vectors[-1]][x][state]
            out.append(letters)
        return state

    def _choice(self, v: int, symbol: int, state: int) -> tuple[str, int]:
        """Letters for a row, rows added in front among them, and the state that follows: the least letter
        of a cheapest whole each time, given the vector after the row."""
        then, here = self.vectors[v], before(symbol, self.vectors[v])
        out = ""
        while True:
            options = [(letter, to) for letter, cost, to in _steps(symbol, state) if cost + then[to] == here[state]]
            if INSERT + here[ADDED[state][1]] == here[state]:
                options.append(("I", ADDED[state][1]))
            letter, state = min(options)
            out += letter
            if letter != "I":
                return out, state


@cache
def tables() -> Tables:
    return Tables()


def damage(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turn, role, text, copy) of rows damaged by a hash of id and turn: some dropped, emptied, left
    without sentence ends, repeated or given to the user.  Null roles and texts become one space."""
    blank = F.lit(" ")
    of = F.crc32(F.concat_ws(":", F.coalesce(F.col(id).cast("string"), blank), F.coalesce(F.col(turn).cast("string"), blank))) % 20
    base = turns.select(F.col(id).alias("id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"),
                        F.coalesce(F.col(text).cast("string"), blank).alias("text"), of.alias("damage")).where("damage <> 0")
    text_ = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select("id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text_.alias("text"), F.explode(copies).alias("copy"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with a digest of role and text, which orders rows of one turn and tells repeats."""
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("digest"), F.asc("copy")]


def _runs(ids: list) -> Iterator[tuple[int, int]]:
    """[start, end) of runs of equal ids, nulls equal to one another."""
    start = 0
    for k in range(1, len(ids) + 1):
        if k == len(ids) or ids[k] != ids[start]:
            yield start, k
            start = k


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, cost, audit) of every conversation of (id, symbol) rows in order."""
    repair = tables().repair
    held, symbols, kind = None, bytearray(), None           # the open conversation

    def closed(done: list[tuple[object, bytes]]) -> pa.RecordBatch:
        fixed = [repair(s) for _, s in done]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], kind), pa.array([c for c, _ in fixed], pa.int64()),
                                           pa.array([a for _, a in fixed], pa.string())], names=["id", "cost", "audit"])

    for b in batches:
        kind, ids, done = b.column(0).type, b.column(0).to_pylist(), []
        symbol = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
        for s, e in _runs(ids):
            if symbols and ids[s] != held:
                done.append((held, bytes(symbols)))
                symbols = bytearray()
            held = ids[s]
            symbols += symbol[s:e]
        if done:
            yield closed(done)
    if symbols:
        yield closed([(held, bytes(symbols))])


class _Writer:
    """The repaired rows of one conversation, hashed as they come."""

    def __init__(self, audit: str):
        self.hash, self.audit, self.at, self.first, self.state = hashlib.sha256(), audit, 0, True, START

    def _put(self, role: str, text: str) -> None:
        self.hash.update(b"" if self.first else b"\n")
        self.hash.update(f"{role}:".encode())
        self.hash.update(text.encode())
        self.first = False

    def _added(self) -> str:
        letter, self.state = ADDED[self.state]
        return ROLE[letter]

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(self._added(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self._put(self._added(), text)
        elif letter == "K":
            self.state = NEXT[self.state][role[:1]]
            self._put(role, text)

    def done(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, repaired_sha256) from (id, audit, role, text) rows in order: a conversation's audit, then its rows."""
    writer, held, kind = None, None, None

    def hashes(done: list[tuple[object, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], kind), pa.array([h for _, h in done], pa.string())],
                                          names=["id", "repaired_sha256"])

    for b in batches:
        kind, done = b.column(0).type, []
        for i, audit, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if audit is None:
                writer.row(role, text)
                continue
            if writer is not None:
                done.append((held, writer.done()))
            writer, held = _Writer(audit), i
        if done:
            yield hashes(done)
    if writer is not None:
        yield hashes([(held, writer.done())])


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per id of `ids`: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows` has id, turn, role, text and copy (a number that tells equal rows of a turn apart), without null
    roles and texts.  Rows are taken by turn, nulls first, rows of one turn by a digest of role and text.
    A row is blank, or else a duplicate (its role and text stood before), or else truncated.  A null id is
    a conversation of its own; ids without rows have zeros, an empty audit and the hash of nothing.
    """
    wordless = F.translate("text", BLANKS, "") == ""
    last = F.right(F.rtrim(F.translate("text", BLANKS, " " * len(BLANKS))), F.lit(1))
    keyed = _keyed(rows)
    light = keyed.select("id", "turn", "digest", "copy", F.substring("role", 1, 1).alias("initial"), wordless.alias("blank"),
                         (~last.isin(".", "!", "?")).alias("open"))
    again = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.asc_nulls_first("turn"), F.asc("copy"))) > 1
    previous = F.lag("initial").over(Window.partitionBy("id").orderBy(*_order()))
    number = F.lit(len(INITIALS))
    for k, c in enumerate(INITIALS):
        number = F.when(F.col("initial") == c, k).otherwise(number)
    judged = light.repartition("id").withColumn("again", again).withColumn("pair", F.concat(previous, F.col("initial"))).withColumn(
        "fault", F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("open"), 3).otherwise(0)).select(
        "id", "turn", "digest", "copy", "fault", (~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.when(F.col("fault").isin(1, 2), MUST_GO).otherwise(number + F.when(F.col("fault") == 3, 4).otherwise(0)).cast("byte").alias("symbol"))
    judged = written(judged, "repair-rows")                 # some forty bytes a row
    counts = judged.groupBy("id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count(F.when(F.col("fault") == k, 1)).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
        F.count(F.when(F.col("illegal"), 1)).alias("illegal"))
    kind = rows.schema["id"].dataType.simpleString()
    swept = judged.repartition("id").sortWithinPartitions(F.asc_nulls_first("id"), *_order()).select("id", "symbol").mapInArrow(
        _sweep, f"id {kind}, cost bigint, audit string")
    audits = written(swept, "repair-audits")
    nothing = {"turn": rows.schema["turn"].dataType, "digest": "binary", "copy": "int", "role": "string", "text": "string"}
    heads = audits.select("id", F.lit(0).alias("part"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    texts = keyed.select("id", F.lit(1).alias("part"), F.lit(None).cast("string").alias("audit"), *nothing)
    merged = heads.union(texts).repartition("id").sortWithinPartitions(F.asc_nulls_first("id"), "part", *_order()).select(
        "id", "audit", "role", "text").mapInArrow(_merge, f"id {kind}, repaired_sha256 string")
    out = ids.select("id").distinct().withColumn("key", _key())
    for part in (counts, audits, merged):
        out = out.join(part.withColumn("key", _key()).drop("id"), "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _key() -> Column:
    """The id as a join key that holds nulls too."""
    return F.struct(F.col("id").isNull().alias("none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"))


def repair_damaged(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage the rows of `turns` by a hash and repair what is left: one row per id of `turns`, see `repair`.

    Nulls: a null role or text is one space (so the row is blank), a null turn sorts first and takes no
    part in gaps, null ids are one conversation.  Empty texts are blank.  Repeated rows are duplicates.
    An empty table gives an empty result; other columns are not carried.
    """
    ids = turns.select(F.col(id).alias("id"))
    return repair(damage(turns, id, turn, role, text), ids).withColumnRenamed("id", id)
