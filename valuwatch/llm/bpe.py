"""Byte-level BPE encoding and decoding with a given rank file.

Merging follows one rule: the leftmost pair of lowest rank goes first.  A segment tree over a piece's
byte positions keeps the lowest pair rank of every range, so the pair is found by one descent from the
root and a merge is three point updates (the merged pair, its left neighbour, the position that went).
Short pieces, nearly all of them, are merged together: trees of equal width are rows of one array and
every step acts on all pieces still merging.  Long pieces get a tree each.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = np.int32(2**31 - 1)
#: Longest piece, in bytes, merged together with others.
TOGETHER = 128
#: Bytes of encoded pieces that a task keeps, in each of two generations, and what a piece costs beside its own.
KEPT, ENTRY = 16 << 20, 160
#: Pieces handled at a time, and rows and tokens of one Arrow batch at most, so that texts of any length leave
#: in bounded batches.
PIECES, ROWS, TOKENS = 250_000, 1_000, 2_000_000


def tokens(file: bytes) -> dict[int, bytes]:
    """The bytes of each id of a `.tiktoken` file."""
    return {int(b): base64.b64decode(a) for a, b in (line.split() for line in file.splitlines() if line)}


class Vocabulary:
    """Ranks of a `.tiktoken` file: lines of base64 bytes and a rank, which is also the id."""

    def __init__(self, file: bytes):
        self.ids = {t: i for i, t in tokens(file).items()}
        self.size = max(self.ids.values()) + 1
        self.byte = np.array([self.ids[bytes([i])] for i in range(256)], dtype=np.int32)
        keys, ranks = array("q"), array("i")
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(i)
        order = np.argsort(np.frombuffer(keys, dtype=np.int64))
        self.keys, self.ranks = np.frombuffer(keys, dtype=np.int64)[order], np.frombuffer(ranks, dtype=np.int32)[order]
        # the same without a wrapper around each number, for one lookup at a time
        self.sorted_keys, self.sorted_ranks = array("q", self.keys.tobytes()), array("i", self.ranks.tobytes())

    def pair_rank(self, a: int, b: int) -> int:
        key = a * self.size + b
        at = bisect_left(self.sorted_keys, key)
        return self.sorted_ranks[at] if at < len(self.sorted_keys) and self.sorted_keys[at] == key else int(NONE)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        widths: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (whole := self.ids.get(p)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) <= TOGETHER:
                widths.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
            else:
                out[k] = np.array(self._merge_one(p), dtype="<i4").tobytes()
        for width, members in widths.items():
            for start in range(0, len(members), 4096):
                some = members[start:start + 4096]
                for k, ids in zip(some, self._merge_many([pieces[k] for k in some], width), strict=True):
                    out[k] = ids
        return out

    def _merge_many(self, pieces: list[bytes], width: int) -> Iterator[bytes]:
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        token = self.byte[raw]
        place = np.arange(width)
        right = np.broadcast_to(place + 1, (n, width)).copy()      # next live position; `lengths` ends the piece
        left = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, dtype=np.int32)
        if width > 1:
            ranks = self.pair_ranks(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
            tree[:, width:2 * width - 1] = np.where(place[None, 1:] < lengths[:, None], ranks, NONE)
            for v in range(width - 1, 0, -1):
                np.minimum(tree[:, 2 * v], tree[:, 2 * v + 1], out=tree[:, v])
        gone = place[None, :] >= lengths[:, None]

        def put(rows: np.ndarray, at: np.ndarray, value) -> None:
            v = at + width
            tree[rows, v] = value
            while v[0] > 1:                                        # all nodes are on one level
                v = v >> 1
                tree[rows, v] = np.minimum(tree[rows, 2 * v], tree[rows, 2 * v + 1])

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            low, v = tree[rows, 1], np.ones(len(rows), dtype=np.int64)
            while v[0] < width:                                    # leftmost leaf that holds the minimum
                v = 2 * v
                v += tree[rows, v] != low
            i = v - width
            j = right[rows, i]
            k = right[rows, j]
            token[rows, i], gone[rows, j], right[rows, i] = low, True, k
            tail = k < lengths[rows]
            left[rows[tail], k[tail]] = i[tail]
            put(rows, j, NONE)
            pair = np.full(len(rows), NONE, dtype=np.int32)
            pair[tail] = self.pair_ranks(low[tail], token[rows[tail], k[tail]])
            put(rows, i, pair)
            before = left[rows, i]
            some = before >= 0
            if some.any():
                put(rows[some], before[some], self.pair_ranks(token[rows[some], before[some]], low[some]))
            rows = rows[tree[rows, 1] != NONE]
        ends = np.cumsum((~gone).sum(1)) * 4
        flat = token[~gone].astype("<i4").tobytes()
        yield from (flat[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))

    def _merge_one(self, piece: bytes) -> list[int]:
        n, none = len(piece), int(NONE)
        width = 1 << (n - 1).bit_length()
        token = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        lookup = self.pair_rank
        tree = [none] * (2 * width)
        first = np.array(token, dtype=np.int32)
        tree[width:width + n - 1] = self.pair_ranks(first[:-1], first[1:]).tolist()
        for v in range(width - 1, 0, -1):
            tree[v] = min(tree[2 * v], tree[2 * v + 1])

        def put(at: int, value: int) -> None:
            v = at + width
            tree[v] = value
            while v > 1:
                v >>= 1
                a, b = tree[2 * v], tree[2 * v + 1]
                low = a if a <= b else b
                if tree[v] == low:
                    return
                tree[v] = low

        while (low := tree[1]) != none:
            v = 1
            while v < width:
                v = 2 * v if tree[2 * v] == low else 2 * v + 1
            i = v - width
            j = right[i]
            k = right[i] = right[j]
            token[i], token[j] = low, -1
            put(j, none)
            if k < n:
                left[k] = i
            put(i, lookup(low, token[k]) if k < n else none)
            if left[i] >= 0:
                put(left[i], lookup(token[left[i]], low))
        return [t for t in token if t >= 0]


class Encoder:
    """Splits texts by a pattern and encodes the pieces; repeated pieces come from a memory of bounded bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, pending, held = [], [], 0
        for t in texts:
            pending.append(self.split(t) if t else [])
            held += len(pending[-1])
            if held > PIECES:
                out += self._known(pending)
                pending, held = [], 0
        return out + self._known(pending)

    def _known(self, split: list[list[str]]) -> list[bytes]:
        if self.held > KEPT:
            self.old, self.young, self.held = self.young, {}, 0
        young = self.young
        new = set().union(*split).difference(young)
        again = new.intersection(self.old)
        young.update((p, self.old[p]) for p in again)
        new = list(new.difference(again))
        coded = self.vocabulary.encode_pieces([p.encode() for p in new])
        young.update(zip(new, coded, strict=True))
        self.held += ENTRY * (len(again) + len(new)) + sum(map(len, new)) + sum(map(len, coded)) + sum(map(len, again))
        return [b"".join(map(young.__getitem__, pieces)) for pieces in split]


@lru_cache(maxsize=1)
def _vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


@lru_cache(maxsize=1)
def _tokens(file: bytes) -> dict[int, bytes]:
    return tokens(file)


def _with(schema: T.StructType, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != column] + [T.StructField(column, kind)])


def _replaced(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    kept = [k for k, name in enumerate(batch.schema.names) if name != column]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), values],
                                      names=[*(batch.schema.names[k] for k in kept), column])


def _decoded(ids: np.ndarray, token: dict[int, bytes]) -> bytes:
    return b"".join(map(token.__getitem__, ids.tolist()))


def encode(docs: DataFrame, vocab: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """`docs` with the token ids of each whole text in `ids`, and the bytes these decode to in `decoded` if
    that is named (columns of these names are replaced).

    `vocab` is the path of a rank file on the driver; its content, bounded by the vocabulary, is sent to
    the workers.  Each match of `pattern` is encoded separately, without special tokens.  Null and empty
    texts have no ids; rows, copies among them, are encoded each for itself; an empty table stays empty.
    """
    file = docs.sparkSession.sparkContext.broadcast(Path(vocab).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(file.value), pattern)        # what it keeps goes with the task
        token = _tokens(file.value) if decoded else {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                coded = encoder.encode(batch.column(text).to_pylist())
                first, held = 0, 0
                for k, c in enumerate(coded):
                    held += len(c) // 4
                    if k + 1 == len(coded) or held + len(coded[k + 1]) // 4 > TOKENS:
                        some = coded[first:k + 1]
                        ends = np.cumsum([0, *(len(x) // 4 for x in some)]).astype(np.int32)
                        flat = np.frombuffer(b"".join(some), dtype="<i4")
                        out = _replaced(batch.slice(first, k + 1 - first), ids, pa.ListArray.from_arrays(ends, pa.array(flat)))
                        if decoded:
                            back = [_decoded(flat[s:e], token) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                            out = _replaced(out, decoded, pa.array(back, type=pa.binary()))
                        yield out
                        first, held = k + 1, 0

    kind = _with(docs.schema, ids, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, _with(kind, decoded, T.BinaryType()) if decoded else kind)


def decode(coded: DataFrame, vocab: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`coded` with the bytes its ids stand for in `out` (replaced if there); null ids give null, none give
    no bytes.  An id outside the vocabulary is an error."""
    file = coded.sparkSession.sparkContext.broadcast(Path(vocab).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(file.value)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                values = [_decoded(c.values.to_numpy(zero_copy_only=False), token) if c.is_valid else None for c in batch.column(ids)]
                yield _replaced(batch, out, pa.array(values, type=pa.binary()))

    return coded.mapInArrow(run, _with(coded.schema, out, T.BinaryType()))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
