"""Personal data by weak supervision.

Regular expressions propose candidate spans.  Labelers - strict patterns, gazetteers and words in the
context - vote for or against each candidate or abstain.  Votes are counted by pattern (a table bounded
by the number of vote patterns, not by the corpus), expectation-maximisation estimates how reliable each
labeler is and what each pattern means, and a logistic classifier trained on those beliefs decides the
spans.

Spans of the strict patterns always stay; the classifier adds to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

KINDS = ("email", "ip", "card", "phone")
#: A classifier's span needs this belief.
BELIEF = 0.8
#: Code points of context on either side of a candidate.
CONTEXT = 40

# Patterns and limits of the strict spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser proposals of the method.
LOOSE = {
    "email": re.compile(r"(?<![\w.@])[\w.+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|<at>|\sat\s)\s?[\w-]{1,63}"
                        r"(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[\w-]{1,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9+.-])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:\(?0[0-9]{1,4}\)?|\([0-9]{2,4}\)|00[0-9]{2})[\x20./-]?[0-9]{2,4}"
                        r"(?:[\x20./-]?[0-9]{2,4}){1,3}(?![0-9])"),
}
# Gazetteers.
TOP_LEVEL = frozenset("com org net edu gov io co info biz eu de fr es uk us it nl ch at be pl ru cn jp br ca au in".split())
CUES = {
    "email": re.compile(r"e-?mail|mailto|contact|write to|correo|courriel|kontakt|@", re.I),
    "ip": re.compile(r"\bip\b|ipv[46]|address|host|server|login from|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|iban|account|karte|carte|tarjeta|konto", re.I),
    "phone": re.compile(r"phone|\btel\b|tel\.|call|mobile|fax|cell|telefon|t[ée]l[ée]phone|tel[ée]fono|handy|whatsapp", re.I),
}
AGAINST = re.compile(r"version|isbn|issn|order|invoice|part no|serial|token|sha|hash|page|section|figure|total|price|[$€£#]", re.I)
ISSUER = re.compile(r"3[47]|4|5[1-5]|2[2-7]|6(?:011|5)|35")

Span = tuple[str, int, int]

_PLACE = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_())]
CANDIDATES = pa.list_(pa.struct([*_PLACE, ("votes", pa.int32())]))
SPANS = pa.list_(pa.struct([*_PLACE, ("belief", pa.float64())]))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def strict_spans(text: str) -> list[Span]:
    """Spans of the strict patterns, leftmost and non-overlapping per kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:                      # the local part ends at an @, so look back from each
        if at >= end:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> list[int]:
    """One vote a labeler: 1 for, -1 against, 0 abstains.  In order: strict pattern, gazetteer, check
    digits or ranges, cue words before, counter-cues before, shape of the surroundings."""
    found = text[start:end]
    before = text[max(0, start - CONTEXT):start]
    d = _digits(found)
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", found)[-1].lower()
        known = 1 if last in TOP_LEVEL else -1
        form = 1 if re.search(r"[(\[{<]|@", found) else -1
    elif kind == "ip":
        parts = found.split(".")
        known = -1 if len(parts) == 4 and parts[0].lstrip("0") == "" else 0
        form = 1 if strict or ("::" in found or found.count(":") == 7) else -1
    elif kind == "card":
        known = 1 if ISSUER.match(d) else -1
        form = 1 if luhn(d) and len(d) >= 13 else -1
    else:
        known = 1 if found[:1] == "+" else 0
        form = 1 if 9 <= len(d) <= 15 else -1
    cue = 1 if CUES[kind].search(before) else 0
    counter = -1 if AGAINST.search(before[-20:]) else 0
    alone = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return [1 if strict else 0, known, form, cue, counter, 0 if alone else -1]


LABELERS = 6


def candidates(text: str | None) -> list[tuple[str, int, int, bool, int]]:
    """(kind, start, end, strict, votes) with the votes as digits to base 3."""
    if not text:
        return []
    out, strict = [], strict_spans(text)
    taken = [(s, e) for _, s, e in strict]
    loose = [(k, m.start(), m.end()) for k, p in LOOSE.items() for m in p.finditer(text)]
    starts = np.array([s for s, _ in sorted(taken)] or [0])
    ends = np.array([e for _, e in sorted(taken)] or [0])
    for kind, s, e in strict:
        out.append((kind, s, e, True))
    last: dict[str, int] = {}
    tops = np.maximum.accumulate(ends)
    for kind, s, e in sorted(loose, key=lambda x: (x[1], KINDS.index(x[0]))):
        k = int(np.searchsorted(starts, e)) - 1                  # strict spans that start before this one ends
        if (k >= 0 and tops[k] > s) or last.get("any", 0) > s:
            continue
        last["any"] = e
        out.append((kind, s, e, False))
    return [(kind, s, e, sure, sum((v + 1) * 3 ** i for i, v in enumerate(votes(text, kind, s, e, sure))))
            for kind, s, e, sure in out]


def extract(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, cands): the candidates of each whole text; none for null and empty ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "strict": sure, "votes": v} for k, s, e, sure, v in candidates(t)]
                     for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, CANDIDATES)], names=["id", "cands"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, cands array<struct<kind:string,start:int,end:int,strict:boolean,votes:int>>")


def unpacked(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3 ** i % 3 - 1 for i in range(LABELERS)], axis=1)


def estimate(patterns: pd.DataFrame, rounds: int = 200) -> pd.DataFrame:
    """Belief that a candidate with a (kind, votes) pattern is personal data.

    Expectation-maximisation of a two-class model in which labelers vote independently given the class,
    with a reliability of its own for every labeler and kind; then logistic regression on the votes,
    trained by Newton steps on the beliefs and weighted by the counts.  `patterns` has kind, votes, n.
    """
    out = []
    for kind, some in patterns.groupby("kind"):
        v = unpacked(some["votes"].to_numpy())
        n = some["n"].to_numpy(dtype=float)
        # start from the majority of votes; the strict pattern weighs more than all others together
        q = 1 / (1 + np.exp(-(v @ np.array([7.0, 1, 1, 2, 2, 1]) - 1.0)))
        q = np.where(v[:, 0] == 1, np.maximum(q, 0.95), q)
        for _ in range(rounds):
            log_odds = np.log((n @ q + 1) / (n @ (1 - q) + 1)) * np.ones(len(v))
            for j in range(LABELERS):
                for value in (-1, 0, 1):
                    hit = v[:, j] == value
                    yes = ((n * q)[hit].sum() + 1) / (n @ q + 3)
                    no = ((n * (1 - q))[hit].sum() + 1) / (n @ (1 - q) + 3)
                    # the classes must not trade places: a vote for never counts against
                    log_odds[hit] += np.clip(np.log(yes / no), *((0, None) if value > 0 else (None, 0) if value < 0 else (None, None)))
            new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
            done = np.abs(new - q).max() < 1e-9
            q = new
            if done:
                break
        x = np.hstack([v > 0, v < 0, np.ones((len(v), 1))]).astype(float)
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            grad = x.T @ (n * (p - q)) + 1.0 * w
            bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            step = np.linalg.solve(bend, grad)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        out.append(pd.DataFrame({"kind": kind, "votes": some["votes"].to_numpy(), "belief": 1 / (1 + np.exp(-x @ w))}))
    return pd.concat(out) if out else pd.DataFrame({"kind": [], "votes": [], "belief": []})


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", belief: float = BELIEF) -> DataFrame:
    """(id, spans): per document its spans in order of kind and start, each with kind, start, end (code
    points, end exclusive), strict and belief.

    Nulls and empty texts have no spans.  Every row is its own document, repeated ids included.  Loose
    candidates that overlap a strict span or an earlier candidate are left out, earlier meaning a smaller
    start, then the order of kinds.  An empty table gives an empty result; other columns are not carried.
    """
    cands = written(extract(docs, id, text), "pii-candidates")
    # at most kinds * 3 ** labelers rows, whatever the corpus holds
    patterns = cands.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes").agg(
        F.count(F.lit(1)).alias("n")).toPandas()
    beliefs = estimate(patterns.sort_values(["kind", "votes"]))
    known = {(k, int(v)): float(b) for k, v, b in beliefs.itertuples(index=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for some in b.column(1).to_pylist():
                rated = [{"kind": c["kind"], "start": c["start"], "end": c["end"], "strict": c["strict"],
                          "belief": known[c["kind"], int(c["votes"])]} for c in some]
                spans.append(sorted((c for c in rated if c["strict"] or c["belief"] >= belief),
                                    key=lambda c: (KINDS.index(c["kind"]), c["start"])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], names=[id, "spans"])

    kind = docs.schema[id].dataType.simpleString()
    return cands.mapInArrow(run, f"`{id}` {kind}, spans array<struct<kind:string,start:int,end:int,strict:boolean,belief:double>>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
