"""Target resampling, chat formatting and turn repair against brute force and on awkward rows."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from valuwatch.llm import chat_format, resampling, turn_repair

BIG = 2**53
CLASH = ["id", "n_words", "weight", "score", "rank", "range", "c", "turn_", "layout", "digest", "copy", "audit", "key", "piece", "end"]


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# 11 target resampling

def drawn(docs, target, runs=1, buckets=10_000, seed=2024, share=10, least=20):
    def features(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(ws), [" ".join(ws[k:k + n]) for n in range(1, runs + 1) for k in range(len(ws) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    have = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, fs in have:
        s.update(map(bucket, fs))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, fs in have:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(enough[:len(enough) * share // 100]):
        r[5] = k + 1
    return rows


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling(spark, runs):
    r = random.Random(runs)
    vocabulary = ["Alpha", "beta", "é漢", "x1", "x-2", "GAMMA", "δ", "zeta", "eta", "O'Neil"]
    docs = [(BIG + k, " ".join(r.choice(vocabulary[k % 4:]) for _ in range(r.randint(0, 60)))) for k in range(300)]
    hot = " ".join(vocabulary * 5)
    docs += [(BIG + 5, hot)] * 130 + [(None, hot)] * 3 + [(900, None), (901, ""), (902, " - "), (903, "w " * 200_000), (903, "w")]
    target = ["alpha beta", "δ é漢 zeta zeta", "", None, "o neil"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).withColumns({c: F.lit("taken") for c in CLASH if c != "text"})
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, goal, runs=runs, share=40)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = drawn(docs, target, runs, share=40)
    assert sorted_rows(got.collect()) == sorted_rows(want)
    ranks = [x[5] for x in want if x[5]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) > 100


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id bigint, text string")
    assert resampling.resample(none, none).count() == 0
    rows = {x["doc_id"]: x for x in resampling.resample(some, none, share=100).collect()}
    assert rows[1]["rank"] == 1 and rows[2]["rank"] is None and rows[2]["weight"] == 0
    assert resampling.resample(some, some, share=0).where("rank is not null").count() == 0


def test_texts_joined_do_not_run_into_one_another():
    texts = [b"A b", b"", b"c", b"!", b"d e f"]
    owner, bucket, n = resampling.hashed_runs(texts, 2, 1 << 32)
    want = [(0, b"a"), (0, b"b"), (2, b"c"), (4, b"d"), (4, b"e"), (4, b"f"), (0, b"a b"), (4, b"d e"), (4, b"e f")]
    assert list(zip(owner.tolist(), bucket.tolist(), strict=True)) == [(o, zlib.crc32(w)) for o, w in want]
    assert n.tolist() == [2, 0, 1, 0, 3] and len(resampling.hashed_runs([b""])[0]) == len(resampling.hashed_runs([])[0]) == 0


# 12 chat formatting

NASTY = ["", "</s>", "[INST] x [/INST]", "<\\s>", "\\", "\\\\", "a\\</s>", "<<s>>", "[[/INST]\n[/INST]\n", "é漢😀 </s>", "$1 \\$0", "line\nline",
         "</s", "<", "[", "[/", "/INST]\n", "s>", "\x00\x1f"]


def test_format_reads_back(spark):
    r = random.Random(4)
    rows = []
    for conv in range(60):
        for turn in range(r.randint(1, 7)):
            role = r.choice(["user", "assistant", "assistant", "system", *NASTY])
            rows.append((BIG + conv, turn, role, "".join(r.choice(NASTY) for _ in range(r.randint(0, 4)))))
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (None, 1, None, None), (7, 0, "assistant", "x"), (7, 0, "assistant", "x")]
    rows += [(8, 0, "assistant", "long </s> \\ é" * 50_000)]
    df = spark.createDataFrame(rows, "id bigint, turn bigint, role string, text string")
    r.shuffle(rows)
    out = chat_format.format_turns(df.repartition(4).withColumns({c: F.lit(1) for c in CLASH if c != "id"}))
    read = {x["id"]: x for x in out.withColumns({
        "turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()}
    by = defaultdict(list)
    for i, turn, role, text in rows:
        by[i].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(read) == set(by)
    for i, some in by.items():
        x, some = read[i], sorted(some)
        assert x["n_turns"] == len(some) and [(t["role"], t["text"]) for t in x["turns"]] == [s[2:] for s in some]
        said = [s[3] for s in some if s[2] == "assistant"]
        assert x["loss"] == said
        # marks are the template's own
        assert x["formatted"].count("</s>") == x["formatted"].count("<s>") == x["formatted"].count("[/INST]") == len(some)
        for span, text in zip(x["loss_spans"], said, strict=True):
            piece = x["formatted"][span["start"]:span["end"]]
            assert re.sub(r"(?s)\\(.)", r"\1", piece) == text
            assert x["formatted"].encode()[span["byte_start"]:span["byte_end"]] == piece.encode()


def test_layouts(spark):
    records = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "narrator", "value": "n"}], "id": 4},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a", "system": "s"}, {"question": "q", "answer": "a", "score": 0.5},
        {"instruction": "do", "input": "this", "output": "done"}, {"instruction": "do", "output": "done", "input": None},
        {"role": "user", "text": "hello", "turn": 3}, {"messages": []}, {"prompt": "alone"}, {"prompt": "q", "completion": "a", "answer": "b"}, {}]
    texts = [json.dumps(r) for r in records] + ["not json", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, record string")
    got = defaultdict(list)
    names = {}
    for x in chat_format.canonical(df).collect():
        names[x["id"]] = x["layout"]
        if x["role"] is not None:
            got[x["id"]].append((x["turn"], x["role"], x["text"]))
    want = {0: ("messages", ["s:s", "u:q", "a:"]), 1: ("speakers", ["u:q", "a:a", "n:n"]), 2: ("prompt", ["u:q", "a:a"]),
            3: ("request", ["s:s", "u:q", "a:a"]), 4: ("question", ["u:q", "a:a"]), 5: ("instruction", ["u:do\n\nthis", "a:done"]),
            6: ("instruction", ["u:do", "a:done"]), 7: ("row", ["u:hello"]), 8: ("messages", [])}
    for i in range(len(texts)):
        name, turns = want.get(i, (None, []))
        assert names[i] == name and [f"{role[:1]}:{text}" for _, role, text in sorted(got[i])] == turns, i
    assert chat_format.format_records(df).where("id in (9, 10, 11, 12, 13, 14)").count() == 0
    # the same layouts from typed columns
    typed = spark.createDataFrame([(1, ("q", "a", 7)), (2, ("q", None, 7)), (3, None)], "id int, record struct<prompt:string,completion:string,other:int>")
    assert [(x["layout"], x["role"], x["text"]) for x in chat_format.canonical(typed).orderBy("id", "turn").collect()] == [
        ("prompt", "user", "q"), ("prompt", "assistant", "a"), (None, None, None), (None, None, None)]


def test_format_of_nothing(spark):
    assert chat_format.format_records(spark.createDataFrame([], "id bigint, record string")).count() == 0
    assert chat_format.format_turns(spark.createDataFrame([], "id bigint, turn bigint, role string, text string")).count() == 0


# 13 turn repair

def cheapest(symbols):
    """Least (cost, letters) over all edits, by plain search."""
    @functools.cache
    def go(i, state, added):
        out = [(0, "")] if i == len(symbols) and state in "0a" else []
        follow = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
        if added < 3:
            cost, letters = go(i, follow, added + 1)
            out.append((cost + 3, "I" + letters))
        if i < len(symbols):
            initial, fault = symbols[i]
            cost, letters = go(i + 1, state, 0)
            out.append((cost + 4, "D" + letters))
            if fault in ("none", "truncated"):
                more = 3 * (fault == "truncated")
                cost, letters = go(i + 1, follow, 0)
                out.append((cost + 3 + more, "R" + letters))
                if initial == follow or state == "0" and initial == "s":
                    cost, letters = go(i + 1, initial, 0)
                    out.append((cost + more, "K" + letters))
        return min(out, default=(10**9, ""))
    return go(0, "0", 0)


def repaired(rows):
    """The contract's row for one conversation, from damaged rows in order."""
    seen, faults = set(), []
    for turn, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "none")
        seen.add((role, text))
    cost, audit = cheapest(tuple((r[1][:1], f) for r, f in zip(rows, faults, strict=True)))
    made, at = [], 0
    for letter in audit:
        text = "" if letter == "I" else rows[at][2]
        if letter != "D":
            made.append((None if letter != "K" else rows[at][1], text))
        at += letter != "I"
    odd = len(made) % 2
    said = [f"{role or ('user' if k % 2 == odd else 'assistant')}:{text}" for k, (role, text) in enumerate(made)]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def broken(i, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    x = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
    return [] if x == 0 else [(turn, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)


def test_tables_are_a_plain_search():
    r = random.Random(6)
    repair = turn_repair.tables().repair
    kinds = [(c, f) for f in ("none", "truncated") for c in "suax"] + [("s", "blank")]
    for n in range(4):
        for some in itertools.product(range(turn_repair.SYMBOLS), repeat=n):
            assert repair(bytes(some)) == cheapest(tuple(kinds[k] for k in some))
    for _ in range(500):
        some = [r.randrange(turn_repair.SYMBOLS) for _ in range(r.randint(4, 30))]
        assert repair(bytes(some)) == cheapest(tuple(kinds[k] for k in some))


def test_repair(spark):
    r = random.Random(7)
    texts = ["Yes.", "No", "Why? ", "", " \t", "é漢!", None, "a.b", "Long. " * 30_000]
    rows = []
    for conv in range(250):
        for turn in range(r.randint(1, 12)):
            if r.random() < 0.9:
                rows.append((BIG + conv, turn * r.choice([1, 1, 1, 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                             r.choice(texts[:8]) if r.random() < 0.5 else f"Text {r.random()}."))
    rows += [(None, None, "user", "A."), (None, 1, "assistant", "B."), (None, 5, None, None), (3, 2, "user", texts[8]), (3, 3, "assistant", "x.")]
    rows += [(4, None, "user", "x"), (4, None, "user", "x"), (5, 1, "user", "x!"), (5, 1, "user", "x!"), (5, 1, "user", "x!")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    got = turn_repair.repair_damaged(df.withColumns({c: F.lit(1) for c in CLASH}))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    by = defaultdict(list)
    for x in rows:
        by[x[0]] += broken(*x)

    def digest(x):
        return hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()

    out = {x["conv_id"]: tuple(x)[1:] for x in got.collect()}
    assert len(out) == len(by) and any(not v for v in by.values())
    for i, some in by.items():
        some = sorted(some, key=lambda x: (x[0] is not None, x[0] or 0, digest(x)))
        assert out[i] == repaired(some), (i, some)


def test_repair_of_nothing(spark):
    assert turn_repair.repair_damaged(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
