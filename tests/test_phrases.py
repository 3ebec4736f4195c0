"""The phrase join against a plain search, with more terms than fit a hand-written list."""

from __future__ import annotations

import random
import re

from valuwatch.operators import text as T


def plain(lines, entries):
    """Repeatedly the earliest unseen entry, the longest on ties, going on behind it."""
    rx = {t: [re.compile(rf"(?<![A-Za-z0-9_&]){re.escape(s)}(?![A-Za-z0-9_&])", re.I) for s in some] for t, some in entries.items()}
    out, seen = [], set()
    for number, line in enumerate(lines):
        at = 0
        while True:
            best = None
            for t in sorted(rx):
                if t in seen:
                    continue
                starts = [(m.start(), k, m.end() - m.start()) for k, p in enumerate(rx[t]) if (m := p.search(line, at))]
                if starts:
                    start, _, length = min(starts)
                    if best is None or (start, -length) < (best[0], -best[1]):
                        best = (start, length, t)
            if best is None:
                break
            out.append((number, best[2], best[0], best[1]))
            seen.add(best[2])
            at = best[0] + best[1]
    return out


def test_phrases_equal_a_plain_search(spark):
    r = random.Random(3)
    words = ["IPV", "review", "mark", "P&L", "(MAP)", "é", "lod-1", "x", "x1", "the"]
    entries = {}
    for k in range(40):
        some = [" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3))]
        entries.setdefault(some[0], some)
    texts = []
    for k in range(60):
        lines = ["".join(r.choice([w.upper(), w.lower(), w]) + r.choice([" ", " ", " ", ", ", ""]) for w in r.choices(words, k=r.randint(0, 14))) for _ in range(r.randint(1, 4))]
        texts.append((2**53 + k, "\n".join(lines)))
    texts += [(1, None), (2, ""), (None, "IPV review")]
    df = spark.createDataFrame(texts, "text_id bigint, text string")
    terms = spark.createDataFrame([(t, some[1:]) for t, some in entries.items()] + [("...", []), (None, ["x"])], "term string, aliases array<string>")
    got = sorted((tuple(x) for x in T.glossary_tag(df, terms).collect()), key=str)
    want = sorted(((i, *hit) for i, t in texts for hit in plain((t or "").split("\n"), entries)), key=str)
    assert got == want and len(want) > 200


def test_a_large_glossary(spark):
    terms = spark.range(20_000).selectExpr("concat('term number ', id) as term")
    df = spark.createDataFrame([(1, "Here Term number 77, and term  number 78; term number 19999."), (2, "term number 20000")], "text_id int, text string")
    assert sorted(tuple(x)[1:] for x in T.glossary_tag(df, terms).collect()) == [(0, "term number 19999", 42, 17), (0, "term number 77", 5, 14)]
    assert T.glossary_tag(df, terms.limit(0)).count() == 0


def test_few_lengths_of_windows_for_spellings_of_any_length(spark):
    def join(n):
        terms = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k + 1)),) for k in range(n)], "term string")
        return T.glossary_tag(df, terms)

    df = spark.createDataFrame([(1, "so " + " ".join(f"w{i}" for i in range(60)) + "; w0 w1 w2, w0 w1")], "text_id int, text string")
    assert sorted(tuple(x) for x in join(45).collect()) == [(1, 0, "w0 w1", 244, 5), (1, 0, "w0 w1 w2", 234, 8), (1, 0, " ".join(f"w{i}" for i in range(45)), 3, 169)]
    few, many = (join(n)._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") for n in (40, 60))
    assert few == many < 20
