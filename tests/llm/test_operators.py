"""Each operator on awkward rows, against brute force where there is one."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from valuwatch.llm import (bpe, html_text, jaccard_join, line_dedup, mixing, pii, quality_model, quality_rules,  # noqa: E402
                           queries, sharding, vector_dedup)

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside or add.
CLASH = ["row", "key", "id", "size", "cid", "mix_size", "token_ids", "n_cut", "q_words", "shard", "bits", "spans", "part"]


def prose(seed: int, n: int = 80, per_line: int = 12) -> str:
    r = random.Random(seed)
    ws = ["".join(r.choice(["ta", "ri", "no", "el", "um", "os", "qu", "e"]) for _ in range(r.randint(2, 5))) for _ in range(n)]
    return "\n".join(" ".join(ws[k:k + per_line]) + "." for k in range(0, n, per_line))


def awkward(spark, extra=()):
    long = prose(99, 6000)
    rows = [(1, prose(1)), (2, None), (3, ""), (4, " \t\n "), (5, prose(1)), (5, prose(1)), (None, prose(2)), (6, long), (7, "x"),
            (8, "é漢😀 " * 30), *extra]
    df = spark.createDataFrame([(i, t, None if i == 7 else "en", None if i in (1, 8) else f"s{(i or 0) % 3}", 0) for i, t in rows], DOC)
    return df.withColumns({c: F.lit("taken") for c in CLASH})


def empty(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 1 mixing

def levels(sizes: dict, cap=3):
    """Shares by weight, cut at the cap and shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        goal = {s: cap * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if goal[s] > cap * sizes[s]}
        if not over:
            return goal
        full |= over


def test_mix_meets_targets(spark):
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.randint(0, 60)), "en", r.choice(["hot"] * 5 + ["a", "b", "é", None]), 0) for k in range(400)]
    rows += [(k, "w w w", "en", "tiny", 0) for k in range(400, 402)] + [(1000, None, "en", "void", 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = [x.asDict() for x in mixing.mix(docs).collect()]
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    goal = levels(sizes)
    taken = defaultdict(int)
    for x in got:
        assert x["mix_size"] == len(words(x["text"])) and 0 <= x["mix_copies"] <= 3
        assert x["mix_source_size"] == sizes[x["source"]] and x["mix_target"] == pytest.approx(goal[x["source"]])
        taken[x["source"]] += x["mix_copies"] * x["mix_size"]
    for s, g in goal.items():
        assert abs(taken[s] - g) <= max(3, 0.01 * g), s
    again = {x["doc_id"]: x["mix_copies"] for x in mixing.mix(docs.repartition(5)).collect()}
    assert again == {x["doc_id"]: x["mix_copies"] for x in got}
    out = mixing.repeated(mixing.mix(docs), docs.columns)
    assert out.columns == docs.columns and out.count() == sum(x["mix_copies"] for x in got)


def test_mix_awkward(spark):
    docs = awkward(spark)
    out = mixing.mix(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert mixing.mix(empty(spark)).count() == 0


# 2 byte-level BPE

VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    v = bpe.Vocabulary(open(VOCAB, "rb").read())
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ids, special_tokens={})


def test_encoding_is_the_librarys():
    v, lib = reference()
    enc = bpe.Encoder(v, public_tokenizers.PATTERN)
    r = random.Random(5)
    texts = ["", None, " " * 5000, "ab" * 3000, "a\r\n\t\x1c b", "I'm we'LL 's"] + [
        "".join(chr(c) for c in range(a, min(a + 3000, 0x110000), 7) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 30000)]
    texts += ["".join(r.choice("abE .,\n1!é漢'") for _ in range(300)) for _ in range(200)]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<i4").tolist() == lib.encode_ordinary(t or "")
    piece = "".join(r.choice("aeionrst") for _ in range(100)).encode()
    assert v._merge_one(piece) == np.frombuffer(v.encode_pieces([piece])[0], "<i4").tolist()


def test_bpe_round_trip(spark):
    docs = awkward(spark)
    coded = bpe.encode(docs, VOCAB, public_tokenizers.PATTERN)
    rows = bpe.decode(coded, VOCAB).withColumn("t", bpe.ids_text(F.col("token_ids"))).collect()
    _, lib = reference()
    assert len(rows) == docs.count()
    for x in rows:
        assert bytes(x["decoded"]).decode() == (x["text"] or "") and list(x["token_ids"]) == lib.encode_ordinary(x["text"] or "")
        assert x["t"] == " ".join(map(str, x["token_ids"]))
    assert bpe.decode(bpe.encode(empty(spark), VOCAB, public_tokenizers.PATTERN), VOCAB).count() == 0


def test_text_of_ids(spark):
    df = spark.createDataFrame([([],), ([7],), ([0, 50256, 12],), (None,)], "ids array<int>")
    text = df.select(bpe.ids_text(F.col("ids")).alias("t"))
    assert [x["t"] for x in text.collect()] == ["", "7", "0 50256 12", None]
    assert "translate" not in text._jdf.queryExecution().optimizedPlan().toString()      # character by character


# 3 line dedup

def test_line_dedup(spark):
    passage = prose(50, 60)
    moved = passage.split("\n")
    rows = [(10, prose(11) + "\n" + passage), (11, passage + "\n" + prose(12)), (12, prose(13)),
            (13, "\n".join(moved[3:] + [prose(14, 12)] + moved[:3])), (14, prose(13)), (15, "Short line.\n" + prose(15)),
            (16, "Short line.\n" + prose(16))]
    rows += [(100 + k, prose(200 + k, 24) + "\n" + passage) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    out = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs).collect()}
    text = dict(rows)
    for i in (10, 12, 15, 16):                                  # first holders and clean documents stay
        assert out[i]["text"] == text[i] and out[i]["n_cut"] == 0
    assert out[11]["text"] == prose(12) and out[13]["text"] == prose(14, 12) and out[14]["text"] == ""
    for k in range(40):
        assert out[100 + k]["text"] == prose(200 + k, 24)


def test_line_dedup_awkward(spark):
    docs = awkward(spark)
    out = line_dedup.dedup_lines(docs).collect()
    by = defaultdict(list)
    for x in out:
        by[x["doc_id"]].append(x)
    assert len(out) == docs.count() and by[2][0]["text"] is None and by[4][0]["text"] == " \t\n "
    assert by[1][0]["text"] == prose(1) and [x["text"] for x in by[5]] == ["", ""]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_of_copies_after_parts(spark):
    passage = [f"line{k} has words" for k in range(10)]
    rows = [(0, "\n".join(passage[:5])), (1, "\n".join(passage[4:]))] + [(2 + k, prose(700 + k, 24) + "\n" + "\n".join(passage)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs).collect()}
    assert all(out[k] == dict(rows)[k] for k in (0, 1, 2))      # no earlier one has 20 words of it
    assert all(out[2 + k] == prose(700 + k, 24) for k in range(1, 40))


def test_common_blocks_that_cross_an_alignment():
    block, others = list(range(100, 103)), list(range(10))
    later = [x for k in others for x in (k, 1000 + k)]
    words = [7] * 3 + [1] * len(later)
    first = [x for k in others for x in (k, 2000 + k)] + block
    assert line_dedup.common_blocks(first, block + later, words) == [(0, 3)]


# 4 quality model

def kneser_ney(texts, order):
    """log2 P(word | context) by the textbook recursion, over dictionaries."""
    seqs = [["<s>", *words(t), "</s>"] for t in texts if words(t)]
    raw = [Counter(tuple(s[i:i + k]) for s in seqs for i in range(len(s) - k + 1)) for k in range(order + 1)]
    counts = [None] * (order + 1)
    counts[order] = raw[order]
    for k in range(1, order):
        after = Counter(g[1:] for g in raw[k + 1])
        counts[k] = {g: raw[k][g] if g[0] == "<s>" else after[g] for g in raw[k] if not (k == 1 and g[0] == "<s>")}
    if order == 1:
        counts[1] = {g: n for g, n in raw[1].items() if g[0] != "<s>"}
    cuts = [None] + [quality_model.discounts([sum(n == j for n in counts[k].values()) for j in range(1, 5)]) for k in range(1, order + 1)]
    by_context = [None] + [defaultdict(dict) for _ in range(order)]
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            by_context[k][g[:-1]][g[-1]] = n

    def p(context, word):
        k = len(context) + 1
        here = by_context[k].get(context)
        lower = 1 / (len(counts[1]) + 1) if k == 1 else p(context[1:], word)
        if not here:
            return lower
        total, d = sum(here.values()), cuts[k]
        gamma = sum(d[min(n, 3) - 1] for n in here.values()) / total
        n = here.get(word, 0)
        return (n - d[min(n, 3) - 1] if n else 0) / total + gamma * lower

    return lambda t: -sum(np.log2(p(tuple(s[max(0, i - order + 1):i]), s[i])) for s in [["<s>", *words(t), "</s>"]] for i in range(1, len(s)))


@pytest.mark.parametrize("order, top, bits", [(2, 1 << 19, 1 << 26), (3, 7, 1 << 10), (1, 5, 1 << 8)])
def test_perplexities_are_the_textbooks(spark, monkeypatch, order, top, bits):
    monkeypatch.setattr(quality_model, "TOP", top)               # values that go to every task, and a filter that lets much through
    monkeypatch.setattr(quality_model, "BITS", bits)
    r = random.Random(order)
    vocabulary = [f"w{k}" for k in range(30)] + ["é", "<s>", "</s>"]

    def said(n):
        return " ".join(vocabulary[min(int(r.expovariate(0.2)), len(vocabulary) - 1)] for _ in range(n))

    fit = [said(r.randint(1, 25)) for _ in range(80)] + ["", " "]
    asked = [said(r.randint(1, 40)) for _ in range(40)] + ["never seen words", "w1", "w1 " * 300, fit[0]]
    trusted = spark.createDataFrame([(t,) for t in fit], "text string").repartition(3)
    values, unknown = quality_model.train(trusted, order)
    rows = [(k, t) for k, t in enumerate([*asked, "", None])] + [(0, asked[0])] * 3
    docs = spark.createDataFrame(rows, "key bigint, text string").repartition(4)
    got = {x["key"]: x for x in quality_model.score(docs, values, unknown, order).collect()}
    # the marks are no words of texts
    renamed = [" ".join({"<s>": "START", "</s>": "END"}.get(w, w) for w in words(t)) for t in fit]
    bits_of = kneser_ney(renamed, order)
    for k, t in enumerate(asked):
        t = " ".join({"<s>": "START", "</s>": "END"}.get(w, w) for w in words(t))
        assert got[k]["lm_words"] == len(words(t)) and got[k]["lm_bits"] == pytest.approx(bits_of(t), rel=1e-9), t
    assert [got[len(asked) + k]["lm_words"] for k in (0, 1)] == [0, 0]


def test_model_tells_junk(spark):
    good = [(k, prose(k, 120), "en", "s", 0) for k in range(100)]
    junk = [(1000 + k, re.sub(r"(\w)\b", r"\1$$%#", prose(k + 500, 120)).upper(), "en", "s", 0) for k in range(20)]
    docs = spark.createDataFrame(good + junk + [(2000, None, None, None, 0), (2001, "", "xx", None, 0), (2002, "x " * 100_000, "en", None, 0)], DOC)
    labels = spark.createDataFrame([(k, 1) for k in range(70)] + [(1000, 0), (None, 1)], "doc_id bigint, quality int")
    out = {x["doc_id"]: x for x in quality_model.classify(docs, labels).collect()}
    assert sum(out[k]["lm_kept"] for k in range(100)) >= 97 and not any(out[1000 + k]["lm_kept"] for k in range(20))
    assert not out[2000]["lm_kept"] and out[2000]["perplexity"] is None and out[2001]["lm_words"] == 0


def test_model_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(k, 1) for k in (1, 5, 6, 8, 900)] + [(1, 1)], "doc_id bigint, quality int").withColumn("text", F.lit("x"))
    out = quality_model.classify(docs, labels)
    rows = out.collect()
    assert out.columns == ["doc_id", "lang", "lm_words", "perplexity", "limit", "lm_kept"] and len(rows) == docs.count()
    assert len({(x["perplexity"], x["lm_kept"]) for x in rows if x["doc_id"] == 5}) == 1
    nobody = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_model.classify(empty(spark), nobody).count() == 0
    assert {x["lm_kept"] for x in quality_model.classify(docs, nobody).collect() if x["lm_words"]} == {True}


# 5 quality rules

def repeats(ws):
    tri = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    return len({p for k in range(len(ws) - 2) if tri[tuple(ws[k:k + 3])] > 1 for p in (k, k + 1, k + 2)})


def test_quality_rules(spark):
    r = random.Random(8)
    rows = [(k, " ".join(r.choice("a b c d e".split()) for _ in range(r.randint(0, 90))), "en", "s", 0) for k in range(150)]
    rows += [(200, "\n".join([prose(3, 90)] * 2), "en", "s", 0), (201, "one | two | three | four | five\n" * 14, "en", "s", 0),
             (202, prose(4, 100) + "\nHome\nAll rights reserved by us", "en", "s", 0),
             (203, " ".join(w + "$$$" for w in words(prose(5, 90))), "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOC)
    out = {x["doc_id"]: x for x in quality_rules.measures(docs).collect()}
    for i, t, *_ in rows:
        ws, lines, x = words(t), [y for y in t.split("\n") if words(y)], out[i]
        assert x["q_words"] == len(ws) and x["q_word_chars"] == sum(map(len, ws)) and x["q_repeat_words"] == repeats(ws)
        assert x["q_dup_lines"] == len(lines) - len(set(lines)) and x["q_symbols"] == sum(c in "#*$%&|<>" for c in t)
    assert out[202]["q_kept"] and out[202]["q_text"] == prose(4, 100)
    assert not out[203]["q_kept"] and not out[203]["q_base_failed"] and not out[201]["q_kept"]
    docs = awkward(spark)
    assert quality_rules.measures(docs).count() == docs.count() and quality_rules.measures(empty(spark)).count() == 0


def test_only_suspect_lines_are_cut_into_words(spark):
    bad = ["home", "Home!", "log  in", "a | b | c | d", "wow!! ok", "##x y z", "x All  rights\t RESERVED y z", "terms of  use a b", " skip to\rcontent"]
    good = ["", " \x0b", "a b c d", "x :: y z", "wow!! a b c", "one two three", "the policy of a house", "a / b and c or d / e f"]
    df = spark.createDataFrame([(x,) for x in bad + good], "line string")
    line = quality_rules.bad_line(F.col("line"))
    assert [x["b"] for x in df.select(line.alias("b")).collect()] == [True] * len(bad) + [False] * len(good)
    assert "CASE WHEN" in df.select(line.alias("b"))._jdf.queryExecution().optimizedPlan().toString()


# 6 sharding

def test_shards(spark):
    r = random.Random(9)
    rows = [(k, "x" * r.randint(0, 400), "en", "s", 0) for k in range(500)] + [(7777, "y" * 5000, "en", "s", 0)]
    rows += [(8888, "z" * 100, "en", "s", 0)] * 60 + [(None, None, None, None, 0)] * 3
    out = sharding.shards(spark.createDataFrame(rows, DOC), 2000).collect()
    assert len(out) == len(rows)
    held = defaultdict(list)
    for x in out:
        held[x["shard"]].append(x)
    for name, some in held.items():
        total = sum(x["shard_row_bytes"] for x in some)
        assert {x["shard_bytes"] for x in some} == {total} and (total <= 2000 or len(some) == 1), name
    leaves = sorted({x["shard"].split("-")[0] for x in out})
    assert not any(b.startswith(a) for a, b in zip(leaves, leaves[1:], strict=False))      # prefix-free
    size = defaultdict(int)
    for i, t, *_ in rows:                                        # no split that was not needed
        bits = f"{int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:15], 16):060b}"
        for d in range(61):
            size[bits[:d]] += len(t or "")
    assert all(size[x[:-1]] > 2000 for x in leaves if x)
    assert sharding.shards(empty(spark), 10).count() == 0
    assert sharding.shards(awkward(spark), 500).count() == awkward(spark).count()


# 7 personal data

def base_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub(r"\D", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark):
    r = random.Random(10)
    texts = ["".join(r.choice("ab1.@-+ 0952(") for _ in range(120)) for _ in range(300)]
    texts += ["a@b@c.de x@y..z 1.2.3.4.5.6.7.8 300.1.1.1 4111111111111111 4111-1111 1111 1111 +1 (017) 555-7713", "é 😀 +49 30 1234567"]
    for t in texts:
        assert pii.strict_spans(t) == base_spans(t)
    rows = [(k, f"{prose(k, 8)} mail me{k}@site.com or card 4111111111111111 end") for k in range(60)]
    rows += [(900, "reach jo [at] host [dot] com now"), (901, "my card 7536784127813050 4845168114407329 is")]
    docs = awkward(spark, rows)
    out = {x["doc_id"]: x["spans"] for x in pii.find(docs).collect()}
    assert out[2] == out[3] == out[1] == [] and [s["kind"] for s in out[0]] == ["email", "card"]
    assert any(s["kind"] == "card" and not s["strict"] for s in out[901])
    assert pii.find(docs).count() == docs.count() and pii.find(empty(spark)).count() == 0


def test_personal_data_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op7_personal_data(spark, sf).collect()
    assert len(rows) == len(text)
    for x in rows:
        spans = base_spans(text[x["doc_id"]])
        counts = Counter(k for k, _, _ in spans)
        assert [x[f"n_{k}"] for k in pii.KINDS] == [counts[k] for k in pii.KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert x["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(x["spans"].split(","))


# 8 HTML

def test_html(spark):
    article = ("The day was long and the work of the people in the town was not done, so they went on with it for all that they "
               "had and it was good for the rest of them as well, and that is the end of it.")
    page = (f"<!DOCTYPE html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='has-sidebar'>"
            f"<header><h1>Site</h1></header><nav><ul><li><a href='/x'>x</a></ul></nav><!-- ad --><div class='ad'>Buy it now.</div>"
            f"<article><header class='entry-header'><h1>Head &amp; line</h1></header><p>{article}<p><b>Short\n &eacute;</b>nd.<br>Now"
            f"<aside>no</aside><div id='comments'><p>{article}</div><form>mail</form></article><footer>&copy; me</footer>")
    want = f"Head & line {article} Short énd. Now"
    assert html_text.main_text(page) == want
    bare = f"<div class='cookie-notice'>We use cookies</div><div id=content><h2>Head</h2><p>{article * 2}</p><p>It was.</p><p>{article * 2}</p></div>"
    assert html_text.main_text(bare) == f"Head {article * 2} It was. {article * 2}"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div>") == ""
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (2, "u", ""), (3, "u", "<p " * 2000)], "page_id bigint, url string, html string")
    rows = html_text.extract(pages.withColumn("text", F.lit(5))).collect()
    assert len(rows) == 4 and {x["text"] for x in rows} == {want, ""}
    assert html_text.extract(pages.limit(0)).count() == 0


# 9 vectors

def test_near_vectors(spark):
    r = np.random.default_rng(11)
    base = r.normal(size=(60, 16))
    x = np.vstack([base, base[:10] + 0.02 * r.normal(size=(10, 16)), base[0] + 0.05 * r.normal(size=(80, 16)), np.repeat(base[1:2], 30, 0), base[2:3] * 7])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (906, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1))
    out = {x["vec_id"]: x for x in vector_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    label = list(range(len(x)))
    for _ in range(len(x)):
        label = [min(label[j] for j in np.flatnonzero(near[k])) for k in range(len(x))]
    for k in range(len(x)):
        assert out[k]["n_links"] == near[k].sum() - 1 and out[k]["component_id"] == label[k]
    for k, _ in odd:
        assert out[k]["n_links"] == 0 and out[k]["component_id"] == k
    audit = {x["id"]: x["n_links"] for x in vector_dedup.exact_links(df.where("vec_id < 900")).collect()}
    assert audit and all(out[k]["n_links"] == n for k, n in audit.items())
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_vectors_of_a_large_dense_group(spark):
    r = np.random.default_rng(15)
    hot = r.normal(size=(1, 64)) / 8 + 0.27 * r.normal(size=(6000, 64)) / 8          # pairwise cosine about 0.93
    x = np.vstack([hot, r.normal(size=(6000, 64))])
    x = x[r.permutation(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(8)
    out = {y["vec_id"]: y for y in vector_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert near.sum() > 30_000_000                               # nearly all pairs of the group
    assert [out[k]["n_links"] for k in range(len(x))] == (near.sum(1) - 1).tolist()
    assert len({out[k]["component_id"] for k in np.flatnonzero(near.sum(1) > 1)}) == 1


def test_bounds_exclude_blocks_but_no_pair():
    import pandas as pd

    r = np.random.default_rng(16)
    centre = r.normal(size=(40, 8))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = centre[r.integers(0, 40, 30_000)] + 0.1 * r.normal(size=(30_000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ centre.T
    home = s.argmax(1)
    angle = pd.Series(np.arccos(np.clip(s.max(1), -1, 1))).groupby(home)
    table = pd.DataFrame({"n": angle.size(), "low": angle.min(), "high": angle.max()}).rename_axis("cluster").reset_index()
    blocks = vector_dedup.Blocks(table, centre, 0.9)
    met = blocks.packs_met(home, s)
    pack = np.array([blocks.pack[k] for k in home])
    assert met.mean() < 0.8
    for k in range(0, 30_000, 100):
        assert met[k][pack[x @ x[k] >= 0.9]].all()


# 10 similarity join

def shingle_set(t):
    ws = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = [i for i, _ in rows]
    linked = [[j for j in range(len(rows)) if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= 75 * len(sets[k] | sets[j])] or [k]
              for k in range(len(rows))]
    while True:
        new = [min(label[j] for j in linked[k]) for k in range(len(rows))]
        if new == label:
            return sets, label
        label = new


def test_similarity_classes(spark):
    r = random.Random(12)
    rows = []
    for family in range(12):
        ws = words(prose(300 + family, r.choice([3, 20, 60, 300])))
        for _ in range(r.choice([1, 2, 30])):
            some = list(ws)
            for _ in range(r.randint(0, max(1, len(ws) // 25))):
                some[r.randrange(len(some))] = f"new{r.random()}"
            rows.append((len(rows), " ".join(w.upper() if r.random() < 0.2 else w for w in some)))
    shared = prose(77, 40)
    rows += [(1000 + k, prose(400 + k, 30) + " " + shared) for k in range(40)] + [(2000, None), (2001, ""), (2002, "a"), (2003, "A")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("n", "cid", "component")})
    sets, label = brute_components(rows)
    out = {x["doc_id"]: x for x in jaccard_join.similarity_classes(df).collect()}
    for (i, _), s, c in zip(rows, sets, label, strict=True):
        assert out[i]["n_shingles"] == len(s) and out[i]["component_id"] == c
    docs = awkward(spark)
    again = jaccard_join.similarity_classes(docs).collect()
    assert len(again) == docs.count() and {x["component_id"] for x in again if x["doc_id"] in (1, 5)} == {1}
    assert jaccard_join.similarity_classes(empty(spark)).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    # near copies of one text, copies of another and documents that share most of a template without linking
    r = random.Random(15)
    rows = []
    for family, (length, changes) in enumerate([(200, 4), (60, 1), (200, 25)]):
        ws = words(prose(500 + family, length))
        for _ in range(60):
            some = list(ws)
            for _ in range(r.randint(0, changes)):
                some[r.randrange(len(some))] = f"new{r.random()}"
            rows.append((len(rows), " ".join(some)))
    rows += [(1000 + k, prose(600 + k, 80)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets, label = brute_components(rows)
    assert len(set(label)) > 40
    for block in (7, 1024):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        out = {x["doc_id"]: x["component_id"] for x in jaccard_join.similarity_classes(df).collect()}
        assert [out[i] for i, _ in rows] == label


def test_block_pairs_meet_once_and_hold_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r = random.Random(16)
    # a large group mostly of one component, a large one of many, and a small one
    rows = [(1, c, 7 if c < 30 else c) for c in range(40)] + [(2, c, c) for c in range(25)] + [(3, c, c) for c in range(3)]
    r.shuffle(rows)
    apart = spark.createDataFrame(rows, "gid bigint, cid bigint, part bigint")
    tasks = {}
    for x in jaccard_join._block_pairs(apart).collect():
        tasks.setdefault((x["key"], x["gid"]), []).append(x)
    assert all(key == gid for key, gid in tasks if gid == 3)
    met = [(gid, *sorted((x["cid"], y["cid"]))) for (_, gid), some in tasks.items() for i, x in enumerate(some) for y in some[:i]
           if x["part"] != y["part"] and (x["alone"] or x["block"] != y["block"])]
    want = {(g, a, b) for g, a, p in rows for h, b, q in rows if g == h and a < b and p != q}
    assert len(met) == len(set(met)) and set(met) == want
    assert max(map(len, tasks.values())) < 25


def test_tree_misses_no_pair():
    r = np.random.default_rng(13)
    p = np.vstack([r.poisson(2, (1, 32)) + r.integers(0, 2, (60, 32)), r.poisson(2, (100, 32))]).astype(np.int32)
    n = p.sum(1)
    part = np.arange(len(p))
    got = {tuple(sorted(x)) for i, j in jaccard_join.RTree(p, n, part).pairs() for x in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(len(p)) for b in range(a + 1, len(p)) if 7 * np.minimum(p[a], p[b]).sum() >= 3 * (n[a] + n[b])}
    assert want <= got and all(7 * min(np.minimum(p[a], p[b]).sum(), n[a], n[b]) >= 3 * (n[a] + n[b]) for a, b in got)
    assert not list(x for i, j in jaccard_join.RTree(p, n, part * 0).pairs() for x in i)


def test_pairs_meet_in_one_group_only():
    import pandas as pd

    r = np.random.default_rng(14)
    p = (r.poisson(2, (1, 32)) + r.integers(0, 2, (40, 32))).astype("u1")
    groups = {g: sorted(r.choice(40, r.integers(2, 30), replace=False).tolist()) for g in range(60)}
    lows = {c: ([g for g in groups if c in groups[g]] + [2**63 - 1] * 8)[:jaccard_join.LOWEST] for c in range(40)}
    rows = [(g, c, c, int(p[c].sum()), b"\1" + p[c].tobytes(), np.array(lows[c])) for g, some in groups.items() for c in some]
    batch = pd.DataFrame(rows, columns=["gid", "cid", "part", "n", "point", "lows"])
    got = [tuple(x) for out in jaccard_join._across(iter([batch[:300], batch[300:]])) for x in out.to_numpy().tolist()]
    want = {(a, b) for some in groups.values() for a in some for b in some if a < b
            and 7 * np.minimum(p[a], p[b]).sum(dtype=int) >= 3 * int(p[a].sum(dtype=int) + p[b].sum(dtype=int))}
    assert set(got) == want
    every = sum(len({(a, b) for a in some for b in some if a < b} & want) for some in groups.values())
    assert len(got) < every / 2
