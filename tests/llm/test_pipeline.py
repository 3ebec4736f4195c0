"""The pipeline on a small table, stage by stage against what each stage promises."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from valuwatch.llm.common import table
from valuwatch.session import written

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        seen.append((name, docs))
        if stage is not corpus_pipeline.tokens:
            assert docs.columns == columns
    quality, lines, copies, mixed, tokens = (d for _, d in seen)
    labels = table(spark, SF, "labels")
    good = labels.join(table(spark, SF, "documents"), "doc_id").where("quality = 1")
    long_enough = good.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= 50)
    assert long_enough.join(quality, "doc_id", "left_anti").count() == 0
    left = {x["doc_id"]: x["text"] for x in copies.collect()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, t in left.items() if (w := re.findall(r"\S+", t.lower()))}
    ids = sorted(sets)
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert tokens.where("not round_trip").count() == 0 and tokens.count() == mixed.count()
    assert lines.where("text = ''").count() == 0


def test_copies_are_rows(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a, "s"), (1, a, "s"), (1, a, "t"), (2, a, "s"), (2, b, "s"), (None, a, "s"), (None, c, "s"), (None, c, "s"),
            (3, d, "s"), (3, d + " more", "s"), (4, None, "s"), (5, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = corpus_pipeline.copies(spark, docs, SF)
    assert out.columns == docs.columns
    left = [(x["doc_id"], (x["text"] or "")[:1]) for x in out.collect()]
    assert sorted(left, key=str) == sorted([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (4, ""), (5, "")], key=str)


STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward(spark):
    """Nulls in every column, repeated rows, empty and long texts, and columns that stages use inside."""
    def said(k, n=90):
        return "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(9)) + "." for i in range(n // 9))

    rows = [(1, said(1), "en", "a", 5), (1, said(1), "en", "a", 5), (2**53 + 1, said(2), None, None, None), (None, said(3), "en", "b", 1),
            (None, said(3), "en", "b", 1), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n ", "en", "a", 3), (7, said(7, 9000), "en", "c", 1)]
    df = spark.createDataFrame(rows, COLUMNS).coalesce(1)
    names = ["row", "key", "q_words", "q_kept", "q_text", "n_cut", "cuts", "mix_size", "mix_copies", "mix_copy", "token_ids", "here"]
    return rows, df.withColumns({c: F.lit(f"own {c}") for c in names})


def test_stages_on_awkward_rows(spark):
    rows, df = awkward(spark)
    want = {"quality rules": [0, 1, 2, 3, 4, 8], "line dedup": list(range(9)), "n-gram Jaccard join": [0, 2, 3, 5, 6, 7, 8]}
    for name in ("quality rules", "line dedup", "n-gram Jaccard join", "source mixing"):
        out = STAGES[name](spark, df, SF)
        assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType, name
        got = out.collect()
        assert all(x[c] == f"own {c}" for x in got for c in df.columns[5:]), name
        if name in want:
            expected = sorted(((rows[k][0], rows[k][1]) for k in want[name]), key=str)
            assert sorted(((x["doc_id"], x["text"]) for x in got), key=str) == expected, name
        else:
            assert {(x["doc_id"], x["text"]) for x in got} <= {r[:2] for r in rows} and len(got) >= 3
    coded = STAGES["byte-level BPE"](spark, df, SF).collect()
    assert len(coded) == len(rows) and all(x["round_trip"] for x in coded)
    assert sorted((x["doc_id"] or 0) for x in coded) == sorted((r[0] or 0) for r in rows)


def test_stages_on_nothing(spark):
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
