"""Ids beyond 2^53 beside null ids and repeated rows in one batch come back as they went in."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from valuwatch.llm import html_text, jaccard_join, line_dedup, pii, quality_model  # noqa: E402

from test_operators import prose  # noqa: E402

A, B, C = 2**53 + 1, 2**53 + 3, -(2**62) - 7
PASSAGE = prose(90, 60)


def docs(spark):
    rows = [(A, prose(1) + "\n" + PASSAGE), (B, prose(2) + "\n" + PASSAGE), (None, PASSAGE), (None, PASSAGE), (C, prose(1) + "\n" + PASSAGE),
            (A, None), (B, "mail me@site.com " * 3), (B, "mail me@site.com " * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    return rows, df.withColumns({"lang": F.lit("en"), "more": F.when(F.col("doc_id") > 0, F.lit(A)), "hash": F.lit("x"), "cuts": F.lit(1)})


def test_line_dedup_ids(spark):
    rows, df = docs(spark)
    out = line_dedup.dedup_lines(df).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(i for i, _ in rows)
    # null ids come first and hold the passage, C comes before A
    assert [x["n_cut"] for x in out if x["doc_id"] is None] == [0, 0]
    assert all(x["more"] == (A if (x["doc_id"] or -1) > 0 else None) for x in out)
    cut = {(x["doc_id"], x["text"]) for x in out}
    assert (A, "") in cut and (B, prose(2)) in cut and (C, prose(1)) in cut


def test_personal_data_ids(spark):
    rows, df = docs(spark)
    out = pii.find(df).collect()
    assert Counter((x["doc_id"], len(x["spans"])) for x in out) == Counter((i, (t or "").count("@")) for i, t in rows)


def test_html_ids(spark):
    pages = spark.createDataFrame([(A, "u", "<p>A b c</p>", B), (None, None, None, None), (B, "u", "", A), (B, "u", "", A)],
                                  "page_id bigint, url string, html string, n bigint").coalesce(1)
    out = html_text.extract(pages)
    assert out.schema["n"].dataType == pages.schema["n"].dataType
    assert Counter((x["page_id"], x["n"], x["text"]) for x in out.collect()) == Counter({(A, B, "A b c"): 1, (None, None, ""): 1, (B, A, ""): 2})


def test_long_page(spark):
    page = "<article>" + "".join(f"<p>The day of the {k} was long and it was good for the rest of them.</p>" for k in range(20_000)) + "</article>"
    out = html_text.extract(spark.createDataFrame([(1, page)], "page_id int, html string")).collect()
    assert out[0]["text"].count("The day of the") == 20_000


def test_similarity_ids(spark):
    rows, df = docs(spark)
    out = jaccard_join.similarity_classes(df).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(i for i, _ in rows)
    whole = {x["doc_id"]: x["component_id"] for x in out if x["n_shingles"] > 50}
    assert whole[A] == whole[C] == C and whole[B] == B


def test_quality_model_ids(spark):
    rows, df = docs(spark)
    labels = spark.createDataFrame([(A, 1), (C, 1)], "doc_id bigint, quality int")
    out = quality_model.classify(df, labels).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(i for i, _ in rows)
