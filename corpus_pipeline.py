"""A training corpus in five stages, each a function of the documents the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuwatch.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules
from valuwatch.llm.common import BLANKS, pack, table, unpack
from valuwatch.session import written

#: No single statement: alignment, links and mixing are iterative.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep, without the lines that fail them.

    Null and empty texts fail and go; repeated rows are judged each for itself; an empty table stays empty.
    Other columns pass through, whatever their names.
    """
    judged = quality_rules.measures(docs.select(pack(docs), "text"))
    # a filter below the verdict would have every line judged twice; one that reads such a column stays above
    judged = judged.withColumn("here", F.spark_partition_id()).where("q_kept and here >= 0")
    return _documents(judged, docs, F.col("q_text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents left without a word go.

    Order is by id, nulls first.  Texts without a word (null and empty ones among them) lose nothing and stay;
    rows equal in id and text are one document, cut alike; an empty table stays empty.  Other columns pass
    through, whatever their names.
    """
    cut = line_dedup.dedup_lines(docs.select(pack(docs), "doc_id", "text"))
    return _documents(cut.where((F.col("n_cut") == 0) | (F.translate("text", BLANKS, "") != "")), docs, F.col("text"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the smallest id.

    Rows are known by id and text, as an id may be null or have several texts.  Null ids come last, texts
    of one id follow a hash, and of rows equal in both one stays.  Rows without a word are copies of nothing.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    keyed = docs.select(pack(docs), key, F.col("doc_id").alias("id"))
    members, parts = jaccard_join.link_classes(docs.select(key, "text"), id="key")
    rows = members.where("n > 0").groupBy("id").agg(F.min("cid").alias("cid"), F.count(F.lit(1)).alias("copies")).withColumnRenamed("id", "key")
    rows = rows.join(parts.withColumnRenamed("node", "cid"), "cid", "left").join(keyed.groupBy("key").agg(F.min("id").alias("id")), "key")
    rows = written(rows.select("key", "copies", F.coalesce("component", "cid").alias("part"),
                               F.struct(F.col("id").isNull().alias("last"), "id", "key").alias("rank")), "copy-rows")
    best = rows.groupBy("part").agg(F.min("rank").alias("best"))
    judged = written(rows.join(best, "part").select("key", "copies", (F.col("rank") == F.col("best")).alias("kept")), "copy-keys")
    alone = keyed.join(judged.where("not kept or copies > 1").select("key").hint("shuffle_hash"), "key", "left_anti")
    # equal rows of a kept document may differ in other columns
    again = keyed.join(judged.where("kept and copies > 1").select("key").hint("shuffle_hash"), "key", "left_semi")
    one = again.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return unpack(alone.select("row").union(one.select("row")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times.

    A null source is a source; null and empty texts are taken once; repeated rows count each for itself; an
    empty table stays empty.  Other columns pass through, whatever their names.
    """
    mixed = mixing.mix(docs.select(pack(docs), "doc_id", "source", "text"))
    return unpack(mixing.repeated(mixed, ["row"]), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, and whether they decode to its text.

    Null and empty texts have no ids; repeated rows are encoded each for itself; an empty table gives an
    empty result.  Other columns than doc_id, lang and source are not carried.
    """
    import public_tokenizers

    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocab, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("round_trip"))


def _documents(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The packed columns of documents with a new text, n_chars (where there is one) following it."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unpack(df, docs, **new).select(*[F.col(f"`{c}`") for c in docs.columns])


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", copies),
          ("source mixing", mix), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
