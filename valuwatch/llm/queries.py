"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat_format, html_text, jaccard_join, line_dedup, mixing, pii, quality_model, quality_rules,
               resampling, sharding, turn_repair, vector_dedup)
from .common import table
from .oracles import ORACLES

#: Shard size of the sharding query, in bytes of text.
SHARD_BYTES = 4 << 20


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                    F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                          F.sha2(bpe.ids_text(F.col("token_ids")), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "text", "n_lines", "n_cut", F.array_join(F.transform(
        "cuts", lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"))), ",").alias("cuts"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return c.select("doc_id", "lang", F.col("lm_words").alias("n_scored"), "perplexity", "limit", F.col("lm_kept").alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality_rules.measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select("doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"),
                    F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"),
                    F.col("q_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"),
                    F.col("q_kept").alias("kept"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return s.select("doc_id", "shard", F.col("shard_depth").cast("long").alias("depth"),
                    F.col("shard_row_bytes").alias("row_bytes"), "shard_bytes")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["strict"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return spans.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return p.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return v.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resampling.resample(docs.select("doc_id", "text"), target.select("text")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = F.lit("</s>[INST] ok [/INST]")
    empty = F.lit(None).cast("string")
    fields = {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit("")), "prompt": empty, "completion": empty}
    one = {"role": empty, "text": empty, "prompt": said, "completion": said}
    kind = rows.schema["conv_id"].dataType

    def record(turn: Column, values: dict[str, Column]) -> Column:
        return F.struct(turn.cast("long").alias("turn"), *[c.alias(k) for k, c in values.items()]).alias("record")

    # the row beside the table is in another layout, a prompt with its completion
    extra = spark.range(1).select(F.lit(-1).cast(kind).alias("conv_id"), record(F.lit(None), one))
    records = rows.select("conv_id", record(F.col("turn"), fields)).unionByName(extra)
    done = chat_format.format_records(records, id="conv_id")
    read = done.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), F.array_join(
        chat_format.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), F.length("formatted").alias("n"))
    said_again = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_again, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.col("n").cast("long").alias("formatted_chars"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mix_sources, op2_byte_bpe, op3_line_dedup, op4_quality_model, op5_quality_rules, op6_shards,
    op7_personal_data, op8_html_text, op9_near_vectors, op10_jaccard_join, op11_target_resampling, op12_chat_format, op13_turn_repair)}
ORACLE_SQL = ORACLES
