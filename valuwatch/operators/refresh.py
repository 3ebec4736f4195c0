"""Gaps kept by rule and fingerprint, so that an edit of the policy recomputes the rules it touches only."""

from __future__ import annotations

import hashlib
from dataclasses import astuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Book, Rule
from .rules import BRANCHES, expected_controls, gap_materialise

GAPS = "gap_id string, position_id string, trigger_event_id string, status string, severity string, due_by timestamp_ntz, computed_at timestamp_ntz"


def fingerprint(b: Book, rule: Rule, facts: str) -> str:
    """sha-256 of all values of a rule, the clock and the version of the facts."""
    return hashlib.sha256(repr((astuple(rule), b.as_of, b.regime_breaks, facts)).encode()).hexdigest()


def marked(gaps: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Gaps with the fingerprint of their rule.  The few fingerprints are literals: a join by rule would send all
    gaps of a rule to one task, and with a single rule left it would be a Cartesian product."""
    table = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    return gaps.withColumn("fingerprint", F.try_element_at(table, F.col("rule_id"))).where("fingerprint is not null")


def refresh_gaps(b: Book, folder: str, facts: str = "") -> tuple[DataFrame, list[str]]:
    """The gaps of the book, read from a store below `folder`, and the rules that had to be recomputed.

    The store is partitioned by rule and fingerprint.  What a rule gave under a fingerprint is written once
    and named in a list when it is complete; a run that dies before that is repeated and replaces its own
    partition.  `facts` names the version of the facts, which an edit of rules leaves as it is.
    """
    wanted = {r.rule_id: fingerprint(b, r, facts) for r in b.rules if r.rule_id in BRANCHES}
    spark = b.spark
    spark.createDataFrame([], "rule_id string, fingerprint string").write.mode("append").parquet(f"{folder}/complete")
    complete = spark.read.schema("rule_id string, fingerprint string").parquet(f"{folder}/complete")
    asked = spark.createDataFrame(list(wanted.items()), "rule_id string, fingerprint string")
    stale = sorted((r.rule_id for r in asked.join(complete, ["rule_id", "fingerprint"], "left_anti").collect()), key=lambda r: (len(r), r))
    if stale:
        part = b.with_(rules=tuple(r for r in b.rules if r.rule_id in stale))
        part.memo["controls"] = expected_controls(part)
        marked(gap_materialise(part), wanted).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rule_id", "fingerprint").parquet(f"{folder}/gaps")
        if "answers" in part.memo:  # an edit of rules leaves them as they are
            b.memo["answers"] = part.memo["answers"]
        asked.where(F.col("rule_id").isin(stale)).coalesce(1).write.mode("append").parquet(f"{folder}/complete")
    here = [(F.col("rule_id") == r) & (F.col("fingerprint") == f) for r, f in wanted.items()]
    keep = here[0]
    for h in here[1:]:
        keep = keep | h
    kept = spark.read.schema(f"{GAPS}, rule_id string, fingerprint string").parquet(f"{folder}/gaps").where(keep)
    return kept.select("gap_id", "rule_id", "position_id", "trigger_event_id", "status", "severity", "due_by", "computed_at"), stale
