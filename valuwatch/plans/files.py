"""Registered queries: readers of CSV, JSON columns and XML, on files that are written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PARAM_NAMES
from ..operators.policy import text
from ..session import scratch_dir
from ..sources import files
from .registry import query


def _folder(b, name: str) -> str:
    return f"{scratch_dir(b.spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _csv(df: DataFrame, folder: str) -> str:
    df.write.option("header", True).option("escape", '"').csv(folder)
    return folder


# ---- curve: wide rows, blanks where a tenor has no yield

def curve_file(b) -> str:
    names = list(files.CURVE_COLUMNS)
    wide = b.curve.groupBy(F.col("day").cast("date").alias("observation_date")).agg(
        *[F.max(F.when(F.col("tenor_no") == i, F.col("yield"))).alias(n) for i, n in enumerate(names)])
    return _csv(wide, _folder(b, "curve-csv"))


query("scan_curve_file", """
    SELECT day, tenor_no, tenor_years, yield FROM curve WHERE day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")(
    lambda b: files.read_curve(b.spark, curve_file(b), "1996-01-01", "1998-12-31"))


# ---- register: two snapshots, the later one winning for the records it has

def register_files(b) -> str:
    top = _folder(b, "register-xml")
    part = b.raw["part"].select(
        F.concat(F.when(F.col("p_partkey") % 9 == 0, "XS").otherwise("US"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("0")).alias("Id"),
        F.when(F.col("p_partkey") % 10 == 0, "SHRS").otherwise("BOND").alias("FinInstrmClssfctn"), (F.col("p_size") % 2 == 0).alias("Lqdty"),
        (F.col("p_partkey") % 4 == 0).alias("again"))
    part.select("Id", "FinInstrmClssfctn", "Lqdty").write.format("xml").option("rowTag", "RefData").save(f"{top}/snapshot=20200101")
    part.where("again").select("Id", "FinInstrmClssfctn", (~F.col("Lqdty")).alias("Lqdty")).write.format("xml").option(
        "rowTag", "RefData").save(f"{top}/snapshot=20210101")
    return f"{top}/*"


query("scan_liquidity_xml", """
    SELECT lpad(p_partkey::VARCHAR, 9, '0') AS cusip, (p_size % 2 = 0) <> (p_partkey % 4 = 0) AS liquid
    FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 10 <> 0""", raw=True)(
    lambda b: files.liquidity_flags(b.spark, register_files(b)))


# ---- obligations of every desk, parameters as JSON in a column; desks 7, 14, ... have a broken one

def obligation_file(b) -> str:
    def params(r) -> dict:
        return {**r.params(), **({"slaDays": r.sla_days + 1} if r.rule_id == "R5" else {})}

    rows = []
    for r in b.rules:
        values = [F.lit(v).cast("double" if isinstance(v, float) else "boolean" if isinstance(v, bool) else "int").alias(k)
                  for k, v in params(r).items()]
        own = F.to_json(F.struct(*values)) if values else F.lit("{}")
        rows.append(F.struct(
            F.lit(r.rule_id).alias("rule"), F.lit(r.name).alias("name"), F.lit(r.trigger_event).alias("trigger_event"),
            F.lit("when, as \"stated\"").alias("trigger_condition"), F.lit(r.required_control).alias("required_control"),
            F.lit(r.required_by_role).cast("string").alias("required_by_role"), F.lit(r.timing).alias("timing"), F.lit(r.sla_days).alias("sla_days"),
            F.when((F.col("n_nationkey") % 7 == 0) & (F.lit(r.rule_id) == "R3"), "{broken").otherwise(own).alias("params_json"),
            F.lit(r.applies_to).cast("string").alias("applies_to_attribute"), F.lit(r.severity).alias("severity"),
            F.lit(r.gap_definition).alias("gap_definition"), F.lit(True).alias("default_broken_by_TP"), F.lit(False).alias("default_broken_by_FP")))
    every = b.raw["nation"].select("n_nationkey", F.inline(F.array(*rows)))
    return _csv(every.select(F.concat_ws("/", "rule", "n_nationkey").alias("id"), *[c for c in every.columns if c not in ("rule", "n_nationkey")]),
                _folder(b, "obligations-csv"))


def _obligations(b) -> DataFrame:
    path = obligation_file(b)
    read = files.load_obligations(b.spark, path)
    faults = files.obligation_faults(b.spark, path).select("rule_id", F.lit(True).alias("broken"))
    return read.join(faults, "rule_id", "left").select(
        "rule_id", "sla_days", "severity", "applies_to", *PARAM_NAMES, F.coalesce("broken", F.lit(False)).alias("broken"))


def _obligation_sql() -> str:
    from ..model import DEFAULT_RULES

    def lit(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else text(v)

    kinds = {"same_desk_allowed": "BOOLEAN", "n": "INT", "window_days": "INT", "consecutive_days": "INT", "period_months": "INT", "regime_sla_days": "INT"}
    rows = ", ".join("(" + ", ".join([lit(r.rule_id), str(r.sla_days + (r.rule_id == "R5")), lit(r.severity), lit(r.applies_to),
                                      *[lit(getattr(r, f)) for f in PARAM_NAMES]]) + ")" for r in DEFAULT_RULES)
    names = ", ".join(["rule_id", "sla_days", "severity", "applies_to", *PARAM_NAMES])
    fields = ", ".join(f"CASE WHEN NOT broken THEN {f} END::{kinds.get(f, 'DOUBLE')} AS {f}" for f in PARAM_NAMES)
    return f"""SELECT rule_id || '/' || n_nationkey AS rule_id, sla_days, severity, applies_to, {fields}, broken
        FROM (SELECT *, rule_id = 'R3' AND n_nationkey % 7 = 0 AS broken FROM nation, (VALUES {rows}) r({names}))"""


query("scan_obligations", _obligation_sql(), raw=True)(_obligations)


# ---- case rows of the positions with an incident

def case_file(b) -> str:
    some = b.event.join(b.incident.select("position_id").distinct(), "position_id", "left_semi")
    rows = some.select(
        (F.col("consecutive_days") + 1).cast("int").alias("seq"), F.col("event_at").cast("date").alias("date"), F.lit("day").alias("date_precision"),
        F.col("label").alias("event_label"), "event_id", F.concat(F.lit('said "'), "description", F.lit('", then\nno more')).alias("description"),
        "actor_role", (F.col("deviation_bps") / 4).alias("amount_usd_m"), F.lit(None).cast("string").alias("graph_pattern"),
        F.when(F.col("deviation_bps") > 25, "R3;R9").alias("rules_broken"), F.lit("S, p. 1").alias("source"), F.lit("high").alias("confidence"))
    return _csv(rows, _folder(b, "case-csv"))


query("scan_case_csv", """
    SELECT (consecutive_days + 1)::INT AS seq, event_at::DATE AS date, 'day' AS date_precision, label AS event_label, event_id,
           'said "' || label || ' ' || event_id || ' on ' || position_id || ' by ' || performer_id || '", then' || chr(10) || 'no more' AS description,
           actor_role, deviation_bps / 4.0 AS amount_usd_m, NULL::VARCHAR AS graph_pattern,
           CASE WHEN deviation_bps > 25 THEN 'R3;R9' END AS rules_broken, 'S, p. 1' AS source, 'high' AS confidence
    FROM event WHERE position_id IN (SELECT position_id FROM incident)""")(
    lambda b: files.load_case_events(b.spark, case_file(b)))
