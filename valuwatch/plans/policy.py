"""Registered queries: policy operators, one policy variant per desk of the nation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import DEFAULT_RULES
from ..operators import policy as P
from ..operators.steps import early_detection
from .prelude import obligation_values, sql
from .registry import query

CLOCKS = [f"{y}-01-01" for y in range(1996, 2002)]

# (rule, parameter, base, step, modulus): desk n edits the parameter to base + step * (n % modulus)
EDITS = (("R2", "slaDays", 15, 1, 25), ("R3", "thresholdBps", 10, 2, 25), ("R3", "slaDays", 3, 1, 5),
         ("R5", "divergenceBps", 30, 1, 25), ("R6", "consecutiveDays", 3, 1, 5))


def desk_overlays(b):
    edits = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(p).alias("param"),
                               (F.lit(base) + step * (F.col("n_nationkey") % mod)).cast("string").alias("value"))
                      for r, p, base, step, mod in EDITS])
    return b.raw["nation"].select(F.concat(F.lit("DESK-"), "n_nationkey").alias("variant_id"), F.inline(edits))


_OVERLAY = " UNION ALL ".join(
    f"SELECT 'DESK-' || n_nationkey AS variant_id, '{r}' AS rule_id, '{p}' AS param, "
    f"({base} + {step} * (n_nationkey % {mod}))::VARCHAR AS value FROM nation" for r, p, base, step, mod in EDITS)

_PARAMS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r.rule_id}', '{k}', '{P.text(v)}')" for r in DEFAULT_RULES for k, v in r.params().items()) + ") v(rule_id, param, value)"

_VIEWS = {
    "overlay": _OVERLAY,
    "param": _PARAMS,
    "variant": "SELECT DISTINCT variant_id FROM overlay",
    "edited": """
        SELECT v.variant_id, o.rule_id, coalesce(s.value::INT, o.sla_days) AS sla_days,
               (SELECT string_agg(p.param || '=' || coalesce(e.value, p.value), ',' ORDER BY p.param)
                FROM param p LEFT JOIN overlay e ON e.variant_id = v.variant_id AND e.rule_id = p.rule_id
                 AND e.param = p.param WHERE p.rule_id = o.rule_id) AS params
        FROM variant v CROSS JOIN obligation o LEFT JOIN overlay s
          ON s.variant_id = v.variant_id AND s.rule_id = o.rule_id AND s.param = 'slaDays'""",
    "restored": """
        SELECT v.variant_id, o.rule_id, CASE WHEN o.rule_id = 'R2' THEN o.sla_days
               ELSE coalesce(s.value::INT, o.sla_days) END AS sla_days,
               (SELECT string_agg(p.param || '=' || p.value, ',' ORDER BY p.param) FROM param p
                WHERE p.rule_id = o.rule_id) AS params
        FROM variant v CROSS JOIN obligation o LEFT JOIN overlay s
          ON s.variant_id = v.variant_id AND s.rule_id = o.rule_id AND s.param = 'slaDays'""",
    "policies": """
        SELECT variant_id || '/edit' AS variant_id, rule_id, sla_days, coalesce(params, '') AS params FROM edited
        UNION ALL SELECT variant_id || '/reset', rule_id, sla_days, coalesce(params, '') FROM restored
        UNION ALL SELECT variant_id || '/proposed', 'R-C1', 0, 'communityResolution=1' FROM variant""",
}

query("policy_overlay", "SELECT * FROM policies", **_VIEWS)(lambda b: P.policy_overlay(b, desk_overlays(b)))

query("policy_params", """
    SELECT d.desk_id AS variant_id, o.rule_id, o.rule_name AS name, o.timing, e.sla_days, e.params, o.gap_definition
    FROM desk d JOIN policies e ON e.variant_id = d.desk_id || '/edit' JOIN obligation o ON o.rule_id = e.rule_id""",
      **_VIEWS)(lambda b: b.desk.select(F.concat("desk_id", F.lit("/edit")).alias("v"), F.col("desk_id").alias("d"))
                .join(P.policy_overlay(b, desk_overlays(b)).withColumnRenamed("variant_id", "v"), "v")
                .join(P.rule_rows(b).drop("sla_days", "params"), "rule_id")
                .select(F.col("d").alias("variant_id"), "rule_id", "name", "timing", "sla_days", "params", "gap_definition"))

query("policy_fingerprint", """
    SELECT variant_id, sha256('S1|' || variant_id || '|' || string_agg(
           rule_id || '{slaDays=' || sla_days || ';' || params || '}', ';' ORDER BY rule_id) || '|en') AS fingerprint
    FROM policies GROUP BY variant_id""", **_VIEWS)(
    lambda b: P.policy_fingerprint(P.policy_overlay(b, desk_overlays(b)), "S1", "en"))

_TOUCHED = ("R2", "R3", "R5", "R6")
_SWEEP_OBLIGATION = f"""
    SELECT NULL AS variant_id, * FROM ({obligation_values()}) WHERE rule_id NOT IN {_TOUCHED}
    UNION ALL
    SELECT 'DESK-' || n_nationkey, o.* REPLACE (
        CASE rule_id WHEN 'R2' THEN 15 + n_nationkey % 25 WHEN 'R3' THEN 3 + n_nationkey % 5 ELSE sla_days END AS sla_days,
        CASE rule_id WHEN 'R3' THEN 10 + 2 * (n_nationkey % 25) ELSE threshold_bps END AS threshold_bps,
        CASE rule_id WHEN 'R5' THEN 30 + n_nationkey % 25 ELSE divergence_bps END AS divergence_bps,
        CASE rule_id WHEN 'R6' THEN 3 + n_nationkey % 5 ELSE consecutive_days END AS consecutive_days)
    FROM nation, ({obligation_values()}) o WHERE rule_id IN {_TOUCHED}"""

query("policy_sweep", """
    SELECT variant_id, rule_id, status, count(*) AS n FROM (
        SELECT variant_id, rule_id, status FROM r2 UNION ALL SELECT variant_id, rule_id, status FROM r3
        UNION ALL SELECT variant_id, rule_id, status FROM r5 UNION ALL SELECT variant_id, rule_id, status FROM r6)
    GROUP BY 1, 2, 3
    UNION ALL
    SELECT 'DESK-' || n_nationkey, c.rule_id, c.status, c.n FROM nation, (
        SELECT rule_id, status, count(*) AS n FROM controls WHERE rule_id IN ('R1', 'R4', 'R7', 'R8', 'R9', 'R10')
        GROUP BY 1, 2) c""", obligation=_SWEEP_OBLIGATION)(
    lambda b: P.policy_sweep(b, desk_overlays(b)))

EARLY = " UNION ALL ".join(
    "SELECT * FROM (" + sql(f"SELECT TIMESTAMP '{c}' AS as_of, rule_id, status, count(*) AS n FROM controls GROUP BY 2, 3",
                            clock=f"SELECT TIMESTAMP '{c}' AS as_of") + ")" for c in CLOCKS)
query("early_detection", EARLY, raw=True)(lambda b: early_detection(b, CLOCKS))
