"""DuckDB views of the canonical book, written independently of the Spark binding.

`sql(body)` prefixes a statement with exactly the views it needs.
"""

from __future__ import annotations

import re

from ..model import AS_OF, DEFAULT_RULES


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def obligation_values(rules=DEFAULT_RULES) -> str:
    cols = ("rule_id", "name", "severity", "required_control", "required_by_role", "sla_days", "threshold_bps",
            "pct_of_bid_ask", "n", "window_days", "divergence_bps", "unexplained_threshold", "consecutive_days",
            "period_months", "regime_sla_days", "same_desk_allowed", "applies_to", "timing", "gap_definition")
    rows = ",\n".join("(" + ", ".join(_lit(getattr(r, c)) for c in cols) + ")" for r in rules)
    names = ", ".join("rule_name" if c == "name" else c for c in cols)
    return f"SELECT * FROM (VALUES {rows}) v({names})"


def rd(expr: str, digits: int) -> str:
    """Round half up on the decimal expansion, as the engine under test does."""
    return f"round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits})::DOUBLE"


def half_even(expr: str, digits: int) -> str:
    """Round half to even on the decimal expansion."""
    up, scaled = f"round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits})", f"CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)) * {10 ** digits}"
    tie = f"abs({scaled} - trunc({scaled})) = 0.5 AND ({up} * {10 ** digits})::BIGINT % 2 <> 0"
    return f"(CASE WHEN {tie} THEN trunc({scaled}) / {10 ** digits} ELSE {up} END)::DOUBLE"


# Sector of each industry code, apart from those of the engine.
_SECTOR_CASE = """CASE ff
    WHEN 1 THEN 'Consumer' WHEN 2 THEN 'Consumer' WHEN 3 THEN 'Consumer' WHEN 4 THEN 'Consumer'
    WHEN 5 THEN 'Consumer' WHEN 6 THEN 'Consumer' WHEN 7 THEN 'Consumer' WHEN 8 THEN 'Healthcare'
    WHEN 9 THEN 'Materials' WHEN 10 THEN 'Materials' WHEN 11 THEN 'Industrials' WHEN 12 THEN 'Materials'
    WHEN 13 THEN 'Industrials' WHEN 14 THEN 'Industrials' WHEN 15 THEN 'Industrials' WHEN 16 THEN 'Industrials'
    WHEN 17 THEN 'Materials' WHEN 18 THEN 'Energy' WHEN 19 THEN 'Energy' WHEN 20 THEN 'Utilities'
    WHEN 21 THEN 'Telecom' WHEN 22 THEN 'Services' WHEN 23 THEN 'Technology' WHEN 24 THEN 'Materials'
    WHEN 25 THEN 'Transport' WHEN 26 THEN 'Services' WHEN 27 THEN 'Consumer' WHEN 28 THEN 'Consumer'
    WHEN 29 THEN 'Financials' WHEN 30 THEN 'Other'
    ELSE 'Other' END"""

VIEWS: dict[str, str] = {
    "obligation": obligation_values(),
    "clock": f"SELECT TIMESTAMP '{AS_OF} 00:00:00' AS as_of",
    "desk": "SELECT 'DESK-' || n_nationkey AS desk_id, n_name AS name, n_regionkey = 0 AS control FROM nation",
    "person": """
        SELECT 'PER-' || s_suppkey AS person_id, s_name AS name, 'DESK-' || s_nationkey AS desk_id,
               CASE s_suppkey % 7 WHEN 0 THEN 'Trader' WHEN 1 THEN 'Trader' WHEN 2 THEN 'Desk head'
                    WHEN 3 THEN 'IPV analyst' WHEN 4 THEN 'Risk officer' WHEN 5 THEN 'Product controller'
                    ELSE 'MAP member' END AS role FROM supplier""",
    "instrument": f"""
        SELECT 'INS-' || p_partkey AS instrument_id, p_name AS name, ff AS ff_code,
               {_SECTOR_CASE} AS sector, maturity_years, p_retailprice * 1000 AS amount, register_liquid,
               CASE WHEN maturity_years IS NULL THEN '5-10Y' WHEN maturity_years < 2 THEN '<2Y'
                    WHEN maturity_years < 5 THEN '2-5Y' WHEN maturity_years < 10 THEN '5-10Y' ELSE '10Y+' END AS bucket,
               CASE WHEN register_liquid THEN 'liquid' ELSE 'illiquid' END AS liq
        FROM (SELECT *, CASE WHEN p_partkey % 13 = 4 THEN 30 ELSE p_partkey % 32 + 1 END AS ff,
                     CASE WHEN p_partkey % 17 = 5 THEN NULL ELSE p_size / 2.0 END AS maturity_years,
                     CASE p_partkey % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS register_liquid FROM part)""",
    "position": """
        SELECT 'POS-' || c.no AS position_id, 'Book ' || c.no AS name, 'DESK-' || nation AS desk_id,
               'PER-' || owner AS owner_id, 'INS-' || (c.no % (SELECT count(*) FROM part)) AS instrument_id,
               'METH-' || family AS methodology_id, family, opened_at,
               CASE WHEN acctbal < 0 THEN last_at END AS valid_to
        FROM (SELECT c_custkey // 12 AS no, min_by(c_nationkey, c_custkey) AS nation,
                     min_by(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'matrix' WHEN 'BUILDING' THEN 'proxy'
                            WHEN 'FURNITURE' THEN 'broker' WHEN 'HOUSEHOLD' THEN 'model' ELSE 'curve' END,
                            c_custkey) AS family,
                     min_by(c_acctbal, c_custkey) AS acctbal FROM customer GROUP BY 1) c
        JOIN (SELECT o_custkey // 12 AS no, min(o_orderdate) AS opened_at, max(o_orderdate) AS last_at
              FROM orders GROUP BY 1) s ON s.no = c.no
        LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS owner FROM supplier GROUP BY 1) o
               ON o.s_nationkey = c.nation""",
    "event": """
        SELECT 'EV-' || o_orderkey AS event_id,
               CASE left(o_orderpriority, 1) WHEN '1' THEN 'PriceOverride' WHEN '2' THEN 'IPVReview'
                    WHEN '3' THEN 'PnLSignal' WHEN '4' THEN 'MethodologyChange' ELSE
                    CASE o_orderstatus WHEN 'F' THEN 'MAPReview' WHEN 'O' THEN 'Control'
                         ELSE 'DecorrelationSignal' END END AS label,
               'POS-' || (o_custkey // 12) AS position_id,
               o_orderdate + to_hours(o_orderkey % 24) AS event_at, o_orderdate AS source_at,
               CASE WHEN o_orderstatus = 'F' THEN NULL
                    ELSE o_orderdate + to_hours(o_orderkey % 24) + to_days((o_orderkey % 11)::INT) END AS effective_at,
               floor(o_totalprice)::BIGINT % 60 AS deviation_bps,
               CASE WHEN o_orderkey % 2 = 0 THEN 'favourable' ELSE 'adverse' END AS side,
               o_custkey % 100 AS pct_of_bid_ask, floor(o_totalprice)::BIGINT % 100 AS divergence_bps,
               (o_custkey % 100) / 1000.0 AS unexplained_pct, o_orderkey % 10 AS consecutive_days,
               CASE o_orderkey % 4 WHEN 0 THEN 'upheld' WHEN 1 THEN 'adjusted' WHEN 2 THEN 'explained' END AS outcome,
               'PER-' || (o_custkey % (SELECT count(*) FROM supplier)) AS performer_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'desk' WHEN 1 THEN 'control' END AS actor_role
        FROM orders""",
    "response": """
        SELECT 'RS-' || l_orderkey || '-' || l_linenumber AS response_id,
               CASE WHEN flag = 'A' THEN 'Approval' WHEN flag = 'R' THEN 'Escalation'
                    WHEN status = 'O' THEN 'Challenge' ELSE 'Adjustment' END AS kind,
               'EV-' || l_orderkey AS source_event_id, shipped + to_hours(l_linenumber) AS event_at,
               'PER-' || person AS person_id, status = 'O' AS evidenced,
               flag = 'R' AND l_linenumber = 7 AS of_position, e.label AS source_label, e.position_id
        FROM (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS shipped, min(l_suppkey) AS person,
                     min(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2) l
        JOIN event e ON e.event_id = 'EV-' || l_orderkey""",
    "attribute": """
        SELECT position_id AS entity_id, unnest(['issuerSector', 'maturityBucket', 'liquidityTier',
               'methodologyFamily', 'deskId']) AS ra_type,
               unnest([sector, bucket, liq, family, desk_id]) AS ra_value
        FROM position JOIN instrument USING (instrument_id)""",
    "incident": """
        SELECT 'INC-' || c_custkey AS incident_id, 'POS-' || (c_custkey // 12) AS position_id
        FROM customer WHERE c_acctbal > 9900""",
    "regime": "SELECT 'REGIME-2000' AS id, TIMESTAMP '2000-01-01' AS at_",
    "mark": """
        SELECT 'POS-' || (o_custkey // 12) AS position_id, last_day(o_orderdate) AS day,
               sum(floor(o_totalprice)) / count(*) AS clean FROM orders GROUP BY 1, 2""",
    "trade": """
        SELECT 'INS-' || l_partkey AS instrument_id, l_shipdate::DATE AS day,
               CASE WHEN q % 23 = 7 THEN NULL ELSE px END AS pr,
               CASE WHEN q % 7 = 3 THEN NULL ELSE disc + 0.01 END AS ytm,
               CASE WHEN q % 11 = 5 THEN NULL ELSE p_size / 5.0 END AS mod_dur, trade_count,
               CASE WHEN q % 5 <> 0 THEN px * (1 - disc) END AS prc_bid,
               CASE WHEN q % 5 <> 0 THEN px * (1 + tax) END AS prc_ask,
               CASE WHEN supp % 50 = 0 THEN 3 ELSE supp % 2 + 1 END AS db_type,
               CASE WHEN p_partkey % 13 = 4 THEN NULL ELSE p_partkey % 32 + 1 END AS ff30num,
               CASE WHEN p_partkey % 17 = 5 THEN NULL ELSE p_size / 2.0 END AS bond_maturity,
               p_retailprice * 1000 AS bond_amt_outstanding, prc_first, prc_hi, prc_lo, prc_last
        FROM (SELECT l_partkey, l_shipdate, count(*) AS trade_count, max(p) AS prc_hi, min(p) AS prc_lo,
                     first(p ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS prc_first,
                     last(p ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS prc_last,
                     last(p ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS px,
                     last(l_discount ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS disc,
                     last(l_tax ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS tax,
                     last(l_quantity ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS q,
                     last(l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS supp
              FROM (SELECT *, 20 + (floor(l_extendedprice)::BIGINT % 10000) / 100.0 AS p FROM lineitem)
              GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey""",
    "curve": """
        SELECT day, i - 1 AS tenor_no, [1/12, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 20.0, 30.0][i] AS tenor_years,
               CASE WHEN (date_diff('day', DATE '1970-01-01', day) + i - 1) % 5 = 0 THEN NULL
                    ELSE 2.0 + (date_diff('day', DATE '1970-01-01', day) % 97) / 50.0 + (i - 1) / 8.0 END AS yield
        FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), range(1, 12) r(i)""",
    "chronology": """
        SELECT event_id, label, position_id, event_at, source_at,
               label || ' ' || event_id || ' on ' || position_id || ' by ' || performer_id AS description,
               performer_id AS person_id, deviation_bps, side, divergence_bps, actor_role FROM event
        UNION ALL
        SELECT response_id, kind, position_id, event_at, event_at, kind || ' of ' || source_event_id, CASE WHEN kind = 'Approval' THEN person_id END,
               NULL, NULL, NULL, NULL FROM response WHERE kind IN ('Approval', 'Escalation')""",
    "approvals": "SELECT * FROM response WHERE kind = 'Approval'",
    "r1": """
        SELECT o.*, e.position_id, e.event_id AS trigger_event_id, e.event_at AS trigger_at, e.label AS trigger_label,
               coalesce(effective_at, e.event_at) AS due_by,
               (SELECT arg_min(a.response_id, (a.event_at, a.response_id)) FROM approvals a
                WHERE a.source_event_id = e.event_id) AS observed_event_id,
               (SELECT min(a.event_at) FROM approvals a WHERE a.source_event_id = e.event_id) AS observed_at,
               CASE WHEN EXISTS (SELECT 1 FROM approvals a WHERE a.source_event_id = e.event_id
                                 AND a.event_at <= coalesce(effective_at, e.event_at)) THEN 'MET'
                    WHEN EXISTS (SELECT 1 FROM approvals a WHERE a.source_event_id = e.event_id) THEN 'LATE'
                    ELSE 'MISSED' END AS status
        FROM event e, obligation o, clock WHERE e.label = 'MethodologyChange' AND e.event_at <= as_of AND o.rule_id = 'R1'""",
    "r2": """
        SELECT o.*, e.position_id, e.event_id AS trigger_event_id, e.event_at AS trigger_at, e.label AS trigger_label,
               e.eff + to_days(o.sla_days) AS due_by, v.id AS observed_event_id, v.at_ AS observed_at,
               CASE WHEN v.at_ <= e.eff + to_days(o.sla_days) THEN 'MET' WHEN v.at_ IS NOT NULL THEN 'LATE'
                    WHEN e.eff + to_days(o.sla_days) > as_of THEN 'PENDING' ELSE 'MISSED' END AS status
        FROM (SELECT *, coalesce(effective_at, event_at) AS eff FROM event WHERE label = 'MethodologyChange') e
        CROSS JOIN obligation o CROSS JOIN clock
        LEFT JOIN (SELECT e.event_id, min(i.event_at) AS at_, arg_min(i.event_id, (i.event_at, i.event_id)) AS id
                   FROM event e JOIN event i ON i.position_id = e.position_id AND i.label = 'IPVReview'
                    AND i.event_at > coalesce(e.effective_at, e.event_at) CROSS JOIN clock
                   WHERE i.event_at <= as_of GROUP BY 1) v ON v.event_id = e.event_id
        WHERE e.event_at <= as_of AND o.rule_id = 'R2'""",
    "r3": """
        SELECT * EXCLUDE (challenged, n_all, n_within), CASE WHEN n_within > 0 AND challenged THEN 'MET' WHEN n_all > 0 AND challenged THEN 'LATE'
               WHEN due_by > (SELECT as_of FROM clock) AND challenged THEN 'PENDING' ELSE 'MISSED' END AS status
        FROM (SELECT o.*, e.position_id, e.event_id AS trigger_event_id, e.event_at AS trigger_at,
                     e.label AS trigger_label, e.event_at + to_days(o.sla_days) AS due_by,
                     arg_min(a.response_id, (a.event_at, a.response_id)) FILTER (a.kind = 'Approval') AS observed_event_id,
                     min(a.event_at) FILTER (a.kind = 'Approval') AS observed_at,
                     count(*) FILTER (a.kind = 'Approval') AS n_all,
                     count(*) FILTER (a.kind = 'Approval' AND a.event_at <= e.event_at + to_days(o.sla_days)) AS n_within,
                     coalesce(bool_or(a.kind = 'Challenge'), FALSE) AS challenged
              FROM event e CROSS JOIN obligation o CROSS JOIN clock LEFT JOIN response a ON a.source_event_id = e.event_id
              WHERE e.label = 'PriceOverride' AND o.rule_id = 'R3' AND e.event_at <= as_of
                AND (e.deviation_bps > o.threshold_bps OR coalesce(e.pct_of_bid_ask, 0) > o.pct_of_bid_ask)
              GROUP BY ALL)""",
    "r4": """
        SELECT o.*, q.* EXCLUDE (rule_id), NULL::VARCHAR AS observed_event_id, NULL::TIMESTAMP AS observed_at
        FROM (SELECT 'R4' AS rule_id, position_id, trigger_event_id, trigger_at, trigger_label, due_by, status
              FROM (SELECT *, CASE WHEN escalated THEN 'MET' WHEN due_by > (SELECT as_of FROM clock) THEN 'PENDING'
                              ELSE 'MISSED' END AS status
                    FROM (SELECT e.position_id, e.event_id AS trigger_event_id, e.event_at AS trigger_at,
                                 e.label AS trigger_label, e.event_at + to_days(o.sla_days) AS due_by, o.n,
                                 (SELECT count(*) FROM event x WHERE x.position_id = e.position_id AND x.label = 'PriceOverride'
                                  AND x.event_at <= e.event_at AND x.event_at > e.event_at - to_days(o.window_days)) AS cnt,
                                 EXISTS (SELECT 1 FROM response s WHERE s.position_id = e.position_id AND s.kind = 'Escalation'
                                         AND (s.of_position OR s.source_label = 'PriceOverride')
                                         AND s.event_at >= e.event_at - to_days(o.window_days)
                                         AND s.event_at <= e.event_at + to_days(o.sla_days)) AS escalated
                          FROM event e, obligation o, clock
                          WHERE e.label = 'PriceOverride' AND o.rule_id = 'R4' AND e.event_at <= as_of)
                    WHERE cnt >= n)
              QUALIFY row_number() OVER (PARTITION BY position_id
                      ORDER BY status <> 'MISSED', trigger_at, trigger_event_id) = 1) q
        JOIN obligation o USING (rule_id)""",
    "r5": """
        SELECT o.*, e.position_id, e.event_id AS trigger_event_id, e.event_at AS trigger_at, e.label AS trigger_label,
               e.event_at + to_days(o.sla_days) AS due_by, NULL::VARCHAR AS observed_event_id, NULL::TIMESTAMP AS observed_at,
               CASE WHEN EXISTS (SELECT 1 FROM response s WHERE s.source_event_id = e.event_id
                         AND (s.kind IN ('Adjustment', 'Challenge') OR (s.kind = 'Escalation' AND NOT s.of_position
                              AND s.event_at <= e.event_at + to_days(o.sla_days)))) THEN 'MET'
                    WHEN e.event_at + to_days(o.sla_days) > as_of THEN 'PENDING' ELSE 'MISSED' END AS status
        FROM event e, obligation o, clock WHERE e.label = 'IPVReview' AND o.rule_id = 'R5' AND e.event_at <= as_of
          AND e.divergence_bps > o.divergence_bps""",
    "r6": """
        SELECT o.*, e.position_id, e.event_id AS trigger_event_id, e.event_at AS trigger_at, e.label AS trigger_label,
               e.event_at + to_days(o.sla_days) AS due_by, v.id AS observed_event_id, v.at_ AS observed_at,
               CASE WHEN v.at_ <= e.event_at + to_days(o.sla_days) THEN 'MET' WHEN v.at_ IS NOT NULL THEN 'LATE'
                    WHEN e.event_at + to_days(o.sla_days) > as_of THEN 'PENDING' ELSE 'MISSED' END AS status
        FROM (SELECT * FROM event WHERE label = 'PnLSignal') e
        CROSS JOIN obligation o CROSS JOIN clock
        LEFT JOIN (SELECT e.event_id, min(i.event_at) AS at_, arg_min(i.event_id, (i.event_at, i.event_id)) AS id
                   FROM event e JOIN event i ON i.position_id = e.position_id AND i.label = 'Control'
                    AND i.event_at >= e.event_at CROSS JOIN clock WHERE i.event_at <= as_of GROUP BY 1) v
               ON v.event_id = e.event_id
        WHERE e.event_at <= as_of AND o.rule_id = 'R6' AND coalesce(e.unexplained_pct, 0) >= o.unexplained_threshold
          AND coalesce(e.consecutive_days, 0) >= o.consecutive_days""",
    "r7_scope": """
        SELECT o.*, p.position_id, p.opened_at, p.valid_to FROM obligation o
        JOIN attribute a ON a.ra_type = split_part(o.applies_to, '=', 1) AND a.ra_value = split_part(o.applies_to, '=', 2)
        JOIN position p ON p.position_id = a.entity_id WHERE o.rule_id = 'R7'""",
    "r7a": """
        SELECT s.* EXCLUDE (opened_at, valid_to), position_id AS trigger_event_id, opened_at AS trigger_at,
               'Position' AS trigger_label, as_of AS due_by, m.id AS observed_event_id, m.at_ AS observed_at,
               CASE WHEN m.id IS NULL THEN 'MISSED' ELSE 'MET' END AS status
        FROM r7_scope s CROSS JOIN clock
        LEFT JOIN (SELECT s.position_id AS pid, max(event_at) AS at_, arg_max(event_id, (event_at, event_id)) AS id
                   FROM r7_scope s JOIN event e ON e.position_id = s.position_id AND e.label = 'MAPReview' CROSS JOIN clock
                   WHERE event_at <= as_of AND event_at > as_of - to_months(s.period_months) GROUP BY 1) m
               ON m.pid = s.position_id
        WHERE (valid_to IS NULL OR valid_to > as_of) AND opened_at <= as_of - to_months(period_months)""",
    "r7b": """
        SELECT s.* EXCLUDE (opened_at, valid_to), r.id AS trigger_event_id, r.at_ AS trigger_at,
               'RegimeBreak' AS trigger_label, r.at_ + to_days(regime_sla_days) AS due_by,
               NULL::VARCHAR AS observed_event_id, NULL::TIMESTAMP AS observed_at,
               CASE WHEN EXISTS (SELECT 1 FROM event e WHERE e.position_id = s.position_id AND e.label = 'MAPReview'
                         AND e.event_at > r.at_ AND e.event_at <= r.at_ + to_days(regime_sla_days)) THEN 'MET'
                    WHEN r.at_ + to_days(regime_sla_days) > as_of THEN 'PENDING' ELSE 'MISSED' END AS status
        FROM r7_scope s, regime r, clock WHERE r.at_ <= as_of AND opened_at <= r.at_
          AND (valid_to IS NULL OR valid_to > r.at_)""",
    "r8": """
        SELECT o.*, p.position_id, e.event_id AS trigger_event_id, e.event_at AS trigger_at, e.label AS trigger_label,
               a.event_at AS due_by, a.response_id AS observed_event_id, a.event_at AS observed_at, 'MISSED' AS status
        FROM approvals a JOIN event e ON e.event_id = a.source_event_id JOIN position p ON p.position_id = e.position_id
        JOIN person r ON r.person_id = a.person_id CROSS JOIN obligation o CROSS JOIN clock
        WHERE o.rule_id = 'R8' AND o.same_desk_allowed = FALSE AND a.event_at <= as_of
          AND (p.owner_id = a.person_id OR p.desk_id = r.desk_id)""",
    "r9": """
        SELECT o.*, x.position_id, x.response_id AS trigger_event_id, x.event_at AS trigger_at, x.kind AS trigger_label,
               x.event_at AS due_by, NULL::VARCHAR AS observed_event_id, NULL::TIMESTAMP AS observed_at, 'MISSED' AS status
        FROM response x, obligation o, clock WHERE o.rule_id = 'R9' AND x.event_at <= as_of
          AND x.kind IN ('Approval', 'Escalation') AND NOT x.evidenced""",
    "r10": """
        SELECT o.*, e.position_id, e.event_id AS trigger_event_id, e.event_at AS trigger_at, e.label AS trigger_label,
               e.event_at + to_days(o.sla_days) AS due_by, NULL::VARCHAR AS observed_event_id, NULL::TIMESTAMP AS observed_at,
               CASE WHEN EXISTS (SELECT 1 FROM event c JOIN approvals a ON a.source_event_id = c.event_id
                         WHERE c.position_id = e.position_id AND c.label = 'MethodologyChange'
                           AND a.event_at <= coalesce(c.effective_at, c.event_at)
                           AND coalesce(c.effective_at, c.event_at) BETWEEN e.event_at - to_days(o.sla_days)
                               AND e.event_at + to_days(o.sla_days))
                      OR EXISTS (SELECT 1 FROM event v WHERE v.position_id = e.position_id AND v.label = 'IPVReview'
                         AND v.event_at BETWEEN e.event_at AND e.event_at + to_days(o.sla_days)
                         AND (v.outcome IN ('adjusted', 'challenged', 'explained') OR EXISTS (
                              SELECT 1 FROM response s WHERE s.source_event_id = v.event_id
                              AND s.kind = 'Adjustment'))) THEN 'MET'
                    WHEN e.event_at + to_days(o.sla_days) > as_of THEN 'PENDING' ELSE 'MISSED' END AS status
        FROM event e, obligation o, clock WHERE e.label = 'DecorrelationSignal' AND o.rule_id = 'R10' AND e.event_at <= as_of""",
}

GAP_SQL = ("rule_id, rule_name, severity, required_control AS expected_control, required_by_role, position_id, "
           "trigger_event_id, trigger_at, trigger_label, due_by, observed_event_id, observed_at, status")

VIEWS["controls"] = " UNION ALL ".join(
    f"SELECT {GAP_SQL} FROM {r}" for r in ("r1", "r2", "r3", "r4", "r5", "r6", "r7a", "r7b", "r8", "r9", "r10"))
VIEWS["gap"] = """
    SELECT 'GAP-' || rule_id || '-' || position_id || '-' || coalesce(trigger_event_id, 'x') AS gap_id, rule_id,
           position_id, trigger_event_id, min(status) AS status, severity, min(due_by) AS due_by,
           (SELECT as_of FROM clock) AS computed_at
    FROM controls WHERE status IN ('MISSED', 'LATE') GROUP BY rule_id, position_id, trigger_event_id, severity"""

_NAME = r"[a-z_][a-z_0-9]*"
_SOURCE = re.compile(rf"(?:FROM|JOIN)\s+({_NAME}(?:\s+{_NAME})?(?:\s*,\s*{_NAME}(?:\s+{_NAME})?)*)")


def needed(body: str, views: dict[str, str]) -> list[str]:
    """Views a statement reads from, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for sources in _SOURCE.findall(text):
            for name in (part.split()[0] for part in sources.split(",")):
                if name in views and name not in order:
                    visit(views[name])
                    if name not in order:
                        order.append(name)

    visit(body)
    return order


def sql(body: str, **extra: str) -> str:
    """`body` behind the WITH list it needs; `extra` adds views local to the statement."""
    views = {**VIEWS, **extra}
    names = needed(body, views)
    head = ",\n".join(f"{n} AS (\n{views[n]})" for n in names)
    return f"WITH {head}\n{body}" if head else body
