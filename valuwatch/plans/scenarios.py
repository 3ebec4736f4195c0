"""Registered queries: scenarios and the position timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import market as M
from ..operators import scenarios as S
from ..operators import timeline as T
from .events import GRAPH_VIEWS, PRICE_VIEWS, event_prices, prices, proxied
from .prelude import rd
from .registry import query

VIEWS = {
    **GRAPH_VIEWS,
    "gap_rules": "SELECT position_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, count(DISTINCT rule_id) AS k FROM gap GROUP BY 1",
    "chained": """
        SELECT event_id, label, position_id, event_at, source_at, description FROM chronology
        UNION ALL SELECT 'MK-' || position_id || '-' || day, 'Mark', position_id, day + INTERVAL 17 HOUR, NULL, NULL FROM mark""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY event_at, event_id) AS rn FROM chained",
    "near": """
        SELECT src AS position_id, src AS f, dst AS t, rel_type AS ty FROM edge WHERE from_label = 'Position' AND rel_type IN
               ('OVERRIDDEN_BY', 'GENERATED_SIGNAL', 'CHANGED_TO', 'REVIEWED_BY', 'SUBJECT_TO_CONTROL', 'ESCALATED_TO',
                'OWNED_BY', 'ON_DESK', 'VALUED_BY', 'OF_INSTRUMENT')
        UNION SELECT position_id, source_event_id, response_id, 'APPROVED_BY' FROM approvals
              WHERE source_label IN ('PriceOverride', 'MethodologyChange')
        UNION SELECT position_id, response_id, person_id, 'APPROVED_BY' FROM approvals
              WHERE source_label IN ('PriceOverride', 'MethodologyChange')
        UNION SELECT position_id, gap_id, position_id, 'ON_POSITION' FROM gap""",
    "core": """
        SELECT position_id, event_id AS id FROM event
        WHERE label IN ('PriceOverride', 'PnLSignal', 'DecorrelationSignal', 'MethodologyChange')
        UNION SELECT position_id, trigger_event_id FROM gap WHERE trigger_event_id IN (SELECT event_id FROM chronology)""",
    "member": """
        SELECT position_id, position_id AS id FROM position UNION SELECT * FROM core UNION SELECT position_id, gap_id FROM gap
        UNION SELECT c.position_id, performer_id FROM core c JOIN event e ON e.event_id = c.id
        UNION SELECT c.position_id, response_id FROM core c JOIN approvals a ON a.source_event_id = c.id
        UNION SELECT c.position_id, person_id FROM core c JOIN approvals a ON a.source_event_id = c.id""",
    "fact": """
        SELECT entity_id AS position_id, 'RA-' || ra_type || '-' || ra_value AS target_id, ra_type || '=' || ra_value AS name,
               ra_type, FALSE AS is_gap FROM attribute
        UNION SELECT position_id, 'GAPCLASS-' || rule_id, rule_id, NULL, TRUE FROM gap""",
    "extracted": """
        SELECT DISTINCT incident_id, target_id, name, is_gap FROM incident JOIN fact USING (position_id)
        WHERE is_gap OR ra_type IN ('methodologyFamily', 'liquidityTier', 'maturityBucket')""",
    "pattern": """SELECT target_id, name, is_gap FROM extracted WHERE incident_id = (
                  SELECT 'INC-' || min(split_part(incident_id, '-', 2)::BIGINT) FROM incident)""",
    "candidate": """SELECT DISTINCT target_id, name, is_gap FROM fact WHERE NOT is_gap
                    UNION SELECT 'GAPCLASS-' || rule_id, rule_id, TRUE FROM obligation""",
}


def q(name, oracle):
    return query(name, oracle, **VIEWS)


def pattern(b):
    """The pattern of the first confirmed incident."""
    first = b.incident.agg(F.min(F.substring("incident_id", 5, 18).cast("bigint"))).scalar()
    mine = b.with_(incident=b.incident.where(F.substring("incident_id", 5, 18).cast("bigint") == first))
    return S.pattern_extract(mine, b.gaps).select("target_id", "name", "is_gap")


query("next_chain", """
    SELECT position_id, event_id AS from_id, to_id, floor(epoch(to_at - event_at) / 86400)::BIGINT AS time_delta
    FROM (SELECT *, lead(event_id) OVER w AS to_id, lead(event_at) OVER w AS to_at FROM chained
          WINDOW w AS (PARTITION BY position_id ORDER BY event_at, event_id)) WHERE to_id IS NOT NULL""", **VIEWS)(
    lambda b: E.next_chain(S.chain_events(b)))

q("list_positions", """
    SELECT p.position_id AS id, p.name, p.desk_id AS desk, d.name AS desk_name, i.sector, coalesce(g.n, 0) AS gap_count
    FROM position p JOIN desk d USING (desk_id) LEFT JOIN instrument i USING (instrument_id)
    LEFT JOIN (SELECT position_id, count(*) AS n FROM gap GROUP BY 1) g USING (position_id)""")(
    lambda b: S.list_positions(b, b.gaps))
q("conjunction", """
    SELECT p.position_id, p.name, d.name AS desk, coalesce(s, 0) AS signals, coalesce(o, 0) AS overrides,
           coalesce(m, 0) AS method_changes, coalesce(rules, '') AS broken_rules, coalesce(k, 0) AS rule_count,
           (coalesce(s, 0) + coalesce(o, 0) + coalesce(m, 0)) * coalesce(k, 0) AS conjunction_score
    FROM position p JOIN desk d USING (desk_id) LEFT JOIN gap_rules USING (position_id) LEFT JOIN (
        SELECT position_id, count(*) FILTER (label = 'PnLSignal') AS s, count(*) FILTER (label = 'PriceOverride') AS o,
               count(*) FILTER (label = 'MethodologyChange') AS m FROM event GROUP BY 1) USING (position_id)""")(
    lambda b: S.conjunction(b, b.gaps))
q("neighborhood", "SELECT * FROM near")(lambda b: S.neighborhood(b, b.gaps))
q("conjunction_members", "SELECT * FROM member")(lambda b: S.conjunction_members(b, b.gaps))
q("conjunction_paint", """
    SELECT n.position_id, n.id, l.label, CASE WHEN length(l.caption) > 28 THEN left(l.caption, 28) || '…' ELSE l.caption END AS caption,
           m.id IS NULL AS grey
    FROM (SELECT position_id, f AS id FROM near UNION SELECT position_id, t FROM near) n
    JOIN (SELECT * FROM node UNION ALL SELECT gap_id, 'GovernanceGap', gap_id FROM gap) l ON l.id = n.id
    LEFT JOIN member m ON m.position_id = n.position_id AND m.id = n.id""")(lambda b: S.conjunction_paint(b, b.gaps))
_SHOWN = """JOIN (SELECT * FROM node UNION ALL SELECT gap_id, 'GovernanceGap', gap_id FROM gap) l ON l.id = n.id"""
q("neighborhood_nodes", f"""
    SELECT n.position_id, n.id, l.label, l.caption
    FROM (SELECT position_id, f AS id FROM near UNION SELECT position_id, t FROM near) n {_SHOWN}""")(lambda b: S.neighborhood_nodes(b, b.gaps))
q("conjunction_paint_edges", """
    SELECT position_id, f, t, ty FROM near WHERE f IN (SELECT id FROM node UNION SELECT gap_id FROM gap)
       AND t IN (SELECT id FROM node UNION SELECT gap_id FROM gap)""")(
    lambda b: S.conjunction_paint_edges(b, b.gaps))
q("timeline", """
    SELECT position_id, event_id AS id, label, event_at AS at_time, source_at, description,
           floor(epoch(event_at - prev_at) / 86400)::BIGINT AS time_delta_days
    FROM (SELECT *, lag(event_at) OVER (PARTITION BY position_id ORDER BY event_at, event_id) AS prev_at FROM chained)
    WHERE label <> 'Mark'""")(S.timeline)
q("chain_paths", """
    SELECT a.position_id, a.event_id AS from_id, z.event_id AS to_id, a.h AS hops,
           floor(epoch(z.event_at - a.event_at) / 86400)::BIGINT AS days_between
    FROM (SELECT *, unnest(range(1, 11)) AS h FROM placed WHERE label = 'PriceOverride') a
    JOIN (SELECT * FROM placed WHERE label = 'IPVReview') z ON z.position_id = a.position_id AND z.rn = a.rn + a.h""")(S.chain_paths)
q("who_approved", """
    SELECT a.source_event_id, a.response_id AS approval_id, a.event_at AS approved_at, r.name AS approver, r.role AS approver_role,
           r.desk_id AS approver_desk, p.desk_id AS position_desk, coalesce(r.desk_id = p.desk_id, FALSE) AS same_desk, a.evidenced
    FROM approvals a LEFT JOIN person r USING (person_id) LEFT JOIN position p USING (position_id)""")(S.who_approved)
query("divergence_history", """
    SELECT p.position_id, d.day, d.pr AS observed, x.proxy, x.divergence_bps FROM position p JOIN daily d USING (instrument_id)
    LEFT JOIN proxied x ON x.instrument_id = d.instrument_id AND x.day = d.day""", **PRICE_VIEWS)(
    lambda b: S.divergence_history(b, M.daily_ohlc(b.trade), proxied(b)))
q("near_misses", """
    SELECT position_id, p.name, d.name AS desk, rules, k AS rule_count FROM gap_rules JOIN position p USING (position_id)
    JOIN desk d USING (desk_id) WHERE k >= 2 AND position_id NOT IN (SELECT position_id FROM incident)
    ORDER BY rule_count DESC, position_id LIMIT 25""")(lambda b: S.near_misses(b, b.gaps))
q("pattern_extract", "SELECT * FROM extracted")(lambda b: S.pattern_extract(b, b.gaps))
q("pattern_get", "SELECT * FROM pattern")(pattern)
q("pattern_candidates", "SELECT * FROM candidate")(lambda b: S.pattern_candidates(b, b.gaps))
q("read_across", """
    SELECT p.position_id, p.name, d.name AS desk,
           coalesce(string_agg(t.name, ',' ORDER BY t.name) FILTER (f.target_id IS NOT NULL), '') AS satisfied,
           coalesce(string_agg(t.name, ',' ORDER BY t.name) FILTER (f.target_id IS NULL), '') AS missing,
           round(count(f.target_id) / count(*), 6) AS score, bool_or(p.position_id IN (SELECT position_id FROM incident)) AS confirmed_incident
    FROM position p JOIN desk d USING (desk_id) CROSS JOIN pattern t
    LEFT JOIN fact f ON f.position_id = p.position_id AND f.target_id = t.target_id GROUP BY 1, 2, 3""")(
    lambda b: S.read_across(b, b.gaps, pattern(b)))
q("read_across_all", """
    SELECT pattern_id, any_value(incidents) AS incidents, profile_id, any_value(positions) AS positions, count(*) AS satisfied,
           any_value(total) AS total, round(count(*) / any_value(total), 6) AS score
    FROM (SELECT pattern_id, count(*) AS incidents, any_value(ts) AS targets, any_value(len(ts)) AS total, unnest(any_value(ts)) AS target_id
          FROM (SELECT incident_id, md5(string_agg(target_id, ',' ORDER BY target_id)) AS pattern_id, list(target_id) AS ts
                FROM (SELECT DISTINCT incident_id, target_id FROM extracted) GROUP BY 1) GROUP BY 1)
    JOIN (SELECT profile_id, count(*) AS positions, unnest(any_value(ts)) AS target_id
          FROM (SELECT position_id, md5(string_agg(target_id, ',' ORDER BY target_id)) AS profile_id, list(target_id) AS ts
                FROM (SELECT DISTINCT position_id, target_id FROM fact WHERE target_id IN (SELECT target_id FROM extracted)) GROUP BY 1) GROUP BY 1)
    USING (target_id) GROUP BY pattern_id, profile_id""")(lambda b: S.read_across_all(b, b.gaps))
q("pattern_sweep", """
    SELECT variant_id, changed_target, satisfied, total, count(*) AS positions,
           round(CASE WHEN total > 0 THEN satisfied / total END, 6) AS score
    FROM (SELECT v.variant_id, v.changed_target, p.position_id, count(f.target_id) AS satisfied, any_value(v.total) AS total
          FROM position p CROSS JOIN (
              SELECT CASE WHEN c.target_id IN (SELECT target_id FROM pattern) THEN '-' ELSE '+' END || c.target_id AS variant_id,
                     c.target_id AS changed_target, t.target_id, count(t.target_id) OVER (PARTITION BY c.target_id) AS total
              FROM candidate c JOIN candidate t ON (t.target_id IN (SELECT target_id FROM pattern)) <> (t.target_id = c.target_id)) v
          LEFT JOIN fact f ON f.position_id = p.position_id AND f.target_id = v.target_id GROUP BY 1, 2, 3)
    GROUP BY 1, 2, 3, 4""")(lambda b: S.pattern_sweep(b, b.gaps, pattern(b), S.pattern_candidates(b, b.gaps)))
q("price_structure", """
    SELECT position_id, instrument_id, i.name AS instrument, p.desk_id, d.name AS desk, owner_id, r.name AS owner, methodology_id
    FROM position p LEFT JOIN instrument i USING (instrument_id) LEFT JOIN desk d ON d.desk_id = p.desk_id
    LEFT JOIN person r ON r.person_id = p.owner_id""")(S.price_structure)
q("signal_reveal", """
    SELECT position_id, CASE label WHEN 'PnLSignal' THEN 'pnl' WHEN 'PriceOverride' THEN 'override'
           WHEN 'MethodologyChange' THEN 'change' ELSE 'review' END AS kind, event_id AS id, event_at AS at_time,
           CASE label WHEN 'PnLSignal' THEN unexplained_pct WHEN 'PriceOverride' THEN deviation_bps
           WHEN 'IPVReview' THEN divergence_bps END AS value
    FROM event WHERE label IN ('PnLSignal', 'PriceOverride', 'MethodologyChange', 'IPVReview', 'MAPReview')
    UNION ALL SELECT g.position_id, 'gap', gap_id, c.event_at, NULL FROM gap g LEFT JOIN chronology c ON c.event_id = g.trigger_event_id""")(
    lambda b: S.signal_reveal(b, b.gaps))

TIMELINE_VIEWS = {
    **PRICE_VIEWS,
    "position_price": "SELECT position_id, side, day, price FROM position JOIN price USING (instrument_id)",
    "marker": """SELECT * FROM chronology WHERE label IN ('MethodologyChange', 'PriceOverride', 'IPVReview', 'Approval',
                 'Escalation', 'MAPReview', 'DecorrelationSignal')""",
    "span": """SELECT position_id, min(day) AS a, max(day) AS z FROM (
               SELECT position_id, day FROM position_price UNION ALL SELECT position_id, event_at::DATE FROM marker
               UNION ALL SELECT position_id, due_by::DATE FROM gap) GROUP BY 1""",
    "bundle": f"""
        SELECT position_id, 'price' AS section, x.day::TIMESTAMP AS at_time, side AS ref, side AS label, NULL AS role,
               price AS value, NULL AS divergence_bps, CASE WHEN side = 'observed' THEN open END AS open, CASE WHEN side = 'observed' THEN high END AS high,
               CASE WHEN side = 'observed' THEN low END AS low, CASE WHEN side = 'observed' THEN close END AS close,
               CASE WHEN side = 'observed' THEN trade_count END AS trade_count, NULL AS model_price, NULL AS ipv_price, NULL AS rule_name
        FROM position JOIN price x USING (instrument_id) LEFT JOIN daily d ON d.instrument_id = x.instrument_id AND d.day = x.day
        UNION ALL
        SELECT m.position_id, 'event', m.event_at, m.event_id, m.label, coalesce(r.role, m.actor_role), {rd('mark', 3)},
               coalesce(m.divergence_bps, CASE WHEN {rd('mdl', 3)} > 0 THEN
                        floor(({rd('mark', 3)} - {rd('mdl', 3)}) / {rd('mdl', 3)} * 10000 + 0.5)::BIGINT END),
               NULL, NULL, NULL, NULL, NULL, {rd('mdl', 3)}, {rd("CASE WHEN m.label = 'IPVReview' THEN mark * (1 - x.divergence_bps / 10000) END", 3)}, NULL
        FROM marker m LEFT JOIN person r ON r.person_id = m.person_id LEFT JOIN priced x ON x.event_id = m.event_id
        UNION ALL
        SELECT position_id, 'control', due_by, concat_ws('/', rule_id, trigger_event_id, observed_event_id), status, NULL, NULL, NULL,
               NULL, NULL, NULL, NULL, NULL, NULL, NULL, rule_name
        FROM controls""",
}


def tq(name, oracle):
    return query(name, oracle, **TIMELINE_VIEWS)


tq("timeline_bundle", """SELECT *, row_number() OVER (PARTITION BY position_id, section ORDER BY at_time, ref) AS seq FROM bundle""")(
    lambda b: T.timeline_bundle(b, prices(b), event_prices(b), b.controls))
tq("ohlc_candles", """SELECT instrument_id, day, coalesce(open, pr) AS open, coalesce(high, pr) AS high, coalesce(low, pr) AS low,
                      coalesce(close, pr) AS close FROM daily""")(lambda b: T.ohlc_candles(M.daily_ohlc(b.trade)))
tq("calendar_fill", """
    SELECT c.position_id, c.day, x.price AS observed FROM (
        SELECT position_id, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM span) c
    LEFT JOIN position_price x ON x.position_id = c.position_id AND x.day = c.day AND x.side = 'observed'""")(
    lambda b: T.calendar_fill(b, prices(b), b.gaps))
tq("event_price_level", """
    SELECT d.position_id, d.day, coalesce(arg_max(x.price, x.day) FILTER (x.side = 'observed'),
           arg_max(x.price, x.day) FILTER (x.side = 'model'), 100.0) AS value
    FROM (SELECT DISTINCT position_id, event_at::DATE AS day FROM marker) d
    LEFT JOIN position_price x ON x.position_id = d.position_id AND x.day <= d.day GROUP BY 1, 2""")(
    lambda b: T.event_price_level(b, prices(b)))
tq("cumulative_broken", """
    SELECT m.position_id, m.month_start, (SELECT count(*) FROM gap g WHERE g.position_id = m.position_id
           AND g.due_by::DATE < m.month_start) AS broken
    FROM (SELECT position_id, a, z, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month_start
          FROM span) m WHERE month_start BETWEEN a AND z""")(lambda b: T.cumulative_broken(b, prices(b), b.gaps))
tq("rule_bars", """SELECT position_id, rule_id, rule_name, count(*) FILTER (status = 'LATE') AS late,
                   count(*) FILTER (status = 'MISSED') AS missed FROM controls GROUP BY 1, 2, 3""")(lambda b: T.rule_bars(b.controls))
tq("event_rules", """
    SELECT trigger_event_id AS event_id, rule_id, status, 'trigger' AS role FROM controls
    UNION ALL SELECT observed_event_id, rule_id, status, 'observed' FROM controls
    WHERE observed_event_id IS NOT NULL AND observed_event_id <> trigger_event_id""")(lambda b: T.event_rules(b.controls))
