"""Registered queries: event modelling and the graph view of the book."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import graph as G
from ..operators import market as M
from ..operators import views as V
from ..operators.cases import LABEL_RULES, encode_case
from ..sources.files import read_layer
from .market import _VIEWS as MARKET_VIEWS
from .market import proxied
from .prelude import rd
from .registry import query

PLAN = (("R3", "PriceOverride"), ("R4", "PriceOverride"), ("R5", "IPVReview"), ("R6", "PnLSignal"))

def event_prices(b):
    """Prices at event time, which the timeline reads too."""
    return b.once("event_prices", lambda: E.annotate_event_prices(b, prices(b)))


GRAPH_VIEWS = {
    "edge": """
        SELECT position_id AS src, CASE label WHEN 'MethodologyChange' THEN 'CHANGED_TO' WHEN 'PriceOverride' THEN 'OVERRIDDEN_BY'
               WHEN 'PnLSignal' THEN 'GENERATED_SIGNAL' WHEN 'DecorrelationSignal' THEN 'GENERATED_SIGNAL'
               WHEN 'Control' THEN 'SUBJECT_TO_CONTROL' ELSE 'REVIEWED_BY' END AS rel_type, event_id AS dst,
               'Position' AS from_label, label AS to_label FROM event
        UNION ALL SELECT event_id, 'PERFORMED_BY', performer_id, label, 'Person' FROM event
        UNION ALL SELECT source_event_id, 'APPROVED_BY', response_id, source_label, 'Approval' FROM approvals
        UNION ALL SELECT response_id, 'APPROVED_BY', person_id, 'Approval', 'Person' FROM approvals
        UNION ALL SELECT CASE WHEN of_position THEN position_id ELSE source_event_id END, 'ESCALATED_TO', response_id,
                  CASE WHEN of_position THEN 'Position' ELSE source_label END, 'Escalation' FROM response WHERE kind = 'Escalation'
        UNION ALL SELECT source_event_id, 'CHALLENGED_BY', response_id, source_label, 'IPVReview' FROM response WHERE kind = 'Challenge'
        UNION ALL SELECT source_event_id, 'EVIDENCED_BY', response_id, source_label, 'Evidence' FROM response WHERE kind = 'Adjustment'
        UNION ALL SELECT response_id, 'EVIDENCED_BY', 'EVD-' || response_id, kind, 'Evidence' FROM response
                  WHERE kind IN ('Approval', 'Escalation') AND evidenced
        UNION ALL SELECT position_id, 'OF_INSTRUMENT', instrument_id, 'Position', 'Instrument' FROM position
        UNION ALL SELECT position_id, 'OWNED_BY', owner_id, 'Position', 'Person' FROM position WHERE owner_id IS NOT NULL
        UNION ALL SELECT position_id, 'ON_DESK', desk_id, 'Position', 'Desk' FROM position
        UNION ALL SELECT position_id, 'VALUED_BY', methodology_id, 'Position', 'ValuationMethodology' FROM position
        UNION ALL SELECT person_id, 'ON_DESK', desk_id, 'Person', 'Desk' FROM person
        UNION ALL SELECT entity_id, 'HAS_RISK_ATTRIBUTE', 'RA-' || ra_type || '-' || ra_value, 'Position', 'RiskAttribute' FROM attribute
        UNION ALL SELECT incident_id, 'CAUSED_BY', position_id, 'Incident', 'Position' FROM incident""",
    "node": """
        SELECT event_id AS id, label, event_id AS caption FROM event
        UNION ALL SELECT response_id, CASE kind WHEN 'Challenge' THEN 'IPVReview' WHEN 'Adjustment' THEN 'Evidence' ELSE kind END,
                  response_id FROM response
        UNION ALL SELECT 'EVD-' || response_id, 'Evidence', 'EVD-' || response_id FROM response
                  WHERE kind IN ('Approval', 'Escalation') AND evidenced
        UNION ALL SELECT position_id, 'Position', name FROM position
        UNION ALL SELECT person_id, 'Person', name FROM person
        UNION ALL SELECT desk_id, 'Desk', name FROM desk
        UNION ALL SELECT instrument_id, 'Instrument', name FROM instrument
        UNION ALL SELECT DISTINCT methodology_id, 'ValuationMethodology', methodology_id FROM position
        UNION ALL SELECT DISTINCT 'RA-' || ra_type || '-' || ra_value, 'RiskAttribute', 'RA-' || ra_type || '-' || ra_value FROM attribute
        UNION ALL SELECT incident_id, 'Incident', incident_id FROM incident""",
}


def prices(b):
    """Observed and model prices of the held instruments."""
    held = b.position.select("instrument_id").distinct()
    observed = M.daily_ohlc(b.trade.join(held, "instrument_id", "left_semi")).select(
        "instrument_id", F.lit("observed").alias("side"), "day", F.col("pr").alias("price"), "open", "high", "low", "close", "trade_count")
    model = proxied(b).join(held, "instrument_id", "left_semi").select(
        "instrument_id", F.lit("model").alias("side"), "day", F.col("proxy").alias("price"))
    return observed.unionByName(model, allowMissingColumns=True)


PRICE_VIEWS = {
    **MARKET_VIEWS,
    "price": """
        SELECT instrument_id, 'observed' AS side, day, pr AS price FROM daily WHERE instrument_id IN (SELECT instrument_id FROM position)
        UNION ALL SELECT instrument_id, 'model', day, proxy FROM proxied
                  WHERE instrument_id IN (SELECT instrument_id FROM position)""",
    "priced": """
        SELECT event_id, label, position_id, event_at, m AS base_mark, mdl,
               CASE WHEN label = 'PriceOverride' THEN m * (1 + CASE WHEN side = 'favourable' THEN 1 ELSE -1 END * deviation_bps / 10000)
                    ELSE m END AS mark, divergence_bps
        FROM (SELECT *, coalesce(obs, mdl) AS m FROM (
              SELECT c.*, coalesce(arg_max(x.price, x.day) FILTER (x.side = 'observed' AND x.day <= c.event_at::DATE),
                                   arg_min(x.price, x.day) FILTER (x.side = 'observed')) AS obs,
                     coalesce(arg_max(x.price, x.day) FILTER (x.side = 'model' AND x.day <= c.event_at::DATE),
                              arg_min(x.price, x.day) FILTER (x.side = 'model')) AS mdl
              FROM chronology c JOIN position p USING (position_id) LEFT JOIN price x ON x.instrument_id = p.instrument_id
              WHERE label IN ('MethodologyChange', 'PriceOverride', 'IPVReview', 'Approval', 'Escalation', 'MAPReview')
              GROUP BY ALL))""",
}

query("asof_event_prices", f"""
    SELECT event_id, label, position_id, {rd('mark', 3)} AS trader_mark, {rd('mdl', 3)} AS model_price,
           {rd("CASE WHEN label = 'IPVReview' THEN mark * (1 - divergence_bps / 10000) END", 3)} AS ipv_price FROM priced""",
      **PRICE_VIEWS)(event_prices)

query("shift_clock", """
    SELECT event_id, source_at::DATE AS source_day, (source_at + INTERVAL 10 YEAR)::DATE AS shifted FROM event""")(
    lambda b: E.shift_years(b.event.select("event_id", F.to_date("source_at").alias("source_day")), "source_day", 10, "shifted"))


def case_series(b):
    """Each override of 50 bps or more opens a series that runs for its count of days, in weeks."""
    day = F.to_date("event_at")
    return b.event.where("label = 'PriceOverride' and deviation_bps >= 50").select(
        "event_id", "position_id", day.alias("start"), F.date_add(day, (F.col("consecutive_days") * 7).cast("int")).alias("end"))


query("encode_case", """
    SELECT event_id || '-' || lpad((w + 1)::VARCHAR, 2, '0') AS event_id, position_id, day,
           30 + 10 * w AS deviation_bps, least(30 + 6 * w, 95) AS pct_of_bid_ask
    FROM (SELECT event_id, position_id, w, (event_at::DATE + (7 * w)::INT) AS day, event_at::DATE + (consecutive_days * 7)::INT AS z
          FROM event, range(0, 12) r(w) WHERE label = 'PriceOverride' AND deviation_bps >= 50) WHERE day <= z""")(
    lambda b: E.weekly_overrides(case_series(b)))


def case_rows(b):
    """The positions of confirmed incidents as case files, sequenced by order number."""
    rows = b.event.join(b.incident.select("position_id").distinct(), "position_id", "left_semi")
    return rows.select("event_id", F.col("label").alias("event_label"), "position_id", F.to_date("event_at").alias("date"),
                       F.lit("day").alias("date_precision"), F.substring("event_id", 4, 18).cast("bigint").alias("seq"),
                       "description", "actor_role", F.lit(None).cast("string").alias("rules_broken"))


def loaded_case(b):
    events, chain, bad = E.load_case(case_rows(b))
    out = [events.select(F.lit("event").alias("part"), F.col("event_id").alias("a"), F.col("label").alias("b")),
           E.label_edges(events, E.CASE_EDGE).select(F.lit("edge").alias("part"), F.col("rel_type").alias("a"), F.col("dst").alias("b")),
           chain.select(F.lit("chain").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b")),
           bad.select(F.lit("unsupported").alias("part"), F.col("event_id").alias("a"), F.col("event_label").alias("b"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


query("load_case", """
    SELECT 'event' AS part, event_id AS a, label AS b FROM kept
    UNION ALL SELECT 'edge', rel_type, dst FROM edge WHERE dst IN (SELECT event_id FROM kept) AND from_label = 'Position'
    UNION ALL SELECT 'chain', event_id, nxt FROM (
        SELECT event_id, lead(event_id) OVER (PARTITION BY position_id ORDER BY split_part(event_id, '-', 2)::BIGINT) AS nxt FROM kept)
        WHERE nxt IS NOT NULL
    UNION ALL SELECT 'unsupported', event_id, label FROM cases WHERE label = 'DecorrelationSignal'""",
      cases="SELECT * FROM event WHERE position_id IN (SELECT position_id FROM incident)",
      kept="SELECT * FROM cases WHERE label <> 'DecorrelationSignal'", **GRAPH_VIEWS)(loaded_case)


def whole_cases(b):
    """Every event, answer and incident of the positions with an incident as case rows."""
    some = b.incident.select("position_id").distinct()
    day, large = F.to_date("event_at"), F.expr("label = 'PriceOverride' and deviation_bps >= 50")
    events = b.event.join(some, "position_id", "left_semi")
    rows = [
        events.select("event_id", F.col("label").alias("event_label"), "position_id", day.alias("date"),
                      F.when(large, day).alias("series_start"),
                      F.when(large, F.date_add(day, (F.col("consecutive_days") * 7).cast("int"))).alias("series_end")),
        b.response.join(some, "position_id", "left_semi").select(
            F.col("response_id").alias("event_id"), F.when(F.col("kind") == "Adjustment", "CorrectiveAction").otherwise(
                F.col("kind")).alias("event_label"), "position_id", day.alias("date")),
        b.incident.join(events.groupBy("position_id").agg(F.max(day).alias("date")), "position_id").select(
            F.col("incident_id").alias("event_id"), F.lit("Incident").alias("event_label"), "position_id", "date")]
    case = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    blank = {"seq": "int", "date_precision": "string", "description": "string", "actor_role": "string", "amount_usd_m": "double",
             "source": "string", "confidence": "string"}
    return case.select("*", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()]).join(
        b.position.select("position_id", "instrument_id"), "position_id")


def case_graph(b):
    nodes, edges, bad = encode_case(whole_cases(b), LABEL_RULES)
    return nodes.select(F.lit("node").alias("part"), F.col("label").alias("a"), F.col("id").alias("b"), F.col("position_id").alias("c"),
                        F.to_date("at").alias("day")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("rel_type").alias("a"), F.col("src").alias("b"), F.col("dst").alias("c"),
                     F.lit(None).cast("date").alias("day"))).unionByName(
        bad.select(F.lit("unsupported").alias("part"), F.col("event_label").alias("a"), F.col("event_id").alias("b"),
                   F.col("position_id").alias("c"), F.col("date").alias("day")))


query("encode_case_graph", """
    SELECT 'node' AS part, label AS a, id AS b, position_id AS c, (day + INTERVAL 10 YEAR)::DATE AS day FROM encoded
    UNION ALL SELECT DISTINCT 'edge', CASE label WHEN 'MethodologyChange' THEN 'CHANGED_TO' WHEN 'PriceOverride' THEN 'OVERRIDDEN_BY'
        WHEN 'PnLSignal' THEN 'GENERATED_SIGNAL' WHEN 'Control' THEN 'SUBJECT_TO_CONTROL' WHEN 'Escalation' THEN 'ESCALATED_TO'
        ELSE 'REVIEWED_BY' END, position_id, id, NULL::DATE FROM encoded WHERE label NOT IN ('Approval', 'CorrectiveAction', 'Incident')
    UNION ALL SELECT DISTINCT 'edge', 'CAUSED_BY', id, position_id, NULL FROM encoded WHERE label = 'Incident'
    UNION ALL SELECT DISTINCT 'edge', 'MITIGATED_BY', first_id, id, NULL FROM encoded JOIN (
        SELECT position_id, min(incident_id) AS first_id FROM incident JOIN lasting USING (position_id) GROUP BY 1) USING (position_id)
        WHERE label = 'CorrectiveAction'
    UNION ALL SELECT 'unsupported', label, id, position_id, day FROM told WHERE label IN ('DecorrelationSignal', 'Challenge')""",
      own="SELECT * FROM event WHERE position_id IN (SELECT position_id FROM incident)",
      lasting="SELECT position_id, max(event_at::DATE) AS day FROM own GROUP BY 1",
      told="""
        SELECT event_id AS id, label, position_id, event_at::DATE AS day FROM own WHERE label <> 'PriceOverride' OR deviation_bps < 50
        UNION ALL SELECT event_id || '-' || lpad((w + 1)::VARCHAR, 2, '0'), label, position_id, (event_at::DATE + (7 * w)::INT)
                  FROM own, range(0, 100) r(w) WHERE label = 'PriceOverride' AND deviation_bps >= 50 AND w <= consecutive_days
        UNION ALL SELECT response_id, CASE kind WHEN 'Adjustment' THEN 'CorrectiveAction' ELSE kind END, position_id, event_at::DATE
                  FROM response WHERE position_id IN (SELECT position_id FROM incident)
        UNION ALL SELECT incident_id, 'Incident', position_id, day FROM incident JOIN lasting USING (position_id)""",
      encoded="SELECT * FROM told WHERE label NOT IN ('DecorrelationSignal', 'Challenge')")(case_graph)


def declared(b):
    no = F.substring("incident_id", 5, 18).cast("bigint")
    return b.incident.groupBy("position_id").agg(F.min(no).alias("no")).select(
        "position_id", F.concat(F.lit("R1;R3;R9;R"), F.col("no") % 10 + 1).alias("rules"))


query("declared_vs_computed", """
    SELECT coalesce(d.position_id, g.position_id) AS position_id, coalesce(d.rule_id, g.rule_id) AS rule_id,
           CASE WHEN d.rule_id IS NULL THEN 'computed only' ELSE 'declared only' END AS side
    FROM said d FULL JOIN (SELECT DISTINCT position_id, rule_id FROM gap WHERE position_id IN (SELECT position_id FROM incident)) g
      ON g.position_id = d.position_id AND g.rule_id = d.rule_id WHERE d.rule_id IS NULL OR g.rule_id IS NULL""",
      said="""SELECT DISTINCT position_id, unnest(['R1', 'R3', 'R9', 'R' || (no % 10 + 1)]) AS rule_id FROM (
              SELECT position_id, min(split_part(incident_id, '-', 2)::BIGINT) AS no FROM incident GROUP BY 1)""")(
    lambda b: E.rule_set_diff(declared(b), b.gaps))


def cascade(b):
    closed = b.position.where("valid_to is not null").select(F.col("position_id").alias("id"))
    nodes, edges = E.detach(G.nodes(b), G.edges(b), closed)
    return nodes.groupBy(F.lit("node").alias("part"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        edges.groupBy(F.lit("edge").alias("part"), F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n")))


query("cascade_delete", """
    SELECT 'node' AS part, label AS name, count(*) AS n FROM node WHERE id NOT IN (SELECT position_id FROM gone) GROUP BY 2
    UNION ALL SELECT 'edge', rel_type, count(*) FROM edge
    WHERE src NOT IN (SELECT position_id FROM gone) AND dst NOT IN (SELECT position_id FROM gone) GROUP BY 2""",
      gone="SELECT position_id FROM position WHERE valid_to IS NOT NULL", **GRAPH_VIEWS)(cascade)

_PICK = """SELECT '{r}' AS rule_id, position_id, label, removed FROM cand WHERE label = '{lab}'
           AND position_id NOT IN ({taken}) ORDER BY removed DESC, position_id LIMIT 1"""
query("gap_holdout", "SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4",
      cand="""SELECT position_id, label, count(*) AS removed FROM event
              WHERE (label <> 'IPVReview' OR divergence_bps > 50) AND position_id NOT IN (SELECT position_id FROM incident) GROUP BY 1, 2""",
      **{f"h{i + 1}": _PICK.format(r=r, lab=lab, taken=" UNION ALL ".join(
          [f"SELECT position_id FROM h{j + 1}" for j in range(i)]) or "SELECT ''") for i, (r, lab) in enumerate(PLAN)})(
    lambda b: E.gap_holdout(b, PLAN, b.incident))

query("link_holdout", """
    SELECT entity_id, ra_type, ra_value FROM attribute WHERE ra_type <> 'liquidityTier' AND entity_id NOT IN (SELECT position_id FROM incident)
    ORDER BY md5('42|' || coalesce(entity_id, '') || '|' || coalesce(ra_type, '') || '|' || coalesce(ra_value, '')), entity_id, ra_type, ra_value LIMIT 6""")(lambda b: held_links(b))


def held_links(b):
    return E.link_holdout(b.attribute, b.incident.select("position_id").distinct(), 6, 42)


query("link_bridge", """
    SELECT entity_id, ra_type, ra_value FROM attribute WHERE (entity_id, ra_type, ra_value) NOT IN (
        SELECT (entity_id, ra_type, ra_value) FROM attribute WHERE ra_type <> 'liquidityTier' AND entity_id NOT IN (SELECT position_id FROM incident)
        ORDER BY md5('42|' || coalesce(entity_id, '') || '|' || coalesce(ra_type, '') || '|' || coalesce(ra_value, '')), entity_id, ra_type, ra_value LIMIT 6)""")(
    lambda b: E.without_links(b.attribute.select("entity_id", "ra_type", "ra_value"), held_links(b)))

query("id_unique_check", """
    SELECT label, id, count(*) AS n FROM (
        SELECT label, id FROM node UNION ALL SELECT 'TradeLine', l_orderkey || '-' || l_linenumber FROM lineitem)
    GROUP BY 1, 2 HAVING count(*) > 1""", **GRAPH_VIEWS)(
    lambda b: G.unique_ids(G.nodes(b).select("label", "id").unionByName(b.raw["lineitem"].select(
        F.lit("TradeLine").alias("label"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")))))
query("label_counts", "SELECT label, count(*) AS n FROM node GROUP BY 1", **GRAPH_VIEWS)(G.label_counts)
query("schema_triples", """SELECT from_label, rel_type, to_label, count(*) AS n FROM edge GROUP BY 1, 2, 3
                           ORDER BY n DESC, 1, 2, 3 LIMIT 30""", **GRAPH_VIEWS)(lambda b: G.schema_triples(G.edges(b)))
query("node_summary", """
    SELECT id, rel_type, dir, any_value(cnt) AS cnt, string_agg(caption, ', ' ORDER BY other) AS sample
    FROM (SELECT h.*, n.caption, count(*) OVER (PARTITION BY h.id, rel_type, dir) AS cnt,
                 row_number() OVER (PARTITION BY h.id, rel_type, dir ORDER BY other) AS rn
          FROM half h JOIN node n ON n.id = h.other) WHERE rn <= 4 GROUP BY 1, 2, 3""",
      half="""SELECT src AS id, rel_type, 'out' AS dir, dst AS other FROM edge UNION ALL
              SELECT dst, rel_type, 'in', src FROM edge""", **GRAPH_VIEWS)(lambda b: G.node_summary(G.edges(b), G.nodes(b)))


def sink_layers(b):
    version = V.store_layer(b, V.layer_folder(b))
    _, edges = read_layer(b.spark, V.layer_folder(b), version)
    return edges.groupBy("rel_type", "from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))


query("sink_layers", "SELECT rel_type, from_label, to_label, count(*) AS n FROM edge GROUP BY 1, 2, 3", **GRAPH_VIEWS)(sink_layers)


def scan_layers(b):
    version = V.store_layer(b, V.layer_folder(b))
    nodes, _ = read_layer(b.spark, V.layer_folder(b), version)
    return nodes.select("id", "label", "caption", "at", "sourceAt", "effectiveAt", "openedAt", "validTo", "deviationBps", "divergenceBps", "outcome")


query("scan_layers", """
    SELECT n.id, n.label, n.caption, e.event_at AS at, e.source_at AS sourceAt, e.effective_at AS effectiveAt, p.opened_at::TIMESTAMP AS openedAt,
           p.valid_to::TIMESTAMP AS validTo, e.deviation_bps AS deviationBps, e.divergence_bps AS divergenceBps, e.outcome
    FROM node n LEFT JOIN event e ON e.event_id = n.id LEFT JOIN position p ON p.position_id = n.id""", **GRAPH_VIEWS)(scan_layers)


def reset_and_load(b):
    V.store_layer(b, V.layer_folder(b))
    return V.reset_and_load(b.spark, V.layer_folder(b))


query("reset_and_load", "SELECT label, count(*) AS n FROM node GROUP BY 1", **GRAPH_VIEWS)(reset_and_load)

query("sql_views", """SELECT p.desk_id, e.label, count(*) AS n FROM event e JOIN position p USING (position_id)
                      WHERE e.event_at >= TIMESTAMP '1998-01-01' GROUP BY 1, 2""")(
    lambda b: V.sql_views(b, """
        SELECT p.desk_id, e.label, count(*) AS n FROM event e JOIN position p USING (position_id)
        WHERE e.event_at >= CAST(:start AS TIMESTAMP_NTZ) GROUP BY 1, 2""", start="1998-01-01 00:00:00"))
