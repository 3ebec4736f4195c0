"""Registered queries: shaped payloads, run rollup and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenarios as S
from ..operators import shape as X
from ..operators import text as T
from .registry import query
from .scenarios import VIEWS as SCENARIO_VIEWS

VIEWS = {
    **SCENARIO_VIEWS,
    "tl": """SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY event_at, event_id) AS n FROM chained
             WHERE label <> 'Mark' QUALIFY n <= 60""",
    "ct": """SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY trigger_at, rule_id, trigger_event_id,
             observed_event_id NULLS FIRST) - 1 AS i FROM controls QUALIFY i < 60""",
    "ct_event": "SELECT * FROM ct WHERE trigger_event_id <> position_id",
    "ct_seen": "SELECT position_id, trigger_event_id, min(i) AS i, arg_min(trigger_label, i) AS label FROM ct_event GROUP BY 1, 2",
    "ap": """SELECT a.source_event_id AS ev, a.response_id AS ap, r.name AS who, r.role, r.desk_id AS dk FROM approvals a
             LEFT JOIN person r USING (person_id)""",
    "nm": """SELECT position_id, rules, k FROM gap_rules WHERE k >= 2 AND position_id NOT IN (SELECT position_id FROM incident)
             ORDER BY k DESC, position_id LIMIT 15""",
    "nmr": "SELECT position_id, unnest(string_split(rules, ',')) AS rule FROM nm",
}
N = "NULL AS from_id, NULL AS to_id"


def q(name, oracle=None, **views):
    return query(name, oracle, **{**VIEWS, **views})


q("graph_timeline", f"""
    SELECT 'node' AS part, position_id AS owner, position_id AS id, 'Position' AS kind, position_id AS caption, {N}, -1 AS ord
    FROM (SELECT DISTINCT position_id FROM tl)
    UNION ALL SELECT 'node', position_id, event_id, label, label || ' ' || strftime(event_at, '%Y-%m-%d'), NULL, NULL, n - 1 FROM tl
    UNION ALL SELECT 'rel', position_id, 'pos-first', 'FIRST_EVENT', NULL, position_id, event_id, NULL FROM tl WHERE n = 1
    UNION ALL SELECT 'rel', z.position_id, 'next-' || (z.n - 2), 'NEXT', NULL, a.event_id, z.event_id, NULL
              FROM tl z JOIN tl a ON a.position_id = z.position_id AND a.n = z.n - 1""")(lambda b: X.graph_timeline(S.timeline(b)))
q("graph_controls", f"""
    SELECT 'node' AS part, position_id AS owner, position_id AS id, 'Position' AS kind, position_id AS caption, {N}, NULL AS ord
    FROM (SELECT DISTINCT position_id FROM ct)
    UNION ALL SELECT DISTINCT 'node', position_id, rule_id, 'ControlObligation', rule_id || ' ' || rule_name, NULL, NULL, NULL FROM ct
    UNION ALL SELECT 'node', position_id, trigger_event_id, label, trigger_event_id, NULL, NULL, NULL FROM ct_seen
    UNION ALL SELECT 'rel', position_id, 't-' || i, 'HAS_EVENT', NULL, position_id, trigger_event_id, NULL FROM ct_seen
    UNION ALL SELECT 'rel', position_id, 's-' || i, status, NULL, trigger_event_id, rule_id, NULL FROM ct_event""")(
    lambda b: X.graph_controls(b.controls))
q("graph_approvals", f"""
    SELECT 'node' AS part, ev AS owner, ev AS id, 'Event' AS kind, ev AS caption, {N}, NULL AS ord FROM (SELECT DISTINCT ev FROM ap)
    UNION ALL SELECT 'node', ev, ap, 'Approval', ap, NULL, NULL, NULL FROM ap
    UNION ALL SELECT DISTINCT 'node', ev, who, 'Person', who || ' (' || coalesce(role, '?') || ')', NULL, NULL, NULL FROM ap WHERE who IS NOT NULL
    UNION ALL SELECT DISTINCT 'node', ev, dk, 'Desk', dk, NULL, NULL, NULL FROM ap WHERE who IS NOT NULL AND dk IS NOT NULL
    UNION ALL SELECT 'rel', ev, 'a-' || ap, 'APPROVED_BY', NULL, ev, ap, NULL FROM ap
    UNION ALL SELECT 'rel', ev, 'p-' || ap, 'APPROVED_BY', NULL, ap, who, NULL FROM ap WHERE who IS NOT NULL
    UNION ALL SELECT 'rel', ev, 'd-' || ap, 'ON_DESK', NULL, who, dk, NULL FROM ap WHERE who IS NOT NULL AND dk IS NOT NULL""")(
    lambda b: X.graph_approvals(S.who_approved(b)))
q("graph_read_across", f"""
    SELECT 'node' AS part, 'all' AS owner, position_id AS id, 'Position' AS kind, position_id AS caption, {N}, NULL AS ord FROM nm
    UNION ALL SELECT DISTINCT 'node', 'all', rule, 'GovernanceGap', rule, NULL, NULL, NULL FROM nmr
    UNION ALL SELECT 'rel', 'all', position_id || '-' || rule, 'HAS_GAP', NULL, position_id, rule, NULL FROM nmr""")(
    lambda b: X.graph_read_across(S.near_misses(b, b.gaps)))


def log(b):
    """The event stream as a query log: clicks are ungrouped entries."""
    return b.raw["events"].select(
        F.col("user_id").alias("owner"), F.col("ts").alias("at"), F.col("event_id").alias("entry_id"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("label"), F.col("value").alias("ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("rows"), (F.col("event_type") == "error").alias("error"))


query("run_rollup", """
    SELECT user_id AS owner, run_id, max(label) AS label, count(*) AS entries, round(sum(value), 2) AS total_ms,
           sum((props ->> '$.k')::BIGINT)::BIGINT AS total_rows, bool_or(event_type = 'error') AS has_error
    FROM (SELECT *, sum(CASE WHEN label = before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run_id
          FROM (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
                FROM (SELECT *, CASE WHEN event_type <> 'click' THEN event_type END AS label FROM events)))
    GROUP BY 1, 2""")(lambda b: X.run_rollup(log(b)))


def texts(b):
    """Descriptions of the chronology and whole documents."""
    return b.chronology.select(F.col("event_id").alias("text_id"), F.col("description").alias("text")).unionByName(
        b.raw["documents"].select(F.concat(F.lit("DOC-"), "doc_id").alias("text_id"), "text"))


q("mention_ids", f"""
    SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY first_at) - 1 AS pos, id FROM (
        SELECT text_id, id, min(i) AS first_at FROM (
            SELECT text_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM (
                SELECT text_id, regexp_extract_all(text, '{T.ID_PATTERN}') AS ids FROM (
                    SELECT event_id AS text_id, description AS text FROM chronology
                    UNION ALL SELECT 'DOC-' || doc_id, text FROM documents))) GROUP BY 1, 2)""")(lambda b: T.mention_ids(texts(b)))


def terms(b):
    """A glossary drawn from the benchmark table: whole items, each known by its first three words as well."""
    return b.raw["benchmark"].select(F.col("text").alias("term"), F.array(F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).alias("aliases"))


query("glossary_tag", r"""
    WITH RECURSIVE spelled AS (SELECT text AS term, 0 AS alt, text AS s FROM benchmark
        UNION ALL SELECT text, 1, array_to_string(string_split(text, ' ')[1:3], ' ') FROM benchmark),
    line AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS para FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    hit AS (SELECT doc_id, para, term, alt, length(s) AS n, unnest(list_filter(range(1, (length(l) - length(s) + 2)::INT),
                lambda i: lower(substr(l, i::INT, length(s)::INT)) = lower(s))) AS i, l
            FROM line JOIN (SELECT term, s, min(alt) AS alt FROM spelled GROUP BY 1, 2) ON contains(lower(l), lower(s))),
    free AS (SELECT doc_id, para, i - 1 AS start, term, arg_min(n, alt) AS n FROM hit
             WHERE (i = 1 OR NOT regexp_matches(substr(l, (i - 1)::INT, 1), '[A-Za-z0-9_&]')) AND NOT regexp_matches(substr(l, (i + n)::INT, 1), '[A-Za-z0-9_&]')
             GROUP BY 1, 2, 3, 4),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para, start, n DESC, term) AS k FROM free),
    fold AS (SELECT doc_id, 0::BIGINT AS k, -1::BIGINT AS para, 0::BIGINT AS upto, []::VARCHAR[] AS seen, NULL::VARCHAR AS term, 0::BIGINT AS start, 0::BIGINT AS n
             FROM (SELECT DISTINCT doc_id FROM ordered)
             UNION ALL
             SELECT o.doc_id, o.k, CASE WHEN t THEN o.para ELSE f.para END, CASE WHEN t THEN o.start + o.n ELSE f.upto END,
                    CASE WHEN t THEN list_append(f.seen, o.term) ELSE f.seen END, CASE WHEN t THEN o.term END, o.start, o.n
             FROM (SELECT f.*, o.k AS k2, (o.para > f.para OR o.start >= f.upto) AND NOT list_contains(f.seen, o.term) AS t
                   FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.k = f.k + 1) f
             JOIN ordered o ON o.doc_id = f.doc_id AND o.k = f.k2)
    SELECT doc_id AS text_id, para, term, start, n AS length FROM fold WHERE term IS NOT NULL""", raw=True)(
    lambda b: T.glossary_tag(b.raw["documents"].select(F.col("doc_id").alias("text_id"), "text"), terms(b)))

CHANGE, OVERRIDE, REVIEW, RULES = (("marking",), ("the", "le ")), (("and", "et "),), (("upheld", "vcg"), ("of", "de "), ("a",)), ("th", "er", "on", "re")


def _sql_first(needles):
    parts = [f"nullif(instr(t, '{n}'), 0)" for n in needles]
    return parts[0] if len(parts) == 1 else f"least({', '.join(parts)})"


def _sql_tiers(tiers):
    return f"coalesce({', '.join(map(_sql_first, tiers))})"


query("chronology_grade", f"""
    SELECT text_id, reason = 'ok' AS passed, reason FROM (
        SELECT text_id, CASE WHEN c IS NULL THEN 'no change' WHEN o IS NULL THEN 'no override' WHEN r IS NULL THEN 'no review'
               WHEN c >= r THEN 'order' WHEN n < 2 THEN 'rules' ELSE 'ok' END AS reason
        FROM (SELECT text_id, {_sql_tiers(CHANGE)} AS c, {_sql_tiers(OVERRIDE)} AS o, {_sql_tiers(REVIEW)} AS r,
                     {' + '.join(f"contains(t, '{x}')::INT" for x in RULES)} AS n
              FROM (SELECT conv_id || '/' || turn AS text_id, lower(text) AS t FROM conversations)))""")(
    lambda b: T.chronology_grade(b.raw["conversations"].select(F.concat_ws("/", "conv_id", "turn").alias("text_id"), "text"),
                                 CHANGE, OVERRIDE, REVIEW, RULES))
