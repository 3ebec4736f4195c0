"""Registered queries: approval communities, trajectories, nearest neighbours, decorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import AS_OF
from ..operators import communities as C
from ..operators import decorrelation as D
from ..operators import events as E
from ..operators import fastpath as FP
from ..operators import knn as K
from ..operators import rules as R
from . import prelude
from .events import PLAN
from .registry import query

P = FP.Params()
THRESHOLD = 0.45   # fixed value: correlation below which a position has left its peers
TOP = 10

# ---- approval communities ------------------------------------------------------------------

VIEWS = {
    "approved": """SELECT a.person_id AS approver, e.performer_id AS author, count(*) AS weight FROM approvals a
                   JOIN event e ON e.event_id = a.source_event_id WHERE e.label = 'PriceOverride' AND a.person_id <> e.performer_id
                   GROUP BY 1, 2""",
    "flagged": """SELECT person_id, control OR regexp_matches(role, '(ipv|product control|risk|controller|vcg|map|model)', 'i') AS independent
                  FROM person LEFT JOIN desk USING (desk_id)""",
}


def q(name, oracle=None, **views):
    return query(name, oracle, **{**VIEWS, **views})


def weighted(b):
    return C.approval_edges(b).select(F.col("approver").alias("a"), F.col("author").alias("b"), F.col("weight").alias("w"))


def by_role(b):
    return b.person.select(F.col("person_id").alias("node"), F.col("role").alias("community"))


q("approval_edges", "SELECT * FROM approved")(C.approval_edges)
q("independence_flag", "SELECT * FROM flagged")(C.independence_flag)
q("circle_rollup", """
    SELECT role AS community, count(*) AS size, count(DISTINCT desk_id) AS desks, coalesce(bool_or(independent), FALSE) AS has_independent
    FROM person JOIN flagged USING (person_id) GROUP BY 1""")(lambda b: C.circle_rollup(b, by_role(b)))
q("modularity", """
    SELECT round(sum(inside) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) AS q FROM (
        SELECT x.role, sum(weight)::DOUBLE AS k, coalesce(sum(weight) FILTER (x.role = y.role), 0)::DOUBLE AS inside
        FROM (SELECT approver AS s, author AS t, weight FROM approved UNION ALL SELECT author, approver, weight FROM approved)
        JOIN person x ON x.person_id = s JOIN person y ON y.person_id = t GROUP BY 1)""")(
    lambda b: C.modularity(weighted(b), by_role(b)))

def circles(b):
    return b.once("circles", lambda: C.louvain(weighted(b)))


q("louvain")(circles)
q("approval_circles")(lambda b: C.circle_rollup(b, circles(b)))

# ---- trajectories --------------------------------------------------------------------------

_NEAREST = "(SELECT arg_min(i, (abs(i * 91.25 - elapsed), i)) FROM range(0, 5) r(i))"
TRAJ = {
    "traj": f"""
        SELECT c.position_id, c.event_id, floor(epoch(as_of - c.event_at) / 86400) AS elapsed,
               list_distinct(list_filter([c.label, r.role, p.desk_id], lambda x: x IS NOT NULL)) AS atoms
        FROM chronology c CROSS JOIN clock JOIN position p ON p.position_id = c.position_id LEFT JOIN person r ON r.person_id = c.person_id
        WHERE c.label IN ('MethodologyChange', 'PriceOverride', 'Escalation', 'PnLSignal', 'Approval')
          AND c.event_at < as_of AND c.event_at >= as_of - INTERVAL 365 DAY
        UNION ALL
        SELECT position_id, gap_id, floor(epoch(as_of - due_by) / 86400), [rule_id] FROM gap CROSS JOIN clock
        WHERE due_by < as_of AND due_by >= as_of - INTERVAL 365 DAY""",
    "atom": "SELECT atom, row_number() OVER (ORDER BY atom) - 1 AS atom_no FROM (SELECT DISTINCT unnest(atoms) AS atom FROM traj)",
    "smooth": f"""
        SELECT *, raw / sum(raw) OVER (PARTITION BY event_id) AS w FROM (
            SELECT position_id, event_id, elapsed, atoms, gi, exp(-0.02 * abs(gi * 91.25 - elapsed)) AS raw
            FROM (SELECT *, {_NEAREST} AS near FROM traj) CROSS JOIN range(0, 5) g(gi) WHERE abs(gi - near) <= 1)""",
    "cell": "SELECT position_id, event_id, elapsed, unnest(atoms) AS atom, gi, w AS v FROM smooth",
    "embedded": """SELECT position_id, atom, gi, sum(exp(-0.005 * elapsed) * v) AS v FROM cell
                   WHERE elapsed > 0 AND elapsed <= 365 GROUP BY 1, 2, 3""",
    "norms": "SELECT position_id, sqrt(sum(v * v)) AS n FROM embedded GROUP BY 1",
    "cosines": """
        SELECT x.position_id AS a, y.position_id AS b, round(sum(x.v * y.v) / any_value(nx.n * ny.n), 9) AS similarity
        FROM embedded x JOIN embedded y ON y.atom = x.atom AND y.gi = x.gi AND y.position_id <> x.position_id
        JOIN norms nx ON nx.position_id = x.position_id JOIN norms ny ON ny.position_id = y.position_id GROUP BY 1, 2""",
    "shortlist": "SELECT * FROM cosines QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) <= 10",
    "cross": """
        SELECT s.a, s.b, c.atom, c.gi, coalesce(max(c.v) FILTER (c.position_id = s.a), 0) AS va,
               coalesce(max(c.v) FILTER (c.position_id = s.b), 0) AS vb
        FROM shortlist s JOIN embedded c ON c.position_id IN (s.a, s.b) GROUP BY 1, 2, 3, 4""",
    "reranked": """SELECT a, b, round(any_value(similarity), 4) AS cosine, round(sqrt(sum((va - vb) * (va - vb))), 4) AS euclid
                   FROM cross_ JOIN shortlist USING (a, b) GROUP BY 1, 2""",
    "rich": """SELECT position_id FROM gap CROSS JOIN clock WHERE rule_id IN ('R3', 'R5', 'R8') AND due_by < as_of
               AND due_by >= as_of - INTERVAL 365 DAY GROUP BY 1 HAVING count(*) >= 2""",
}
TRAJ["cross_"] = TRAJ.pop("cross")


def tq(name, oracle=None, **views):
    return query(name, oracle, **{**TRAJ, **views})


def traj(b):
    return FP.trajectory_events(b, b.gaps, P)


def embedding(b):
    return b.once("embedding", lambda: FP.fp_embedding(traj(b), P))


def atoms(b):
    return FP.trajectory_atoms(traj(b))


def shortlist(b):
    return b.once("shortlist", lambda: K.knn(FP.dense(embedding(b), atoms(b), P), TOP))


def spans(b):
    """Days between first and last event of every position."""
    return b.event.groupBy("position_id").agg(F.date_diff(F.max("event_at"), F.min("event_at")).cast("double").alias("theta"))


def basis(b):
    """A four-dimensional basis for the data's atoms: small whole-number halves."""
    cells = atoms(b).select("atom", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("gi")).select(
        "atom", "gi", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return cells.withColumn("v", ((F.length("atom") * 7 + F.col("gi") * 3 + F.col("k")) % 5 - 2) / 2.0)


tq("trajectory_events", "SELECT position_id, event_id, elapsed, array_to_string(list_sort(atoms), ',') AS atoms FROM traj")(
    lambda b: traj(b).withColumn("atoms", F.array_join(F.array_sort("atoms"), ",")))
tq("trajectory_atoms", "SELECT * FROM atom")(atoms)
query("fp_grid", """
    SELECT position_id, theta, gi, round(gi * (theta / 4), 6) AS tau FROM (
        SELECT position_id, date_diff('day', min(event_at)::DATE, max(event_at)::DATE)::DOUBLE AS theta FROM event GROUP BY 1), range(0, 5) g(gi)""")(
    lambda b: FP.fp_grid(spans(b), P).withColumn("tau", F.round("tau", 6)))
tq("fp_smoothing", "SELECT event_id, gi, round(w, 6) AS w FROM smooth")(
    lambda b: FP.fp_smoothing(traj(b), P).select("event_id", "gi", F.round("w", 6).alias("w")))
tq("fp_event_embedding", "SELECT event_id, atom, gi, round(v, 6) AS v FROM cell")(
    lambda b: FP.fp_event_embedding(traj(b), P).select("event_id", "atom", "gi", F.round("v", 6).alias("v")))
tq("fp_embedding", "SELECT position_id, atom, gi, round(v, 6) AS v FROM embedded")(
    lambda b: embedding(b).withColumn("v", F.round("v", 6)))
tq("fp_identity_basis", "SELECT atom, gi, atom_no * 5 + gi AS k FROM atom, range(0, 5) g(gi)")(
    lambda b: FP.fp_identity_basis(atoms(b), P))
tq("fp_dimension_name", "SELECT atom_no * 5 + gi AS k, atom, gi FROM atom, range(0, 5) g(gi)")(
    lambda b: FP.fp_dimension_name(FP.fp_identity_basis(atoms(b), P).select("k"), atoms(b), P))
tq("fp_given_basis", """
    SELECT position_id, k, round(sum(v * ((length(atom) * 7 + gi * 3 + k) % 5 - 2) / 2.0), 6) AS v
    FROM embedded, range(0, 4) d(k) GROUP BY 1, 2""")(
    lambda b: FP.fp_given_basis(embedding(b), basis(b)).withColumn("v", F.round("v", 6)))
tq("fp_random_basis", f"""
    SELECT atom, gi, k, CASE WHEN u < 1 / 6.0 THEN 1.0 WHEN u < 1 / 3.0 THEN -1.0 ELSE 0.0 END::DOUBLE AS v FROM (
        SELECT atom, gi, k, ('0x' || substr(md5('42|' || atom || '|' || gi || '|' || k), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE AS u
        FROM atom, range(0, 5) g(gi), range(0, 16) d(k))""")(lambda b: FP.fp_random_basis(atoms(b), 16, 42, P))
tq("trajectory_write", "SELECT position_id, count(*) AS dimensions, round(sqrt(sum(v * v)), 6) AS norm FROM embedded GROUP BY 1")(
    lambda b: FP.trajectory_write(embedding(b)))

query("knn_cosine", """
    SELECT a, b, round(similarity, 4) AS similarity FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) <= 10""",
      sims="""SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS similarity
              FROM embeddings x JOIN embeddings y ON y.vec_id <> x.vec_id""")(
    lambda b: K.knn(b.raw["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), TOP)
    .withColumn("similarity", F.round("similarity", 4)))
tq("trajectory_shortlist", "SELECT a, b, round(similarity, 4) AS similarity FROM shortlist")(
    lambda b: shortlist(b).withColumn("similarity", F.round("similarity", 4)))
tq("euclid_rerank", "SELECT * FROM reranked")(lambda b: FP.euclid_rerank(shortlist(b), embedding(b)))
tq("top_dimensions", """
    SELECT a, b, rank, atom, gi, round(vb, 6) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(va * vb, 9) DESC, atom, gi) AS rank FROM cross_
        WHERE round(va * vb, 9) > 0) WHERE rank <= 3""")(lambda b: FP.top_dimensions(shortlist(b), embedding(b)))
tq("fingerprint_heat", """
    SELECT e.position_id, rank, e.atom, gi, round(v, 6) AS cell FROM embedded e JOIN (
        SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY peak DESC, atom) AS rank FROM (
            SELECT position_id, atom, round(max(v), 9) AS peak FROM embedded GROUP BY 1, 2) WHERE peak > 1e-9) p
    ON p.position_id = e.position_id AND p.atom = e.atom WHERE rank <= 12""")(lambda b: FP.fingerprint_heat(embedding(b)))
tq("gap_rich", "SELECT position_id FROM rich")(lambda b: FP.gap_rich(b.gaps, b.as_of, P))


def evaluation(b):
    """Neighbours and gaps of the book from which the held-out events are gone."""
    held = b.once("gap_holdout", lambda: E.gap_holdout(b, PLAN, b.incident))
    rest = E.without_holdout(b, held)
    return FP.retrieval_eval(shortlist(rest), FP.gap_rich(rest.gaps, rest.as_of, P), embedding(rest), held)


_HOLDOUT = {name: text for name, text in (
    ("full_event", prelude.VIEWS["event"]),
    ("event", """SELECT * FROM full_event WHERE event_id NOT IN (SELECT event_id FROM held_event)"""),
    ("full_response", prelude.VIEWS["response"].replace("JOIN event e", "JOIN full_event e")),
    ("response", """SELECT * REPLACE (CASE WHEN source_event_id NOT IN (SELECT event_id FROM held_event) THEN source_event_id END AS source_event_id,
                        CASE WHEN source_event_id NOT IN (SELECT event_id FROM held_event) THEN source_label END AS source_label) FROM full_response"""),
    ("held_event", """SELECT e.event_id FROM full_event e JOIN taken t ON t.position_id = e.position_id AND t.label = e.label
                      WHERE e.label <> 'IPVReview' OR divergence_bps > 50"""),
    ("taken", """SELECT position_id, 'PriceOverride' AS label FROM h1 UNION ALL SELECT position_id, 'PriceOverride' FROM h2
                 UNION ALL SELECT position_id, 'IPVReview' FROM h3 UNION ALL SELECT position_id, 'PnLSignal' FROM h4"""),
    ("cand", """SELECT position_id, label, count(*) AS removed FROM full_event
                WHERE (label <> 'IPVReview' OR divergence_bps > 50) AND position_id NOT IN (SELECT position_id FROM incident) GROUP BY 1, 2"""),
    ("h1", "SELECT position_id FROM cand WHERE label = 'PriceOverride' ORDER BY removed DESC, position_id LIMIT 1"),
    ("h2", """SELECT position_id FROM cand WHERE label = 'PriceOverride' AND position_id NOT IN (SELECT position_id FROM h1)
              ORDER BY removed DESC, position_id LIMIT 1"""),
    ("h3", """SELECT position_id FROM cand WHERE label = 'IPVReview' AND position_id NOT IN (SELECT position_id FROM h1 UNION ALL
              SELECT position_id FROM h2) ORDER BY removed DESC, position_id LIMIT 1"""),
    ("h4", """SELECT position_id FROM cand WHERE label = 'PnLSignal' AND position_id NOT IN (SELECT position_id FROM h1 UNION ALL
              SELECT position_id FROM h2 UNION ALL SELECT position_id FROM h3) ORDER BY removed DESC, position_id LIMIT 1"""),
    ("held_out", """SELECT position_id FROM h1 UNION ALL SELECT position_id FROM h2 UNION ALL SELECT position_id FROM h3
                    UNION ALL SELECT position_id FROM h4"""))}
tq("retrieval_eval", """
    SELECT a AS reference, count(*) FILTER (b IN (SELECT position_id FROM rich)) AS enriched, count(*) AS neighbors,
           round((SELECT count(*) FROM rich) / (SELECT count(*) FROM norms), 6) AS pop_share,
           count(*) FILTER (b IN (SELECT position_id FROM rich)) / count(*)
             > (SELECT count(*) FROM rich) / (SELECT count(*) FROM norms) * 1.5 AS verdict,
           count(*) FILTER (b IN (SELECT position_id FROM held_out)) AS holdout_hits FROM shortlist GROUP BY 1""", **_HOLDOUT)(evaluation)
tq("watchlist", f"""
    SELECT b AS position_id, 'trajectory similar to ' || a || ' as of {AS_OF}' AS reason, 'Trajectories' AS panel, a AS reference,
           '{AS_OF}' AS as_of
    FROM reranked QUALIFY row_number() OVER (PARTITION BY b ORDER BY euclid, a) = 1""")(
    lambda b: FP.watchlist(FP.euclid_rerank(shortlist(b), embedding(b)), b.as_of))

# ---- peer decorrelation --------------------------------------------------------------------

MARKS = {
    "seen": "SELECT mark.* FROM mark CROSS JOIN clock WHERE day <= as_of",
    "returned": """SELECT position_id, day, ln(clean / prev) AS ret FROM (
                   SELECT *, lag(clean) OVER (PARTITION BY position_id ORDER BY day) AS prev FROM seen) WHERE prev > 0 AND clean > 0""",
    "grouped": """SELECT entity_id AS position_id, string_agg('|' || ra_value, '' ORDER BY ra_type) AS grp FROM attribute
                  WHERE ra_type IN ('liquidityTier', 'methodologyFamily') GROUP BY 1""",
    "paired": """
        SELECT position_id, grp, day, ret, n - 1 AS peers, CASE WHEN n - 1 >= 3 THEN (s - ret) / (n - 1) END AS peer_ret
        FROM (SELECT position_id, grp, day, ret, count(*) OVER w AS n, sum(ret) OVER w AS s
              FROM returned JOIN grouped USING (position_id) WINDOW w AS (PARTITION BY grp, day))""",
    "rolled": """
        SELECT position_id, grp, day, np = 8 AS evaluable, CASE WHEN np = 8 THEN round(
               CASE WHEN sx <= 0 OR sy <= 0 THEN 0.0 ELSE c END, 9) END AS corr
        FROM (SELECT *, count(*) OVER w AS n, count(peer_ret) OVER w AS np, corr(ret, peer_ret) OVER w AS c,
                     var_pop(ret) OVER w AS sx, var_pop(peer_ret) OVER w AS sy FROM paired
              WINDOW w AS (PARTITION BY position_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE n = 8""",
    "signal": f"""
        SELECT position_id, day, round(corr, 4) AS correlation, grp AS peer_group FROM (
            SELECT *, count(*) OVER (PARTITION BY position_id, island) AS len FROM (
                SELECT *, sum(CASE WHEN corr < {THRESHOLD} THEN 0 ELSE 1 END) OVER (PARTITION BY position_id ORDER BY day) AS island FROM rolled)
            WHERE corr < {THRESHOLD}) WHERE len >= 2
        QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY day) = 1""",
    "grid_no": "SELECT day, row_number() OVER (ORDER BY day DESC) AS no FROM (SELECT DISTINCT day FROM seen)",
    "vector": """SELECT position_id AS id, list(ret ORDER BY day) AS v FROM (
                 SELECT m.position_id, m.day, ln(m.clean / p.clean) AS ret FROM seen m JOIN grid_no g ON g.day = m.day AND g.no <= 8
                 JOIN grid_no h ON h.no = g.no + 1 JOIN seen p ON p.day = h.day AND p.position_id = m.position_id
                 WHERE m.clean > 0 AND p.clean > 0) GROUP BY 1 HAVING count(*) = 8""",
    "pearsons": """SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(list_transform(x.v, lambda e: e - list_avg(x.v)),
                   list_transform(y.v, lambda e: e - list_avg(y.v))), 9) AS similarity FROM vector x JOIN vector y ON y.id <> x.id""",
}


def mq(name, oracle=None, **views):
    return query(name, oracle, **{**MARKS, **views})


def marks(b):
    """Marks known at the book's clock."""
    return b.mark.where(F.col("day") <= F.lit(b.as_of).cast("date"))


def paired(b):
    return D.peer_mean(D.mark_returns(marks(b)), D.peer_groups(b.attribute))


def signals(b):
    return b.once("signals", lambda: D.decorr_signals(D.rolling_pearson(paired(b)), THRESHOLD))


def correlated(b):
    return b.once("pearson", lambda: K.knn(D.return_vectors(marks(b)), TOP, "pearson"))


def clusters(b):
    return b.once("clusters", lambda: D.behaviour_clusters(C.louvain(D.correlation_edges(correlated(b)))))


mq("mark_returns", "SELECT position_id, day, round(ret, 6) AS ret FROM returned")(
    lambda b: D.mark_returns(marks(b)).withColumn("ret", F.round("ret", 6)))
mq("peer_groups", "SELECT * FROM grouped")(lambda b: D.peer_groups(b.attribute))
mq("peer_mean", "SELECT position_id, day, peers, round(peer_ret, 6) AS peer_ret FROM paired")(
    lambda b: paired(b).select("position_id", "day", "peers", F.round("peer_ret", 6).alias("peer_ret")))
mq("rolling_pearson", "SELECT position_id, day, evaluable, round(corr, 4) AS corr FROM rolled")(
    lambda b: D.rolling_pearson(paired(b)).select("position_id", "day", "evaluable", F.round("corr", 4).alias("corr")))
mq("decorr_signals", "SELECT * FROM signal")(signals)
mq("signal_events", """SELECT 'DS-' || position_id AS event_id, 'DecorrelationSignal' AS label, position_id, day + INTERVAL 17 HOUR AS event_at
                       FROM signal""")(lambda b: D.signal_events(signals(b)))
mq("signals_verdict", """
    SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM event c JOIN approvals a ON a.source_event_id = c.event_id
                         WHERE c.position_id = s.position_id AND c.label = 'MethodologyChange'
                           AND a.event_at <= coalesce(c.effective_at, c.event_at)
                           AND coalesce(c.effective_at, c.event_at) BETWEEN s.day + INTERVAL 17 HOUR - INTERVAL 30 DAY
                               AND s.day + INTERVAL 17 HOUR + INTERVAL 30 DAY)
                      OR EXISTS (SELECT 1 FROM event v WHERE v.position_id = s.position_id AND v.label = 'IPVReview'
                         AND v.event_at BETWEEN s.day + INTERVAL 17 HOUR AND s.day + INTERVAL 17 HOUR + INTERVAL 30 DAY
                         AND (v.outcome IN ('adjusted', 'challenged', 'explained') OR EXISTS (
                              SELECT 1 FROM response r WHERE r.source_event_id = v.event_id AND r.kind = 'Adjustment'))) THEN 'MET'
                    WHEN s.day + INTERVAL 17 HOUR + INTERVAL 30 DAY > as_of THEN 'PENDING' ELSE 'MISSED' END AS status
    FROM signal s, clock""")(
    lambda b: D.signals_verdict(signals(b), R.one_rule(D.with_signals(b, signals(b)), R.rule_r10)))
mq("return_vectors", "SELECT id, i AS no, round(v[i], 6) AS ret FROM vector, range(1, 9) r(i)")(
    lambda b: D.return_vectors(marks(b)).select("id", F.posexplode("v").alias("no", "ret")).select(
        "id", (F.col("no") + 1).alias("no"), F.round("ret", 6).alias("ret")))
mq("knn_pearson", """SELECT a, b, round(similarity, 4) AS similarity FROM pearsons
                     QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) <= 10""")(
    lambda b: correlated(b).withColumn("similarity", F.round("similarity", 4)))
mq("behaviour_clusters")(clusters)
mq("cluster_attributes")(lambda b: D.cluster_attributes(b.attribute, clusters(b)))


def reset_counts(b):
    """What is left, per table, once everything derived by the discovery tier is removed."""
    grown = D.with_signals(b, signals(b)).with_(attribute=D.cluster_attributes(b.attribute, clusters(b)))
    clean = D.discovery_reset(grown)
    return clean.event.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        clean.attribute.groupBy(F.col("ra_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))).unionByName(
        R.rule_table(clean).select(F.col("rule_id").alias("name"), F.lit(1).cast("bigint").alias("n")))


mq("discovery_reset", """
    SELECT label AS name, count(*) AS n FROM event WHERE label <> 'DecorrelationSignal' GROUP BY 1
    UNION ALL SELECT ra_type, count(*) FROM attribute GROUP BY 1
    UNION ALL SELECT rule_id, 1 FROM obligation WHERE rule_id <> 'R10'""")(reset_counts)
