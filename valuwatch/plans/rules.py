"""Registered queries: rule branches and their evaluation."""

from __future__ import annotations

import uuid
from dataclasses import replace

from ..model import DEFAULT_RULES
from ..operators import rules as R
from ..operators.refresh import refresh_gaps
from ..session import scratch_dir
from .prelude import GAP_SQL, obligation_values
from .registry import query

for _name, _branch, _view in (
    ("rule_r1_preapproval", R.rule_r1, "r1"), ("rule_r2_post_ipv", R.rule_r2, "r2"),
    ("rule_r3_override", R.rule_r3, "r3"), ("rule_r4_recurring", R.rule_r4, "r4"),
    ("rule_r5_ipv_divergence", R.rule_r5, "r5"), ("rule_r6_unexplained_pnl", R.rule_r6, "r6"),
    ("rule_r7a_periodic", R.rule_r7a, "r7a"), ("rule_r7b_regime", R.rule_r7b, "r7b"),
    ("rule_r8_segregation", R.rule_r8, "r8"), ("rule_r9_evidence", R.rule_r9, "r9"),
    ("rule_r10_decorrelation", R.rule_r10, "r10"),
):
    query(_name, f"SELECT {GAP_SQL} FROM {_view}")(lambda b, f=_branch: R.one_rule(b, f))

query("expected_controls", "SELECT * FROM controls")(R.expected_controls)
query("governance_gaps", "SELECT * FROM controls WHERE status IN ('MISSED', 'LATE')")(
    lambda b: R.governance_gaps(b.controls))
query("gap_materialise", "SELECT * FROM gap")(R.gap_materialise)


def _edited(rules):
    return tuple(replace(r, divergence_bps=80) if r.rule_id == "R5" else r for r in rules)


def gap_refresh(b):
    """Gaps stored under the book's rules, then read again under an edit of one of them."""
    folder = f"{scratch_dir(b.spark)}/gap-store-{uuid.uuid4().hex[:8]}"
    refresh_gaps(b, folder)
    return refresh_gaps(b.with_(rules=_edited(b.rules)), folder)[0]


query("gap_refresh", "SELECT * FROM gap", obligation=obligation_values(_edited(DEFAULT_RULES)))(gap_refresh)

_SUMMARY = """
    SELECT o.rule_id, any_value(o.rule_name) AS rule_name,
           count(*) FILTER (c.status = 'MET') AS met, count(*) FILTER (c.status = 'LATE') AS late,
           count(*) FILTER (c.status = 'MISSED') AS missed, count(*) FILTER (c.status = 'PENDING') AS pending
    FROM obligation o LEFT JOIN controls c ON c.rule_id = o.rule_id GROUP BY o.rule_id"""
query("gap_summary", _SUMMARY)(lambda b: R.gap_summary(b, b.controls))
