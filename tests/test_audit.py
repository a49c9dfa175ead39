"""State, history and audit of decisions."""

import datetime
import json

from orelink.operators import audit as A
from orelink.operators import uom as U

T = datetime.datetime(2024, 1, 1)


def test_rules_and_their_trail(spark):
    rules = spark.createDataFrame([(1, "PENDING", "SET", "EA", 4), (2, "APPROVED", "KG", "G", 1000), (3, "REJECTED", "L", "ML", 1000)], "rule_id long, status string, from_uom string, to_uom string, factor long")
    asked = [(10, 1, "APPROVED", 7, T), (9, 1, "DISABLED", 7, T), (11, 1, "REJECTED", 8, T), (12, 2, "DISABLED", 7, T), (13, 3, "APPROVED", 7, T), (14, 99, "APPROVED", 7, T), (15, 2, None, 7, T)]
    decided = A.decided_rules(rules, spark.createDataFrame(asked, "request_id long, rule_id long, to_status string, actor long, ts timestamp"))
    got = {r.request_id: (r.outcome, r.action, r.status) for r in decided.collect()}
    assert got == {
        9: ("not_allowed", None, "PENDING"), 10: ("decided", "APPROVE", "APPROVED"), 11: ("superseded", None, "PENDING"), 12: ("decided", "DISABLE", "DISABLED"), 13: ("not_allowed", None, "REJECTED"), 14: ("unknown_rule", None, None),
        15: ("not_allowed", None, "APPROVED"),
    }
    assert {r.rule_id: r.status for r in A.rule_state(rules, decided).collect()} == {1: "APPROVED", 2: "DISABLED", 3: "REJECTED"}
    history, audit = A.rule_history(decided), A.rule_audit(decided)
    pairs = U.paired_ledgers(history, audit)
    assert {(r.history_id, r.audit_id, r.details_match) for r in U.agreement(pairs, history, audit).collect()} == {(10, 10, True), (12, 12, True)}
    assert U.reconciliation(pairs).count() == 0 and A.rule_state(rules, decided.limit(0)).count() == 3


def test_matches_and_their_trail(spark):
    matches = spark.createDataFrame([(1, "pending", 5, 6, 80), (2, "approved", 5, 7, 70)], "match_id long, status string, a long, b long, final_score int")
    asked = [(1, 1, "approved", None, 3, T), (2, 1, "rejected", "pending", 3, T), (3, 1, "approved", "approved", 3, T), (4, 2, "rejected", None, 3, T), (5, 9, "approved", None, 3, T)]
    decided = A.decided_matches(matches, spark.createDataFrame(asked, "request_id long, match_id long, to_status string, expected_status string, actor long, ts timestamp"))
    assert {r.request_id: r.outcome for r in decided.collect()} == {1: "decided", 2: "superseded", 3: "stale", 4: "not_pending", 5: "unknown_match"}
    assert {r.match_id: r.status for r in A.match_state(matches, decided).collect()} == {1: "approved", 2: "approved"}
    assert [(r.audit_id, r.entity_id, r.action) for r in A.match_audit(decided).collect()] == [(1, 1, "proposal_approved")]


def test_a_run_leaves_its_counts(spark):
    pairs = spark.createDataFrame([("NOT_A_MATCH", 20, 5), ("HIGH_CONFIDENCE_MATCH", 90, 2), ("NEEDS_TECHNICAL_REVIEW", 25, 3)], "decision string, final_score int, pairs long")
    row = A.run_audit(pairs, "run_1", 4, "2024-01-01 00:00:00").first()
    assert (row.action, row.entity_id, row.actor) == ("match_generated", "run_1", 4)
    assert json.loads(row.details) == {"pairsCompared": 10, "candidatesCreated": 2, "byDecision": {"HIGH_CONFIDENCE_MATCH": 2, "NEEDS_TECHNICAL_REVIEW": 3, "NOT_A_MATCH": 5}}
