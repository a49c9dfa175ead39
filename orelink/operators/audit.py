"""Decisions that leave a trail: one plan decides requests, and the new state, the history and the audit are read from its rows.

``decided_rules`` and ``decided_matches`` give a row for each request with its outcome and what was before. Write it once (``sources.scratch.written_once``) and take
``rule_state``, ``rule_history``, ``rule_audit`` or ``match_state``, ``match_audit`` from it: they cannot disagree, since none decides anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelink.operators.uom import EXPECTED_AUDIT, RULE_TRANSITIONS

# The history action of each allowed change of a rule.
ACTIONS = {"PENDING>APPROVED": "APPROVE", "PENDING>REJECTED": "REJECT", "APPROVED>DISABLED": "DISABLE", "DISABLED>APPROVED": "RE_ENABLE"}


def _map(entries: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def decided_rules(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (request_id, rule_id, to_status, actor, ts). Every request with its outcome: unknown_rule, not_allowed, superseded or decided.

    Of several allowed requests on a rule the one of least request_id decides; the others are superseded.
    """
    known = rules.select("rule_id", F.col("status").alias("previous"), "from_uom", "to_uom", "factor")
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in RULE_TRANSITIONS])
    step = F.concat("previous", F.lit(">"), "to_status")
    rows = requests.join(known, "rule_id", "left").withColumn("_ok", F.coalesce(F.array_contains(allowed, step), F.lit(False)))
    firsts = rows.where("_ok").groupBy("rule_id").agg(F.min("request_id").alias("_first"))
    outcome = F.when(F.col("previous").isNull(), "unknown_rule").when(~F.col("_ok"), "not_allowed").when(F.col("request_id") > F.col("_first"), "superseded").otherwise("decided")
    rows = rows.join(firsts, "rule_id", "left").withColumn("outcome", outcome)
    done = F.col("outcome") == "decided"
    return rows.select(
        "request_id", "rule_id", "actor", "ts", "outcome", F.when(done, F.try_element_at(_map(ACTIONS), step)).alias("action"), "previous", F.when(done, F.col("to_status")).otherwise(F.col("previous")).alias("status"), "from_uom", "to_uom", "factor",
    )


def rule_state(rules: DataFrame, decided: DataFrame) -> DataFrame:
    """The rules after the decisions."""
    new = decided.where("outcome = 'decided'").select("rule_id", F.col("status").alias("_new"))
    return rules.join(new, "rule_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def rule_history(decided: DataFrame) -> DataFrame:
    return decided.where("outcome = 'decided'").select(F.col("request_id").alias("history_id"), "rule_id", "actor", "action", "ts", "from_uom", "to_uom", "factor")


def rule_audit(decided: DataFrame) -> DataFrame:
    """The audit rows that belong to ``rule_history``: the expected action, and the conversion and the change as JSON details."""
    details = F.to_json(F.struct(F.col("from_uom").alias("fromUom"), F.col("to_uom").alias("toUom"), F.col("factor").alias("factor"), F.col("previous").alias("previousStatus"), F.col("status").alias("status")))
    rows = decided.where("outcome = 'decided'")
    return rows.select(F.col("request_id").alias("audit_id"), "rule_id", "actor", F.try_element_at(_map(EXPECTED_AUDIT), F.col("action")).alias("action"), "ts", details.alias("details"))


def decided_matches(matches: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (request_id, match_id, to_status, expected_status or null, actor, ts). Every request with its outcome: unknown_match, stale, not_pending, superseded or decided."""
    known = matches.select("match_id", F.col("status").alias("previous"), "a", "b", "final_score")
    rows = requests.join(known, "match_id", "left")
    fault = F.when(F.col("previous").isNull(), "unknown_match").when(F.col("expected_status") != F.col("previous"), "stale").when(F.col("previous") != "pending", "not_pending")
    rows = rows.withColumn("_fault", fault)
    firsts = rows.where("_fault is null").groupBy("match_id").agg(F.min("request_id").alias("_first"))
    outcome = F.coalesce("_fault", F.when(F.col("request_id") > F.col("_first"), "superseded").otherwise("decided"))
    rows = rows.join(firsts, "match_id", "left").withColumn("outcome", outcome)
    return rows.select("request_id", "match_id", "actor", "ts", "outcome", "previous", F.when(F.col("outcome") == "decided", F.col("to_status")).otherwise(F.col("previous")).alias("status"), "a", "b", "final_score")


def match_state(matches: DataFrame, decided: DataFrame) -> DataFrame:
    new = decided.where("outcome = 'decided'").select("match_id", F.col("status").alias("_new"))
    return matches.join(new, "match_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


# The audit action of each state that a match is decided to.
MATCH_ACTIONS = {"approved": "proposal_approved", "rejected": "proposal_rejected", "deferred": "proposal_deferred", "sent_for_review": "proposal_deferred"}


def match_audit(decided: DataFrame) -> DataFrame:
    """One audit row for each decided match, with the decision, both materials and the score as JSON details."""
    details = F.to_json(F.struct(F.col("status").alias("decision"), "a", "b", "final_score", "previous"))
    action = F.try_element_at(_map(MATCH_ACTIONS), F.col("status"))
    return decided.where("outcome = 'decided'").select(F.col("request_id").alias("audit_id"), F.lit("match_candidate").alias("entity_type"), F.col("match_id").alias("entity_id"), "actor", action.alias("action"), "ts", details.alias("details"))


def run_audit(pairs: DataFrame, run_id: str, actor: int, ts: str) -> DataFrame:
    """The audit row of a match run: pairs compared and kept, and the kept ones by decision, as JSON details. pairs: decision, final_score, pairs (how many stand behind a row)."""
    kept = (F.col("decision") != "NOT_A_MATCH") & (F.col("final_score") >= 30)
    by = pairs.groupBy("decision").agg(F.sum("pairs").alias("n"), F.coalesce(F.sum(F.when(kept, F.col("pairs"))), F.lit(0)).alias("kept"))
    one = by.agg(F.sum("n").alias("pairsCompared"), F.sum("kept").alias("candidatesCreated"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision", "n")))).alias("byDecision"))  # an entry a decision
    return one.select(F.lit("match_generated").alias("action"), F.lit("match_run").alias("entity_type"), F.lit(run_id).alias("entity_id"), F.lit(actor).cast("long").alias("actor"), F.lit(ts).cast("timestamp").alias("ts"), F.to_json(F.struct("pairsCompared", "candidatesCreated", "byDecision")).alias("details"))
