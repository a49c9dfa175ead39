"""Evaluation records, rule resolution and decisions on small fixtures."""

from orelink.operators import evaluation as E
from orelink.operators import uom as U
from orelink.operators import workflow as W


def test_fingerprint_depends_on_every_setting():
    a = E.config_fingerprint({"w": [0.4, 0.6], "t": 30})
    assert a == E.config_fingerprint({"w": [0.4, 0.6], "t": 30}) != E.config_fingerprint({"w": [0.4, 0.6], "t": 31})
    assert a.startswith("cfg-") and len(a) == 10
    # 32-bit FNV-1a of "{}" is 0x2f070fa9 by hand: two steps from the offset basis
    h = 0x811C9DC5
    for c in b"{}":
        h = (h ^ c) * 0x01000193 % 2**32
    assert E.config_fingerprint({}) == f"cfg-{h:08x}"[:10]


def test_two_live_domain_rules_fail_closed(spark):
    rules = spark.createDataFrame([("PCS", "EA", 1, "ALIAS"), ("SET", "EA", 2, "SCALE")], "from_uom string, to_uom string, factor long, rule_type string")
    own = spark.createDataFrame([("c1", "SET", "EA", 4, "APPROVED"), ("c2", "SET", "EA", 4, "APPROVED"), ("c2", "set", "EA", 6, "APPROVED"), ("c3", "SET", "EA", 9, "PENDING")], "cmi string, from_uom string, to_uom string, factor long, status string")
    asked = spark.createDataFrame([("set ", "c1"), ("SET", "c2"), ("SET", "c3"), ("SET", None), ("", "c1"), ("PCS", "c2")], "uom string, cmi string")
    got = {(r.uom, r.cmi): (r.factor, r.rule_source) for r in U.effective_rules(asked, rules, own).collect()}
    assert got == {("set ", "c1"): (4, "DOMAIN"), ("SET", "c2"): (None, None), ("SET", "c3"): (2, "SYSTEM"), ("SET", None): (2, "SYSTEM"), ("", "c1"): (None, None), ("PCS", "c2"): (1, "SYSTEM")}


def test_decisions_need_a_pending_match_in_the_expected_state(spark):
    matches = spark.createDataFrame([(1, "pending"), (2, "approved"), (3, "pending"), (4, "pending")], "match_id long, status string")
    asked = spark.createDataFrame([(1, "approved", None), (2, "rejected", None), (3, "approved", "approved")], "match_id long, to_status string, expected_status string")
    got = {r.match_id: (r.status, r.outcome) for r in W.decided(matches, asked).collect()}
    assert got == {1: ("approved", "decided"), 2: ("approved", "not_pending"), 3: ("pending", "stale"), 4: ("pending", None)}


def test_history_keeps_one_row_an_event(spark):
    old = spark.createDataFrame([(1, 7), (2, 7)], "event_id long, rule_id long")
    new = spark.createDataFrame([(2, 9), (3, 7), (3, 7)], "event_id long, rule_id long")
    assert sorted(map(tuple, U.appended(old, new).collect())) == [(1, 7), (2, 7), (3, 7)]
