"""Ledger pairing against the plain rule: each history row, by id, takes the free audit row of least id."""

import datetime
import random

from orelink.operators import uom as U

START = datetime.datetime(2024, 1, 1)
ROWS = "rule_id long, actor long, action string, ts timestamp"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain(history, audit):
    used, out = set(), []
    for h, rule, actor, action, ts in sorted(history):
        fits = [a for a, r, w, x, t in audit if a not in used and (r, w, x) == (rule, actor, U.EXPECTED_AUDIT.get(action)) and abs((t - ts).total_seconds()) <= 5]
        used.update([min(fits)] if fits else [])
        out.append((rule, h, min(fits) if fits else None))
    return sorted(out + [(r, None, a) for a, r, *_ in audit if a not in used], key=str)


def frames(spark, history, audit):
    return spark.createDataFrame(history, f"history_id long, {ROWS}"), spark.createDataFrame(audit, f"audit_id long, {ROWS}")


def test_the_earliest_free_id_is_taken_not_the_nearest(spark):
    """Audit 1 is three seconds off and audit 2 none: history 1 takes audit 1, so history 2 finds audit 2."""
    history = [(1, 7, 7, "AMEND", at(10)), (2, 7, 7, "AMEND", at(11)), (3, 7, 7, "AMEND", at(40))]
    audit = [(1, 7, 7, "uom_rule_amended", at(7)), (2, 7, 7, "uom_rule_amended", at(10)), (3, 7, 7, "uom_rule_created", at(40))]
    pairs = U.paired_ledgers(*frames(spark, history, audit))
    assert {(r.history_id, r.audit_id) for r in pairs.collect()} == {(1, 1), (2, 2), (3, None), (None, 3)}
    assert {r.finding for r in U.reconciliation(pairs).collect()} == {"MISSING_AUDIT_EVENT", "UNEXPECTED_AUDIT_EVENT"}


def test_pairs_match_the_plain_rule(spark):
    """Dense ledgers, ids out of time order, several rules, actors and actions, nulls."""
    rng = random.Random(3)
    kinds = list(U.EXPECTED_AUDIT)[:2]
    history = [(i, rng.randrange(3), rng.randrange(2), rng.choice(kinds), at(rng.randrange(120))) for i in range(150)]
    audit = [(i, rng.randrange(3), rng.randrange(2), U.EXPECTED_AUDIT[rng.choice(kinds)], at(rng.randrange(120))) for i in range(150)]
    got = sorted(((r.rule_id, r.history_id, r.audit_id) for r in U.paired_ledgers(*frames(spark, history, audit)).collect()), key=str)
    assert got == plain(history, audit)
    odd = [(900, None, 1, "CREATE", at(1)), (901, 1, 1, "OTHER", at(1)), (902, 1, 1, "CREATE", None)]
    assert {(r.history_id, r.audit_id) for r in U.paired_ledgers(*frames(spark, odd, [(5, None, 1, "uom_rule_created", at(1))])).collect()} == {(900, None), (901, None), (902, None), (None, 5)}


def test_a_busy_run_pairs_in_time(spark):
    rows = [(i, i / 10) for i in range(100_000)]
    pairs = U.pair_run(rows, [(i, t + 1) for i, t in rows], 5)
    assert len(pairs) == 100_000 and all(h == a for h, a in pairs)


def test_details_agree_where_they_speak(spark):
    history = spark.createDataFrame([(k, 1, "APPROVE", "SET", "EA", 4) for k in range(6)], "history_id long, rule_id long, action string, from_uom string, to_uom string, factor long")
    texts = [None, '{"fromUom":"SET","factor":4}', '{"factor":5}', '{"proposed":{"toUom":"G"}}', '{"previous":{"factor":4}}']
    audit = spark.createDataFrame(list(enumerate(texts)), "audit_id long, details string")
    pairs = spark.createDataFrame([(1, k, k if k < 5 else None) for k in range(6)], U.PAIRED)
    got = {r.history_id: r.details_match for r in U.agreement(pairs, history, audit).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: None}


def test_a_busy_key_over_many_partitions(spark):
    """Runs of one key that spread over range partitions are those of one pass over the key."""
    rng = random.Random(9)
    seconds, rows = 0.0, []
    for i in range(3000):
        seconds += rng.choice([0, 0, 1, 4, 5]) if i % 400 else 60
        rows.append((1 if i % 7 else 2, 1, "x", at(seconds), i))
    frame = spark.createDataFrame(rows, "rule_id long, actor long, action string, ts timestamp, id long").repartition(7)
    got = {r.id: r.run for r in U.close_runs(frame, ["rule_id", "actor", "action"], 5).collect()}
    want, last, run = {}, {}, {}
    for rule, _, _, ts, i in rows:
        if rule not in last or (ts - last[rule]).total_seconds() > 5:
            run[rule] = ts
        last[rule] = ts
        want[i] = run[rule]
    assert got == want
