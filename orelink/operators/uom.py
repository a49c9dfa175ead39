"""Units of measure: rule resolution, classification, comparable quantities, governance ledgers."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelink.functions import vocabulary as V
from orelink.operators.rollup import measured
from orelink.sources.scratch import written_once


def active_rules(rules: DataFrame) -> DataFrame:
    """(from_uom, to_uom, factor, rule_type): units with exactly one ALIAS or SCALE rule; others fail closed."""
    usable = rules.where(F.col("rule_type").isin("ALIAS", "SCALE")).groupBy("from_uom")
    return usable.agg(F.count("*").alias("n"), F.min("to_uom").alias("to_uom"), F.min("factor").alias("factor"), F.min("rule_type").alias("rule_type")).where("n = 1").drop("n")


def classified(uoms: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the quality class of column ``uom``."""
    clean = F.upper(F.trim("uom"))
    joined = uoms.join(active_rules(rules).select(F.col("from_uom").alias("_from"), F.col("rule_type").alias("_type")), clean == F.col("_from"), "left")
    kind = (
        F.when(F.coalesce(clean, F.lit("")) == "", "INVALID")
        .when(F.col("_type") == "ALIAS", "ALIAS_NORMALIZED")
        .when(F.col("_type") == "SCALE", "SCALED")
        .when(clean.isin(V.CANONICAL_UOMS), "NORMALIZED")
        .when(clean.isin(V.KNOWN_UOMS), "UNCONVERTED")
        .otherwise("UNKNOWN")
    )
    return joined.withColumn("uom_class", kind).drop("_from", "_type")


def normalized(records: DataFrame, rules: DataFrame, domain_rules: DataFrame | None = None) -> DataFrame:
    """Adds norm_uom, factor and norm_cents: an approved domain rule of the record's cmi first, then a system rule, else as is."""
    clean = F.upper(F.trim("uom"))
    system = active_rules(rules).select(F.col("from_uom").alias("_sf"), F.col("to_uom").alias("_st"), F.col("factor").alias("_sx"))
    out = records.join(system, clean == F.col("_sf"), "left")
    if domain_rules is not None:
        own = domain_rules.where("status = 'APPROVED'").groupBy("cmi", "from_uom").agg(F.count("*").alias("n"), F.min("to_uom").alias("_dt"), F.min("factor").alias("_dx")).where("n = 1")
        own = own.select(F.col("cmi").alias("_dc"), F.col("from_uom").alias("_df"), "_dt", "_dx")
        out = out.join(own, (F.col("cmi") == F.col("_dc")) & (clean == F.col("_df")), "left")
    else:
        out = out.withColumns({"_dt": F.lit(None).cast("string"), "_dx": F.lit(None).cast("long"), "_dc": F.lit(None), "_df": F.lit(None)})
    out = out.withColumns({"norm_uom": F.coalesce("_dt", "_st", clean), "factor": F.coalesce("_dx", "_sx", F.lit(1)), "rule_source": F.when(F.col("_dt").isNotNull(), "DOMAIN").when(F.col("_st").isNotNull(), "SYSTEM").otherwise("NONE")})
    return out.withColumn("norm_cents", F.col("qty_cents") * F.col("factor")).drop("_sf", "_st", "_sx", "_dt", "_dx", "_dc", "_df")


def comparable(records: DataFrame, rules: DataFrame, *keys: str, domain_rules: DataFrame | None = None) -> DataFrame:
    """Comparable quantities: cents of the normalized unit by key. Units are counted before the rules join."""
    slim = measured(records).groupBy(*dict.fromkeys([*keys, "cmi", "uom"])).agg(F.sum("records").alias("records"), F.sum("qty_cents").alias("qty_cents"))
    return normalized(slim, rules, domain_rules).groupBy(*keys, "norm_uom").agg(F.sum("records").alias("records"), F.sum("norm_cents").alias("norm_cents"))


# Allowed status changes of a domain rule.
RULE_TRANSITIONS = [("PENDING", "APPROVED"), ("PENDING", "REJECTED"), ("APPROVED", "DISABLED"), ("DISABLED", "APPROVED")]


def change_rules(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (cmi, from_uom, to_status). New status and acceptance for each rule."""
    asked = rules.join(requests, ["cmi", "from_uom"], "left")
    ok = F.coalesce(F.array_contains(F.array([F.lit(f"{a}>{b}") for a, b in RULE_TRANSITIONS]), F.concat("status", F.lit(">"), "to_status")), F.lit(False))
    return asked.select("cmi", "from_uom", F.when(ok, F.col("to_status")).otherwise(F.col("status")).alias("status"), ok.alias("accepted"))


def latest_versions(history: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    line = Window.partitionBy(key).orderBy(order.desc())
    return history.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")


def _first_of_rule(rows: DataFrame, test: Column) -> DataFrame:
    """Adds _first: the least request_id of each rule's requests that fit ``test``."""
    return rows.join(rows.where(test).groupBy("rule_id").agg(F.min("request_id").alias("_first")), "rule_id", "left")


def proposed_amendments(rules: DataFrame, versions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (request_id, rule_id, from_uom, to_uom, factor, reason, actor), null where unchanged. Adds outcome, version_number and supersedes.

    Only rules that are approved or disabled and await no decision can be amended; of several good requests the first becomes the pending version.
    """
    last = versions.groupBy("rule_id").agg(F.max("version_number").alias("_last"))
    known = rules.select("rule_id", "status", F.col("from_uom").alias("_from"), F.col("to_uom").alias("_to"), F.col("factor").alias("_factor"), "effective_version", "pending_version")
    rows = requests.join(known, "rule_id", "left").join(last, "rule_id", "left")
    unit = lambda own, old: F.upper(F.trim(F.coalesce(own, old)))
    source, target, factor = unit("from_uom", "_from"), unit("to_uom", "_to"), F.coalesce("factor", "_factor")
    fault = (
        F.when(F.col("status").isNull(), "unknown_rule")
        .when(~F.col("status").isin("APPROVED", "DISABLED"), "not_amendable")
        .when(F.col("pending_version").isNotNull(), "already_pending")
        .when(source == "", "empty_unit")
        .when(source == target, "same_unit")
        .when(~target.isin(V.CANONICAL_UOMS), "not_canonical")
        .when(factor <= 0, "bad_factor")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no_reason")
    )
    rows = _first_of_rule(rows.withColumn("_fault", fault), F.col("_fault").isNull())
    outcome = F.coalesce("_fault", F.when(F.col("request_id") > F.col("_first"), "already_pending").otherwise("proposed"))
    made = outcome == "proposed"
    return rows.select(
        "request_id", "rule_id", outcome.alias("outcome"), F.when(made, F.coalesce(F.col("_last"), F.lit(0)) + 1).alias("version_number"), F.when(made, F.col("effective_version")).alias("supersedes"),
        F.when(made, source).alias("from_uom"), F.when(made, target).alias("to_uom"), F.when(made, factor).alias("factor"),
    )


def decided_amendments(rules: DataFrame, versions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (request_id, rule_id, decision approve or reject, actor). Adds outcome, and the version and factor then in effect.

    The proposer of a version may not decide it. Of several good requests on a rule the first decides.
    """
    pending = versions.select(F.col("version_id").alias("pending_version"), F.col("created_by").alias("_by"), F.col("factor").alias("_new"))
    rows = requests.select("request_id", "rule_id", "decision", "actor").join(rules.select("rule_id", "status", "factor", "effective_version", "pending_version"), "rule_id", "left").join(pending, "pending_version", "left")
    fault = (
        F.when(F.col("status").isNull(), "unknown_rule")
        .when(F.col("pending_version").isNull() | F.col("effective_version").isNull(), "nothing_pending")
        .when(F.col("_by") == F.col("actor"), "own_proposal")
        .when(~F.col("status").isin("APPROVED", "DISABLED"), "not_amendable")
    )
    rows = _first_of_rule(rows.withColumn("_fault", fault), F.col("_fault").isNull())
    outcome = F.coalesce("_fault", F.when(F.col("request_id") > F.col("_first"), "nothing_pending").when(F.col("decision") == "approve", "approved").otherwise("rejected"))
    took = outcome == "approved"
    return rows.select("request_id", "rule_id", outcome.alias("outcome"), F.when(took, F.col("pending_version")).otherwise(F.col("effective_version")).alias("version_id"), F.when(took, F.col("_new")).otherwise(F.col("factor")).alias("factor"))


def quality_counts(records: DataFrame, rules: DataFrame) -> DataFrame:
    """(uom, records, uom_class): one row a unit; the one pass over the records that all quality figures share."""
    return classified(measured(records).groupBy("uom").agg(F.sum("records").alias("records")), rules)


def remedied_cmis(records: DataFrame) -> DataFrame:
    """One row, ``n``: the cmis with a unit outside the known ones."""
    return records.where(F.col("cmi").isNotNull() & ~F.upper(F.trim("uom")).isin(V.KNOWN_UOMS)).agg(F.countDistinct("cmi").alias("n"))


def named_counts(section: str, counts: DataFrame, *names: str) -> DataFrame:
    """(section, name, n) of the named columns of a one-row table."""
    return counts.unpivot([], list(names), "name", "n").select(F.lit(section).alias("section"), "name", F.col("n").cast("long").alias("n"))


def steward_overview(rules: DataFrame, versions: DataFrame, history: DataFrame, quality: DataFrame, remedied: DataFrame, since: str) -> DataFrame:
    """(section, name, n): rules by status, record quality by class, activity and amendments since a time, versions."""
    states, kinds = ["PENDING", "APPROVED", "REJECTED", "DISABLED"], ["INVALID", "ALIAS_NORMALIZED", "SCALED", "NORMALIZED", "UNCONVERTED", "UNKNOWN"]
    by_status = rules.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == x).alias(x.lower()) for x in states])
    of = lambda k: F.coalesce(F.sum(F.when(F.col("uom_class") == k, F.col("records"))), F.lit(0))
    by_class = quality.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total"), *[of(k).alias(k.lower()) for k in kinds], (of("UNCONVERTED") + of("UNKNOWN")).alias("not_converted"))
    recent, actions = history.where(F.col("ts") >= F.lit(since).cast("timestamp")), ["CREATE", "APPROVE", "REJECT", "DISABLE", "RE_ENABLE"]
    done = recent.agg(*[F.count_if(F.col("action") == x).alias(x.lower()) for x in actions])
    amended = F.col("previous_version").isNotNull()
    amends = recent.agg(F.count_if(F.col("action") == "AMEND").alias("proposed"), F.count_if((F.col("action") == "APPROVE") & amended).alias("approved"), F.count_if((F.col("action") == "REJECT") & amended).alias("rejected"))
    waiting = rules.agg(F.count_if(F.col("pending_version").isNotNull() & F.col("effective_version").isNotNull()).alias("pending"))
    made = versions.agg(F.count("*").alias("total"), F.count("supersedes").alias("superseded"))
    parts = [
        named_counts("rules", by_status, "total", *[x.lower() for x in states]), named_counts("quality", by_class, "total", *[k.lower() for k in kinds], "not_converted"),
        named_counts("quality", remedied.withColumnRenamed("n", "cmis_to_remedy"), "cmis_to_remedy"), named_counts("activity", done, *[x.lower() for x in actions]),
        named_counts("amendments", amends, "proposed", "approved", "rejected"), named_counts("amendments", waiting, "pending"), named_counts("versions", made, "total", "superseded"),
    ]
    return reduce(DataFrame.unionByName, parts)


def pending_queue(rules: DataFrame, history: DataFrame, records: DataFrame) -> DataFrame:
    """Rules that await approval, with their events, the records of their cmi and those of them in the rule's unit."""
    used = measured(records).where("cmi is not null").groupBy("cmi", F.upper(F.trim("uom")).alias("_unit")).agg(F.sum("records").alias("n"))
    events = history.groupBy("rule_id").agg(F.count("*").alias("events"))
    rows = rules.where("status = 'PENDING'").join(used, "cmi", "left").join(events, "rule_id", "left")
    sums = rows.groupBy("rule_id", "cmi", "from_uom", F.coalesce("events", F.lit(0)).alias("events"))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cmi_records"), F.coalesce(F.sum(F.when(F.col("_unit") == F.col("from_uom"), F.col("n"))), F.lit(0)).alias("affected"))


def amendment_queue(rules: DataFrame, versions: DataFrame, records: DataFrame) -> DataFrame:
    """Rules with a pending version, in any state: both version numbers, the proposed factor and the records in the proposed unit."""
    named = lambda pointer, *c: versions.select(F.col("version_id").alias(pointer), *c)
    rows = rules.where("pending_version is not null and effective_version is not null").drop("from_uom", "to_uom", "factor")
    rows = rows.join(named("effective_version", F.col("version_number").alias("effective_number")), "effective_version", "left")
    rows = rows.join(named("pending_version", F.col("version_number").alias("proposed_number"), "from_uom", "factor"), "pending_version", "left")
    used = measured(records).where("cmi is not null").groupBy("cmi", F.upper(F.trim("uom")).alias("from_uom")).agg(F.sum("records").alias("affected"))
    return rows.join(used, ["cmi", "from_uom"], "left").select("rule_id", "cmi", "effective_number", "proposed_number", "from_uom", "factor", F.coalesce("affected", F.lit(0)).alias("affected"))


def governance_summary(queue: DataFrame, rules: DataFrame, organizations: DataFrame, mappings: DataFrame, history: DataFrame, quality: DataFrame, remedied: DataFrame, since: str) -> DataFrame:
    """One row of ten counters; each is one aggregate of a small or pre-aggregated table."""
    version, pending = F.col("effective_version").isNotNull(), F.col("pending_version").isNotNull()
    ruled = rules.agg(
        F.count_if(F.col("status") == "PENDING").alias("pending_rules"), F.count_if(F.col("status") == "APPROVED").alias("approved_rules"), F.count_if((F.col("status") == "APPROVED") & version).alias("active_rules"),
        F.count_if(pending & version).alias("pending_amendments"),
    )
    bad = F.col("uom_class").isin("UNCONVERTED", "UNKNOWN")
    units = quality.agg(F.least(F.count_if(~F.col("uom").isin(V.KNOWN_UOMS)), F.lit(50)).cast("long").alias("unknown_units"), F.coalesce(F.sum(F.when(bad, F.col("records"))), F.lit(0)).alias("unconverted_records"))
    parts = [
        queue.agg(F.count_if(F.col("status") == "open").alias("open_reviews")), ruled, organizations.join(mappings.select("org_id").distinct(), "org_id", "left_anti").agg(F.count("*").alias("organizations_unmapped")),
        units, remedied.withColumnRenamed("n", "cmis_to_remedy"), history.agg(F.count_if(F.col("ts") >= F.lit(since).cast("timestamp")).alias("recent_events")),
    ]
    return reduce(DataFrame.crossJoin, parts)  # one row each


def open_reviews(queue: DataFrame, matches: DataFrame) -> DataFrame:
    """The open reviews with what they are about: (match_id, priority, created, a, b, final_score). Reviews whose match is gone are left out."""
    return queue.where("status = 'open'").select("match_id", "priority").join(matches.select("match_id", "created", "a", "b", "final_score"), "match_id")


def oldest_review(reviews: DataFrame, today: str) -> DataFrame:
    """One row, ``oldest_days``: the age of the oldest of ``open_reviews``, null without any."""
    return reviews.agg(F.datediff(F.lit(today).cast("date"), F.min("created")).alias("oldest_days"))


def health(summary: DataFrame, reconciled: DataFrame, oldest: DataFrame) -> DataFrame:
    """(indicator, state, n): six indicators of a ``governance_summary`` row, one row (issues) of ledger findings and one of ``oldest_review``."""
    n = F.col
    due = lambda count, state: F.when(count > 0, state).otherwise("PASS")
    decisions = n("pending_rules") + n("pending_amendments")
    rows = {
        "ledger_agreement": (due(n("issues"), "ACTION REQUIRED"), n("issues")), "effective_versions": (F.when((n("approved_rules") == 0) | (n("approved_rules") == n("active_rules")), "PASS").otherwise("WARNING"), n("approved_rules") - n("active_rules")),
        "pending_decisions": (due(decisions, "ACTION REQUIRED"), decisions), "unit_quality": (due(n("unconverted_records"), "WARNING"), n("unconverted_records")),
        "review_backlog": (F.when(n("open_reviews") == 0, "PASS").when(n("oldest_days") > 30, "ACTION REQUIRED").otherwise("WARNING"), n("open_reviews")), "cmi_coverage": (due(n("organizations_unmapped"), "WARNING"), n("organizations_unmapped")),
    }
    made = F.array(*[F.struct(F.lit(k).alias("indicator"), state.alias("state"), count.cast("long").alias("n")) for k, (state, count) in rows.items()])
    return summary.crossJoin(reconciled).crossJoin(oldest).select(F.explode(made).alias("h")).select("h.*")


def work_queue(reviews: DataFrame, pending: DataFrame, amendments: DataFrame, quality: DataFrame, summary: DataFrame, most: int = 15) -> DataFrame:
    """(type, ref, scope, n): what waits for a person: the first reviews, rules, amendments, unknown units and unmapped organizations."""
    item = lambda kind, rows, ref, scope, n: rows.select(F.lit(kind).alias("type"), ref.cast("string").alias("ref"), scope.cast("string").alias("scope"), n.cast("long").alias("n"))
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    first = reviews.where("status = 'open'").orderBy(rank, "match_id").limit(most)
    unknown = quality.where(~F.col("uom").isin(V.KNOWN_UOMS)).orderBy(F.desc("records"), "uom").limit(50)
    parts = [
        item("MATCH_REVIEW", first, F.col("match_id"), F.col("priority"), F.lit(1)), item("UOM_RULE_APPROVAL", pending, F.col("rule_id"), F.col("cmi"), F.col("affected")), item("UOM_RULE_AMENDMENT", amendments, F.col("rule_id"), F.col("cmi"), F.col("affected")),
        item("UOM_REMEDIATION", unknown, F.col("uom"), F.lit("all"), F.col("records")), item("CMI_GOVERNANCE", summary.where("organizations_unmapped > 0"), F.lit("unmapped organizations"), F.lit("all"), F.col("organizations_unmapped")),
    ]
    return reduce(DataFrame.unionByName, parts)


# The audit action that goes with each history action.
EXPECTED_AUDIT = {"CREATE": "uom_rule_created", "APPROVE": "uom_rule_approved", "REJECT": "uom_rule_rejected", "DISABLE": "uom_rule_disabled", "RE_ENABLE": "uom_rule_re_enabled", "AMEND": "uom_rule_amended"}
PAIRED = "rule_id long, history_id long, audit_id long"


class _Free:
    """Audit rows in time order; the least id among the free ones of a stretch, in logarithmic time."""

    def __init__(self, ids: list[int]):
        self.n = len(ids)
        self.least = [float("inf")] * self.n + ids
        for i in range(self.n - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def first(self, low: int, high: int) -> float:
        found, low, high = float("inf"), low + self.n, high + self.n
        while low < high:
            if low & 1:
                found, low = min(found, self.least[low]), low + 1
            if high & 1:
                high -= 1
                found = min(found, self.least[high])
            low, high = low >> 1, high >> 1
        return found

    def take(self, place: int) -> None:
        place += self.n
        self.least[place] = float("inf")
        while place > 1:
            place >>= 1
            self.least[place] = min(self.least[2 * place], self.least[2 * place + 1])


def pair_run(history: list[tuple[int, float]], audit: list[tuple[int, float]], seconds: float) -> list[tuple[int | None, int | None]]:
    """(history_id, audit_id) over (id, time) rows: history rows in order of id take the free audit row of least id within ``seconds``."""
    audit = sorted(audit, key=lambda r: (r[1], r[0]))
    times, places = [t for _, t in audit], {a: k for k, (a, _) in enumerate(audit)}
    free, out = _Free([a for a, _ in audit]), []
    for h, t in sorted(history):
        a = free.first(bisect_left(times, t - seconds), bisect_right(times, t + seconds)) if audit else float("inf")
        if a == float("inf"):
            out.append((h, None))
        else:
            free.take(places.pop(a))
            out.append((h, a))
    return out + [(None, a) for a in places]


def close_runs(rows: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Adds ``run``: the time at which a key's run of rows began of which none is more than ``seconds`` after the one before.

    Rows are dealt by range of (key, time), so a busy key is many tasks. Each takes two values over from the partitions before: the last time of the key
    there, and when the last run began; these come from one row for each key and partition.
    """
    parts = written_once(rows.repartitionByRange(*keys, "ts").withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy("_part", *keys).orderBy("ts")
    carried = lambda table, last: table.groupBy("_part", *keys).agg(F.max(last).alias("_m")).select("_part", *keys, F.max("_m").over(ahead).alias(f"_{last}_before")).where(F.col(f"_{last}_before").isNotNull())
    before = F.coalesce(F.lag("ts").over(line), F.col("_ts_before"))
    gap = before.isNull() | (F.col("ts").cast("double") - before.cast("double") > seconds)
    marked = parts.join(carried(parts, "ts"), ["_part", *keys], "left").withColumn("_began", F.when(gap, F.col("ts")))
    began = F.max("_began").over(line.rowsBetween(Window.unboundedPreceding, 0))
    told = marked.join(carried(marked, "_began").withColumnRenamed("__began_before", "_run_before"), ["_part", *keys], "left").withColumn("run", F.coalesce(began, F.col("_run_before")))
    return told.select(*rows.columns, "run")


def paired_ledgers(history: DataFrame, audit: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Greedy one-to-one pairing of history and audit rows of one rule and actor within ``seconds``.

    history: (history_id, rule_id, actor, action, ts), audit: (audit_id, rule_id, actor, action, ts), the audit action being the
    expected one of the history action. History rows in order of id take the free audit row of least id. Rows unmatched on either
    side keep a null partner; a null rule, actor, action or time matches nothing. Each key's rows are cut where neighbours lie more than
    ``seconds`` apart: pairs never cross such a gap, so what a task holds is a run of close events (three numbers each), not a key.
    """
    expected = F.create_map(*[F.lit(x) for pair in EXPECTED_AUDIT.items() for x in pair])
    none = F.lit(None).cast("long")
    both = history.select("rule_id", "actor", F.try_element_at(expected, F.col("action")).alias("action"), "ts", "history_id", none.alias("audit_id"))
    both = both.unionByName(audit.select("rule_id", "actor", "action", "ts", none.alias("history_id"), "audit_id"))
    usable = F.col("rule_id").isNotNull() & F.col("actor").isNotNull() & F.col("action").isNotNull() & F.col("ts").isNotNull()
    runs = close_runs(both.where(usable), ["rule_id", "actor", "action"], seconds)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, ([], []), []

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 3)], ["rule_id", "history_id", "audit_id"])
            out.clear()
            return batch

        for b in batches:
            for rule, actor, action, run, at, h, a in zip(*(c.to_pylist() for c in b.columns)):
                if (rule, actor, action, run) != key:
                    out += [(key[0], *x) for x in pair_run(*rows, seconds)] if key else []
                    key, rows = (rule, actor, action, run), ([], [])
                rows[h is None].append((a if h is None else h, at))
            yield given()
        out += [(key[0], *x) for x in pair_run(*rows, seconds)] if key else []
        yield given()

    keys = ["rule_id", "actor", "action", "run"]
    dealt = written_once(runs).select(*keys, (F.unix_micros("ts") / 1e6).alias("at"), "history_id", "audit_id").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(pair, PAIRED).unionByName(both.where(~usable).select("rule_id", "history_id", "audit_id"))


def agreement(pairs: DataFrame, history: DataFrame, audit: DataFrame) -> DataFrame:
    """History rows with their audit row and whether its JSON ``details`` name the same conversion (null without an audit row).

    Details may hold from, to and factor themselves, as the proposal or as what was before; what they lack counts as agreeing.
    """
    rows = history.join(pairs.where("history_id is not null").select("history_id", "audit_id"), "history_id").join(audit.select("audit_id", "details"), "audit_id", "left")
    said = lambda key, own: F.coalesce(F.get_json_object("details", f"$.{key}"), F.get_json_object("details", f"$.proposed.{key}"), F.get_json_object("details", f"$.previous.{key}"), F.col(own).cast("string"))
    same = (said("fromUom", "from_uom") == F.col("from_uom")) & (said("toUom", "to_uom") == F.col("to_uom")) & (said("factor", "factor").try_cast("double") == F.col("factor"))
    return rows.select("history_id", "rule_id", "action", "audit_id", F.when(F.col("audit_id").isNotNull(), F.coalesce(same, F.lit(True))).alias("details_match"))


def reconciliation(pairs: DataFrame) -> DataFrame:
    """MISSING_AUDIT_EVENT and UNEXPECTED_AUDIT_EVENT findings of ``paired_ledgers``."""
    kind = F.when(F.col("audit_id").isNull(), "MISSING_AUDIT_EVENT").when(F.col("history_id").isNull(), "UNEXPECTED_AUDIT_EVENT")
    return pairs.withColumn("finding", kind).where("finding is not null")


def activity_feed(a: DataFrame, b: DataFrame, most: int = 50) -> DataFrame:
    return a.unionByName(b).orderBy(F.desc("ts"), "source", F.desc("id")).limit(most)


def effective_rules(requests: DataFrame, rules: DataFrame, domain_rules: DataFrame) -> DataFrame:
    """requests: uom, cmi. Adds to_uom, factor and rule_source (DOMAIN, SYSTEM or null).

    One approved domain rule of (cmi, unit) wins; several of them fail closed to no rule; without any the active system rule holds.
    """
    unit = F.upper(F.trim("uom"))
    domain = domain_rules.where("status = 'APPROVED'").groupBy("cmi", F.upper(F.trim("from_uom")).alias("_unit")).agg(F.count("*").alias("_live"), F.min("to_uom").alias("_to"), F.min("factor").alias("_factor"))
    system = active_rules(rules).select(F.col("from_uom").alias("_unit"), F.col("to_uom").alias("_sys_to"), F.col("factor").alias("_sys_factor"))
    both = requests.withColumn("_unit", unit).join(domain, ["cmi", "_unit"], "left").join(system, "_unit", "left")  # one row a unit
    source = F.when(F.col("_live") == 1, "DOMAIN").when(F.col("_live").isNull() & F.col("_sys_to").isNotNull(), "SYSTEM")
    pick = lambda a, b: F.when(F.col("rule_source") == "DOMAIN", F.col(a)).when(F.col("rule_source") == "SYSTEM", F.col(b))
    both = both.withColumn("rule_source", source)
    return both.select(*requests.columns, pick("_to", "_sys_to").alias("to_uom"), pick("_factor", "_sys_factor").alias("factor"), "rule_source")


def appended(history: DataFrame, events: DataFrame) -> DataFrame:
    """An append-only history with new events; events whose id it has already are ignored."""
    return history.unionByName(events.dropDuplicates(["event_id"]).join(history.select("event_id"), "event_id", "left_anti"))


def history_page(history: DataFrame, most: int = 5) -> DataFrame:
    """The last ``most`` events of each rule and the number of all of them."""
    line = Window.partitionBy("rule_id").orderBy(F.desc("event_id"))
    counts = history.groupBy("rule_id").agg(F.count("*").alias("events"))
    return history.withColumn("n", F.row_number().over(line)).where(F.col("n") <= most).join(counts, "rule_id")
