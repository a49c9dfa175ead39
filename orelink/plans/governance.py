"""Units of measure and governance (U) over the mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelink.operators import uom as U
from orelink.plans import rolls
from orelink.plans.registry import Registry
from orelink.sources.mart import mart

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_ACTIVE = "(SELECT from_uom, min(to_uom) AS to_uom, min(factor) AS factor, min(rule_type) AS rule_type FROM uom_rules WHERE rule_type IN ('ALIAS', 'SCALE') GROUP BY from_uom HAVING count(*) = 1)"
_CLASS = """CASE WHEN upper(trim(uom)) = '' THEN 'INVALID' WHEN rule_type = 'ALIAS' THEN 'ALIAS_NORMALIZED' WHEN rule_type = 'SCALE' THEN 'SCALED' WHEN upper(trim(uom)) IN ('EA', 'G', 'ML', 'MM') THEN 'NORMALIZED'
  WHEN upper(trim(uom)) IN ('EA', 'PCS', 'NOS', 'SET', 'KG', 'G', 'TON', 'L', 'ML', 'M', 'CM', 'MM') THEN 'UNCONVERTED' ELSE 'UNKNOWN' END"""


def _comparable(keys: str) -> str:
    return f"""SELECT {keys}, coalesce(d.to_uom, r.to_uom, upper(uom)) AS norm_uom, count(*) AS records, cast(sum(qty_cents * coalesce(d.factor, r.factor, 1)) AS bigint) AS norm_cents
FROM procurement p LEFT JOIN {_ACTIVE} r ON r.from_uom = upper(uom) LEFT JOIN (SELECT * FROM domain_rules WHERE status = 'APPROVED') d ON d.cmi = p.cmi AND d.from_uom = upper(uom) GROUP BY ALL"""


@query(f"SELECT from_uom, to_uom, factor, rule_type FROM {_ACTIVE} x")
def u2_active_rules(spark: SparkSession, d: str) -> DataFrame:
    return U.active_rules(mart(spark, d, "uom_rules"))


@query(f"SELECT uom, {_CLASS} AS uom_class, records FROM (SELECT uom, count(*) AS records FROM procurement GROUP BY uom) LEFT JOIN {_ACTIVE} r ON r.from_uom = upper(trim(uom))")
def u3_uom_classes(spark: SparkSession, d: str) -> DataFrame:
    return U.classified(rolls.units(spark, d).groupBy("uom").agg(F.sum("records").alias("records")), mart(spark, d, "uom_rules"))


@query(f"SELECT coalesce(r.to_uom, upper(uom)) AS norm_uom, count(*) AS records, cast(sum(qty_cents * coalesce(factor, 1)) AS bigint) AS norm_cents FROM procurement LEFT JOIN {_ACTIVE} r ON r.from_uom = upper(uom) GROUP BY 1")
def u4_comparable_total(spark: SparkSession, d: str) -> DataFrame:
    return U.comparable(rolls.units(spark, d), mart(spark, d, "uom_rules"))


@query(_comparable("p.cmi"))
def u5_comparable_scoped(spark: SparkSession, d: str) -> DataFrame:
    return U.comparable(rolls.units(spark, d), mart(spark, d, "uom_rules"), "cmi", domain_rules=mart(spark, d, "domain_rules"))


@query(_comparable("org_id"))
def u6_comparable_by_organization(spark: SparkSession, d: str) -> DataFrame:
    return U.comparable(rolls.units(spark, d), mart(spark, d, "uom_rules"), "org_id", domain_rules=mart(spark, d, "domain_rules"))


@query(_comparable("supplier_id"))
def u6_comparable_by_supplier(spark: SparkSession, d: str) -> DataFrame:
    return U.comparable(mart(spark, d, "procurement"), mart(spark, d, "uom_rules"), "supplier_id", domain_rules=mart(spark, d, "domain_rules"))


@query(f"""SELECT po, material_id, uom, coalesce(d.to_uom, r.to_uom, upper(uom)) AS norm_uom, cast(qty_cents * coalesce(d.factor, r.factor, 1) AS bigint) AS norm_cents,
CASE WHEN d.to_uom IS NOT NULL THEN 'DOMAIN' WHEN r.to_uom IS NOT NULL THEN 'SYSTEM' ELSE 'NONE' END AS rule_source
FROM procurement p LEFT JOIN {_ACTIVE} r ON r.from_uom = upper(uom) LEFT JOIN (SELECT * FROM domain_rules WHERE status = 'APPROVED') d ON d.cmi = p.cmi AND d.from_uom = upper(uom)""")
def u7_normalized_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = U.normalized(mart(spark, d, "procurement"), mart(spark, d, "uom_rules"), mart(spark, d, "domain_rules"))
    return rows.select("po", "material_id", "uom", "norm_uom", "norm_cents", "rule_source")


@query("""SELECT uom, count(*) AS records FROM procurement GROUP BY uom HAVING uom NOT IN ('EA', 'PCS', 'NOS', 'SET', 'KG', 'G', 'TON', 'L', 'ML', 'M', 'CM', 'MM') ORDER BY records DESC, uom LIMIT 50""")
def u9_unknown_uoms(spark: SparkSession, d: str) -> DataFrame:
    counts = rolls.units(spark, d).groupBy("uom").agg(F.sum("records").alias("records"))
    return counts.where(~F.col("uom").isin(U.V.KNOWN_UOMS)).orderBy(F.desc("records"), "uom").limit(50)


@query(f"SELECT cmi, uom, records, {_CLASS} AS uom_class FROM (SELECT cmi, uom, count(*) AS records FROM procurement WHERE cmi IS NOT NULL GROUP BY ALL) LEFT JOIN {_ACTIVE} r ON r.from_uom = upper(trim(uom))")
def u10_remediation_board(spark: SparkSession, d: str) -> DataFrame:
    counts = rolls.units(spark, d).where("cmi is not null").groupBy("cmi", "uom").agg(F.sum("records").alias("records"))
    return U.classified(counts, mart(spark, d, "uom_rules"))


@query("""SELECT cmi, from_uom, CASE WHEN status = 'PENDING' THEN 'APPROVED' ELSE CASE WHEN status = 'DISABLED' THEN 'APPROVED' ELSE status END END AS status, status IN ('PENDING', 'DISABLED') AS accepted FROM domain_rules""")
def u11_rule_transitions(spark: SparkSession, d: str) -> DataFrame:
    rules = mart(spark, d, "domain_rules")
    return U.change_rules(rules, rules.select("cmi", "from_uom", F.lit("APPROVED").alias("to_status")))


@query("SELECT event_id, rule_id, action FROM ledger QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY event_id DESC) = 1")
def u12_latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return U.latest_versions(mart(spark, d, "ledger"), "rule_id", F.col("event_id")).select("event_id", "rule_id", "action")


_ASKED = """SELECT rule_id * 2 + k AS request_id, rule_id, CASE WHEN rule_id % 11 = 0 THEN ' ea ' END AS from_uom, CASE WHEN rule_id % 7 = 0 THEN 'KG' WHEN rule_id % 13 = 0 THEN 'g' END AS to_uom, CASE WHEN rule_id % 17 = 0 THEN cast(0 AS bigint) WHEN rule_id % 2 = 0 THEN cast(6 AS bigint) END AS factor,
CASE WHEN rule_id % 19 = 0 THEN ' ' ELSE 'measured' END AS reason, rule_id % 7 + k AS actor, CASE WHEN rule_id % 4 = 3 THEN 'reject' ELSE 'approve' END AS decision FROM governed_rules CROSS JOIN (VALUES (0), (1)) AS v(k)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_ASKED.replace("FROM governed_rules", "FROM {rules}"), rules=mart(spark, d, "governed_rules"))


@query(f"""WITH q AS (SELECT a.request_id, a.rule_id, a.reason, r.status, r.pending_version, r.effective_version, upper(trim(coalesce(a.from_uom, r.from_uom))) AS f, upper(trim(coalesce(a.to_uom, r.to_uom))) AS t, coalesce(a.factor, r.factor) AS x FROM ({_ASKED}) a JOIN governed_rules r USING (rule_id)),
p AS (SELECT *, CASE WHEN status NOT IN ('APPROVED', 'DISABLED') THEN 'not_amendable' WHEN pending_version IS NOT NULL THEN 'already_pending' WHEN f = '' THEN 'empty_unit' WHEN f = t THEN 'same_unit' WHEN t NOT IN ('EA', 'G', 'ML', 'MM') THEN 'not_canonical' WHEN x <= 0 THEN 'bad_factor'
WHEN trim(reason) = '' THEN 'no_reason' END AS fault FROM q), o AS (SELECT *, coalesce(fault, CASE WHEN row_number() OVER (PARTITION BY rule_id, fault ORDER BY request_id) > 1 THEN 'already_pending' ELSE 'proposed' END) AS outcome FROM p)
SELECT request_id, rule_id, outcome, CASE WHEN outcome = 'proposed' THEN coalesce((SELECT max(version_number) FROM rule_versions v WHERE v.rule_id = o.rule_id), 0) + 1 END AS version_number, CASE WHEN outcome = 'proposed' THEN effective_version END AS supersedes,
CASE WHEN outcome = 'proposed' THEN f END AS from_uom, CASE WHEN outcome = 'proposed' THEN t END AS to_uom, CASE WHEN outcome = 'proposed' THEN x END AS factor FROM o""")
def u12_proposed_amendments(spark: SparkSession, d: str) -> DataFrame:
    return U.proposed_amendments(mart(spark, d, "governed_rules"), mart(spark, d, "rule_versions"), _asked(spark, d))


@query(f"""WITH q AS (SELECT a.request_id, a.rule_id, decision, r.effective_version, r.pending_version, r.factor, v.factor AS x, CASE WHEN r.pending_version IS NULL OR r.effective_version IS NULL THEN 'nothing_pending' WHEN v.created_by = a.actor THEN 'own_proposal' END AS fault
FROM ({_ASKED}) a JOIN governed_rules r USING (rule_id) LEFT JOIN rule_versions v ON v.version_id = r.pending_version), o AS (SELECT *, coalesce(fault, CASE WHEN row_number() OVER (PARTITION BY rule_id, fault ORDER BY request_id) > 1 THEN 'nothing_pending' WHEN decision = 'approve' THEN 'approved' ELSE 'rejected' END) AS outcome FROM q)
SELECT request_id, rule_id, outcome, CASE WHEN outcome = 'approved' THEN pending_version ELSE effective_version END AS version_id, CASE WHEN outcome = 'approved' THEN x ELSE factor END AS factor FROM o""")
def u12_decided_amendments(spark: SparkSession, d: str) -> DataFrame:
    return U.decided_amendments(mart(spark, d, "governed_rules"), mart(spark, d, "rule_versions"), _asked(spark, d))


_QUALITY = f"SELECT uom, {_CLASS} AS uom_class, records FROM (SELECT uom, count(*) AS records FROM procurement GROUP BY uom) LEFT JOIN {_ACTIVE} r ON r.from_uom = upper(trim(uom))"
_REMEDIED = "(SELECT count(DISTINCT cmi) FROM procurement WHERE cmi IS NOT NULL AND upper(trim(uom)) NOT IN ('EA', 'PCS', 'NOS', 'SET', 'KG', 'G', 'TON', 'L', 'ML', 'M', 'CM', 'MM'))"
_SINCE = "2024-01-15"


def _quality(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = rolls.units(spark, d)
    return U.quality_counts(records, mart(spark, d, "uom_rules")), U.remedied_cmis(records)


@query(f"SELECT uom_class, count(*) AS units, cast(sum(records) AS bigint) AS records FROM ({_QUALITY}) GROUP BY uom_class")
def u9_quality_counts(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)[0].groupBy("uom_class").agg(F.count("*").alias("units"), F.sum("records").alias("records"))


@query(f"""WITH q AS ({_QUALITY}), h AS (SELECT * FROM rule_history WHERE ts >= TIMESTAMP '{_SINCE}')
SELECT 'rules' AS section, 'total' AS name, count(*) AS n FROM governed_rules UNION ALL SELECT 'rules', lower(s), (SELECT count(*) FROM governed_rules WHERE status = s) FROM (VALUES ('PENDING'), ('APPROVED'), ('REJECTED'), ('DISABLED')) v(s)
UNION ALL SELECT 'quality', 'total', cast(sum(records) AS bigint) FROM q UNION ALL SELECT 'quality', lower(k), (SELECT cast(coalesce(sum(records), 0) AS bigint) FROM q WHERE uom_class = k) FROM (VALUES ('INVALID'), ('ALIAS_NORMALIZED'), ('SCALED'), ('NORMALIZED'), ('UNCONVERTED'), ('UNKNOWN')) v(k)
UNION ALL SELECT 'quality', 'not_converted', cast(coalesce(sum(records), 0) AS bigint) FROM q WHERE uom_class IN ('UNCONVERTED', 'UNKNOWN') UNION ALL SELECT 'quality', 'cmis_to_remedy', {_REMEDIED}
UNION ALL SELECT 'activity', lower(x), (SELECT count(*) FROM h WHERE action = x) FROM (VALUES ('CREATE'), ('APPROVE'), ('REJECT'), ('DISABLE'), ('RE_ENABLE')) v(x)
UNION ALL SELECT 'amendments', 'proposed', count(*) FROM h WHERE action = 'AMEND' UNION ALL SELECT 'amendments', 'approved', count(*) FROM h WHERE action = 'APPROVE' AND previous_version IS NOT NULL UNION ALL SELECT 'amendments', 'rejected', count(*) FROM h WHERE action = 'REJECT' AND previous_version IS NOT NULL
UNION ALL SELECT 'amendments', 'pending', count(*) FROM governed_rules WHERE pending_version IS NOT NULL AND effective_version IS NOT NULL UNION ALL SELECT 'versions', 'total', count(*) FROM rule_versions UNION ALL SELECT 'versions', 'superseded', count(supersedes) FROM rule_versions""")
def u14_steward_overview(spark: SparkSession, d: str) -> DataFrame:
    return U.steward_overview(mart(spark, d, "governed_rules"), mart(spark, d, "rule_versions"), mart(spark, d, "rule_history"), *_quality(spark, d), _SINCE)


_PENDING_QUEUE = """SELECT rule_id, cmi, from_uom, (SELECT count(*) FROM rule_history h WHERE h.rule_id = r.rule_id) AS events, (SELECT count(*) FROM procurement p WHERE p.cmi = r.cmi) AS cmi_records,
(SELECT count(*) FROM procurement p WHERE p.cmi = r.cmi AND upper(trim(uom)) = r.from_uom) AS affected FROM governed_rules r WHERE status = 'PENDING'"""
_AMENDMENT_QUEUE = """SELECT r.rule_id, cmi, e.version_number AS effective_number, v.version_number AS proposed_number, v.from_uom, v.factor, (SELECT count(*) FROM procurement p WHERE p.cmi = r.cmi AND upper(trim(uom)) = v.from_uom) AS affected
FROM governed_rules r JOIN rule_versions e ON e.version_id = r.effective_version JOIN rule_versions v ON v.version_id = r.pending_version"""


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return U.pending_queue(mart(spark, d, "governed_rules"), mart(spark, d, "rule_history"), rolls.units(spark, d))


def _amendments(spark: SparkSession, d: str) -> DataFrame:
    return U.amendment_queue(mart(spark, d, "governed_rules"), mart(spark, d, "rule_versions"), rolls.units(spark, d))


@query(_PENDING_QUEUE)
def u14_pending_queue(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d)


@query(_AMENDMENT_QUEUE)
def u14_amendment_queue(spark: SparkSession, d: str) -> DataFrame:
    return _amendments(spark, d)


@query("SELECT history_id, h.rule_id, action, actor, status FROM rule_history h LEFT JOIN governed_rules r ON r.rule_id = h.rule_id ORDER BY history_id DESC LIMIT 25")
def u14_recent_activity(spark: SparkSession, d: str) -> DataFrame:
    rows = mart(spark, d, "rule_history").orderBy(F.desc("history_id")).limit(25)
    return rows.join(mart(spark, d, "governed_rules").select("rule_id", "status"), "rule_id", "left").select("history_id", "rule_id", "action", "actor", "status")


def _ledgers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rule history, and an audit of it: two seconds late, every seventh event missing, every eleventh an hour off, every thirteenth of another factor."""
    rows, n = mart(spark, d, "rule_history"), F.col("history_id")
    late = F.when(n % 11 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval 2 seconds"))
    action = F.try_element_at(F.create_map(*[F.lit(x) for pair in U.EXPECTED_AUDIT.items() for x in pair]), F.col("action"))
    factor = F.when(n % 13 == 0, F.col("factor") + 1).otherwise(F.col("factor"))
    details = F.when(n % 2 == 0, F.to_json(F.struct(F.col("from_uom").alias("fromUom"), factor.alias("factor")))).otherwise(F.to_json(F.struct(F.struct(F.col("to_uom").alias("toUom"), factor.alias("factor")).alias("proposed"))))
    audit = rows.where("history_id % 7 <> 0").select(n.alias("audit_id"), "rule_id", "actor", action.alias("action"), (F.col("ts") + late).alias("ts"), details.alias("details"))
    return rows, audit


# In these tables no two events of a rule, actor and action are within seconds of each other, so whatever fits is the pair.
_PAIRED = """au AS (SELECT history_id AS audit_id, rule_id, actor, action, CASE WHEN history_id % 11 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts + INTERVAL 2 SECOND END AS ts, CASE WHEN history_id % 13 = 0 THEN factor + 1 ELSE factor END AS said FROM rule_history WHERE history_id % 7 <> 0),
pr AS (SELECT h.history_id, h.factor, a.audit_id, a.said FROM rule_history h JOIN au a ON a.rule_id = h.rule_id AND a.actor = h.actor AND a.action = h.action AND abs(epoch_us(a.ts) - epoch_us(h.ts)) <= 5000000)"""


@query(f"WITH {_PAIRED} SELECT history_id, h.rule_id, h.action, audit_id, said = pr.factor AS details_match FROM rule_history h LEFT JOIN pr USING (history_id)")
def u15_ledger_agreement(spark: SparkSession, d: str) -> DataFrame:
    history, audit = _ledgers(spark, d)
    return U.agreement(U.paired_ledgers(history, audit), history, audit)


@query(f"""WITH {_PAIRED} SELECT rule_id, history_id, NULL::BIGINT AS audit_id, 'MISSING_AUDIT_EVENT' AS finding FROM rule_history WHERE history_id NOT IN (SELECT history_id FROM pr)
UNION ALL SELECT rule_id, NULL, audit_id, 'UNEXPECTED_AUDIT_EVENT' FROM au WHERE audit_id NOT IN (SELECT audit_id FROM pr)""")
def u16_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return U.reconciliation(U.paired_ledgers(*_ledgers(spark, d)))


_TODAY = "1998-12-31"


@query("""SELECT q.match_id, q.priority, m.created, m.a, m.b, m.final_score FROM review_queue q JOIN matches m ON m.match_id = q.match_id WHERE q.status = 'open' ORDER BY m.created, q.match_id LIMIT 25""")
def u17_open_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The open reviews, oldest first."""
    return U.open_reviews(mart(spark, d, "review_queue"), mart(spark, d, "matches")).orderBy("created", "match_id").limit(25)


_SUMMED = f"""SELECT (SELECT count(*) FROM review_queue WHERE status = 'open') AS open_reviews, (SELECT count(*) FROM governed_rules WHERE status = 'PENDING') AS pending_rules, (SELECT count(*) FROM governed_rules WHERE status = 'APPROVED') AS approved_rules,
(SELECT count(*) FROM governed_rules WHERE status = 'APPROVED' AND effective_version IS NOT NULL) AS active_rules, (SELECT count(*) FROM governed_rules WHERE pending_version IS NOT NULL AND effective_version IS NOT NULL) AS pending_amendments,
(SELECT count(*) FROM organizations o WHERE o.org_id NOT IN (SELECT org_id FROM materials WHERE cmi IS NOT NULL AND size < 2)) AS organizations_unmapped, (SELECT least(count(*), 50) FROM ({_QUALITY}) WHERE uom NOT IN ('EA', 'PCS', 'NOS', 'SET', 'KG', 'G', 'TON', 'L', 'ML', 'M', 'CM', 'MM')) AS unknown_units,
(SELECT cast(coalesce(sum(records), 0) AS bigint) FROM ({_QUALITY}) WHERE uom_class IN ('UNCONVERTED', 'UNKNOWN')) AS unconverted_records, {_REMEDIED} AS cmis_to_remedy, (SELECT count(*) FROM rule_history WHERE ts >= TIMESTAMP '{_SINCE}') AS recent_events"""


def _summed(spark: SparkSession, d: str) -> DataFrame:
    mapped = mart(spark, d, "materials").where("cmi is not null and size < 2")
    return U.governance_summary(mart(spark, d, "review_queue"), mart(spark, d, "governed_rules"), mart(spark, d, "organizations"), mapped, mart(spark, d, "rule_history"), *_quality(spark, d), _SINCE)


@query(_SUMMED)
def u18_governance_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summed(spark, d)


@query("""SELECT strftime(purchase_date, '%Y-%m') AS month, count(*) FILTER (status = 'OPEN') AS opened, count(*) FILTER (status = 'RECEIVED') AS received, count(*) FILTER (cmi IS NULL) AS unlinked
FROM procurement GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def u19_monthly_pivot(spark: SparkSession, d: str) -> DataFrame:
    months = mart(spark, d, "procurement").groupBy(F.date_format("purchase_date", "yyyy-MM").alias("month"))
    sums = months.agg(F.count_if(F.col("status") == "OPEN").alias("opened"), F.count_if(F.col("status") == "RECEIVED").alias("received"), F.count_if(F.col("cmi").isNull()).alias("unlinked"))
    return sums.orderBy(F.desc("month")).limit(12)


@query("""SELECT source, id FROM (SELECT 'rules' AS source, event_id AS id, ts FROM ledger WHERE action = 'click' UNION ALL SELECT 'audit', event_id, ts FROM ledger WHERE action <> 'click') ORDER BY ts DESC, source, id DESC LIMIT 50""")
def u20_activity_feed(spark: SparkSession, d: str) -> DataFrame:
    rows = mart(spark, d, "ledger")
    feed = lambda name, test: rows.where(test).select(F.lit(name).alias("source"), F.col("event_id").alias("id"), "ts")
    return U.activity_feed(feed("rules", "action = 'click'"), feed("audit", "action <> 'click'")).select("source", "id")


@query(f"""SELECT 'unknown_uom' AS indicator, (SELECT count(*) FROM procurement WHERE uom = 'bX9') AS n UNION ALL SELECT 'unlinked', (SELECT count(*) FROM procurement WHERE cmi IS NULL)
UNION ALL SELECT 'unpriced', (SELECT count(*) FROM procurement WHERE unit_price IS NULL) UNION ALL SELECT 'pending_rules', (SELECT count(*) FROM domain_rules WHERE status = 'PENDING')""")
def u21_cockpit(spark: SparkSession, d: str) -> DataFrame:
    sums = mart(spark, d, "procurement").agg(F.count_if(~F.col("uom").isin(U.V.KNOWN_UOMS)).alias("unknown_uom"), F.count_if(F.col("cmi").isNull()).alias("unlinked"), F.count_if(F.col("unit_price").isNull()).alias("unpriced"))
    rules = mart(spark, d, "domain_rules").agg(F.count_if(F.col("status") == "PENDING").alias("pending_rules"))
    return sums.crossJoin(rules).unpivot([], ["unknown_uom", "unlinked", "unpriced", "pending_rules"], "indicator", "n")


@query(f"""WITH s AS ({_SUMMED}), q AS ({_QUALITY}) SELECT 'MATCH_REVIEW' AS type, cast(match_id AS varchar) AS ref, priority AS scope, cast(1 AS bigint) AS n FROM (SELECT * FROM review_queue WHERE status = 'open' ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, match_id LIMIT 15)
UNION ALL SELECT 'UOM_RULE_APPROVAL', cast(rule_id AS varchar), cmi, affected FROM ({_PENDING_QUEUE}) UNION ALL SELECT 'UOM_RULE_AMENDMENT', cast(rule_id AS varchar), cmi, affected FROM ({_AMENDMENT_QUEUE})
UNION ALL SELECT 'UOM_REMEDIATION', uom, 'all', records FROM (SELECT * FROM q WHERE uom NOT IN ('EA', 'PCS', 'NOS', 'SET', 'KG', 'G', 'TON', 'L', 'ML', 'M', 'CM', 'MM') ORDER BY records DESC, uom LIMIT 50)
UNION ALL SELECT 'CMI_GOVERNANCE', 'unmapped organizations', 'all', organizations_unmapped FROM s WHERE organizations_unmapped > 0""")
def u21_work_queue(spark: SparkSession, d: str) -> DataFrame:
    return U.work_queue(mart(spark, d, "review_queue"), _pending(spark, d), _amendments(spark, d), _quality(spark, d)[0], _summed(spark, d))


@query(f"""WITH s AS ({_SUMMED}) SELECT 'ledger_agreement' AS indicator, 'PASS' AS state, cast(0 AS bigint) AS n FROM s UNION ALL SELECT 'effective_versions', CASE WHEN approved_rules = 0 OR approved_rules = active_rules THEN 'PASS' ELSE 'WARNING' END, approved_rules - active_rules FROM s
UNION ALL SELECT 'pending_decisions', CASE WHEN pending_rules + pending_amendments > 0 THEN 'ACTION REQUIRED' ELSE 'PASS' END, pending_rules + pending_amendments FROM s UNION ALL SELECT 'unit_quality', CASE WHEN unconverted_records > 0 THEN 'WARNING' ELSE 'PASS' END, unconverted_records FROM s
UNION ALL SELECT 'review_backlog', CASE WHEN open_reviews = 0 THEN 'PASS' WHEN (SELECT DATE '{_TODAY}' - min(created) FROM review_queue q JOIN matches m ON m.match_id = q.match_id WHERE q.status = 'open') > 30 THEN 'ACTION REQUIRED' ELSE 'WARNING' END, open_reviews FROM s UNION ALL SELECT 'cmi_coverage', CASE WHEN organizations_unmapped > 0 THEN 'WARNING' ELSE 'PASS' END, organizations_unmapped FROM s""")
def u21_health(spark: SparkSession, d: str) -> DataFrame:
    """The history against an audit that has every event once; the age of the open reviews by the last day of the tables."""
    history = mart(spark, d, "rule_history")
    action = F.try_element_at(F.create_map(*[F.lit(x) for pair in U.EXPECTED_AUDIT.items() for x in pair]), F.col("action"))
    findings = U.reconciliation(U.paired_ledgers(history, history.select(F.col("history_id").alias("audit_id"), "rule_id", "actor", action.alias("action"), "ts")))
    return U.health(_summed(spark, d), findings.agg(F.count("*").alias("issues")), U.oldest_review(U.open_reviews(mart(spark, d, "review_queue"), mart(spark, d, "matches")), _TODAY))
