"""Match review, run records, rule resolution and import reports (W, D, E, U, V) over the mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelink.operators import audit as A
from orelink.operators import evaluation as E
from orelink.operators import uom as U
from orelink.operators import workflow as W
from orelink.plans.imports import _CHECKED, _ROWS, _rows, _stored
from orelink.plans.registry import Registry
from orelink.sources import imports as I
from orelink.sources.mart import mart
from orelink.sources.scratch import written_once

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _context(spark: SparkSession, d: str) -> DataFrame:
    return W.in_context(mart(spark, d, "matches"), mart(spark, d, "materials"), mart(spark, d, "organizations"))


_CONTEXT = """SELECT m.*, x.org_code AS org_a, y.org_code AS org_b, s.category AS category_a, c.category AS category_b, s.manufacturer AS manufacturer_a, c.manufacturer AS manufacturer_b
FROM matches m JOIN materials s ON s.material_id = m.a JOIN organizations x ON x.org_id = s.org_id JOIN materials c ON c.material_id = m.b JOIN organizations y ON y.org_id = c.org_id"""


@query("""SELECT q.match_id, q.priority, q.status FROM review_queue q WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.match_id = q.match_id AND m.status = 'pending')""")
def w5_delete_pending(spark: SparkSession, d: str) -> DataFrame:
    return W.without_children_of_pending(mart(spark, d, "review_queue"), mart(spark, d, "matches"))


@query("""SELECT match_id, priority, status FROM review_queue UNION ALL
SELECT match_id, CASE match_type WHEN 'needs_review' THEN 'high' WHEN 'identical' THEN 'low' ELSE 'medium' END, 'open' FROM matches WHERE match_id NOT IN (SELECT match_id FROM review_queue)""")
def w6_enqueued(spark: SparkSession, d: str) -> DataFrame:
    return W.enqueued(mart(spark, d, "review_queue"), mart(spark, d, "matches"))


@query(f"""WITH c AS ({_CONTEXT}), f AS (SELECT * FROM c WHERE status = 'pending' AND (org_a = 'ASIA' OR org_b = 'ASIA') AND final_score >= 30 AND final_score <= 95 AND evidence ->> '$.decision.state' = 'TECHNICAL_CONFLICT'
AND json_array_length(evidence, '$.criticalConflicts') > 0) SELECT match_id, a, b, final_score, match_type, (SELECT count(*) FROM f) AS total FROM f ORDER BY final_score DESC, match_id LIMIT 10 OFFSET 10""")
def w7_list_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = W.listed(_context(spark, d), 30, 95, True, status="pending", organization="ASIA", decision="TECHNICAL_CONFLICT")
    return W.page_of(rows, "score_desc", 2, 10).select("match_id", "a", "b", "final_score", "match_type", "total")


@query("""SELECT count(*) AS approved, count(*) FILTER (x.cmi IS NULL OR y.cmi IS NULL OR x.cmi <> y.cmi) AS awaiting_cmi, count(*) FILTER (x.cmi = y.cmi) AS cmi_created
FROM matches LEFT JOIN materials x ON x.material_id = a LEFT JOIN materials y ON y.material_id = b WHERE status = 'approved'""")
def w10_approval_funnel(spark: SparkSession, d: str) -> DataFrame:
    return W.funnel(mart(spark, d, "matches"), mart(spark, d, "materials").select("material_id", "cmi"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("match_id")
    requests = mart(spark, d, "matches").where("match_id % 4 <> 0").select(
        "match_id", F.when(n % 3 == 0, "rejected").otherwise("approved").alias("to_status"), F.when(n % 5 == 0, "pending").when(n % 5 == 1, "approved").alias("expected_status")
    )
    return W.decided(mart(spark, d, "matches"), requests)


_OUTCOME = """SELECT match_id, CASE WHEN match_id % 4 = 0 THEN NULL WHEN match_id % 5 = 0 AND status <> 'pending' OR match_id % 5 = 1 AND status <> 'approved' THEN 'stale'
WHEN status <> 'pending' THEN 'not_pending' ELSE 'decided' END AS outcome, status AS old FROM matches"""


@query(f"SELECT match_id, outcome, CASE WHEN outcome = 'decided' THEN CASE WHEN match_id % 3 = 0 THEN 'rejected' ELSE 'approved' END ELSE old END AS status FROM ({_OUTCOME}) x")
def w11_decide_match(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("match_id", "outcome", "status")


@query("""SELECT match_id, coalesce(x.cmi, y.cmi, 'CMI-' || match_id) AS cmi FROM matches LEFT JOIN materials x ON x.material_id = a LEFT JOIN materials y ON y.material_id = b
WHERE status = 'approved' AND (x.cmi IS NULL OR y.cmi IS NULL)""")
def w11_new_cmis(spark: SparkSession, d: str) -> DataFrame:
    return W.new_cmis(mart(spark, d, "matches"), mart(spark, d, "materials"))


@query(f"SELECT outcome, count(*) AS n FROM ({_OUTCOME}) x GROUP BY outcome")
def w12_staleness_guard(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({_CONTEXT}) SELECT (SELECT count(*) FROM review_queue WHERE status = 'open') AS open_reviews, count(*) FILTER (evidence ->> '$.decision.state' = 'HIGH_CONFIDENCE_MATCH') AS high_confidence,
count(*) FILTER (json_array_length(evidence, '$.criticalConflicts') > 0) AS technical_conflicts, count(*) FILTER (json_array_length(evidence, '$.missingCritical') > 0) AS missing_critical,
count(*) FILTER (evidence ->> '$.assemblyConfiguration' IS NOT NULL) AS assembly_differences, count(*) FILTER (upper(trim(manufacturer_a)) <> upper(trim(manufacturer_b))) AS cross_brand FROM c WHERE status = 'pending'""")
def w13_review_summary(spark: SparkSession, d: str) -> DataFrame:
    return W.review_summary(_context(spark, d), mart(spark, d, "review_queue"))


@query("""WITH f AS (SELECT match_id, priority, final_score FROM review_queue q JOIN matches m USING (match_id) WHERE q.status = 'open')
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, final_score DESC, match_id LIMIT 25""")
def w18_review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = mart(spark, d, "review_queue").where("status = 'open'").drop("status").join(mart(spark, d, "matches"), "match_id")
    return W.page_of(rows.select("match_id", "priority", "final_score"), "priority", 1, 25)


@query("""SELECT match_id, final_score, critical_difference FROM matches WHERE status = 'pending' ORDER BY critical_difference IS NULL, NOT coalesce(starts_with(critical_difference, 'seal'), false), final_score DESC, match_id LIMIT 3""")
def w19_attention(spark: SparkSession, d: str) -> DataFrame:
    return W.attention(mart(spark, d, "matches")).select("match_id", "final_score", "critical_difference")


_PRECEDENCE = """WITH live AS (SELECT cmi, from_uom, count(*) AS n, min(to_uom) AS to_uom, min(factor) AS factor FROM domain_rules WHERE status = 'APPROVED' GROUP BY ALL),
sys AS (SELECT from_uom, min(to_uom) AS to_uom, min(factor) AS factor FROM uom_rules WHERE rule_type IN ('ALIAS', 'SCALE') GROUP BY 1 HAVING count(*) = 1)
SELECT p.cmi, p.uom, CASE WHEN n = 1 THEN l.to_uom WHEN n IS NULL THEN s.to_uom END AS to_uom, CASE WHEN n = 1 THEN l.factor WHEN n IS NULL THEN s.factor END AS factor,
CASE WHEN n = 1 THEN 'DOMAIN' WHEN n IS NULL AND s.to_uom IS NOT NULL THEN 'SYSTEM' END AS rule_source
FROM (SELECT DISTINCT cmi, uom FROM procurement) p LEFT JOIN live l ON l.cmi = p.cmi AND l.from_uom = upper(trim(p.uom)) LEFT JOIN sys s ON s.from_uom = upper(trim(p.uom))"""


@query(_PRECEDENCE)
def u8_effective_rules(spark: SparkSession, d: str) -> DataFrame:
    asked = mart(spark, d, "procurement").select("cmi", "uom").distinct()
    return U.effective_rules(asked, mart(spark, d, "uom_rules"), mart(spark, d, "domain_rules"))


@query("""SELECT rule_id, event_id, action, n, events FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY event_id DESC) AS n, count(*) OVER (PARTITION BY rule_id) AS events FROM ledger) WHERE n <= 5""")
def u13_rule_history(spark: SparkSession, d: str) -> DataFrame:
    rows = mart(spark, d, "ledger")
    history = U.appended(rows.where("action <> 'click'"), rows)  # those stored already are ignored
    return U.history_page(history).select("rule_id", "event_id", "action", F.col("n").cast("long").alias("n"), "events")


_JUDGED = """SELECT doc_id % 10 AS run_id, CASE WHEN quality = 1 THEN 'MATCH' WHEN doc_id % 2 = 0 THEN 'NEEDS_REVIEW' ELSE 'NOT_A_MATCH' END AS ground_truth,
CASE WHEN toxic = 0 THEN 'MATCH' WHEN doc_id % 3 = 0 THEN 'NEEDS_REVIEW' ELSE 'NOT_A_MATCH' END AS predicted, source AS category, n_chars AS score, doc_id FROM labels JOIN documents USING (doc_id)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    truth = F.when(F.col("quality") == 1, "MATCH").when(F.col("doc_id") % 2 == 0, "NEEDS_REVIEW").otherwise("NOT_A_MATCH")
    said = F.when(F.col("toxic") == 0, "MATCH").when(F.col("doc_id") % 3 == 0, "NEEDS_REVIEW").otherwise("NOT_A_MATCH")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars")
    rows = spark.read.parquet(f"{d}/labels.parquet").join(docs, "doc_id")
    return rows.select((F.col("doc_id") % 10).alias("run_id"), truth.alias("ground_truth"), said.alias("predicted"), F.col("source").alias("category"), F.col("n_chars").alias("score"), "doc_id")


_RUNS = f"""SELECT run_id, count(*) AS pairs, round(count(*) FILTER (ground_truth = predicted) / count(*), 4) AS accuracy, count(*) FILTER (ground_truth = 'NOT_A_MATCH' AND predicted = 'MATCH') AS false_positives,
count(*) FILTER (ground_truth = 'MATCH' AND predicted = 'NOT_A_MATCH') AS false_negatives, round(count(*) FILTER (predicted = 'NEEDS_REVIEW') / count(*), 4) AS review_rate FROM ({_JUDGED}) j GROUP BY run_id"""


@query(f"{_RUNS} ORDER BY run_id")
def d9_evaluation_runs(spark: SparkSession, d: str) -> DataFrame:
    return E.runs(_judged(spark, d)).orderBy("run_id")


@query(f"SELECT predicted, min(score) AS low, max(score) AS high FROM ({_JUDGED}) j GROUP BY predicted")
def e5_score_ranges(spark: SparkSession, d: str) -> DataFrame:
    return E.score_ranges(_judged(spark, d))


@query(f"""WITH r AS (SELECT predicted, min(score) AS low, max(score) AS high, list_position(['MATCH', 'NEEDS_REVIEW', 'NOT_A_MATCH'], predicted) AS k FROM ({_JUDGED}) j GROUP BY predicted)
SELECT x.predicted AS a, y.predicted AS b FROM r x JOIN r y ON x.k < y.k AND x.low <= y.high AND y.low <= x.high""")
def e5_score_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return E.overlaps(E.score_ranges(_judged(spark, d)))


@query(f"SELECT category, count(*) AS pairs, round(count(*) FILTER (ground_truth = predicted) / count(*), 4) AS agreement, count(*) >= 8 AS sufficient FROM ({_JUDGED}) j GROUP BY category")
def e5_category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return E.by_category(_judged(spark, d))


@query(f"""SELECT count(*) AS expected, count(*) FILTER (starts_with(critical_difference, 'seal')) AS detected, round(count(*) FILTER (starts_with(critical_difference, 'seal')) / count(*), 4) AS rate
FROM matches WHERE critical_difference IS NOT NULL""")
def e5_conflict_rate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("critical_difference")
    pairs = mart(spark, d, "matches").select(F.when(c.isNotNull(), "critical").alias("conflict_expected"), F.when(c.isNotNull(), "seal").alias("conflict_attribute"), F.coalesce(c.startswith("seal"), F.lit(False)).alias("conflict_detected"))
    return E.conflict_rate(pairs)


@query(f"SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'pairs' ELSE 'false_negatives' END AS problem FROM ({_RUNS}) r WHERE run_id % 4 <> 3")
def e7_run_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Runs recorded with one pair too many (even runs) or one missed match too many (one in four), against their pairs."""
    pairs, run = _judged(spark, d), F.col("run_id")
    recorded = E.runs(pairs).withColumns({"pairs": F.col("pairs") + (run % 2 == 0).cast("long"), "false_negatives": F.col("false_negatives") + (run % 4 == 1).cast("long")})
    return E.inconsistent_runs(recorded, pairs)


@query(f"""WITH {_CHECKED} SELECT row_number, array_to_string(list_concat(errors, warnings), '; ') AS rules, (SELECT count(*) FROM c JOIN ({_ROWS}) r USING (row_number) WHERE len(errors) > 0 AND
contains(lower(concat_ws('|', row_number, material_code, description, category, uom, manufacturer, quantity)), 'bag')) AS total
FROM c JOIN ({_ROWS}) r USING (row_number) WHERE len(errors) > 0 AND contains(lower(concat_ws('|', row_number, material_code, description, category, uom, manufacturer, quantity)), 'bag') ORDER BY row_number LIMIT 20 OFFSET 20""")
def v6_report_page(spark: SparkSession, d: str) -> DataFrame:
    page = I.report_page(I.validated(_rows(spark, d), _stored(spark, d)), 2, 20, "ERROR", "bag")
    return page.select("row_number", F.array_join(F.transform("problems", lambda p: p["rule"]), "; ").alias("rules"), "total")


@query(f"WITH {_CHECKED} SELECT row_number FROM c WHERE len(errors) > 0 AND len(list_filter(errors, lambda x: x NOT IN ('duplicate_in_database', 'duplicate_in_file'))) = 0")
def v8_duplicates_only(spark: SparkSession, d: str) -> DataFrame:
    return I.validated(_rows(spark, d), _stored(spark, d)).where(I.duplicate_only()).select("row_number")


@query(f"""WITH {_CHECKED} SELECT row_number, CASE WHEN len(errors) = 0 THEN 'inserted' WHEN errors = ['duplicate_in_database'] THEN 'updated' ELSE 'skipped' END AS outcome FROM c""")
def v15_perform_import(spark: SparkSession, d: str) -> DataFrame:
    return I.performed(I.validated(_rows(spark, d), _stored(spark, d)), True, "update").select("row_number", "outcome")


@query(f"""SELECT DISTINCT m.material_id, r.material_code AS code, first(r.description ORDER BY r.row_number) OVER (PARTITION BY r.material_code, m.material_id ORDER BY r.row_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS file_description, m.description AS stored_description
FROM ({_ROWS}) r JOIN materials m ON upper(m.code) = upper(r.material_code)""")
def v16_code_collisions(spark: SparkSession, d: str) -> DataFrame:
    stored = mart(spark, d, "materials")
    checked = I.validated(_rows(spark, d), stored.select(F.col("code").alias("material_code")))
    return I.code_collisions(checked, stored)


_EVIDENCE = """SELECT o_orderkey AS match_id, '{"comparisons":[{"name":"seal_type","type":"' || CASE o_custkey % 3 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'EXACT_MATCH' ELSE 'MISSING' END || '","critical":true,"value_a":"RS","value_b":"' || cast(o_custkey % 5 AS string)
|| '"},{"name":"size","type":"' || CASE o_custkey % 4 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'CLOSE_MATCH' WHEN 2 THEN 'NORMALIZED_MATCH' ELSE 'OTHER' END || '","critical":false,"value_a":"1","value_b":null}]}' AS evidence,
CASE o_custkey % 6 WHEN 0 THEN 'seal type: RS vs ZZ' WHEN 3 THEN 'voltage: 230 vs 415' WHEN 4 THEN ': ?' END AS critical_difference FROM orders"""


@query(f"""WITH m AS ({_EVIDENCE}), c AS (SELECT match_id, critical_difference, unnest(from_json(evidence -> '$.comparisons', '[{{"name":"VARCHAR","type":"VARCHAR","critical":"BOOLEAN","value_a":"VARCHAR","value_b":"VARCHAR"}}]')) AS x FROM m)
SELECT match_id, x.name AS attribute, x.value_a AS left_value, x.value_b AS right_value, CASE x.type WHEN 'EXACT_MATCH' THEN 'EXACT' WHEN 'NORMALIZED_MATCH' THEN 'NORMALIZED' WHEN 'CLOSE_MATCH' THEN 'CLOSE' WHEN 'MISSING' THEN 'MISSING' WHEN 'CONFLICT' THEN 'CONFLICT' ELSE 'NOT_APPLICABLE' END AS relation,
CASE WHEN x.critical THEN 'CRITICAL' WHEN x.type = 'CONFLICT' THEN 'IMPORTANT' ELSE 'INFORMATIONAL' END AS importance, 'comparison' AS source FROM c
UNION ALL SELECT match_id, CASE WHEN starts_with(critical_difference, ':') THEN 'critical_difference' ELSE split_part(critical_difference, ':', 1) END, NULL, NULL, 'CONFLICT', 'CRITICAL', 'stored_difference' FROM m
WHERE critical_difference IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.match_id = m.match_id AND x.type = 'CONFLICT' AND (contains(m.critical_difference, replace(x.name, '_', ' ')) OR contains(m.critical_difference, x.name)))""")
def w14_review_evidence(spark: SparkSession, d: str) -> DataFrame:
    text = _EVIDENCE.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}")
    return W.review_evidence(spark.sql(text, orders=spark.read.parquet(f"{d}/orders.parquet")))


@query(f"""WITH c AS ({_CONTEXT}) SELECT match_id, coalesce(evidence ->> '$.decision.state', 'UNCLASSIFIED') AS verdict, coalesce(evidence ->> '$.decision.band', 'unknown') AS band, coalesce(evidence ->> '$.decision.state', 'UNCLASSIFIED') IN ('NEEDS_TECHNICAL_REVIEW', 'UNCLASSIFIED') AS review_required,
CASE WHEN coalesce(manufacturer_a, '') = '' OR coalesce(manufacturer_b, '') = '' THEN 'unknown' WHEN upper(trim(manufacturer_a)) = upper(trim(manufacturer_b)) THEN 'same' ELSE 'different' END AS manufacturers,
CASE WHEN lower(trim(category_a)) = lower(trim(category_b)) THEN 'same_category' ELSE 'cross_category' END AS categories, cast(json_array_length(evidence, '$.missingCritical') AS int) AS missing FROM c""")
def w14_review_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return W.review_verdicts(_context(spark, d))


@query("""SELECT m.material_id, CASE WHEN i.row_report ->> '$.integration.adapterId' IS NOT NULL THEN coalesce(i.row_report ->> '$.integration.cpse', org_code) ELSE org_code END AS organization, i.row_report ->> '$.integration.adapterId' AS source_system, m.code AS record,
i.row_report ->> '$.integration.adapterVersion' AS adapter_version, i.file_name, CASE WHEN i.row_report ->> '$.integration.adapterId' IS NOT NULL THEN 'integration' WHEN m.material_id % 3 <> 0 THEN 'import_center' ELSE 'legacy' END AS channel
FROM materials m JOIN organizations o ON o.org_id = m.org_id LEFT JOIN imports i ON i.import_id = CASE WHEN m.material_id % 3 <> 0 THEN m.material_id % 100 + 1 END""")
def w15_source_trace(spark: SparkSession, d: str) -> DataFrame:
    rows = mart(spark, d, "materials").join(mart(spark, d, "organizations"), "org_id").withColumn("import_id", F.when(F.col("material_id") % 3 != 0, F.col("material_id") % 100 + 1))
    return W.source_trace(rows, mart(spark, d, "imports"))


@query("""SELECT import_id, org_id, status, row_report ->> '$.integration.adapterId' AS adapter, row_report ->> '$.integration.adapterVersion' AS version FROM imports WHERE (row_report -> '$.integration') IS NOT NULL""")
def s14_integration_history(spark: SparkSession, d: str) -> DataFrame:
    return W.integration_history(mart(spark, d, "imports"))


_BLOCKS = """SELECT 'totals' AS block, 'materials' AS name, count(*) AS n FROM mt UNION ALL SELECT 'totals', 'mappings', count(cmi) FROM mt UNION ALL SELECT 'totals', 'pending_reviews', count(*) FROM q WHERE status = 'open' UNION ALL SELECT 'totals', 'common_identities', count(*) FROM cmis
UNION ALL SELECT 'totals', 'organizations', count(*) FROM organizations UNION ALL SELECT 'totals', 'near_equivalents', count(*) FROM ma WHERE status = 'pending' AND match_type = 'near_equivalent' UNION ALL SELECT 'totals', 'identical', count(*) FROM ma WHERE status = 'pending' AND match_type = 'identical'
UNION ALL SELECT 'totals', 'critical_conflicts', count(*) FROM ma WHERE status = 'pending' AND critical_difference IS NOT NULL UNION ALL SELECT 'totals', 'imports_completed', count(*) FROM im WHERE status = 'completed' UNION ALL SELECT 'totals', 'imports_pending', count(*) FROM im WHERE status IN ('pending', 'processing')
UNION ALL SELECT 'match_type', match_type, count(*) FROM ma GROUP BY 2 UNION ALL SELECT 'match_status', status, count(*) FROM ma GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM mt GROUP BY 2 UNION ALL SELECT 'open_queue', priority, count(*) FROM q WHERE status = 'open' GROUP BY 2
UNION ALL SELECT 'queue_status', status, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'decision', coalesce(evidence ->> '$.decision.state', 'UNCLASSIFIED'), count(*) FROM ma GROUP BY 2"""


def _dashboard(spark: SparkSession, d: str, org_id: int | None = None) -> DataFrame:
    return W.dashboard(*[mart(spark, d, t) for t in ("materials", "matches", "review_queue", "imports", "organizations", "cmis")], org_id=org_id)


@query(f"WITH mt AS (SELECT * FROM materials), ma AS (SELECT * FROM matches), q AS (SELECT * FROM review_queue), im AS (SELECT * FROM imports) {_BLOCKS}")
def d1_dashboard_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _dashboard(spark, d)


@query(f"""WITH mt AS (SELECT * FROM materials WHERE org_id = 2), ma AS (SELECT * FROM matches m WHERE a IN (SELECT material_id FROM materials WHERE org_id = 2) OR b IN (SELECT material_id FROM materials WHERE org_id = 2)),
q AS (SELECT * FROM review_queue WHERE match_id IN (SELECT match_id FROM ma)), im AS (SELECT * FROM imports WHERE org_id = 2) {_BLOCKS}""")
def d1_organization_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return _dashboard(spark, d, 2)


@query("""SELECT regexp_extract(reason, 'conflict: ([a-z_]+):', 1) AS attribute, reason, n FROM (SELECT 'critical technical conflict: ' || critical_difference AS reason, count(*) AS n FROM matches
WHERE evidence ->> '$.decision.state' = 'TECHNICAL_CONFLICT' AND critical_difference IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 12)""")
def d4_top_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return W.conflict_attributes(mart(spark, d, "matches"))


_RULE_REQUESTS = """SELECT rule_id * 3 + k AS request_id, CASE WHEN rule_id % 23 = 0 THEN -rule_id ELSE rule_id END AS rule_id, CASE (rule_id + k) % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'DISABLED' ELSE 'REJECTED' END AS to_status,
rule_id % 7 + k AS actor, cast('2024-01-01 00:00:00' AS timestamp) + make_interval(0, 0, 0, 0, 0, cast(rule_id AS int), 10 * k) AS ts FROM governed_rules CROSS JOIN (VALUES (0), (1), (2)) AS v(k)"""
_RULE_REQUESTS_SQL = _RULE_REQUESTS.replace("make_interval(0, 0, 0, 0, 0, cast(rule_id AS int), 10 * k)", "to_minutes(rule_id::INT) + to_seconds(10 * k)")
_RULES_DECIDED = f"""q AS ({_RULE_REQUESTS_SQL}), j AS (SELECT q.*, g.status AS previous, g.factor, coalesce(g.status || '>' || to_status IN ('PENDING>APPROVED', 'PENDING>REJECTED', 'APPROVED>DISABLED', 'DISABLED>APPROVED'), false) AS ok FROM q LEFT JOIN governed_rules g ON g.rule_id = q.rule_id),
o AS (SELECT *, CASE WHEN previous IS NULL THEN 'unknown_rule' WHEN NOT ok THEN 'not_allowed' WHEN row_number() OVER (PARTITION BY rule_id, ok ORDER BY request_id) > 1 THEN 'superseded' ELSE 'decided' END AS outcome FROM j)"""


def _rule_decisions(spark: SparkSession, d: str) -> DataFrame:
    rules = mart(spark, d, "governed_rules")
    return A.decided_rules(rules, spark.sql(_RULE_REQUESTS.replace("FROM governed_rules", "FROM {rules}"), rules=rules))


@query(f"""WITH {_RULES_DECIDED} SELECT request_id, rule_id, outcome, CASE WHEN outcome = 'decided' THEN CASE previous || to_status WHEN 'PENDINGAPPROVED' THEN 'APPROVE' WHEN 'PENDINGREJECTED' THEN 'REJECT' WHEN 'APPROVEDDISABLED' THEN 'DISABLE' ELSE 'RE_ENABLE' END END AS action, previous,
CASE WHEN outcome = 'decided' THEN to_status ELSE previous END AS status FROM o""")
def u11_decided_rules(spark: SparkSession, d: str) -> DataFrame:
    """Three requests on every rule, each with its outcome."""
    return _rule_decisions(spark, d).select("request_id", "rule_id", "outcome", "action", "previous", "status")


@query(f"WITH {_RULES_DECIDED} SELECT request_id AS history_id, rule_id, CASE previous || to_status WHEN 'PENDINGAPPROVED' THEN 'APPROVE' WHEN 'PENDINGREJECTED' THEN 'REJECT' WHEN 'APPROVEDDISABLED' THEN 'DISABLE' ELSE 'RE_ENABLE' END AS action, request_id AS audit_id, true AS details_match FROM o WHERE outcome = 'decided'")
def u15_written_ledgers(spark: SparkSession, d: str) -> DataFrame:
    """History and audit that the library wrote for one set of decisions: they agree."""
    decisions = written_once(_rule_decisions(spark, d))
    history, audit = A.rule_history(decisions), A.rule_audit(decisions)
    return U.agreement(U.paired_ledgers(history, audit), history, audit)


@query("""WITH q AS (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'rejected' ELSE 'approved' END AS to_status, CASE WHEN match_id % 5 = 0 THEN 'approved' END AS expected FROM matches WHERE match_id % 4 <> 0)
SELECT match_id AS audit_id, match_id AS entity_id, a AS actor, 'proposal_' || to_status AS action FROM q JOIN matches m USING (match_id) WHERE m.status = 'pending' AND (expected IS NULL OR expected = m.status) ORDER BY match_id DESC LIMIT 100""")
def d8_match_audit(spark: SparkSession, d: str) -> DataFrame:
    """The latest audit rows of decided matches."""
    n, matches = F.col("match_id"), mart(spark, d, "matches")
    requests = matches.where("match_id % 4 <> 0").select(n.alias("request_id"), "match_id", F.when(n % 3 == 0, "rejected").otherwise("approved").alias("to_status"), F.when(n % 5 == 0, "approved").alias("expected_status"), F.col("a").alias("actor"), F.col("created").alias("ts"))
    rows = A.match_audit(A.decided_matches(matches, requests))
    return rows.orderBy(F.desc("audit_id")).limit(100).select("audit_id", "entity_id", "actor", "action")
