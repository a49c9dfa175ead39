"""Match persistence and review workflow as pure functions of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_matches(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, final_score, status): new scores replace pending rows; decided rows stay as they are."""
    both = existing.join(new.select("a", "b", F.col("final_score").alias("_new")), ["a", "b"], "full")
    pending = F.coalesce(F.col("status") == "pending", F.lit(True))
    return both.select("a", "b", F.when(pending, F.coalesce("_new", "final_score")).otherwise(F.col("final_score")).alias("final_score"), F.coalesce("status", F.lit("pending")).alias("status"))


def without_pending(matches: DataFrame) -> DataFrame:
    return matches.where("status <> 'pending'")


def enqueued(queue: DataFrame, matches: DataFrame) -> DataFrame:
    """The queue plus an entry for each match that has none; priority by match type."""
    priority = F.when(F.col("match_type") == "needs_review", "high").when(F.col("match_type") == "identical", "low").otherwise("medium")
    fresh = matches.join(queue.select("match_id"), "match_id", "left_anti").select("match_id", priority.alias("priority"), F.lit("open").alias("status"))
    return queue.unionByName(fresh)


def applied_run(matches: DataFrame, queue: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches (a, b, final_score, status) and queue (a, b, priority, status) after a run that found ``found`` (a, b, final_score, match_type).

    Each table holds a pair (a, b) once. Pending matches of earlier runs go, with their queue entries; found pairs are put in or, where decided, left as they
    are; each found pair without an entry is queued; open entries of decided matches are resolved.
    """
    stored = upsert_matches(without_pending(matches), found)
    gone = matches.where("status = 'pending'").select("a", "b")
    held = queue.join(gone, ["a", "b"], "left_anti").withColumn("match_id", F.struct("a", "b")).drop("a", "b")
    entries = enqueued(held, found.select(F.struct("a", "b").alias("match_id"), "match_type")).select("match_id.a", "match_id.b", "priority", "status")
    decided_ = stored.where("status <> 'pending'").select("a", "b", F.lit(True).alias("_decided"))
    closed = entries.join(decided_, ["a", "b"], "left")
    state = F.when((F.col("status") == "open") & F.col("_decided").isNotNull(), "resolved").otherwise(F.col("status"))
    return stored, closed.select("a", "b", "priority", state.alias("status"))


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The row of the largest id of each match."""
    line = Window.partitionBy("match_id").orderBy(F.desc("id"))
    return decisions.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")


def with_cmi_state(matches: DataFrame, mappings: DataFrame) -> DataFrame:
    """Approved matches whose sides map to one cmi are 'created', other approved ones 'pending', else null."""
    side = lambda s: mappings.select(F.col("material_id").alias(s), F.col("cmi").alias(f"cmi_{s}"))
    both = matches.join(side("a"), "a", "left").join(side("b"), "b", "left")
    state = F.when(F.col("status") == "approved", F.when(F.col("cmi_a") == F.col("cmi_b"), "created").otherwise("pending"))
    return both.withColumn("cmi_state", state).drop("cmi_a", "cmi_b")


# States of a match that a person has decided.
DECIDED = ["approved", "rejected", "deferred"]


def short_circuited(pairs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Pairs that are not already of one cmi."""
    return cmi_verdicts(pairs, mappings).where("not same_cmi").select(*pairs.columns)


def cmi_verdicts(pairs: DataFrame, mappings: DataFrame, decided: DataFrame | None = None, mode: str = "shadow") -> DataFrame:
    """Adds same_cmi, and skippable: in mode 'on' a pair of one cmi whose match (a, b in any order, status) is decided; off: neither."""
    side = lambda s: mappings.where("cmi is not null").select(F.col("material_id").alias(s), F.col("cmi").alias(f"_cmi_{s}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    same = F.coalesce(F.col("_cmi_a") == F.col("_cmi_b"), F.lit(False)) if mode != "off" else F.lit(False)
    both = both.withColumn("same_cmi", same)
    skippable = F.lit(False)
    if mode == "on" and decided is not None:
        known = decided.where(F.col("status").isin(DECIDED)).select(F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high")).distinct().withColumn("_decided", F.lit(True))
        both = both.join(known, (F.least("a", "b") == F.col("_low")) & (F.greatest("a", "b") == F.col("_high")), "left")
        skippable = F.col("same_cmi") & F.coalesce("_decided", F.lit(False))
    return both.select(*pairs.columns, "same_cmi", skippable.alias("skippable"))


def resolve(materials: DataFrame, text: str) -> DataFrame:
    """The best material for a free text: exact code, code prefix, then description, without regard to case."""
    code, description, want = F.lower("code"), F.lower("description"), text.lower()
    rank = F.when(code == want, 1).when(code.startswith(want), 2).when(description.contains(want), 3)
    return materials.withColumn("rank", rank).where("rank is not null").orderBy("rank", "code").limit(1)


def without_children_of_pending(children: DataFrame, matches: DataFrame, key: str = "match_id") -> DataFrame:
    """Decisions, queue entries or cmis (by ``key``) that no pending match owns; apply before ``without_pending``."""
    owned = matches.where("status = 'pending'").select(F.col("match_id").alias(key))
    return children.join(owned, key, "left_anti")


def in_context(matches: DataFrame, materials: DataFrame, organizations: DataFrame) -> DataFrame:
    """Matches of known materials, with org, category and manufacturer of both sides (``org_a`` .. ``manufacturer_b``)."""
    rows = materials.join(organizations, "org_id").select("material_id", "org_code", "category", "manufacturer")
    side = lambda s: rows.select(F.col("material_id").alias(s), F.col("org_code").alias(f"org_{s}"), F.col("category").alias(f"category_{s}"), F.col("manufacturer").alias(f"manufacturer_{s}"))
    return matches.join(side("a"), "a").join(side("b"), "b")


def evidence(path: str) -> Column:
    return F.get_json_object("evidence", f"$.{path}")


def listed_in(path: str) -> Column:
    """Whether the evidence's array has any entry."""
    return F.coalesce(F.json_array_length(evidence(path)) > 0, F.lit(False))


def listed(matches: DataFrame, min_score: int | None = None, max_score: int | None = None, conflicts: bool = False, **by) -> DataFrame:
    """Rows of ``in_context`` by any of: status, match_type, cmi_state (equality), organization and manufacturer and
    material (either side), category (both sides), decision and band (evidence), score bounds, critical conflicts."""
    either = lambda name, v: (F.col(f"{name}a") == v) | (F.col(f"{name}b") == v)
    tests = {
        "organization": lambda v: either("org_", v), "manufacturer": lambda v: either("manufacturer_", v), "material": lambda v: either("", v),
        "category": lambda v: (F.col("category_a") == v) & (F.col("category_b") == v), "decision": lambda v: evidence("decision.state") == v, "band": lambda v: evidence("decision.band") == v,
    }
    for name, value in by.items():
        matches = matches.where(tests[name](value) if name in tests else F.col(name) == value)
    matches = matches if min_score is None else matches.where(F.col("final_score") >= min_score)
    matches = matches if max_score is None else matches.where(F.col("final_score") <= max_score)
    return matches.where(listed_in("criticalConflicts")) if conflicts else matches


def review_order(sort: str | None = None) -> list[Column]:
    """Sort columns by name; unknown names sort by falling score."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    orders = {"score_asc": [F.asc("final_score")], "oldest": [F.asc("created")], "newest": [F.desc("created")], "priority": [rank, F.desc("final_score")]}
    return [*orders.get(sort, [F.desc("final_score")]), F.desc("match_id") if sort == "newest" else F.asc("match_id")]


def page_of(matches: DataFrame, sort: str | None, number: int, size: int) -> DataFrame:
    """One page (from 1) and the total of all rows, on every row of the page."""
    total = matches.agg(F.count("*").alias("total"))
    return matches.orderBy(*review_order(sort)).offset((number - 1) * size).limit(size).crossJoin(total)  # total is one row


def funnel(matches: DataFrame, mappings: DataFrame) -> DataFrame:
    """Approved matches by what became of them in the registry."""
    state = with_cmi_state(matches.where("status = 'approved'"), mappings)
    return state.agg(F.count("*").alias("approved"), F.count_if(F.col("cmi_state") == "pending").alias("awaiting_cmi"), F.count_if(F.col("cmi_state") == "created").alias("cmi_created"))


def decided(matches: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (match_id, to_status, expected_status or null), one for a match. Only pending matches change, and none
    that is not in the expected state. Outcome: decided, stale, not_pending, or null without a request."""
    both = matches.join(requests, "match_id", "left")
    outcome = (
        F.when(F.col("to_status").isNull(), None)
        .when(F.col("expected_status") != F.col("status"), "stale")
        .when(F.col("status") != "pending", "not_pending")
        .otherwise("decided")
    )
    both = both.withColumn("outcome", outcome)
    return both.withColumn("status", F.when(F.col("outcome") == "decided", F.col("to_status")).otherwise(F.col("status"))).drop("to_status", "expected_status")


def new_cmis(matches: DataFrame, mappings: DataFrame) -> DataFrame:
    """(match_id, cmi) for approved matches of materials that are not yet of one cmi: that of a side, or a new code."""
    side = lambda s: mappings.select(F.col("material_id").alias(s), F.col("cmi").alias(f"cmi_{s}"))
    both = matches.where("status = 'approved'").join(side("a"), "a", "left").join(side("b"), "b", "left")
    loose = both.where("cmi_a is null or cmi_b is null")
    return loose.select("match_id", F.coalesce("cmi_a", "cmi_b", F.concat(F.lit("CMI-"), F.col("match_id").cast("string"))).alias("cmi"))


def review_summary(matches: DataFrame, queue: DataFrame) -> DataFrame:
    """matches: rows of ``in_context``. Counters over the pending ones, and the open queue entries, in one row."""
    a, b = F.upper(F.trim("manufacturer_a")), F.upper(F.trim("manufacturer_b"))
    sums = matches.where("status = 'pending'").agg(
        F.count_if(evidence("decision.state") == "HIGH_CONFIDENCE_MATCH").alias("high_confidence"), F.count_if(listed_in("criticalConflicts")).alias("technical_conflicts"),
        F.count_if(listed_in("missingCritical")).alias("missing_critical"), F.count_if(evidence("assemblyConfiguration").isNotNull()).alias("assembly_differences"), F.count_if(a != b).alias("cross_brand"),
    )
    return queue.where("status = 'open'").agg(F.count("*").alias("open_reviews")).crossJoin(sums)  # one row each


def attention(matches: DataFrame, most: int = 3) -> DataFrame:
    """The pending matches to look at first: critical differences, those of seals before others, then by score."""
    c = F.col("critical_difference")
    return matches.where("status = 'pending'").orderBy(c.isNull(), ~F.coalesce(c.startswith("seal"), F.lit(False)), F.desc("final_score"), "match_id").limit(most)


# The comparison kinds of stored evidence by the relation that a review shows.
RELATIONS = {"EXACT_MATCH": "EXACT", "NORMALIZED_MATCH": "NORMALIZED", "CLOSE_MATCH": "CLOSE", "MISSING": "MISSING", "CONFLICT": "CONFLICT"}
COMPARISONS = "array<struct<name:string,type:string,critical:boolean,value_a:string,value_b:string>>"


def review_evidence(matches: DataFrame) -> DataFrame:
    """matches: match_id, evidence (JSON with comparisons), critical_difference. One row for each compared attribute and each conflict that only the stored difference names.

    Critical attributes are CRITICAL, other conflicts IMPORTANT, the rest INFORMATIONAL.
    """
    rows = matches.withColumn("compared", F.coalesce(F.from_json(F.get_json_object("evidence", "$.comparisons"), COMPARISONS), F.array().cast(COMPARISONS)))
    relation = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    x = F.col("x")
    conflict = x["type"] == "CONFLICT"
    shown = rows.select("match_id", F.explode("compared").alias("x")).select(
        "match_id", x["name"].alias("attribute"), x["value_a"].alias("left_value"), x["value_b"].alias("right_value"), F.coalesce(F.try_element_at(relation, x["type"]), F.lit("NOT_APPLICABLE")).alias("relation"),
        F.when(x["critical"], "CRITICAL").when(conflict, "IMPORTANT").otherwise("INFORMATIONAL").alias("importance"), F.lit("comparison").alias("source"),
    )
    text = F.lower("critical_difference")
    named = F.exists(F.filter("compared", lambda c: c["type"] == "CONFLICT"), lambda c: text.contains(F.lower(F.regexp_replace(c["name"], "_", " "))) | text.contains(F.lower(c["name"])))
    none = F.lit(None).cast("string")
    only = rows.where(F.col("critical_difference").isNotNull() & (F.col("critical_difference") != "") & ~named)
    name = F.trim(F.substring_index("critical_difference", ":", 1))
    stored = only.select("match_id", F.when(name != "", name).otherwise("critical_difference").alias("attribute"), none.alias("left_value"), none.alias("right_value"), F.lit("CONFLICT").alias("relation"), F.lit("CRITICAL").alias("importance"), F.lit("stored_difference").alias("source"))
    return shown.unionByName(stored)


def review_verdicts(context: DataFrame) -> DataFrame:
    """context: ``in_context`` rows. The verdict of each match, whether a person must review it, and how makers and categories relate."""
    verdict = F.coalesce(F.get_json_object("evidence", "$.decision.state"), F.lit("UNCLASSIFIED"))
    a, b = F.upper(F.trim("manufacturer_a")), F.upper(F.trim("manufacturer_b"))
    makers = F.when(F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), "unknown").when(a == b, "same").otherwise("different")
    kinds = F.when(F.lower(F.trim("category_a")) == F.lower(F.trim("category_b")), "same_category").otherwise("cross_category")
    missing = F.coalesce(F.json_array_length(F.get_json_object("evidence", "$.missingCritical")), F.lit(0))
    return context.select(
        "match_id", verdict.alias("verdict"), F.coalesce(F.get_json_object("evidence", "$.decision.band"), F.lit("unknown")).alias("band"), verdict.isin("NEEDS_TECHNICAL_REVIEW", "UNCLASSIFIED").alias("review_required"),
        makers.alias("manufacturers"), kinds.alias("categories"), missing.alias("missing"),
    )


def source_trace(materials: DataFrame, imports: DataFrame) -> DataFrame:
    """materials: material_id, org_code, code, import_id; imports: import_id, file_name, row_report (JSON). Where each record came from."""
    rows = materials.join(imports.select("import_id", "file_name", "row_report"), "import_id", "left")
    field = lambda name: F.get_json_object("row_report", f"$.integration.{name}")
    joined = F.get_json_object("row_report", "$.integration").startswith("{")
    joined = F.coalesce(joined, F.lit(False))
    channel = F.when(joined, "integration").when(F.col("import_id").isNotNull(), "import_center").otherwise("legacy")
    return rows.select(
        "material_id", F.when(joined, F.coalesce(field("cpse"), "org_code")).otherwise(F.col("org_code")).alias("organization"), F.when(joined, F.coalesce(field("sourceSystem"), field("adapterId"))).alias("source_system"),
        F.col("code").alias("record"), F.when(joined, field("adapterVersion")).alias("adapter_version"), F.when(channel != "legacy", F.coalesce(F.when(joined, field("sourceFileName")), F.col("file_name"))).alias("file_name"), channel.alias("channel"),
    )


def integration_history(imports: DataFrame) -> DataFrame:
    """Imports whose JSON report holds an integration, with its adapter."""
    held = F.get_json_object("row_report", "$.integration")
    return imports.where(F.coalesce(held.startswith("{"), F.lit(False))).select("import_id", "org_id", "status", F.get_json_object("row_report", "$.integration.adapterId").alias("adapter"), F.get_json_object("row_report", "$.integration.adapterVersion").alias("version"))


def dashboard(materials: DataFrame, matches: DataFrame, queue: DataFrame, imports: DataFrame, organizations: DataFrame, cmis: DataFrame, org_id: int | None = None) -> DataFrame:
    """(block, name, n): the dashboard's counts and distributions, of all or of one organization: its materials and imports, and the matches with a side there."""
    if org_id is not None:
        materials, imports = materials.where(F.col("org_id") == org_id), imports.where(F.col("org_id") == org_id)
        own = materials.select("material_id")
        sides = matches.select("match_id", F.explode(F.array("a", "b")).alias("material_id")).join(own, "material_id", "left_semi").select("match_id").distinct()
        matches, queue = matches.join(sides, "match_id", "left_semi"), queue.join(sides, "match_id", "left_semi")
    pending, opened = F.col("status") == "pending", F.col("status") == "open"
    one = lambda df, **counts: named(df.agg(*[c.alias(n) for n, c in counts.items()]), *counts)
    named = lambda df, *names: df.unpivot([], list(names), "name", "n").select(F.lit("totals").alias("block"), "name", F.col("n").cast("long").alias("n"))
    by = lambda block, df, c: df.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(block).alias("block"), "name", "n")
    parts = [
        one(materials, materials=F.count("*"), mappings=F.count("cmi")), one(queue, pending_reviews=F.count_if(opened)), one(cmis, common_identities=F.count("*")), one(organizations, organizations=F.count("*")),
        one(matches, near_equivalents=F.count_if(pending & (F.col("match_type") == "near_equivalent")), identical=F.count_if(pending & (F.col("match_type") == "identical")), critical_conflicts=F.count_if(pending & F.col("critical_difference").isNotNull())),
        one(imports, imports_completed=F.count_if(F.col("status") == "completed"), imports_pending=F.count_if(F.col("status").isin("pending", "processing"))),
        by("match_type", matches, "match_type"), by("match_status", matches, "status"), by("category", materials, "category"), by("open_queue", queue.where(opened), "priority"), by("queue_status", queue, "status"),
        by("decision", matches.select(F.coalesce(F.get_json_object("evidence", "$.decision.state"), F.lit("UNCLASSIFIED")).alias("state")), "state"),
    ]
    return reduce(DataFrame.unionByName, parts)


def conflict_attributes(matches: DataFrame, most: int = 12) -> DataFrame:
    """(attribute, reason, n): the most frequent stored conflict reasons, with the attribute that each names."""
    reason = F.concat(F.lit("critical technical conflict: "), "critical_difference")
    conflicts = matches.where((F.get_json_object("evidence", "$.decision.state") == "TECHNICAL_CONFLICT") & F.col("critical_difference").isNotNull()).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    name = F.regexp_extract("reason", r"(?i)conflict: ([a-z_]+):", 1)
    return conflicts.orderBy(F.desc("n"), "reason").limit(most).select(F.when(name != "", name).otherwise(F.regexp_replace("reason", "critical technical conflict: ", "")).alias("attribute"), "reason", "n")
