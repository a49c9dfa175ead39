"""Procurement analytics: exact-cents aggregation, demand and spend views, opportunities.

Totals are sums of integer cents, spend per currency and quantity per unit, never merged. Every view is one
aggregation with map-side combine over the record table; small masters join afterwards, onto groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelink.operators.rollup import bits, distinct, measured, month, rolled


def cents_text(cents: Column) -> Column:
    """1250 -> 12.50, 1200 -> 12."""
    sign = F.when(cents < 0, "-").otherwise("")
    whole, rest = F.floor(F.abs(cents) / 100).cast("long").cast("string"), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")
    return F.concat(sign, whole, F.when(rest == "00", "").otherwise(F.concat(F.lit("."), rest)))


def filtered(records: DataFrame, rules: DataFrame | None = None, **by) -> DataFrame:
    """Records by equality on any column, ``since`` and ``until`` dates, and ``canonical_uom`` (through the rules)."""
    since, until, canonical = by.pop("since", None), by.pop("until", None), by.pop("canonical_uom", None)
    for name, value in by.items():
        records = records.where(F.col(name).eqNullSafe(F.lit(value)))
    if since:
        records = records.where(F.col("purchase_date") >= F.lit(since).cast("date"))
    if until:
        records = records.where(F.col("purchase_date") <= F.lit(until).cast("date"))
    if canonical:
        units = rules.where(F.col("to_uom") == canonical).select(F.col("from_uom").alias("uom")).unionByName(rules.sparkSession.createDataFrame([(canonical,)], "uom string"))
        records = records.join(units.distinct(), "uom", "left_semi")
    return records


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def summary(records: DataFrame, *keys: str) -> DataFrame:
    """Records, parties, pricing and the first and last date for each key."""
    return records.groupBy(*keys).agg(
        F.count("*").alias("records"),
        F.countDistinct("org_id").alias("organizations"),
        F.countDistinct("supplier_id").alias("suppliers"),
        F.count("unit_price").alias("priced"),
        F.count_if(F.col("unit_price").isNull()).alias("unpriced"),
        F.min("purchase_date").alias("first_date"),
        F.max("purchase_date").alias("last_date"),
    )


def latest_years(records: DataFrame, key: str, most: int) -> DataFrame:
    """(key, first_year): the year down to which a key has ``most`` records or more; a key with fewer dated ones has no row or no year.

    Only counts by key and year are shuffled.
    """
    years = records.groupBy(key, F.year("purchase_date").alias("year")).agg(F.count("*").alias("n"))
    newer = years.withColumn("newer", F.sum("n").over(Window.partitionBy(key).orderBy(F.desc("year"))))
    return newer.where(F.col("newer") >= most).groupBy(key).agg(F.max("year").alias("first_year"))


def latest(records: DataFrame, years: DataFrame | None, key: str, most: int, *ties: str | Column) -> DataFrame:
    """The latest ``most`` records of each key, numbered by ``n``; ``ties`` orders those of a day.

    ``years``: ``latest_years`` of the same key and number. It leaves out the records of older years, which cannot be among the latest,
    before the others are shuffled; records without a year there all stay.
    """
    if years is not None:
        first = F.col("first_year")
        records = records.join(years, key, "left").where(first.isNull() | (F.year("purchase_date") >= first)).drop("first_year")
    line = Window.partitionBy(key).orderBy(F.desc("purchase_date"), *ties)
    return records.withColumn("n", F.row_number().over(line).cast("long")).where(F.col("n") <= most)


def quantities(records: DataFrame, *keys: str) -> DataFrame:
    return measured(records).groupBy(*keys, "uom").agg(F.sum("records").alias("records"), F.sum("qty_cents").alias("qty_cents"))


def spend(records: DataFrame, *keys: str) -> DataFrame:
    return measured(records).where("currency is not null").groupBy(*keys, "currency").agg(F.sum("records").alias("records"), F.sum("spend_cents").alias("spend_cents"))


def _cell(groups: str, name: str, cents: str) -> Column:
    """'EA=12.50; KG=3' from an array of (uom, currency, quantity, spend): sums by unit or currency, in its order."""
    known = F.filter(groups, lambda x: x[name].isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(known, lambda x: x[name])))
    total = lambda n: F.aggregate(F.filter(known, lambda x: x[name] == n), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[cents], F.lit(0)))
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), cents_text(total(n)))), "; ")


def totals(records: DataFrame, *keys: str) -> DataFrame:
    """Per key: records, linked, priced, first and last date, and exact totals by unit and by currency as text cells, never merged.

    One pass sums by (key, unit, currency) with map-side combine; the second gathers these few groups of each key.
    """
    linked = F.when(F.col("cmi").isNotNull(), F.col("records")).otherwise(0)
    parts = measured(records).groupBy(*keys, "uom", "currency").agg(
        F.sum("records").alias("n"), F.sum(linked).alias("linked"), F.sum("priced").alias("priced"), F.min("first_date").alias("first"), F.max("last_date").alias("last"),
        F.sum("qty_cents").alias("quantity"), F.sum("spend_cents").alias("spend"),
    )
    sums = parts.groupBy(*keys).agg(
        F.sum("n").alias("records"), F.sum("linked").alias("linked"), F.sum("priced").alias("priced"), F.min("first").alias("first_date"), F.max("last").alias("last_date"),
        F.collect_list(F.struct("uom", "currency", "quantity", "spend")).alias("groups"),
    )
    return sums.select(
        *keys, "records", "linked", (F.col("records") - F.col("linked")).alias("unlinked"), "priced", (F.col("records") - F.col("priced")).alias("unpriced"), "first_date", "last_date",
        _cell("groups", "uom", "quantity").alias("quantity_by_uom"), _cell("groups", "currency", "spend").alias("spend_by_currency"),
    )


def totals_apart(records: DataFrame, *keys: str) -> DataFrame:
    """(keys, records, quantity_by_uom, spend_by_currency) as ``totals`` has them, for keys with few records each and no null.

    Sums by unit and currency together would be nearly as many rows as the records, and wide ones; a key's few currencies alone combine before they are shuffled.
    """
    by_unit = measured(records).groupBy(*keys, "uom").agg(F.sum("records").alias("n"), F.sum("qty_cents").alias("quantity"))
    units = by_unit.groupBy(*keys).agg(F.sum("n").alias("records"), F.collect_list(F.struct("uom", "quantity")).alias("units"))
    by_currency = measured(records).where("currency is not null").groupBy(*keys, "currency").agg(F.sum("spend_cents").alias("spend"))
    currencies = by_currency.groupBy(*keys).agg(F.collect_list(F.struct("currency", "spend")).alias("currencies"))
    spent = F.coalesce(_cell("currencies", "currency", "spend"), F.lit(""))
    return units.join(currencies, list(keys), "left").select(*keys, "records", _cell("units", "uom", "quantity").alias("quantity_by_uom"), spent.alias("spend_by_currency"))


def monthly(records: DataFrame, *keys: str) -> DataFrame:
    sums = totals(measured(records), *keys, "month")
    return sums.select(*keys, "month", "records", "quantity_by_uom", "spend_by_currency")


def monthly_filled(records: DataFrame, *keys: str, most: int | None = 1200) -> DataFrame:
    """Every month from a key's first to its last, at most the first ``most`` of them (None: all), with nothing where nothing was bought."""
    known = monthly(records, *keys)
    first, last = (F.to_date(F.concat(f, F.lit("-01"))) for f in ("lo", "hi"))
    spans = known.groupBy(*keys).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    steps = F.sequence(first, last if most is None else F.least(last, F.add_months(first, most - 1)), F.expr("interval 1 month"))
    months = spans.select(*keys, F.explode(steps).alias("d")).select(*keys, month(F.col("d")).alias("month"))
    return months.join(known, [*keys, "month"], "left").fillna(0, ["records"]).fillna("", ["quantity_by_uom", "spend_by_currency"])


def coverage(records: DataFrame, suppliers: DataFrame | None = None) -> DataFrame:
    """One row a scope (all, linked, unlinked): counts, dates and totals; ``linked_bp`` is the linked share in basis points, null without records.

    Records, or cells with ``suppliers`` (bitmaps by cmi), are summed once as linked and unlinked; all is both together.
    """
    linked, scopes = F.col("cmi").isNotNull(), lambda rows: rows.withColumn("scope", F.explode(F.array(F.lit("all"), F.when(F.col("_linked"), "linked").otherwise("unlinked"))))
    marked = records.withColumn("_linked", linked)
    parts = rolled(marked, "_linked", "uom", "currency").withColumn("cmi", F.when(F.col("_linked"), ""))
    held = bits(marked, "supplier_id", "_linked") if suppliers is None else suppliers.withColumn("_linked", linked)
    parties = [distinct(scopes(held), "suppliers", "scope"), distinct(scopes(bits(marked, "org_id", "_linked")), "organizations", "scope")]
    known = records.sparkSession.createDataFrame([("all",), ("linked",), ("unlinked",)], "scope string")
    out = known.join(totals(scopes(parts), "scope"), "scope", "left").join(parties[0], "scope", "left").join(parties[1], "scope", "left")
    out = out.fillna(0, ["records", "linked", "unlinked", "priced", "unpriced", "organizations", "suppliers"]).fillna("", ["quantity_by_uom", "spend_by_currency"])
    return out.withColumn("linked_bp", F.floor(F.try_divide(F.col("linked") * 10000, F.col("records"))).cast("long"))


def organization_summaries(organizations: DataFrame, records: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Every organization with its totals; those without records stay, with zeros. ``pairs``: where ``records`` are cells, the pairs of the same filter."""
    parties = (records if pairs is None else pairs).groupBy("org_id").agg(F.countDistinct("supplier_id").alias("suppliers"))
    out = organizations.join(totals(records, "org_id"), "org_id", "left").join(parties, "org_id", "left")
    return out.fillna(0, ["records", "linked", "unlinked", "priced", "unpriced", "suppliers"]).fillna("", ["quantity_by_uom", "spend_by_currency"])


def material_counts(records: DataFrame) -> DataFrame:
    """(org_id, category, linked, material_id, records)."""
    return records.groupBy("org_id", "category", F.col("cmi").isNotNull().alias("linked"), "material_id").agg(F.count("*").alias("records"))


def loose_suppliers(records: DataFrame) -> DataFrame:
    """Bitmaps of suppliers of the unlinked records by organization and category."""
    return bits(records.where("cmi is null"), "supplier_id", "org_id", "category")


def unharmonized(records: DataFrame, counts: DataFrame | None = None, suppliers: DataFrame | None = None) -> DataFrame:
    """Per organization and category with both linked and unlinked records: the unlinked ones, and up to 20 material ids.

    ``counts`` and ``suppliers``: ``material_counts`` and ``loose_suppliers`` where they are stored.
    """
    counts = material_counts(records) if counts is None else counts
    scope = counts.where("linked").select("org_id", "category").distinct()
    loose = counts.where("not linked").join(scope, ["org_id", "category"], "left_semi")
    sums = loose.groupBy("org_id", "category").agg(F.sum("records").alias("records"), F.count("*").alias("materials"))
    line = Window.partitionBy("org_id", "category").orderBy("material_id")
    least = loose.select("org_id", "category", "material_id").withColumn("n", F.row_number().over(line)).where("n <= 20")  # the limit acts before the shuffle too
    ranked = least.groupBy("org_id", "category").agg(F.array_sort(F.collect_list("material_id")).alias("ids"))
    listed = F.substring(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 1, 500)
    held = distinct(loose_suppliers(records) if suppliers is None else suppliers, "suppliers", "org_id", "category")
    return sums.join(ranked, ["org_id", "category"]).join(held, ["org_id", "category"]).select("org_id", "category", "records", "materials", "suppliers", listed.alias("material_ids"))


def opportunity_evidence(records: DataFrame) -> DataFrame:
    return records.where("cmi is not null").groupBy("cmi").agg(
        F.countDistinct("org_id").alias("organizations"), F.countDistinct("supplier_id").alias("suppliers"), F.count("*").alias("records"), F.countDistinct("purchase_date").alias("dates")
    )


def opportunities(records: DataFrame, seen: DataFrame | None = None, loose: DataFrame | None = None) -> DataFrame:
    """(detection_key, opportunity_type, cmi, org_id, category, score, organizations, suppliers, records) by six rules.

    ``seen`` and ``loose``: ``opportunity_evidence`` and ``unharmonized`` where they come from roll-ups.
    """
    seen = opportunity_evidence(records) if seen is None else seen
    score = F.col("organizations") * 2 + F.col("suppliers") * 2 + F.col("records")
    rank = F.greatest(F.lit(1), F.ceil(F.lit(0.1) * F.col("n")).cast("long"))
    # the k-th largest count: the largest value with at least k cmis at or above it, over one row for each distinct count
    levels = seen.groupBy("records").agg(F.count("*").alias("cmis"))
    n = seen.agg(F.count("*").alias("n"))
    ordered = levels.withColumn("above", F.sum("cmis").over(Window.orderBy(F.desc("records"))))
    cut = ordered.crossJoin(n).where((F.col("n") >= 2) & (F.col("above") >= rank)).agg(F.max("records").alias("cut"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("organizations") >= 2, "CROSS_CPSE_DEMAND"),
            F.when((F.col("records") >= 2) & (F.col("dates") >= 2), "REPEATED_PROCUREMENT"),
            F.when((F.col("organizations") >= 2) & (F.col("records") >= 3), "FRAGMENTED_DEMAND"),
            F.when(F.col("suppliers") >= 2, "MULTI_SUPPLIER_ACTIVITY"),
            F.when(F.col("records") >= F.col("cut"), "HIGH_PROCUREMENT_ACTIVITY"),
        )
    )
    by_cmi = seen.crossJoin(F.broadcast(cut)).withColumn("score", score).select(F.explode(kinds).alias("opportunity_type"), "cmi", "score", "organizations", "suppliers", "records")
    by_cmi = by_cmi.select(F.concat_ws(":", "opportunity_type", "cmi").alias("detection_key"), "opportunity_type", "cmi", F.lit(None).cast("int").alias("org_id"), F.lit(None).cast("string").alias("category"), "score", "organizations", "suppliers", "records")
    kind = "UNHARMONIZED_RELATED_PROCUREMENT"
    loose = (unharmonized(records) if loose is None else loose).select(
        F.concat_ws(":", F.lit(kind), "org_id", "category").alias("detection_key"), F.lit(kind).alias("opportunity_type"), F.lit(None).cast("string").alias("cmi"), "org_id", "category",
        F.col("records").alias("score"), F.lit(1).cast("long").alias("organizations"), "suppliers", "records",
    )
    return by_cmi.unionByName(loose)


def upsert_opportunities(existing: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected evidence replaces the old one; an existing status stays, new keys are OPEN, undetected keys stay as they are."""
    new = detected.select("detection_key", F.col("score").alias("new_score"))
    both = existing.join(new, "detection_key", "full")
    return both.select("detection_key", F.coalesce("status", F.lit("OPEN")).alias("status"), F.coalesce("new_score", "score").alias("score"))


# Allowed status changes of an opportunity, and those that need a reason.
TRANSITIONS = [("OPEN", "ACKNOWLEDGED"), ("OPEN", "DISMISSED"), ("OPEN", "RESOLVED"), ("ACKNOWLEDGED", "DISMISSED"), ("ACKNOWLEDGED", "RESOLVED"), ("DISMISSED", "OPEN"), ("RESOLVED", "OPEN")]
WITH_REASON = ("DISMISSED", "RESOLVED", "OPEN")


def transition(opportunities_: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (detection_key, to_status, reason). Each row gets its new status and whether the request was accepted."""
    asked = opportunities_.join(requests, "detection_key", "left")
    allowed = F.array([F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    ok = F.array_contains(allowed, F.concat("status", F.lit(">"), "to_status")) & (~F.col("to_status").isin(*WITH_REASON) | (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    ok = F.coalesce(ok, F.lit(False))
    return asked.select("detection_key", F.when(ok, F.col("to_status")).otherwise(F.col("status")).alias("status"), ok.alias("accepted"))


def supplier_list(suppliers: DataFrame, records: DataFrame, search: str | None = None, **activity) -> DataFrame:
    """All suppliers that fit ``search``; activity filters narrow what is counted, not which suppliers are listed."""
    if search:
        suppliers = suppliers.where(F.lower("supplier").contains(search.lower()))
    counted = filtered(records, **activity).groupBy("supplier_id").agg(F.count("*").alias("records"), F.countDistinct("org_id").alias("organizations"), F.countDistinct("cmi").alias("cmis"), F.max("purchase_date").alias("last_date"))
    return suppliers.join(counted, "supplier_id", "left").fillna(0, ["records", "organizations", "cmis"])


def quantity_cells(records: DataFrame, *keys: str) -> DataFrame:
    """One text a key: its quantities by unit, joined with ' + '."""
    parts = quantities(records, *keys).withColumn("part", F.concat(cents_text(F.col("qty_cents")), F.lit(" "), F.col("uom")))
    return parts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct("uom", "part")))["part"], " + ").alias("cell"))
