"""Import: readers, header mapping, validation, duplicates, feed adapters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelink.functions import text as T

# Header aliases by target, known categories and units, length limits, technical columns.
ALIASES = {
    "material_code": ["material_code", "code", "materialcode", "material_no", "materialno", "material_number", "materialnumber", "item_code", "itemcode", "item_no", "item_number", "part_no", "mat_code", "mat_no", "material_id", "part_code"],
    "description": ["description", "material_description", "materialdescription", "item_description", "itemdescription", "short_text", "shorttext", "desc", "nomenclature", "mat_desc"],
    "category": ["category", "material_group", "mat_group", "group"],
    "subcategory": ["sub_category", "subcategory", "material_subgroup"],
    "uom": ["uom", "unit", "unit_of_measure", "unitofmeasure", "um", "base_uom"],
    "manufacturer": ["manufacturer", "make", "brand", "oem", "mfr"],
    "model": ["model", "model_no", "model_number"],
    "part_number": ["part_number", "partnumber", "partno", "oem_part", "mpn"],
    "organization": ["cpse_name", "cpse", "organization", "organisation", "org", "org_code", "organization_code", "cpse_code", "company", "owner"],
    "quantity": ["quantity", "qty"],
    "size": ["size", "nominal_size", "dimensions"],
    "material_type": ["material", "material_type"],
    "voltage": ["voltage", "voltage_rating", "rated_voltage"],
    "pressure_rating": ["pressure_rating", "pressure_class", "pressure"],
    "power": ["power", "power_rating", "rated_power"],
    "temperature_rating": ["temperature_rating", "temperature", "temp_rating"],
    "seal_type": ["seal_type", "seal", "sealing"],
    "bearing_type": ["bearing_type"],
    "grade": ["grade", "material_grade", "mat_grade"],
}
CATEGORIES = ["Bearings", "Valves", "Motors", "Pumps", "Fasteners", "Uncategorised"]
UOMS = """NOS EA EACH PCS SET PAIR MTR M METER METRE MM CM KM KG G TON TONNE L LTR LITRE LITER ML M2 M3 SQM KVA KW HP BOX ROLL DRUM BOTTLE CAN""".split()
CODE_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9\-/_.]*$"
CODE_MAX, DESCRIPTION_MIN, DESCRIPTION_MAX = 50, 3, 500
FIELD_MAX = {"category": 80, "subcategory": 80, "manufacturer": 120, "model": 80, "part_number": 80, "uom": 20}
MALFORMED = r"(?i)\b\d+(XX|YY|ZZ\s*V)\b"
TECHNICAL = {  # column: (attribute, unit, critical)
    "size": ("size", None, False), "material_type": ("material_type", None, False), "voltage": ("voltage_rating", "V", True), "pressure_rating": ("pressure_class", None, True),
    "power": ("power_rating", "KW", True), "temperature_rating": ("temperature_rating", "C", False), "seal_type": ("seal_type", None, True), "bearing_type": ("bearing_type", None, False), "grade": ("material_grade", None, False),
}
# Header names of a procurement file by target, without '_' (a header may have it between words or not); required targets; states.
PROCUREMENT_HEADERS = {
    "organization": ["cpsename", "cpse", "organizationname", "organisationname", "organization", "organisation", "orgname", "org", "entity", "company"],
    "material_code": ["materialcode", "materialid", "itemcode", "itemid", "item", "material"],
    "supplier": ["suppliercode", "supplierid", "supplier", "vendorcode", "vendorid", "vendor"],
    "purchase_date": ["purchasedate", "podate", "orderdate", "purchasingdate"],
    "delivery_date": ["deliverydate", "receiveddate", "grndate"],
    "quantity": ["orderedqty", "orderedquantity", "purchaseqty", "purchasequantity", "qty", "quantity"],
    "uom": ["uom", "unitofmeasure", "unit"],
    "po": ["po", "pono", "ponumber", "poref", "poreference", "purchaseorder", "purchaseorderno", "purchaseordernumber", "purchaseorderref", "purchaseorderreference", "orderreference"],
    "unit_price": ["unitprice", "rate", "price", "cost"],
    "currency": ["currencycode", "currency"],
    "status": ["procurementstatus", "postatus", "status"],
    "plant": ["plantlocation", "plant", "location", "site", "store"],
    "cmi_code": ["cmicode", "cmiid", "cmi", "commonmaterialcode"],
}
PROCUREMENT_REQUIRED = ["organization", "material_code", "supplier", "purchase_date", "quantity", "uom"]
PROCUREMENT_STATES = ["ORDERED", "PARTIALLY_DELIVERED", "DELIVERED", "CANCELLED"]


CELL_MAX = 65536  # characters of a cell; a longer one is an error, not a cut


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All cells as trimmed strings; quoted newlines stay inside their record, blank lines are no records, a cell over ``CELL_MAX`` fails the read."""
    return spark.read.csv(path, header=header, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False, maxCharsPerColumn=CELL_MAX, mode="FAILFAST")


def write_csv(df: DataFrame, path: str) -> None:
    """Trimmed cells in lines that end in CRLF, quoted where they hold a comma, quote or line break (written as CRLF, too); nulls are empty."""
    cells = df.select(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in df.columns])
    cells.write.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the file's ending; spreadsheets are not supported."""
    if path.endswith((".csv", ".txt")):
        return read_csv(spark, path)
    if path.endswith(".json"):
        return spark.read.json(path, primitivesAsString=True)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format: {path}")


def header_key(header: str) -> str:
    return re.sub(r"[\s\-.]+", "_", header.strip().lower())


def suggest_mapping(headers: list[str]) -> dict[str, str]:
    """Target column -> header: the first header that names a target wins, unknown ones stay out."""
    targets = {a: t for t, names in ALIASES.items() for a in names}
    found: dict[str, str] = {}
    for h in headers:
        if (target := targets.get(header_key(h))) and target not in found:
            found[target] = h
    return found


def unmapped(headers: list[str], mapping: dict[str, str]) -> list[str]:
    """Headers that name no target, or one that an earlier header has."""
    return [h for h in headers if h not in mapping.values()]


def suggest_procurement_mapping(headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """Target column -> header for a procurement file, the first header that names a target winning, and the required targets without one."""
    targets = {a: t for t, names in PROCUREMENT_HEADERS.items() for a in names}
    found: dict[str, str] = {}
    for h in headers:
        key = header_key(h)
        target = targets.get(key.replace("_", ""))
        if target and target not in found and "__" not in key and key == key.strip("_"):
            found[target] = h
    return found, [t for t in PROCUREMENT_REQUIRED if t not in found]


def mapped_procurement(feed: DataFrame) -> DataFrame:
    """A procurement feed (its own headers, and row_number) as the targets of ``PROCUREMENT_HEADERS``; targets without a header are null. A required one without is an error."""
    mapping, missing = suggest_procurement_mapping([c for c in feed.columns if c != "row_number"])
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return feed.select("row_number", *[(F.col(f"`{mapping[t]}`") if t in mapping else F.lit(None)).cast("string").alias(t) for t in PROCUREMENT_HEADERS])


def mapped(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Columns by target name (missing ones null); other columns go to the map ``source_metadata``."""
    mapping = mapping or suggest_mapping(df.columns)
    rest = [c for c in df.columns if c not in mapping.values()]
    extra = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]) if rest else F.create_map().cast("map<string,string>")
    columns = [(F.col(f"`{mapping[t]}`") if t in mapping else F.lit(None)).cast("string").alias(t) for t in ALIASES]
    return df.select(*columns, F.map_filter(extra, lambda k, v: v.isNotNull()).alias("source_metadata"))


def adapted(df: DataFrame, vocabulary: dict[str, dict[str, str]]) -> DataFrame:
    """Replace values of the named columns by a source's vocabulary (upper-cased, trimmed keys)."""
    for column, entries in vocabulary.items():
        words = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
        df = df.withColumn(column, F.coalesce(F.try_element_at(words, F.upper(F.trim(column))), F.col(column)))
    return df


def integrated(feed: DataFrame, vocabulary: dict[str, dict[str, str]], stored: DataFrame, include_warnings: bool = True, duplicates: str = "skip") -> tuple[DataFrame, DataFrame]:
    """A source's feed (its own headers and row_number) through mapping, vocabulary, validation and loading: (analysis, rows with outcome)."""
    rows = mapped(feed)
    rows = adapted(rows.withColumn("row_number", rows["source_metadata"]["row_number"].cast("long")), vocabulary)
    checked = validated(rows.withColumn("source_metadata", F.map_filter("source_metadata", lambda k, v: k != "row_number")), stored)
    return feed_analysis(checked), performed(checked, include_warnings, duplicates)


def code_conflict(code: Column, description: Column) -> Column:
    """The description names another number behind the code's own letters."""
    letters, digits = F.upper(F.regexp_extract(code, r"^([A-Za-z]+)", 1)), F.regexp_extract(code, r"(\d{3,})", 1)
    found = F.regexp_extract_all(F.upper(description), F.concat(F.lit(r"\b"), letters, F.lit(r"[-/ ]?(\d{3,})")), 1)
    return (letters != "") & (digits != "") & F.exists(found, lambda d: d != digits)


def _problem(condition: Column, rule: str, severity: str) -> Column:
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))


def _text(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def validated(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """rows: row_number and any of the mapped columns as strings. Adds problems (rule, severity), severity and is_empty.

    A code's first row (in row order, whatever its other errors) is the original; later ones are duplicates, without regard to case.
    ``existing`` (material_code, optionally organization) holds the codes in store; with organization, and where the file has that
    column, a code is a duplicate within its organization only. Blank codes are in no group.
    """
    code, description, uom, category = _text("material_code"), _text("description"), F.upper(_text("uom")), _text("category")
    cells = [c for c in rows.columns if c in ALIASES]
    keyed = rows.withColumns({"is_empty": F.concat(*[_text(n) for n in cells]) == "", "_key": F.when(code != "", F.upper(code)).otherwise(F.concat(F.lit("\0"), F.col("row_number").cast("string")))})
    firsts = keyed.groupBy("_key").agg(F.min("row_number").alias("_first"))
    rows = keyed.join(firsts, "_key")
    if existing is None:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))
    elif "organization" in existing.columns and "organization" in cells:
        known = existing.select(F.upper(F.trim("material_code")).alias("_known"), F.upper(F.trim("organization")).alias("_owner")).distinct()
        rows = rows.join(known, (F.col("_key") == F.col("_known")) & (F.upper(_text("organization")) == F.col("_owner")), "left")
    else:
        rows = rows.join(existing.select(F.upper(F.trim("material_code")).alias("_known")).distinct(), F.col("_key") == F.col("_known"), "left")
    long = F.lit(False)
    for field, most in FIELD_MAX.items():
        if field in cells:
            long = long | (F.length(_text(field)) > most)
    problems = F.array_compact(
        F.array(
            _problem(code == "", "missing_code", "ERROR"),
            _problem((code != "") & ~code.rlike(CODE_PATTERN), "code_format", "ERROR"),
            _problem(F.length(code) > CODE_MAX, "code_too_long", "ERROR"),
            _problem(description == "", "missing_description", "ERROR"),
            _problem((description != "") & (F.length(description) < DESCRIPTION_MIN), "description_too_short", "ERROR"),
            _problem(F.length(description) > DESCRIPTION_MAX, "description_too_long", "ERROR"),
            _problem((code != "") & (F.col("row_number") > F.col("_first")), "duplicate_in_file", "ERROR"),
            _problem(F.col("_known").isNotNull(), "duplicate_in_database", "ERROR"),
            _problem((category != "") & ~category.isin(CATEGORIES), "unknown_category", "ERROR"),
            _problem(description.rlike(MALFORMED), "malformed_quantity", "WARNING"),
            _problem((uom != "") & ~uom.isin(UOMS), "unknown_uom", "WARNING"),
            _problem(long, "field_too_long", "WARNING"),
            _problem(_text("manufacturer") == "", "missing_manufacturer", "WARNING") if "manufacturer" in cells else F.lit(None).cast("struct<rule:string,severity:string>"),
        )
    )
    problems = F.when(F.col("is_empty"), F.array().cast("array<struct<rule:string,severity:string>>")).otherwise(problems)
    return _with_severity(rows.withColumn("problems", problems)).drop("_first", "_known", "_owner", "_key")


def _with_severity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("severity", F.when(F.exists("problems", lambda p: p["severity"] == "ERROR"), "ERROR").when(F.size("problems") > 0, "WARNING").otherwise("VALID"))


def technical_attributes(rows: DataFrame) -> DataFrame:
    """(row_number, attribute_name, value, normalized_value, unit, is_critical) of each filled technical column."""
    kinds = [(c, *v) for c, v in TECHNICAL.items() if c in rows.columns]
    facts = F.array(*[F.struct(F.lit(name).alias("attribute_name"), _text(c).alias("value"), T.canonical_value(_text(c)).alias("normalized_value"), F.lit(unit).cast("string").alias("unit"), F.lit(critical).alias("is_critical")) for c, name, unit, critical in kinds])
    return rows.select("row_number", F.explode(F.filter(facts, lambda x: x["value"] != "")).alias("a")).select("row_number", "a.*")


def feed_analysis(checked: DataFrame) -> DataFrame:
    """One row over validated rows: counters, whether any row can load, and the filled share of each column of full rows in tenths of a percent."""
    full = ~F.col("is_empty")
    cells = [c for c in checked.columns if c in ALIASES]
    filled = {c: F.coalesce(F.round(F.try_divide(F.count_if(full & (_text(c) != "")) * F.lit(1000), F.count_if(full))).cast("long"), F.lit(0).cast("long")) for c in cells}
    has = lambda rule: F.exists("problems", lambda p: p["rule"] == rule)
    return checked.agg(
        F.count("*").alias("total"), F.count_if(~full).alias("empty"), F.count_if(full & (F.col("severity") == "VALID")).alias("valid"), F.count_if(full & (F.col("severity") == "WARNING")).alias("warnings"),
        F.count_if(full & (F.col("severity") == "ERROR")).alias("errors"), F.count_if(has("duplicate_in_file")).alias("duplicates"),
        (F.count_if(full & (F.col("severity") != "ERROR")) > 0).alias("can_execute"), *[share.alias(f"{c}_filled") for c, share in filled.items()],
    )


def importable(checked: DataFrame, include_warnings: bool = True, duplicates: str = "skip") -> DataFrame:
    """Rows to load. Errors load only with duplicates='update', when all of them are duplicate_in_database; with 'cancel' nothing is loaded."""
    if duplicates not in ("skip", "update", "cancel"):
        raise ValueError(f"unknown strategy for duplicates: {duplicates}")
    if duplicates == "cancel":
        return checked.limit(0)
    only = F.forall(F.filter("problems", lambda p: p["severity"] == "ERROR"), lambda p: p["rule"] == "duplicate_in_database")
    keep = F.col("severity") == "VALID"
    if include_warnings:
        keep = keep | (F.col("severity") == "WARNING")
    if duplicates == "update":
        keep = keep | ((F.col("severity") == "ERROR") & only)
    return checked.where(~F.col("is_empty") & keep)


def error_report(checked: DataFrame) -> DataFrame:
    """One row for each problem row: its rules joined by '; '."""
    return checked.where(F.size("problems") > 0).select("row_number", "severity", F.array_join(F.transform("problems", lambda p: p["rule"]), "; ").alias("rules"))


def duplicate_only() -> Column:
    """Whether a validated row's errors, one at least, are all duplicates in the file or in store."""
    errors = F.filter("problems", lambda p: p["severity"] == "ERROR")
    return (F.size(errors) > 0) & F.forall(errors, lambda p: p["rule"].isin("duplicate_in_database", "duplicate_in_file"))


def report_page(checked: DataFrame, number: int, size: int, severity: str | None = None, search: str | None = None) -> DataFrame:
    """One page (from 1, of 100 rows at most) of validated rows in row order, and the total of all that fit, on every row.

    ``search`` is looked for in every cell and the row number, without regard to case.
    """
    cells = ["row_number", "material_code", "description", "category", "uom", "manufacturer", "quantity"]
    rows = checked if severity is None else checked.where(F.col("severity") == severity)
    if search:
        rows = rows.where(F.exists(F.array(*[F.lower(F.col(c).cast("string")) for c in cells]), lambda x: F.coalesce(x.contains(search.lower()), F.lit(False))))
    size = min(size, 100)
    return rows.orderBy("row_number").offset((number - 1) * size).limit(size).crossJoin(rows.agg(F.count("*").alias("total")))  # one row


def performed(checked: DataFrame, include_warnings: bool = True, duplicates: str = "skip") -> DataFrame:
    """Every full row with its outcome: inserted, updated (in store already) or skipped."""
    loaded = importable(checked, include_warnings, duplicates).select("row_number", F.lit(True).alias("_loaded"))
    outcome = F.when(F.col("_loaded").isNull(), "skipped").when(F.col("severity") == "ERROR", "updated").otherwise("inserted")
    return checked.where(~F.col("is_empty")).join(loaded, "row_number", "left").withColumn("outcome", outcome).drop("_loaded")


def code_collisions(checked: DataFrame, stored: DataFrame) -> DataFrame:
    """Codes in store whose first row in the file has another description (spaces and case aside).

    stored: material_id, code, description.
    """
    plain = lambda c: F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    rows = checked.where(F.exists("problems", lambda p: p["rule"] == "duplicate_in_database")).select("row_number", F.trim("material_code").alias("code"), F.trim("description").alias("file_description"))
    kept = stored.select("material_id", F.col("code").alias("_code"), F.col("description").alias("stored_description"))
    first = rows.join(kept, F.upper("code") == F.upper("_code")).groupBy("code", "material_id", "stored_description").agg(F.min_by("file_description", "row_number").alias("file_description"))
    return first.where((F.col("file_description") != "") & (plain(F.col("file_description")) != plain(F.col("stored_description")))).select("material_id", "code", "file_description", "stored_description")


def parsed_date(raw: Column) -> Column:
    """ISO (trailing text allowed) or D/M/YYYY with slashes or dashes, real calendar days only; else null."""
    raw = F.trim(raw)
    part = lambda i: F.lpad(F.regexp_extract(raw, LOCAL_DATE, i), 2, "0")
    iso, local = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1), F.concat(F.regexp_extract(raw, LOCAL_DATE, 3), F.lit("-"), part(2), F.lit("-"), part(1))
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).when(raw.rlike(LOCAL_DATE), F.try_to_date(local, "yyyy-MM-dd"))


LOCAL_DATE = r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})$"
DECIMAL = r"^\d+(\.\d{1,2})?$"


def _plain(number: Column) -> Column:
    """Digits without trailing zeros of the fraction: 12.50 -> 12.5, 12.00 -> 12."""
    return F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def parsed_quantity(raw: Column) -> Column:
    """The canonical text of a positive number of at most two decimals, thousands commas dropped; else null."""
    clean = F.regexp_replace(F.trim(raw), ",", "")
    return F.when(clean.rlike(DECIMAL) & (clean.try_cast("decimal(38,2)") > 0), _plain(clean))


def parsed_price(raw: Column) -> Column:
    """Like a quantity, with a leading currency sign dropped and zero allowed."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(raw), ",", ""), "^[\u20b9$]", "")
    return F.when(clean.rlike(DECIMAL), _plain(clean))


def row_signature(*columns: Column) -> Column:
    return F.to_json(F.array(*[F.upper(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]))


def resolved(rows: DataFrame, organizations: DataFrame, materials: DataFrame, suppliers: DataFrame, cmis: DataFrame) -> DataFrame:
    """Procurement rows with their masters: org_id, material_id (of that organization), supplier_id (by code, then by name), the cmi named and the cmi mapped.

    organizations: org_id, org_code; materials: material_id, org_id, code, cmi; suppliers: supplier_id, code, supplier; cmis: cmi, active.
    """
    code = lambda c: F.upper(_text(c))  # noqa: E731  whole: a code that only begins like a stored one is another code
    rows = rows.withColumns({"_org": code("organization"), "_code": code("material_code"), "_cmi": code("cmi_code"), "_sup": code("supplier")})
    out = rows.join(organizations.select("org_id", F.upper("org_code").alias("_org")), "_org", "left")
    known = materials.select("material_id", F.col("org_id").alias("_owner"), F.upper("code").alias("_own"), F.col("cmi").alias("mapped_cmi"))
    out = out.join(known, (F.col("org_id") == F.col("_owner")) & (F.col("_code") == F.col("_own")), "left")
    by_code = suppliers.groupBy(F.upper(F.trim("code")).alias("_sup")).agg(F.min("supplier_id").alias("_by_code"))
    by_name = suppliers.groupBy(F.upper(F.trim("supplier")).alias("_sup")).agg(F.min("supplier_id").alias("_by_name"))
    out = out.join(by_code, "_sup", "left").join(by_name, "_sup", "left").withColumn("supplier_id", F.coalesce("_by_code", "_by_name"))
    named = cmis.select(F.upper("cmi").alias("_cmi"), F.col("cmi").alias("named_cmi"), F.col("active").alias("named_active"))
    mapped_ = cmis.select(F.col("cmi").alias("mapped_cmi"), F.col("active").alias("mapped_active"))
    return out.join(named, "_cmi", "left").join(mapped_, "mapped_cmi", "left").drop("_owner", "_own", "_by_code", "_by_name")


def checked_procurement(rows: DataFrame, organizations: DataFrame, materials: DataFrame, suppliers: DataFrame, cmis: DataFrame) -> DataFrame:
    """rows: row_number and the targets of PROCUREMENT_HEADERS as strings. Adds the masters' ids, parsed values, problems, severity, is_empty and signature.

    A record carries the cmi that it names, if its material is mapped there and it is active, else the active one of its material. Of rows
    without errors and of equal signature the first is the original, later ones get a warning.
    """
    out = resolved(rows, organizations, materials, suppliers, cmis)
    state = F.regexp_replace(F.upper(_text("status")), r"[\s\-]+", "_")
    named, mapped_ = F.col("named_cmi"), F.col("mapped_cmi")
    found = F.col("material_id").isNotNull()
    out = out.withColumns(
        {
            "is_empty": F.concat(*[_text(c) for c in PROCUREMENT_HEADERS]) == "", "date": parsed_date(_text("purchase_date")), "delivered": parsed_date(_text("delivery_date")), "qty": parsed_quantity(_text("quantity")),
            "price": parsed_price(_text("unit_price")), "state": F.when(state == "", "ORDERED").when(state.isin(PROCUREMENT_STATES), state), "cmi": F.coalesce(named, F.when((F.col("_cmi") == "") & F.col("mapped_active"), mapped_)),
        }
    )
    blank = lambda c: _text(c) == ""
    bad_cmi = F.filter(F.array(~F.col("named_active"), found & mapped_.isNotNull() & (mapped_ != named), found & mapped_.isNull()), lambda x: F.coalesce(x, F.lit(False)))
    first = F.array_compact(
        F.array(
            _problem(F.col("org_id").isNull(), "unknown_organization", "ERROR"),
            _problem((F.col("_code") == "") | (F.col("org_id").isNotNull() & ~found), "unknown_material", "ERROR"),
            _problem(F.col("supplier_id").isNull(), "unknown_supplier", "ERROR"),
            _problem(F.col("date").isNull(), "invalid_date", "ERROR"),
            _problem(F.col("qty").isNull(), "invalid_quantity", "ERROR"),
            _problem(blank("uom") | (F.length(_text("uom")) > 12), "invalid_uom", "ERROR"),
            _problem(blank("po"), "missing_po_reference", "WARNING"),
            _problem(~blank("delivery_date") & F.col("delivered").isNull(), "invalid_date", "ERROR"),
            _problem((~blank("unit_price") & F.col("price").isNull()) | (blank("unit_price") & ~blank("currency")), "invalid_price", "ERROR"),
            _problem(~blank("unit_price") & blank("currency"), "invalid_currency", "ERROR"),
            _problem(F.col("state").isNull(), "invalid_status", "ERROR"),
            _problem((F.col("_cmi") != "") & named.isNull(), "unknown_cmi", "ERROR"),
        )
    )
    mismatch = F.when(named.isNotNull(), F.transform(bad_cmi, lambda _: F.struct(F.lit("cmi_mismatch").alias("rule"), F.lit("ERROR").alias("severity"))))
    inactive = F.when((F.col("_cmi") == "") & mapped_.isNotNull() & ~F.coalesce("mapped_active", F.lit(False)), F.array(F.struct(F.lit("cmi_mismatch").alias("rule"), F.lit("WARNING").alias("severity"))))
    none = F.array().cast("array<struct<rule:string,severity:string>>")
    out = _with_severity(out.withColumn("problems", F.when(F.col("is_empty"), none).otherwise(F.concat(first, F.coalesce(mismatch, inactive, none)))))
    sign = row_signature(F.col("_org"), F.col("_code"), _text("po"), F.col("date"), F.col("qty"), _text("uom"), F.col("cmi"))
    out = out.withColumn("signature", F.when(~F.col("is_empty") & (F.col("severity") != "ERROR"), sign))
    firsts = out.where("signature is not null").groupBy("signature").agg(F.min("row_number").alias("_first"))
    key = F.coalesce("signature", F.concat(F.lit("\0"), F.col("row_number").cast("string")))  # rows without one are in no group
    out = out.withColumn("_key", key).join(firsts.withColumnRenamed("signature", "_key"), "_key", "left")
    again = F.array(F.struct(F.lit("duplicate_in_file").alias("rule"), F.lit("WARNING").alias("severity")))
    out = out.withColumn("problems", F.when(F.col("row_number") > F.col("_first"), F.concat("problems", again)).otherwise(F.col("problems")))
    return _with_severity(out).drop("_first", "_key", "_org", "_code", "_cmi", "_sup", "mapped_cmi", "mapped_active", "named_cmi", "named_active")


def procurement_analysis(checked: DataFrame) -> DataFrame:
    """(counter, n): rows by severity, empty rows, and problems by rule."""
    rows = checked.select(F.when(F.col("is_empty"), "empty").otherwise(F.lower("severity")).alias("counter"))
    rules = checked.select(F.explode("problems").alias("p")).select(F.col("p.rule").alias("counter"))
    total = checked.select(F.lit("total").alias("counter"))
    return total.unionByName(rows).unionByName(rules).groupBy("counter").agg(F.count("*").alias("n"))


def executed_procurement(checked: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Adds outcome: error, duplicate (in the file, or of a signature in ``seen``) or imported; empty rows are left out."""
    key = F.coalesce("signature", F.concat(F.lit("\0"), F.col("row_number").cast("string")))  # rows without one are in no group
    rows = checked.where("not is_empty").withColumn("_key", key)
    if seen is None:
        rows = rows.withColumn("_seen", F.lit(False))
    else:
        rows = rows.join(seen.where("signature is not null").select(F.col("signature").alias("_key")).distinct().withColumn("_seen", F.lit(True)), "_key", "left")
    again = F.exists("problems", lambda p: p["rule"] == "duplicate_in_file") | F.coalesce("_seen", F.lit(False))
    return rows.withColumn("outcome", F.when(F.col("signature").isNull(), "error").when(again, "duplicate").otherwise("imported")).drop("_key", "_seen")


def insert_problems(records: DataFrame, materials: DataFrame, suppliers: DataFrame, cmis: DataFrame) -> DataFrame:
    """records: (id, org_id, material_id, supplier_id, cmi). Adds ``problem``: the first rule that a single new record breaks, or null.

    A record belongs to its material's organization and names that material's active cmi, or none where it has none.
    """
    own = materials.select("material_id", F.col("org_id").alias("_owner"), F.col("cmi").alias("_mapped"))
    known = cmis.select("cmi", F.col("active").alias("_active"))
    live = cmis.where("active").select(F.col("cmi").alias("_mapped"), F.lit(True).alias("_live"))
    out = records.join(own, "material_id", "left").join(known, "cmi", "left").join(live, "_mapped", "left").join(suppliers.select("supplier_id", F.lit(True).alias("_sold")), "supplier_id", "left")
    mapped_ = F.when(F.col("_live"), F.col("_mapped"))
    problem = (
        F.when(F.col("_owner").isNull(), "unknown_material")
        .when(F.col("org_id") != F.col("_owner"), "organization_mismatch")
        .when(F.col("cmi").isNotNull() & F.col("_active").isNull(), "unknown_cmi")
        .when(F.col("cmi").isNotNull() & ~F.col("_active"), "inactive_cmi")
        .when(~F.col("cmi").eqNullSafe(mapped_), "cmi_mismatch")
        .when(F.col("_sold").isNull(), "unknown_supplier")
    )
    return out.withColumn("problem", problem).select(*records.columns, "problem")
