"""Text intelligence as column expressions: normalization, classification, attributes, quality, assemblies.

Everything stays in built-in functions, so whole projections run inside the JVM without Python workers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelink.functions import vocabulary as V

ATTRIBUTE = "struct<attribute_name:string,value:string,normalized_value:string,unit:string,is_critical:boolean>"


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(value: Column) -> Column:
    """The value as a column that later filters and projections read; without this they compute it anew in each place that names it."""
    return F.explode(F.array(value))


def once_each(rows: DataFrame, keys: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``derive`` adds to ``keys``, worked out once for each distinct value and joined back.

    Both sides are spread over the session's cores first, as a table of short texts may be a single file.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    made = derive(rows.select(*keys).distinct().repartition(tasks, *keys)).withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return rows.repartition(tasks, *rows.columns).join(made, same).drop(*[f"_key_{k}" for k in keys])


def round_half_up(x: Column) -> Column:
    """Rounding of non-negative scores: floor(x + 0.5)."""
    return F.floor(x + 0.5).cast("int")


def attach_units(text: Column) -> Column:
    """75KW -> 75 KW."""
    return F.regexp_replace(text, V.GLUED_UNIT, "$1 $2")


def canonical_value(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(value), r"\s+", " "))


def normalize(text: Column) -> Column:
    """Upper case, split units, punctuation to spaces (compact codes kept whole), known tokens expanded."""
    kept = F.regexp_replace(F.regexp_replace(attach_units(F.upper(F.coalesce(text, F.lit("")))), r"(?<=\d)-(?=\d)", "\u0001"), r"(?<=\d)X(?=\d)", "\u0002")
    tokens = F.filter(F.split(F.regexp_replace(kept, "[^A-Z0-9#\u0001\u0002]+", " "), " "), lambda t: t != "")
    restored = F.transform(tokens, lambda t: F.translate(t, "\u0001\u0002", "-X"))
    return F.array_join(F.transform(restored, lambda t: F.coalesce(F.try_element_at(literal_map(V.UNITS), t), F.try_element_at(literal_map(V.ABBREVIATIONS), t), t)), " ")


def tokens_of(normalized: Column) -> Column:
    return F.filter(F.split(normalized, r"\s+"), lambda t: t != "")


def canonical_unit(token: Column) -> Column:
    return F.try_element_at(literal_map(V.UNITS), F.regexp_replace(F.upper(token), "[^A-Z#]", ""))


def parse_quantity(raw: Column) -> Column:
    """struct(value, unit) of a clean quantity, else null."""
    text, pattern = F.trim(F.upper(raw)), r"^(\d+(?:\.\d+)?)\s*([A-Z#]{1,6})?$"
    unit = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("value"), canonical_unit(unit).alias("unit")))


def keyword_hits(tokens: Column, category: str) -> Column:
    def hit(rule: str):
        if len(rule) <= 3:
            return lambda t: t.contains(rule)
        return lambda t: (t == rule) | (t == rule + "S")

    return sum((F.size(F.filter(tokens, hit(rule))) for rule in V.KEYWORDS[category]), F.lit(0))


def classify(tokens: Column) -> Column:
    """struct(category, confidence): the category with most keyword hits, ties by name."""
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-keyword_hits(tokens, c)).alias("less"), F.lit(c).alias("category")) for c in V.KEYWORDS]), lambda x: x["less"] < 0))
    total = lambda r: F.aggregate(r, F.lit(0), lambda s, x: s - x["less"])
    best = lambda r: F.get(r, F.lit(0))
    return bound(ranked, lambda r: F.struct(best(r)["category"].alias("category"), F.when(F.size(r) > 0, round_half_up(-best(r)["less"] * 100 / total(r))).alias("confidence")))


def subcategory(category: Column, tokens: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, rules in V.SUBCATEGORIES.items():
        for match, label in reversed(rules):
            out = F.when((category == name) & F.exists(tokens, lambda t: t.contains(match)), label).otherwise(out)  # noqa: B023
    return out


def _first(tokens: Column, test) -> Column:
    return F.get(F.filter(tokens, test), F.lit(0))


def _attribute(name: str, value: Column, normalized: Column | None = None, unit: Column | None = None, critical: bool = False) -> Column:
    fields = F.struct(
        F.lit(name).alias("attribute_name"), value.alias("value"), (canonical_value(value) if normalized is None else normalized).alias("normalized_value"),
        (F.lit(None).cast("string") if unit is None else unit.cast("string")).alias("unit"), F.lit(critical).alias("is_critical"),
    )
    return F.when(value.isNotNull(), fields)


def _choice(name: str, *ways: tuple[Column, str, str]) -> Column:
    """The first way (condition, value, normalized value) that holds."""
    value = normalized = F.lit(None).cast("string")
    for condition, v, n in reversed(ways):
        value, normalized = F.when(condition, v).otherwise(value), F.when(condition, n).otherwise(normalized)
    return _attribute(name, value, normalized)


def _quantities(tokens: Column) -> Column:
    """struct(value, unit) of each number that a known unit follows."""
    pairs = F.transform(tokens, lambda t, i: F.struct(F.when(t.rlike(r"^\d+(?:\.\d+)?$"), t).alias("value"), canonical_unit(F.get(tokens, i + 1)).alias("unit")))
    return F.filter(pairs, lambda p: p["value"].isNotNull() & p["unit"].isNotNull())


def _measure(name: str, quantities: Column, units: list[str], critical: bool = False) -> Column:
    q = _first(quantities, lambda p: p["unit"].isin(units))
    return _attribute(name, F.concat(q["value"], F.lit(" "), q["unit"]), q["value"], q["unit"], critical)


def _bearing(t: Column, has, maker: Column) -> list[Column]:
    six = F.exists(t, lambda x: x.rlike(r"^6\d{3}(-|$)"))
    series = _first(t, lambda x: x.rlike(r"^6\d{3}$|^6\d{3}-.+$"))
    number, suffix = F.regexp_extract(series, r"^(6\d{3})", 1), F.regexp_extract(series, r"^6\d{3}-(.+)$", 1)
    size = F.substring(number, 3, 2)
    special = literal_map({"00": "10", "01": "12", "02": "15", "03": "17"})
    bore = F.when(series.isNotNull(), F.coalesce(F.try_element_at(special, size), (size.cast("int") * 5).cast("string")))
    seal = F.coalesce(F.when(suffix.isin(V.SEALS), suffix), _first(t, lambda x: x.isin(V.SEALS)))
    deep = ("DEEP GROOVE BALL", "DEEP_GROOVE_BALL")
    kind = _choice(
        "bearing_type", (has("DEEP") & has("GROOVE"), *deep), (has("TAPER"), "TAPER ROLLER", "TAPER_ROLLER"), (has("CYLINDRICAL"), "CYLINDRICAL ROLLER", "CYLINDRICAL_ROLLER"),
        (has("SPHERICAL"), "SPHERICAL ROLLER", "SPHERICAL_ROLLER"), (has("BALL") & ~six, "BALL", "BALL"), (six, *deep),
    )
    return [
        maker, kind, _attribute("series", F.when(series.isNotNull(), number)), _attribute("bore_diameter", bore, unit=F.lit("MM"), critical=True),
        _attribute("seal_type", seal, critical=True), _attribute("internal_clearance", _first(t, lambda x: x.rlike("^C[0-5]$"))),
    ]


def _motor(t: Column, has, maker: Column) -> list[Column]:
    q = _quantities(t)
    return [
        maker, _choice("phase", (has("THREE_PHASE"), "3", "THREE"), (has("SINGLE_PHASE"), "1", "SINGLE")),
        _choice("motor_type", (has("INDUCTION"), "INDUCTION", "INDUCTION"), (has("SYNCHRONOUS"), "SYNCHRONOUS", "SYNCHRONOUS")),
        _measure("power_rating", q, ["KW", "HP", "W"], True), _measure("voltage_rating", q, ["V"], True), _measure("frequency", q, ["HZ"]), _measure("current_rating", q, ["A"]), _measure("speed", q, ["RPM"]),
        _attribute("mounting", _first(t, lambda x: x.rlike(r"^B\d{1,2}$|^V\d$"))), _attribute("protection_rating", _first(t, lambda x: x.rlike(r"^IP\d{2}[A-Z]?$"))),
    ]


def _pump(t: Column, has, maker: Column) -> list[Column]:
    q, pattern = _quantities(t), r"^(\d{1,2})X(\d{1,2})(?:-(\d{1,3}))?$"
    size = _first(t, lambda x: x.rlike(pattern))
    part = lambda k: F.nullif(F.regexp_extract(size, pattern, k), F.lit(""))
    inches = lambda k: F.concat(part(k), F.lit(" IN"))
    return [
        maker, _choice("pump_type", *[(has(x), x, x) for x in ("CENTRIFUGAL", "SUBMERSIBLE", "MONOBLOCK")]),
        _attribute("suction_size", inches(1), part(1), F.lit("IN"), True), _attribute("discharge_size", inches(2), part(2), F.lit("IN"), True), _attribute("stage_count", part(3)),
        _measure("pressure_rating", q, ["BAR", "PSI"], True), _measure("power_rating", q, ["KW", "HP"], True),
        _choice("casing_material", (has("CAST") & has("IRON"), "CAST IRON", "CAST_IRON"), (has("STAINLESS") & has("STEEL"), "STAINLESS STEEL", "STAINLESS_STEEL")),
    ]


def _valve(t: Column, has, maker: Column) -> list[Column]:
    return [
        maker, _choice("valve_type", *[(has(x), x, x) for x in V.VALVE_TYPES]), _measure("nominal_size", _quantities(t), ["IN", "MM"], True),
        _attribute("pressure_class", _first(t, lambda x: x.rlike(r"^\d{2,4}#$|^PN\d{1,3}$|^ANSI\d{2,4}$|^CLASS\d{2,4}$")), critical=True),
        _attribute("end_connection", _first(t, lambda x: x.isin(V.CONNECTIONS))),
        _choice("body_material", (has("CAST") & has("IRON"), "CAST IRON", "CAST_IRON"), (has("STAINLESS") & has("STEEL"), "STAINLESS STEEL", "STAINLESS_STEEL"), (has("WCB"), "WCB", "WCB")),
    ]


def _fastener(t: Column, has, maker: Column) -> list[Column]:
    kind, pattern = _first(t, lambda x: x.isin(V.FASTENERS)), r"^M(\d{1,3})(?:X(\d{1,3}))?$"
    thread = _first(t, lambda x: x.rlike(pattern))
    part = lambda k: F.nullif(F.regexp_extract(thread, pattern, k), F.lit(""))
    grade = F.coalesce(*[_first(t, lambda x: x.rlike(p)) for p in ("^SS(304|316)$", r"^A[24]-\d{2}$", r"^\d{1,2}\.\d$")])  # noqa: B023
    return [
        _attribute("fastener_type", F.when(has("HEX") & (kind == "BOLT"), "HEX_BOLT").otherwise(kind)), _attribute("thread_specification", thread),
        _attribute("diameter", part(1), unit=F.lit("MM"), critical=True), _attribute("length", part(2), unit=F.lit("MM"), critical=True), _attribute("material_grade", grade),
    ]


def extract_attributes(category: Column, tokens: Column) -> Column:
    """The attributes of a tokenized description, in the order of the category's rules."""
    has = lambda word: F.array_contains(tokens, word)
    maker = _attribute("manufacturer", _first(tokens, lambda t: t.isin(V.MANUFACTURERS)))
    out = F.array().cast(f"array<{ATTRIBUTE}>")
    for name, rules in {"Bearings": _bearing, "Motors": _motor, "Pumps": _pump, "Valves": _valve, "Fasteners": _fastener}.items():
        out = F.when(category == name, F.array_compact(F.array(*rules(tokens, has, maker))).cast(f"array<{ATTRIBUTE}>")).otherwise(out)
    return out


def quality(original: Column, normalized: Column, category: Column, attributes: Column) -> Column:
    """struct(status, failed): the verdict and the names of failed checks."""
    present = lambda name: F.exists(attributes, lambda a: a["attribute_name"] == name)
    missing = F.lit(False)
    for name, expected in V.EXPECTED.items():
        missing = F.when(category == name, ~(present(expected[0]) & present(expected[1]))).otherwise(missing)
    glued = r"^(\d+(?:\.\d+)?)([A-Z]{1,6})$"
    odd = F.exists(tokens_of(normalized), lambda t: t.rlike(glued) & ~t.isin(V.SEALS) & canonical_unit(F.regexp_extract(t, glued, 2)).isNull())
    letters, upper = F.length(F.regexp_replace(original, "[^A-Za-z]", "")), F.length(F.regexp_replace(original, "[^A-Z]", ""))
    untidy = ((letters >= 8) & (upper * 2 < letters)) | original.rlike(r"\.{3,}|!{2,}|\?{2,}")
    failures = {
        "description_present": F.length(F.trim(F.coalesce(original, F.lit("")))) < 3,
        "normalized_description": F.coalesce(normalized, F.lit("")) == "",
        "category_classified": category.isNull(),
        "attributes_extracted": F.size(attributes) == 0,
        "critical_attributes_present": category.isNull() | missing,
        "units_recognised": odd,
        "formatting_sane": F.coalesce(untidy, F.lit(False)),
    }
    failed = F.array_compact(F.array(*[F.when(c, n) for n, c in failures.items()]))
    status = (
        F.when(failures["description_present"] | failures["normalized_description"], "invalid")
        .when(failures["units_recognised"] | failures["formatting_sane"], "warning")
        .when(failures["category_classified"] | failures["critical_attributes_present"], "incomplete")
        .otherwise("good")
    )
    return F.struct(status.alias("status"), failed.alias("failed"))


def assembly(description: Column) -> Column:
    """struct(status, components) of kits, assemblies, sets and WITH <component>."""
    text, names = F.upper(F.coalesce(description, F.lit(""))), "|".join(V.COMPONENTS)
    pattern = rf"\bWITH\s+((?:{names})(?:\s+(?:AND|\+|&)\s+(?:{names}))?)S?\b"
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda m: F.split(m, r"\s+(?:AND|\+|&)\s+")))
    components = F.array_distinct(F.filter(F.transform(found, F.trim), lambda c: c != ""))
    status = (
        F.when(text.rlike(r"\bCOMPLETE\s+SETS?\b|\bSET\s+OF\b"), "complete_set")
        .when(text.rlike(r"\bKITS?\b"), "kit")
        .when(text.rlike(r"\bASSEMBL(?:Y|IES)\b"), "assembly")
        .when(F.size(components) > 0, "with_component")
        .otherwise("standalone")
    )
    return F.struct(status.alias("status"), components.alias("components"))


def assembly_label(signal: Column) -> Column:
    joined = F.coalesce(F.nullif(F.array_join(signal["components"], " + "), F.lit("")), F.lit("component"))
    labels = {"standalone": "Standalone", "kit": "Kit", "assembly": "Assembly", "complete_set": "Complete set"}
    return F.when(signal["status"] == "with_component", F.concat(F.lit("With "), joined)).otherwise(F.try_element_at(literal_map(labels), signal["status"]))


def same_assembly(a: Column, b: Column) -> Column:
    return (a["status"] == b["status"]) & (F.array_sort(a["components"]) == F.array_sort(b["components"]))


def describe(df, text: str = "description"):
    """The whole text pipeline over a description column: normalized .. assembly columns added."""
    df = df.withColumn("normalized", settled(normalize(F.col(text))))
    df = df.withColumn("tokens", settled(tokens_of(F.col("normalized"))))
    df = df.withColumn("class", settled(classify(F.col("tokens"))))
    df = df.withColumns({"category": F.col("class.category"), "confidence": F.col("class.confidence")}).drop("class")
    df = df.withColumn("subcategory", subcategory(F.col("category"), F.col("tokens"))).withColumn("attributes", settled(extract_attributes(F.col("category"), F.col("tokens"))))
    verdict = quality(F.col(text), F.col("normalized"), F.col("category"), F.col("attributes"))
    return df.withColumns({"quality": verdict, "assembly": assembly(F.col(text))})


def _derived(texts: DataFrame) -> DataFrame:
    """What ``reprocessed`` finds from a description and the category that its record has (``_category``)."""
    rows = texts.withColumn("normalized", settled(normalize(F.col("description"))))
    rows = rows.withColumn("tokens", settled(tokens_of(F.col("normalized"))))
    rows = rows.withColumn("category", settled(F.coalesce("_category", classify(F.col("tokens"))["category"])))
    rows = rows.withColumn("extracted", settled(extract_attributes(F.col("category"), F.col("tokens"))))
    return rows.withColumns({"subcategory": subcategory(F.col("category"), F.col("tokens")), "quality": quality(F.col("description"), F.col("normalized"), F.col("category"), F.col("extracted"))})


def reprocessed(df):
    """Materials (material_id, description, category, subcategory, manufacturer, manual attributes as ``manual``) with their derived columns made anew.

    A category that a record has stays over the keyword rules; what the rules do not find stays as it was; manual attributes
    replace extracted ones of their name.
    """
    rows = once_each(df.withColumnsRenamed({"category": "_category", "subcategory": "_subcategory", "manufacturer": "_manufacturer"}), ["description", "_category"], _derived)
    maker = F.get(F.filter("extracted", lambda a: a["attribute_name"] == "manufacturer"), F.lit(0))["value"]
    rows = rows.withColumns({"subcategory": F.coalesce("subcategory", "_subcategory"), "manufacturer": F.coalesce(maker, "_manufacturer")}).drop("_category", "_subcategory", "_manufacturer")
    manual = F.coalesce("manual", F.array().cast(f"array<{ATTRIBUTE}>"))
    free = F.filter("extracted", lambda a: ~F.exists(manual, lambda m: m["attribute_name"] == a["attribute_name"]))
    return rows.withColumn("attributes", F.concat(free, manual)).drop("extracted", "manual")
